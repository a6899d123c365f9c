"""Texts into chunk rows. Packing sentences is sequential within a document, so it runs in Arrow batches of whole documents, without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepool.functions import blocks
from tidepool.functions.text import protected_sentences

CHUNK = "doc_id long, chunk_index int, content string, tokens int"
_END = re.compile(r"(?<=[.!?])\s+")


def count_tokens(text: str) -> int:
    return len(text) // 4


def split_sentences(text: str) -> list[str]:
    return [s.strip() for s in _END.split(text) if s.strip()]


def pack(sentences: list[str], size: int, overlap: int) -> list[str]:
    """Whole sentences up to ``size`` tokens; the next chunk starts with the longest run of last sentences within ``overlap`` tokens."""
    out: list[str] = []
    held: list[str] = []
    held_tokens = 0
    for s in sentences:
        n = count_tokens(s)
        if held and held_tokens + n > size:
            out.append(" ".join(held))
            kept, total = [], 0
            for x in reversed(held):
                if total + count_tokens(x) > overlap:
                    break
                kept.insert(0, x)
                total += count_tokens(x)
            held, held_tokens = kept, total
        held.append(s)
        held_tokens += n
    if held:
        out.append(" ".join(held))
    return out


def tail_words(words: list[str], room: int) -> list[str]:
    """The last words that fit ``room`` tokens, each counted with a blank."""
    kept, total = 0, 0
    while kept < len(words) and total + count_tokens(words[-kept - 1] + " ") <= room:
        kept += 1
        total += count_tokens(words[-kept] + " ")
    return words[len(words) - kept :]


def split_long(sentence: str, size: int, overlap: int) -> list[str]:
    """Pieces of words of at most ``size`` tokens, each starting with the last words of the one before, up to ``overlap`` tokens."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for w in sentence.split():
        n = count_tokens(w + " ")
        if held and total + n > size:
            out.append(" ".join(held))
            held = tail_words(held, overlap)
            total = sum(count_tokens(x + " ") for x in held)
        held.append(w)
        total += n
    return [*out, " ".join(held)] if held else out


def standard_chunks(text: str, size: int = 400, overlap: int = 80) -> list[str]:
    return pack(split_sentences(text), size, overlap)


def tail_sentences(held: list[str], overlap: int, least: int = 20) -> list[str]:
    """The last sentences that fit ``overlap`` tokens, and the last words of the one before them if over ``least`` tokens are left."""
    kept, room = len(held), overlap
    while kept and count_tokens(held[kept - 1]) <= room:
        kept -= 1
        room -= count_tokens(held[kept])
    part = tail_words(held[kept - 1].split(), room) if kept and room > least else []
    return [*([" ".join(part)] if part else []), *held[kept:]]


def semantic_chunks(sentences: list[str], size: int = 400, overlap: int = 80, least: int = 50) -> list[str]:
    """Sentences packed up to ``size`` tokens with overlaps of whole and partial sentences; a sentence over ``size`` is split by words on its
    own; chunks of ``least`` characters or fewer go."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for s in sentences:
        n = count_tokens(s)
        if held and (n > size or total + n > size):
            out.append(" ".join(held))
            held = [] if n > size else tail_sentences(held, overlap)
            total = sum(map(count_tokens, held))
        if n > size:
            out += split_long(s, size, overlap)
        else:
            held.append(s)
            total += n
    chunks = [*out, " ".join(held)] if held else out
    return [c.strip() for c in chunks if len(c.strip()) > least]


def chunk(docs: DataFrame, strategy: str = "standard", size: int = 400, overlap: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunk rows by strategy: 'semantic' (protected sentences, found by column functions), 'hierarchical' (``tree_chunks``), others
    mean 'standard'. Null and empty texts have no chunks."""
    if strategy == "hierarchical":
        return tree_chunks(docs, size, overlap, id_col, text_col).select("doc_id", "chunk_index", "content", "tokens")
    semantic = strategy == "semantic"
    pieces = protected_sentences(F.col(text_col)) if semantic else F.array(F.col(text_col))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            split = lambda p: semantic_chunks(list(p), size, overlap) if semantic else standard_chunks(p[0] or "", size, overlap)
            rows = [(d, i, c, count_tokens(c)) for d, p in zip(pdf["doc_id"], pdf["pieces"], strict=True) for i, c in enumerate(split(p) if p is not None else [])]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "content", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), pieces.alias("pieces")).mapInPandas(run, CHUNK)


def lines(docs: DataFrame, text: Column) -> DataFrame:
    """(doc_id, line_no, line)."""
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def header_sections(docs: DataFrame, text: Column) -> DataFrame:
    """(doc_id, section, level, title, body): markdown sections; text before the first header is left out, empty sections are kept."""
    pattern = r"^(#{1,6})\s+(.+)$"
    rows = lines(docs, text).withColumn("is_head", F.col("line").rlike(pattern))
    rows = rows.withColumn("section", F.sum(F.col("is_head").cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    head = F.when(F.col("is_head"), F.col("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    out = rows.filter("section > 0").groupBy("doc_id", "section").agg(F.max(head).alias("head"), F.trim(body).alias("body"))
    return out.select("doc_id", "section", F.length(F.regexp_extract("head", pattern, 1)).alias("level"), F.trim(F.regexp_extract("head", pattern, 2)).alias("title"), "body")


def numbered_sections(docs: DataFrame, text: Column) -> DataFrame:
    """(doc_id, line_no, number, level, title) of lines such as '2.1. Title'."""
    pattern = r"^(\d+(?:\.\d+)*)\.\s+(.+)$"
    rows = lines(docs, text).filter(F.col("line").rlike(pattern))
    number = F.regexp_extract("line", pattern, 1)
    return rows.select("doc_id", "line_no", number.alias("number"), F.size(F.split(number, r"\.")).alias("level"), F.regexp_extract("line", pattern, 2).alias("title"))


def paragraphs(docs: DataFrame, text: Column, least: int = 100) -> DataFrame:
    """(doc_id, pos, title, content) of paragraphs of more than ``least`` characters; the title is the first sentence, cut to 50."""
    rows = docs.select("doc_id", F.posexplode(F.split(text, r"\n\s*\n")).alias("pos", "raw")).withColumn("content", F.trim("raw")).filter(F.length("content") > least)
    return rows.select("doc_id", "pos", F.substring(F.element_at(F.split("content", r"[.!?]"), 1), 1, 50).alias("title"), "content")


def code_blocks(docs: DataFrame, text: Column) -> DataFrame:
    """(doc_id, pos, language, code) of fenced blocks; no language means 'text'."""
    return docs.select("doc_id", F.posexplode(blocks.code(text)).alias("pos", "x")).select("doc_id", "pos", "x.language", "x.code")


def parents(sections: DataFrame) -> DataFrame:
    """Adds parent: the last earlier section of the document with a smaller level.

    A document's sections come together once, as an array in order; a fold over it carries the open section of each of the six levels.
    """
    levels = range(1, 7)
    own = F.array_sort(F.collect_list(F.struct("section", "level")))

    def step(acc, x):
        smaller = F.array_max(F.filter(acc["open"], lambda o, i: (i + 1 < x["level"]) & o.isNotNull()))
        opened = F.transform(acc["open"], lambda o, i: F.when(i + 1 == x["level"], x["section"]).when(i + 1 < x["level"], o))
        return F.struct(opened.alias("open"), F.concat(acc["out"], F.array(F.struct(x["section"].alias("section"), smaller.alias("parent")))).alias("out"))

    kind = dict(sections.dtypes)["section"]
    start = F.struct(F.array(*(F.lit(None).cast(kind) for _ in levels)).alias("open"), F.array().cast(f"array<struct<section:{kind},parent:{kind}>>").alias("out"))
    found = sections.groupBy("doc_id").agg(F.aggregate(own, start, step)["out"].alias("p")).select("doc_id", F.inline("p"))
    return sections.join(found, ["doc_id", "section"], "left").select(*sections.columns, "parent")


def groups_of(chunks: DataFrame, n: int = 4, each: int = 100, most: int = 300) -> DataFrame:
    """(doc_id, group, n_chunks, preview): every ``n`` chunks under a parent, with the starts of their contents."""
    rows = chunks.withColumn("group", F.floor(F.col("chunk_index") / n).cast("int"))
    starts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", F.substring("content", 1, each).alias("c")))), lambda x: x["c"])
    return rows.groupBy("doc_id", "group").agg(F.count("*").alias("n_chunks"), F.substring(F.array_join(starts, " "), 1, most).alias("preview"))


def siblings(chunks: DataFrame, node: list[str]) -> DataFrame:
    """(chunk, sibling): one row for each other chunk of the same node. ``chunks``: chunk and the columns of ``node``.

    The pairs are the result, so nodes are expected to be sections of a document; nothing is gathered into one row.
    """
    own = chunks.select(*node, "chunk")
    return own.join(own.withColumnRenamed("chunk", "sibling"), node).filter("chunk <> sibling").select("chunk", "sibling")


def children(sections: DataFrame) -> DataFrame:
    """(doc_id, section, children): the sections right under each one that has any, in order. ``sections``: doc_id, section, parent."""
    return sections.filter(F.col("parent").isNotNull()).groupBy("doc_id", F.col("parent").alias("section")).agg(F.sort_array(F.collect_list("section")).alias("own")).select("doc_id", "section", F.col("own").alias("children"))


LEVEL_CHUNK = "doc_id long, chunk_index int, chunk_id string, parent_id string, level int, kind string, title string, content string, tokens int"
_HEADER = re.compile(r"^(#{1,6})\s+(.+)$", re.M)
_NUMBER = re.compile(r"^(\d+(?:\.\d+)*)\.\s+(.+)$", re.M)


def find_sections(text: str, least: int = 100) -> list[tuple[int, str, str]]:
    """(level, title, body): by markdown headers, else by numbered headings, else by paragraphs of more than ``least`` characters."""
    for pattern, level in ((_HEADER, lambda m: len(m[1])), (_NUMBER, lambda m: m[1].count(".") + 1)):
        found = list(pattern.finditer(text))
        if found:
            ends = [m.start() for m in found[1:]] + [len(text)]
            return [(level(m), m[2].strip(), text[m.end() : e].strip()) for m, e in zip(found, ends, strict=True)]
    blocks = [p.strip() for p in re.split(r"\n\s*\n", text) if len(p.strip()) > least]
    return [(1, re.split(r"[.!?]", p)[0][:50], p) for p in blocks]


def level_rows(doc_id: object, text: str, size: int = 400) -> list[tuple]:
    """A header chunk for each section, under the last earlier section of a smaller level, and part chunks of its sentences.

    A section that fits stays with its header. A part starts with the last two sentences of the one before (all, if it had no more).
    Texts without sections are packed by the semantic chunker, in groups of four under a parent.
    """
    rows: list[tuple] = []

    def add(name: str, parent: str | None, level: int, kind: str, title: str, content: str) -> str:
        rows.append((doc_id, len(rows), name, parent, level, kind, title, content, count_tokens(content)))
        return name

    open_: list[tuple[int, str]] = []
    sections = find_sections(text)
    for i, (level, title, body) in enumerate(sections):
        while open_ and open_[-1][0] >= level:
            open_.pop()
        parent = open_[-1][1] if open_ else None
        whole = f"{title}\n{body}".strip()
        fits = count_tokens(whole) <= size
        name = add(f"{doc_id}_chunk_{i}", parent, level, "section" if fits else "header", title, whole if fits else title)
        open_.append((level, name))
        if fits:
            continue
        held, fresh, part = [], 0, 0
        for s in split_sentences(body):
            if fresh and count_tokens(" ".join([*held, s])) > size:
                add(f"{name}_part_{part}", name, level + 1, "part", title, " ".join(held))
                held, fresh, part = held[-2:], 0, part + 1
            held.append(s)
            fresh += 1
        if fresh:
            add(f"{name}_part_{part}", name, level + 1, "part", title, " ".join(held))
    if not sections:
        chunks = semantic_chunks(split_sentences(" ".join(text.split())), size)
        for g in range(0, len(chunks), 4):
            parent = add(f"{doc_id}_group_{g // 4}", None, 0, "group", "", " ".join(c[:100] for c in chunks[g : g + 4])[:300])
            for j, c in enumerate(chunks[g : g + 4]):
                add(f"{doc_id}_chunk_{g + j}", parent, 1, "text", "", c)
    return rows


def level_chunks(docs: DataFrame, size: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``level_rows`` of every document, in batches, without a shuffle."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [r for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for r in level_rows(d, t or "", size)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEVEL_CHUNK.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, LEVEL_CHUNK)


def tables(docs: DataFrame, text: Column) -> DataFrame:
    """(doc_id, pos, content) of pipe tables."""
    return docs.select("doc_id", F.posexplode(blocks.tables(text)).alias("pos", "content"))


def summary(text: Column, most: int = 300) -> Column:
    """The first paragraph, cut to ``most`` characters and '...' if longer."""
    first = F.element_at(F.split(text, "\n\n"), 1)
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most), F.lit("..."))).otherwise(first)


TREE_CHUNK = "doc_id long, chunk_index int, kind string, node string, parent string, level int, title string, content string, tokens int"


def _cut(text: str, most: int) -> str:
    first = text.split("\n\n")[0]
    return first[:most] + "..." if len(first) > most else first


def _paragraph_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs packed up to ``size`` tokens; the next chunk starts with the last ``overlap`` words of the one before."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for p in (x.strip() for x in text.split("\n\n")):
        if not p:
            continue
        n = count_tokens(p)
        if held and total + n > size:
            out.append("\n\n".join(held))
            held = [" ".join(out[-1].split()[-overlap:])] if overlap else []
            total = count_tokens(" ".join([*held, p])) - n
        held.append(p)
        total += n
    return [*out, "\n\n".join(held)] if held else out


def tree_rows(doc_id: object, title: str, text: str, size: int = 800, overlap: int = 100, depth: int = 4, least: int = 100) -> list[tuple]:
    """Chunks along the tree of markdown sections, in document order: a summary of the document, then for each section a summary if it has
    over ``least`` tokens, its code blocks, its tables, and its paragraphs packed. Sections below ``depth`` levels go; a second section
    of one title under one parent stands for the first's node. Nodes are paths of section numbers: '' is the document."""
    rows: list[tuple] = []

    def add(kind: str, node: str, parent: str | None, level: int, name: str, content: str, counted: str | None = None) -> None:
        rows.append((doc_id, len(rows), kind, node, parent, level, name, content, count_tokens(content if counted is None else counted)))

    add("summary", "", None, 0, title, f"# {title}\n\n{_cut(text, 200)}")
    found: list[tuple[int, str, list[str]]] = []
    for line in text.split("\n"):
        m = _HEADER.match(line)
        if m:
            found.append((len(m[1]), m[2], []))
        elif found:
            found[-1][2].append(line)
    sections = [(level, name, "\n".join(body).strip()) for level, name, body in found] or [(1, "Main Content", text)]
    open_: list[tuple[int, str, int]] = []  # markdown level, node, place in the tree
    nodes: dict[tuple[str, str], str] = {}
    dropped = 0  # markdown level of a section too deep, under which all goes
    for i, (level, name, body) in enumerate(sections):
        if dropped and level > dropped:
            continue
        dropped = 0
        while open_ and open_[-1][0] >= level:
            open_.pop()
        parent, place = (open_[-1][1], open_[-1][2] + 1) if open_ else ("", 1)
        if place > depth:
            dropped = level
            continue
        node = nodes.setdefault((parent, name), f"{parent}/{i}")
        open_.append((level, node, place))
        if count_tokens(body) > least:
            add("section", node, parent, place, name, f"## {name}\n\n{_cut(body, 300)}")
        for _, _, language, code in blocks.code_spans(body):
            add("code", node, node, place, name, f"```{language or 'text'}\n{code.strip()}\n```", code.strip())
        for table in blocks.table_texts(body):
            add("table", node, node, place, name, table)
        for c in _paragraph_chunks(blocks.plain_text(body), size, overlap):
            add("hierarchical", node, node, place, name, c)
    return rows


def tree_chunks(docs: DataFrame, size: int = 800, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text", title: Column | None = None) -> DataFrame:
    """``tree_rows`` of every document, in batches, without a shuffle. Null and empty texts have no chunks."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [r for d, t, x in zip(pdf["doc_id"], pdf["title"], pdf["text"], strict=True) if x for r in tree_rows(d, t or "", x, size, overlap)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TREE_CHUNK.split(", ")])

    name = title if title is not None else F.lit("")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), name.alias("title"), F.col(text_col).alias("text")).mapInPandas(run, TREE_CHUNK)
