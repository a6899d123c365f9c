"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of measure become typed placeholders; several of one kind in a row are one slot ("Anna Maria", "twenty five").
What is left of a text is its template. A benchmark item is tiled with template windows of ``k`` tokens, and documents' windows meet
them in a hash join. So that few rows travel, documents first drop the windows whose hash misses a bitmap of the tiles' hashes (a fixed
size; it can only let too much through). Matched tiles of an item that lie on one diagonal of a document are compared slot by slot.
Slots that play one role in the item must mostly have one value in the document: a name stands for one person wherever it occurs, a
number for one quantity of what follows it ("2 apples" and "2 pears" are two roles), a unit for one unit. Different roles may take equal
values. In the roles that occur twice or more, at least ``agree`` of the slots must have their role's commonest value; otherwise the
diagonal is coincidence. An item leaks into a document if at least ``share`` of its tiles match: 'exact' if all do, with equal values;
'partial' if some do, with equal values; 'reparameterised' if values differ.

Defined cases: null and empty texts and items match nothing; items with fewer than ``least`` template words that are not placeholders are
matched by their words as they are, and those with fewer than ``least`` words of any kind can't be told from chance and are skipped;
items shorter than ``k`` tokens are one window of their own length; very long texts are read whole; repeated rows and items give one
result per pair of ids; rows with a null id never match; extra columns pass through. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidepool.llm.common import Bitmap, alone, bitmap_of, materialize, windows, without

# Units of measure and number words.
UNITS = {
    "%", "percent", "g", "kg", "mg", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "lb", "lbs", "oz", "ounce", "ounces", "ton", "tons", "m", "cm", "mm", "km", "meter", "meters", "metre", "metres",
    "mile", "miles", "foot", "feet", "ft", "inch", "inches", "yard", "yards", "second", "seconds", "sec", "minute", "minutes", "min", "hour", "hours", "h", "day", "days", "week", "weeks", "month", "months", "year",
    "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "l", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons", "mph", "kmh", "degree", "degrees", "celsius", "fahrenheit",
}
NUMBER_WORDS = {
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty",
    "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million",
}
# Words that begin sentences and are no names.
FUNCTION_WORDS = {
    "a", "an", "the", "this", "that", "these", "those", "it", "its", "he", "she", "they", "we", "you", "i", "his", "her", "their", "our", "my", "your", "if", "when", "while", "after", "before", "since", "because", "as",
    "and", "or", "but", "so", "then", "there", "here", "what", "which", "who", "whom", "whose", "where", "why", "how", "is", "are", "was", "were", "do", "does", "did", "has", "have", "had", "can", "could", "will",
    "would", "should", "may", "might", "must", "in", "on", "at", "by", "for", "from", "of", "to", "with", "without", "about", "into", "each", "every", "all", "some", "any", "no", "not", "find", "calculate", "let", "given",
}
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "%") + "“”‘’«»…–—·"
NUM, NAME, UNIT = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"<num>", b"<name>", b"<unit>"))
_UNIT_HASHES = np.sort(np.array([xxhash.xxh64_intdigest(x.encode()) for x in UNITS], np.uint64))
BITS = 1 << 22


class Canon(dict):
    """A token of the text -> the hash of its canonical form (0: nothing is left of it); emptied at ``limit`` entries."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        word = token.decode("utf-8", "replace").strip(_STRIP)
        low = word.lower()
        if not word:
            value = 0
        elif any(c.isdigit() for c in word) or low in NUMBER_WORDS:
            value = int(NUM)
        elif word[0].isupper() and len(word) > 1 and low not in FUNCTION_WORDS:
            value = int(NAME)
        else:
            value = xxhash.xxh64_intdigest(low.encode("utf-8", "replace"))
        self[token] = value
        return value


_CANON = Canon()


def template_of(text: str | None, canon: Canon) -> tuple[_Tokens, np.ndarray]:
    """The tokens of a text's template (several numbers or names in a row joined into one) and the hashes of their canonical forms."""
    raw = (text or "").encode("utf-8", "replace").split()
    h = np.fromiter(map(canon.__getitem__, raw), np.uint64, len(raw))
    at = np.flatnonzero(h)
    h = h[at]
    after = np.flatnonzero(h[:-1] == NUM) + 1
    if len(after):
        k = np.minimum(np.searchsorted(_UNIT_HASHES, h[after]), len(_UNIT_HASHES) - 1)
        h[after[_UNIT_HASHES[k] == h[after]]] = UNIT
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | ((h[1:] != NUM) & (h[1:] != NAME))
    starts = np.flatnonzero(first)
    stops = np.append(starts[1:], len(h))
    return _Tokens(raw, at, starts, stops), h[starts]


class _Tokens:
    """Template tokens by their number, put together when they are asked for."""

    def __init__(self, raw: list[bytes], at: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        self.raw, self.at, self.starts, self.stops = raw, at, starts, stops

    def __getitem__(self, i: int) -> str:
        return " ".join(plain(self.raw[j]) for j in self.at[self.starts[i] : self.stops[i]])


def plain(token: bytes) -> str:
    return token.decode("utf-8", "replace").strip(_STRIP).lower()


def words_of(text: str | None) -> tuple[list[str], np.ndarray]:
    """The words of a text as they are, and their hashes."""
    words = [w for w in map(plain, (text or "").encode("utf-8", "replace").split()) if w]
    return words, np.array([xxhash.xxh64_intdigest(w.encode(), seed=1) for w in words], np.uint64)


def is_slot(h: np.ndarray) -> np.ndarray:
    return (h == NUM) | (h == NAME) | (h == UNIT)


def slots(tokens: _Tokens, h: np.ndarray, start: int, size: int) -> list[str]:
    """Values of the placeholders of a window, in order."""
    return [tokens[start + int(i)] for i in np.flatnonzero(is_slot(h[start : start + size]))]


def role(tokens: _Tokens, h: np.ndarray, i: int) -> str:
    """What a placeholder stands for in its text: a name or unit for itself, a number for itself and what follows."""
    kind = {int(NUM): "n", int(NAME): "p", int(UNIT): "u"}[int(h[i])]
    return f"{kind}:{tokens[i]}" + (f":{int(h[i + 1])}" if kind == "n" and i + 1 < len(h) else "")


def item_tiles(items: DataFrame, id_col: str, text_col: str, k: int, least: int) -> DataFrame:
    """_item, as_is, size, hash, tile (token offset), n_tiles, item_places, item_slots, item_roles of the windows that tile each item."""
    rows = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_item"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_item"]

    def tiles_of(item: object, text: str | None) -> Iterator[tuple]:
        tokens, h = template_of(text, _CANON)
        as_is = int((~is_slot(h)).sum()) < least
        if as_is:
            _, h = words_of(text)
            if len(h) < least:
                return
        size = min(k, len(h))
        own = windows(h, size)
        starts = [*range(0, len(h) - size, size), len(h) - size]
        telling = starts if as_is else [a for a in starts if (~is_slot(h[a : a + size])).sum() * 2 >= size] or starts
        for a in telling:
            placed = [] if as_is else (a + np.flatnonzero(is_slot(h[a : a + size]))).tolist()
            yield item, as_is, size, int(own[a].astype(np.int64)), a, len(telling), placed, [tokens[i] for i in placed], [role(tokens, h, i) for i in placed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [t for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in tiles_of(item, text)]
            kinds = [batch.schema.field(0).type, pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["_item", "as_is", "size", "hash", "tile", "n_tiles", "item_places", "item_slots", "item_roles"])

    return rows.mapInArrow(run, f"_item {kind}, as_is boolean, size int, hash bigint, tile int, n_tiles int, item_places array<int>, item_slots array<string>, item_roles array<string>")


def document_windows(docs: DataFrame, id_col: str, text_col: str, sizes: list[tuple[bool, int]], bitmap: Bitmap) -> DataFrame:
    """_id, as_is, size, hash, at, doc_slots of the documents' windows whose hash the bitmap has. ``sizes``: (as_is, size) of the items' windows."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]

    def windows_of(text: str | None) -> Iterator[tuple]:
        for as_is in sorted({x for x, _ in sizes}):
            tokens, h = words_of(text) if as_is else template_of(text, _CANON)
            for size in (n for x, n in sizes if x == as_is):
                own = windows(h, size)
                for a in np.flatnonzero(bitmap.at(own & np.uint64(BITS - 1))).tolist():
                    yield as_is, size, int(own[a].astype(np.int64)), a, [] if as_is else slots(tokens, h, a, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(_CANON)
        for batch in batches:
            out = [(i, *w) for i, text in enumerate(batch.column(1)) for w in windows_of(text.as_py())]
            kinds = [pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string())]
            ids = batch.column(0).take(pa.array([x[0] for x in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds, 1))], names=["_id", "as_is", "size", "hash", "at", "doc_slots"])

    return rows.mapInArrow(run, f"_id {kind}, as_is boolean, size int, hash bigint, at int, doc_slots array<string>")


def _agreement(slots_: Column) -> Column:
    """Of the slots whose role occurs twice or more, the share that has its role's commonest value (1 if there are none). ``slots_``: array of (r, d)."""
    own = lambda r: F.transform(F.filter(slots_, lambda x: x["r"] == r), lambda x: x["d"])
    most = lambda v: F.array_max(F.transform(F.array_distinct(v), lambda d: F.size(F.filter(v, lambda w: w == d))))
    repeated = F.filter(F.transform(F.array_distinct(F.transform(slots_, lambda x: x["r"])), own), lambda v: F.size(v) > 1)
    total = lambda f: F.aggregate(repeated, F.lit(0), lambda n, v: n + f(v))
    return F.coalesce(F.try_divide(total(most), total(F.size)), F.lit(1.0))


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 8, least: int = 4, share: float = 0.5, agree: float = 0.6
) -> DataFrame:
    """One row per leak: id, item, n_tiles, n_matched, at (first token of the template, or first word), kind ('exact', 'partial' or 'reparameterised')."""
    tiles = materialize(item_tiles(items, item_col, item_text_col, k, least).distinct(), "tiles")
    sizes = [tuple(r) for r in tiles.select("as_is", "size").distinct().collect()]  # at most 2 k pairs
    bitmap = bitmap_of(tiles, position=F.col("hash").bitwiseAND(F.lit(BITS - 1)), size=BITS)
    hits = document_windows(docs, id_col, text_col, sizes, bitmap)
    matched = hits.join(tiles, ["hash", "size", "as_is"])
    own = F.arrays_zip(F.col("item_places").alias("at"), F.col("item_slots").alias("i"), F.col("item_roles").alias("r"), F.col("doc_slots").alias("d"))
    diagonal = matched.groupBy("_id", "_item", (F.col("at") - F.col("tile")).alias("shift")).agg(F.collect_set("tile").alias("tiles"), F.max("n_tiles").alias("n_tiles"), F.min("at").alias("at"), F.array_distinct(F.flatten(F.collect_list(own))).alias("map"))
    consistent = diagonal.filter(_agreement(F.col("map")) >= agree)
    equal = F.forall("map", lambda x: x["i"] == x["d"])
    found = consistent.groupBy("_id", "_item").agg(F.size(F.array_distinct(F.flatten(F.collect_list("tiles")))).alias("n_matched"), F.max("n_tiles").alias("n_tiles"), F.min("at").alias("at"), F.bool_and(equal).alias("equal"))
    kind = F.when(~F.col("equal"), "reparameterised").when(F.col("n_matched") < F.col("n_tiles"), "partial").otherwise("exact")
    return found.filter(F.col("n_matched") >= share * F.col("n_tiles")).select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "n_tiles", "n_matched", "at", kind.alias("kind"))


def drop_leaks(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents in ``found``, all columns kept; rows with a null id stay."""
    return without(docs, found.select(id_col), [id_col])
