"""Column functions over text: sentences, counts, names, versions, highlights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tidepool import values
from tidepool.functions.scoring import contains_any


def sentences(text: Column) -> Column:
    """Pieces that end with . ! or ? before white space, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def tokens_by_length(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def tokens_by_words(text: Column) -> Column:
    return word_count(text) * 1.3


def normal_name(name: Column) -> Column:
    """Lower case, letters, digits, spaces and hyphens only, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s-]", ""), r"\s+", " "))


def acronym_pair(a: Column, b: Column) -> Column:
    """Does either name contain an acronym and the other what it stands for?"""
    x, y = F.lower(a), F.lower(b)
    one = lambda p, q: reduce(lambda u, v: u | v, (F.contains(p, F.lit(k)) & F.contains(q, F.lit(v)) for k, v in values.ACRONYMS.items()))
    return one(x, y) | one(y, x)


VERSION = r"^(.+?)[\s\-]*(v?\d+(?:\.\d+)*|\d+)$"


def version_base(name: Column) -> Column:
    """The name without its trailing version, or null if it has none."""
    return F.nullif(F.regexp_extract(F.lower(name), VERSION, 1), F.lit(""))


def relation_between(text: Column) -> Column:
    """Kind of relation that the words between two entities state; RELATES_TO for up to nine words of none, else null."""
    low = F.lower(text)
    first, *rest = values.RELATIONS.items()
    kind = reduce(lambda c, r: c.when(contains_any(low, r[1]), r[0]), rest, F.when(contains_any(low, first[1]), first[0]))
    return kind.otherwise(F.when(word_count(text) < 10, "RELATES_TO"))


def highlights(text: Column, query: Column) -> Column:
    """Up to three of the first five sentences that have a word of the query; long ones cut to ten words."""
    terms = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    pieces = F.filter(F.slice(F.split(text, r"\."), 1, 5), lambda s: F.exists(terms, lambda t: F.contains(F.lower(s), t)))
    split = lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != "")
    return F.slice(F.transform(pieces, lambda s: F.when(F.size(split(s)) > 5, F.concat(F.array_join(F.slice(split(s), 1, 10), " "), F.lit("..."))).otherwise(F.trim(s))), 1, 3)


def snippet(text: Column, limit: int = 36) -> Column:
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.when(F.size(w) > limit, F.concat(F.array_join(F.slice(w, 1, limit), " "), F.lit("..."))).otherwise(F.array_join(w, " "))


def content_id(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 12)


# Abbreviations whose dot does not end a sentence.
ABBREVIATIONS = ["Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "Ph.D", "M.D", "B.A", "M.A", "B.S", "M.S", "i.e", "e.g", "etc", "vs", "Inc", "Ltd", "Co", "Corp"]


def protected_sentences(text: Column) -> Column:
    """Sentences that start with a capital after . ! or ?, not after an abbreviation or inside a URL; blank lines end one as well.

    White space is squeezed, single characters go. A dot is added to what lacks an end, unless it is a heading (under 100 characters,
    no mark inside) that no further paragraph of the same sentence follows.
    """
    dot, shut = "\u0001", "\u0002"
    names = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    marked = F.regexp_replace(F.regexp_replace(text, rf"\b({names})\.\s*", f"$1{dot} "), r"(https?://\S+)", f"$1{shut}")
    pieces = F.split(marked, r"(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?])\s*$")
    plain = lambda x: F.trim(F.regexp_replace(F.translate(x, f"{dot}{shut}", "."), r"\s+", " "))

    def ended(s: Column, more: Column) -> Column:
        heading = (F.length(s) < 100) & ~s.rlike("[.!?]")
        one = F.when(s.rlike(r"""[.!?:;)"'\]}]$""") | heading, s).otherwise(F.concat(s, F.lit(".")))
        return F.when(more & ~one.rlike("[.!?]$"), F.concat(one, F.lit("."))).otherwise(one)

    def of_piece(p: Column) -> Column:
        parts = F.filter(F.transform(F.split(p, "\n\n"), plain), lambda x: F.length(x) > 1)
        return F.transform(parts, lambda x, i: ended(x, i < F.size(parts) - 1))

    return F.flatten(F.transform(pieces, of_piece))


def marked_up(text: Column, query: Column) -> Column:
    """The text with each word of the query (over two letters) wrapped in <mark>, in any case and one word after the other."""
    terms = F.filter(F.split(F.lower(query), " "), lambda w: F.length(w) > 2)
    literal = lambda w: F.concat(F.lit("(?i)("), F.regexp_replace(w, r"([^\p{L}\p{N}])", r"\\$1"), F.lit(")"))
    return F.aggregate(terms, text, lambda t, w: F.regexp_replace(t, literal(w), F.lit("<mark>$1</mark>")))


def suggestions(query: Column) -> Column:
    """Three ways to go on asking, by whether the query has 'how' or 'what'."""
    ends = lambda *tails: F.array(*(F.concat(query, F.lit(x)) for x in tails))
    low = F.lower(query)
    plain = F.array(F.concat(F.lit("How does "), query, F.lit(" work?")), F.concat(F.lit("What is "), query, F.lit("?")), F.concat(F.lit("Explain "), query))
    return F.when(low.contains("how"), ends(" work?", " implemented?", " configured?")).when(low.contains("what"), ends(" is?", " are the benefits?", " are the components?")).otherwise(plain)


def json_of(text: Column) -> Column:
    """The JSON object in a model's reply: from the first brace to the last, fenced or not; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def cut_to(text: Column, most: int) -> Column:
    """The first ``most`` characters, for a caller's external service."""
    return F.substring(text, 1, most)


def text_between(text: Column, a: Column, b: Column) -> Column:
    """What stands between the first occurrences of two names, in either order; '' if one is missing."""
    x, y, low = F.lower(a), F.lower(b), F.lower(text)
    i, j = F.position(x, low), F.position(y, low)
    one = F.substring(low, i + F.length(x), F.greatest(j - i - F.length(x), F.lit(0)))
    two = F.substring(low, j + F.length(y), F.greatest(i - j - F.length(y), F.lit(0)))
    return F.when((i == 0) | (j == 0), "").when(i < j, one).otherwise(two)
