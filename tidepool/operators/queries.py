"""Understanding of query texts: kind, complexity, concepts, expansion, variations, decomposition, strategy. ``q`` is a string column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidepool import values
from tidepool.functions.scoring import contains_any, count_contained, words

KINDS = [("factual", values.FACTUAL), ("analytical", values.ANALYTICAL), ("comparative", values.COMPARATIVE), ("navigational", values.NAVIGATIONAL), ("multi_hop", values.MULTI_HOP)]


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, wherever it stands in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exploratory(q: Column) -> Column:
    return F.when(F.endswith(q, F.lit("?")) & (F.size(words(q)) > 10), 2).otherwise(0)


def _scores(low: Column, q: Column) -> Column:
    """How many marks of each kind are in the query, in the order of KINDS, exploratory last."""
    return F.array(*(count_contained(low, marks) for _, marks in KINDS), exploratory(q))


def _kind(scores: Column) -> Column:
    return F.element_at(F.array(*(F.lit(name) for name, _ in KINDS), F.lit("exploratory")), F.array_position(scores, F.array_max(scores)).cast("int"))


def _complexity(q: Column, low: Column, scores: Column) -> Column:
    marks = F.aggregate(scores, F.lit(0), lambda a, x: a + x)
    stops = F.length(q) - F.length(F.regexp_replace(q, "[,;]", ""))
    joined = (low.contains("and") & low.contains("or")).cast("int")
    return F.least(F.lit(1.0), (F.size(words(q)) / 30 + stops / 5 + marks / 10 + joined) / 4)


def kind(q: Column) -> Column:
    """The kind with most of its marks in the query; the first of equals; factual if there are none."""
    return let(_scores(F.lower(q), q), _kind)


def complexity(q: Column) -> Column:
    """Mean of four signs, at most 1: words / 30, commas and semicolons / 5, marks of all kinds / 10, whether both "and" and "or" occur."""
    return let(F.lower(q), lambda low: let(_scores(low, q), lambda s: _complexity(q, low, s)))


def concepts(q: Column, most: int = 10) -> Column:
    stop = F.array(*map(F.lit, values.STOP_WORDS))
    return F.slice(F.array_distinct(F.filter(words(q), lambda w: ~F.array_contains(stop, w) & (F.length(w) > 2))), 1, most)


def _expanded(low: Column, own: Column) -> Column:
    entry = F.array(*(F.struct(F.lit(k).alias("term"), F.array(*map(F.lit, v)).alias("synonyms")) for k, v in values.SYNONYMS.items()))
    near = lambda e, c: F.contains(e["term"], c) | F.contains(c, e["term"])

    def both(direct: Column) -> Column:
        unknown = F.filter(own, lambda c: ~F.exists(direct, lambda d: d["term"] == c))
        partial = F.transform(unknown, lambda c: F.struct(c.alias("term"), F.get(F.filter(entry, lambda e: near(e, c)), F.lit(0))["synonyms"].alias("synonyms")))
        return F.concat(direct, F.filter(partial, lambda x: x["synonyms"].isNotNull()))

    return let(F.filter(entry, lambda e: F.contains(low, e["term"]) | F.array_contains(own, e["term"])), both)


def expanded(q: Column) -> Column:
    """Array of (term, synonyms): dictionary terms inside the query, then its concepts that contain a term or lie in one, by the first such term."""
    return let(F.lower(q), lambda low: let(concepts(q), lambda own: _expanded(low, own)))


def parts(q: Column, most: int = 5) -> Column:
    """The query cut at conjunctions and punctuation, each part made a question."""
    pieces = F.slice(F.filter(F.transform(F.split(q, r"\s+(?:and|then|but|or)\s+|[,;?]"), lambda p: F.trim(p)), lambda p: p != ""), 1, most)
    asks = lambda p: reduce(lambda a, b: a | b, (F.startswith(p, F.lit(w)) for w in ("what", "when", "where", "who", "why", "how")))
    return F.transform(pieces, lambda p: F.when(asks(p), F.concat(p, F.lit("?"))).otherwise(F.concat(F.lit("What about "), p, F.lit("?"))))


def depends_on_previous(part: Column) -> Column:
    return contains_any(F.lower(part), values.BACK_REFERENCES)


def needs_decomposition(q: Column) -> Column:
    """At least two of: and, then, before or after between spaces, several question marks, several commas, over 15 words."""
    low = F.lower(q)
    count = lambda mark: F.length(q) - F.length(F.replace(q, F.lit(mark), F.lit("")))
    signs = [low.contains(f" {w} ") for w in ("and", "then", "before", "after")] + [count("?") > 1, count(",") > 1, F.size(words(q)) > 15]
    return reduce(lambda a, b: a + b, (s.cast("int") for s in signs)) >= 2


def _sub_queries(q: Column, complex_: Column) -> Column:
    return F.when((complex_ > 0.5) | needs_decomposition(q), parts(q)).otherwise(F.array(q))


def sub_queries(q: Column) -> Column:
    """The parts of a complex query; others are their own only part."""
    return _sub_queries(q, complexity(q))


def _variations(q: Column, low: Column, terms: Column, most: int = 7) -> Column:
    replaced = F.flatten(F.transform(terms, lambda e: F.transform(F.slice(e["synonyms"], 1, 2), lambda s: F.replace(low, e["term"], s))))
    base = F.substring(q, F.lit(1), F.length(q) - 1)
    asked = F.array(F.concat(F.lit("Can you explain "), base, F.lit("?")), F.concat(F.lit("Tell me about "), base), F.concat(F.lit("What do you know about "), base, F.lit("?")), F.concat(F.lit("Show me information on "), base))

    def with_asked(first: Column) -> Column:
        more = let(F.transform(first, lambda v: F.lower(v)), lambda known: F.filter(asked, lambda v: ~F.array_contains(known, F.lower(v))))
        return F.slice(F.when(F.endswith(q, F.lit("?")), F.concat(first, more)).otherwise(first), 1, most)

    return let(F.array_distinct(F.concat(F.array(q), F.filter(replaced, lambda v: v != low))), with_asked)


def variations(q: Column, most: int = 7) -> Column:
    """The query, its lower-case text with a term replaced by either of its first two synonyms, then four ways to ask it if it is a question."""
    return let(F.lower(q), lambda low: let(expanded(q), lambda terms: _variations(q, low, terms, most)))


def reasoning_path(subs: Column) -> Column:
    """How the parts build on each other, as text: those that refer to nothing first, then each that refers back with the part before it."""
    back = lambda s, i: (i > 0) & depends_on_previous(s)
    roots = F.concat(F.lit("Start with: "), F.array_join(F.filter(subs, lambda s, i: ~back(s, i)), ", "))
    then = F.transform(subs, lambda s, i: F.when(back(s, i), F.concat(F.lit("Then use results from ("), F.get(subs, i - 1), F.lit(") to answer: "), s)))
    return F.when(F.size(subs) > 0, F.array_join(F.concat(F.array(roots), F.filter(then, lambda x: x.isNotNull())), " \u2192 "))


def enhanced(q: Column) -> Column:
    """Struct of kind, complexity, sub_queries, concepts, expanded, variations and reasoning_path (for multi-hop queries and those of over two parts)."""

    def whole(x: Column) -> Column:
        low, own = x["low"], x["own"]

        def with_kind(k: Column) -> Column:
            def with_parts(y: Column) -> Column:
                path = F.when((k["kind"] == "multi_hop") | (F.size(y["subs"]) > 2), reasoning_path(y["subs"]))
                return F.struct(
                    k["kind"].alias("kind"), k["complexity"].alias("complexity"), y["subs"].alias("sub_queries"), own.alias("concepts"), y["terms"].alias("expanded"), _variations(q, low, y["terms"]).alias("variations"), path.alias("reasoning_path")
                )

            return let(F.struct(_sub_queries(q, k["complexity"]).alias("subs"), _expanded(low, own).alias("terms")), with_parts)

        return let(let(_scores(low, q), lambda s: F.struct(_kind(s).alias("kind"), _complexity(q, low, s).alias("complexity"))), with_kind)

    return let(F.struct(F.lower(q).alias("low"), concepts(q).alias("own")), whole)


def needs_multi_hop(q: Column) -> Column:
    return (kind(q) == "multi_hop") | contains_any(F.lower(q), values.HOP_WORDS)


def component_weights(kind_: Column) -> Column:
    """Weights of a query's original text, parts, variations and expansions; parts count more in multi-hop queries, expansions less in navigational ones."""
    return F.struct(
        F.lit(1.0).alias("original"), F.when(kind_ == "multi_hop", 1.0).otherwise(0.8).alias("sub_queries"), F.lit(0.6).alias("variations"), F.when(kind_ == "navigational", 0.2).otherwise(0.4).alias("expanded")
    )


def vector_weight(q: Column, default: float = 0.7) -> Column:
    """Weight of vector results that suits the wording of the query; graph results get the rest."""
    low = F.lower(q)
    (first, w), *rest = values.ADAPTIVE
    return reduce(lambda c, x: c.when(contains_any(low, x[0]), x[1]), rest, F.when(contains_any(low, first), w)).otherwise(default)


def weight_recommendation(kind_: Column) -> Column:
    """Struct of weight and reason by the kind of query."""
    pair = lambda x: F.struct(F.lit(x[0]).alias("weight"), F.lit(x[1]).alias("reason"))
    (first, x), *rest = values.RECOMMENDED.items()
    return reduce(lambda c, r: c.when(kind_ == r[0], pair(r[1])), rest, F.when(kind_ == first, pair(x))).otherwise(pair(values.RECOMMENDED_ELSE))


def combined_answers(parts_: DataFrame, results: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, text): each part that has results as a heading over its first ``most`` results. ``parts_``: query_id, pos, part; ``results``: query_id, pos, rank, content."""
    best = results.filter(F.col("rank") <= most).groupBy("query_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n").alias("body"))
    rows = parts_.join(best, ["query_id", "pos"]).select("query_id", "pos", F.concat(F.lit("\n## "), "part", F.lit("\n\n"), "body").alias("block"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n").alias("text"))


def strategy(q: Column, threshold: float = 0.5) -> Column:
    """vector, graph or hybrid, by which of two word lists the query has more of; near ties are hybrid, and so are queries with too small a part of the words of both lists."""
    known = max(0.1 * (len(values.CONCEPTUAL) + len(values.SPECIFIC)), 1.0)

    def decide(x: Column) -> Column:
        conceptual, specific = x["conceptual"], x["specific"]
        return F.when(F.greatest(conceptual, specific) / known < threshold, "hybrid").when(specific - conceptual > 2, "vector").when(conceptual - specific > 2, "graph").otherwise("hybrid")

    counts = lambda low, n: F.struct(
        (count_contained(low, values.CONCEPTUAL) + F.when(n < 5, 1).otherwise(0)).alias("conceptual"), (count_contained(low, values.SPECIFIC) + F.when(n > 10, 2).otherwise(0)).alias("specific")
    )
    return let(F.lower(q), lambda low: let(counts(low, F.size(words(q))), decide))


def _ascii(q: Column) -> Column:
    """Other alphabets' letters and digits as _, their white space as a blank and the rest as a dot: word boundaries are then those of ASCII, and capitals keep their places."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(q, r"[\p{Z}\x{85}]", " "), r"[^\x00-\x7F\p{L}\p{N}]", "."), r"[^\x00-\x7F]", "_")


def entities(q: Column) -> Column:
    """Capitalised runs, acronyms and camel case, quoted texts, known technical words; each once, whatever its case."""
    words_ = let(_ascii(q), lambda t: F.concat(F.regexp_extract_all(t, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), 1), F.regexp_extract_all(t, F.lit(r"\b([A-Z]{2,}|[a-z]+[A-Z][a-zA-Z]*)\b"), 1)))
    known = let(F.lower(q), lambda low: F.filter(F.array(*map(F.lit, values.TECH_KEYWORDS)), lambda k: F.contains(low, k)))
    found = F.concat(words_, F.regexp_extract_all(q, F.lit('"([^"]+)"'), 1), known)
    return let(found, lambda f: let(F.transform(f, lambda x: F.lower(x)), lambda low: F.filter(f, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))
