"""Column functions that score: similarity, match scores, boosts, blends. All stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision; 0 if a norm is 0; within [-1, 1]."""
    double = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(double(x), double(y), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(norms, F.lit(0.0)))))


def prefix_cosine(query: Column, other: Column) -> Column:
    """Cosine after the query vector is cut to the other's length."""
    return cosine(F.slice(query, F.lit(1), F.size(other)), other)


def sigmoid(x: Column, steepness: float = 5.0, middle: float = 0.5) -> Column:
    return 1 / (1 + F.exp(-steepness * (x - middle)))


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(n) for n in needles))


def count_contained(text: Column, needles: list[str]) -> Column:
    """How many of the needles occur in the text as substrings."""
    return reduce(lambda a, b: a + b, (text.contains(n).cast("int") for n in needles))


def vector_match(query: Column, content: Column, similarity: Column) -> Column:
    """0 to 100: sigmoid of the similarity, up to 20 for the share of query words in the content, 30 for the whole phrase."""
    terms, low = F.array_distinct(words(query)), F.lower(content)
    hits = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    coverage = F.when(F.size(terms) > 0, hits / F.greatest(F.size(terms), F.lit(1))).otherwise(0.0)
    phrase = F.when(F.contains(low, F.lower(query)), 30.0).otherwise(0.0)
    return F.round(F.least(F.lit(100.0), 100 * sigmoid(similarity) + 20 * coverage + phrase), 1)


def match_quality(score: Column) -> Column:
    cuts = [(90, "Excellent match"), (75, "Strong match"), (60, "Good match"), (40, "Moderate match"), (25, "Weak match")]
    return reduce(lambda c, x: c.when(score >= x[0], x[1]), cuts[1:], F.when(score >= cuts[0][0], cuts[0][1])).otherwise("Poor match")


def match_explanation(score: Column, source: Column, match_type: Column, hops: Column) -> Column:
    hop_text = F.concat(F.lit(" - Related entity ("), hops.cast("string"), F.lit(" hop"), F.when(hops == 1, "").otherwise("s"), F.lit(")"))
    graph = F.when(match_type == "exact", " - Exact entity match").when(match_type == "contains", " - Partial entity match").when(match_type == "traversal", hop_text).otherwise("")
    suffix = F.when(source == "graph", graph).when(source == "vector", " - Semantic similarity").otherwise("")
    return F.concat(match_quality(score), F.lit(" ("), F.format_string("%.1f", score), F.lit("%)"), suffix)


def graph_match(query: Column, entity: Column, match_type: Column, hops: Column, confidence: Column, ratio: Column) -> Column:
    """Score of a graph hit: exact 95; one name inside the other by their lengths; other containment 75; fuzzy by ``ratio``; traversal by hops; else 30.

    Times the confidence, plus up to 15 for words that query and entity share; at most 100.
    """
    q, e = F.lower(query), F.lower(entity)
    share = lambda a, b: F.length(a) / F.greatest(F.length(b), F.lit(1))
    base = (
        F.when(match_type == "exact", 95.0).when(q == e, 95.0)
        .when(F.contains(q, e), 70 + 25 * share(e, q)).when(F.contains(e, q), 60 + 30 * share(q, e))
        .when(match_type == "contains", 75.0).when(match_type == "fuzzy", 85 * ratio)
        .when(match_type == "traversal", F.greatest(F.lit(10.0), 40 - 10.0 * hops)).otherwise(30.0)
    )
    a, b = F.array_distinct(words(query)), F.array_distinct(words(entity))
    overlap = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
    return F.round(F.least(F.lit(100.0), base * confidence + 15 * overlap), 1)


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the word sets of two texts; 0 if either is empty."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def rank_boost(query: Column, content: Column, score: Column) -> Column:
    """1.5 times for the phrase, 1 + 0.3 times the share of query words (over 2 letters) found, 1 + 0.2 for each found as a whole word."""
    low = F.lower(content)
    terms = F.filter(F.array_distinct(words(query)), lambda w: F.length(w) > 2)
    found = F.size(F.filter(terms, lambda w: F.contains(low, w)))
    whole = F.size(F.array_intersect(terms, words(content)))
    boosted = score * F.when(F.contains(low, F.lower(query)), 1.5).otherwise(1.0)
    boosted = boosted * (1 + 0.3 * F.when(F.size(terms) > 0, found / F.greatest(F.size(terms), F.lit(1))).otherwise(0.0))
    return boosted * (1 + 0.2 * whole)


def evaluation_grade(passed: Column, warned: Column, total: Column) -> Column:
    share = (100 * passed + 50 * warned) / (100 * total)
    return F.when(share >= 0.9, "A").when(share >= 0.8, "B").when(share >= 0.7, "C").when(share >= 0.6, "D").otherwise("F")


def hybrid_match(vector: Column, graph: Column, source: Column) -> Column:
    """Score of a row that one or both searches found: its own list's, else the better of both, else 50."""
    both = F.when(vector.isNotNull() & graph.isNotNull(), F.greatest(vector, graph)).otherwise(50.0)
    return F.when((source == "vector") & vector.isNotNull(), vector).when((source == "graph") & graph.isNotNull(), graph).otherwise(both)


def hop_penalty(nodes: Column) -> Column:
    return F.pow(F.lit(0.9), F.size(nodes) - 1)


def path_score(nodes: Column, confidence: Column, coherence: Column) -> Column:
    """0.3 coherence, 0.25 confidence, 0.25 share of distinct nodes, 0.2 hop penalty; unknown coherence counts 0.5."""
    distinct = F.size(F.array_distinct(nodes)) / F.greatest(F.size(nodes), F.lit(1))
    return 0.3 * F.coalesce(coherence, F.lit(0.5)) + 0.25 * confidence + 0.25 * distinct + 0.2 * hop_penalty(nodes)


def relevance(similarity: Column, entity: Column, relation: Column) -> Column:
    """Of an entity and its relation to a query: 0.4 similarity, 0.3 each confidence; without similarity the mean of the confidences."""
    return F.when(similarity.isNull(), (entity + relation) / 2).otherwise(0.4 * similarity + 0.3 * entity + 0.3 * relation)


def rerank_blend(score: Column, logit: Column, weight: float = 0.5) -> Column:
    """A score blended with the sigmoid of a re-ranker's output, which is a hook of the caller's."""
    return (1 - weight) * score + weight * sigmoid(logit, 1.0, 0.0)


def ranking_explanation(match: Column, source: Column, weight: Column, rank: Column) -> Column:
    found = F.when(source == "vector", F.concat(F.lit("Source: Vector Search (weight: "), F.format_string("%.0f%%", 100 * weight), F.lit(")")))
    found = found.when(source == "graph", F.concat(F.lit("Source: Graph Search (weight: "), F.format_string("%.0f%%", 100 * weight), F.lit(")"))).otherwise("Source: Hybrid (found by both)")
    place = F.when(rank > 0, F.concat(F.lit("Rank: #"), rank.cast("string")))
    return F.concat_ws(" | ", F.concat(F.lit("Match Quality: "), F.format_string("%.1f", match), F.lit("%")), found, place)
