"""Greedy clusters of like names, as a loop over all entities in id order would make them, by rounds over all names at once.

The loop: an entity joins the earliest cluster whose leading name is like its own (likeness 2 M / (m + n) of Ratcliff and Obershelp above a
threshold) but not equal to it; if there is none, it opens or joins the cluster of its own name. The leading names are what a scan finds
that takes a name unless an earlier taken one is like it. That needs no scan: a name all of whose earlier like names are out is in, and a
name with an earlier like name that is in is out; each round decides every name of which that is known.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepool.operators.skew import dealt_join
from tidepool.session import stored


def character_tokens(name: Column) -> Column:
    """A name's characters, each with the number of its occurrence: equal tokens of two names number as many as characters they can match."""
    chars = F.split(name, "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def like_names(names: DataFrame, least: float) -> DataFrame:
    """(u, v, forth, back): names u < v by number whose likeness is above ``least`` either way; forth is that of (v, u), back of (u, v). No pair is lost.

    What two names of m and n characters match is at most what their characters have in common, and must be over least (m + n) / 2. So, in
    one order of the tokens from rare to common, the first tokens of both, up to what may stay unmatched, must meet; a meeting at places i
    and j leaves room for 1 + min(m - i - 1, n - j - 1) matches if it is the first. ``names``: number, name (distinct).
    """
    each = names.select("number", F.length("name").alias("m"), F.explode(character_tokens(F.col("name"))).alias("token"))
    held = each.groupBy("token").agg(F.count("*").alias("df"))
    ordered = dealt_join(each, held, ["token"], F.col("number")).groupBy("number", "m").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    # The shortest like name has m least / (2 - least) characters; fewer matches than that rule a pair out.
    needed = F.floor(F.col("m") * least / (2 - least) + 1e-9).cast("int")
    heads = stored(ordered.select("number", "m", F.posexplode(F.slice("t", F.lit(1), F.greatest(F.col("m") - needed + 1, F.lit(1)))).alias("i", "t")).select("number", "m", "i", "t.token"), "heads")
    a, b = heads.toDF("u", "m", "i", "token"), heads.toDF("v", "n", "j", "token")
    room = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j"))
    pairs = dealt_join(a, b, ["token"], F.col("u")).filter((F.col("u") < F.col("v")) & (2 * room > least * (F.col("m") + F.col("n")) - 1e-9)).select("u", "v").distinct()

    @F.pandas_udf("struct<forth:double,back:double>")
    def likeness(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for p, q in zip(x, y, strict=True):
            match = difflib.SequenceMatcher(None, q, p)
            out.append((match.ratio(), difflib.SequenceMatcher(None, p, q).ratio()) if match.quick_ratio() > least else (0.0, 0.0))
        return pd.DataFrame(out, columns=["forth", "back"])

    side = lambda x, n: names.select(F.col("number").alias(x), F.col("name").alias(n))
    rows = pairs.join(side("u", "p"), "u").join(side("v", "q"), "v").repartition(F.xxhash64("u", "v")).withColumn("r", likeness("p", "q"))
    return rows.select("u", "v", "r.forth", "r.back").filter((F.col("forth") > least) | (F.col("back") > least))


def first_independent(edges: DataFrame, name: str = "taken") -> DataFrame:
    """(v) of ``edges`` (u, v), u < v, that a scan in order would not take: those with an earlier neighbour that it takes. Rounds, each over all edges still open."""
    open_ = stored(edges.select("u", "v").distinct(), name)
    out = open_.select("v").limit(0)
    while open_.limit(1).count():
        waiting = open_.select(F.col("v").alias("u")).distinct()
        new = stored(open_.join(waiting, "u", "left_anti").select("v").distinct(), name)  # u waits for nobody, so it is taken
        out = out.unionByName(new)
        open_ = stored(open_.join(new, "v", "left_anti").join(new.select(F.col("v").alias("u")), "u", "left_anti"), name)
    return out


def greedy_clusters(entities: DataFrame, least: float = 0.8, shortest: int = 4) -> DataFrame:
    """(id, key, leader): each entity's lower-case name and the first id of the name that leads its cluster. Names under ``shortest`` characters are in none. ``entities``: id, name."""
    return _clusters(entities, least, shortest)[0]


def _clusters(entities: DataFrame, least: float, shortest: int) -> tuple[DataFrame, DataFrame]:
    keyed = entities.select("id", F.trim(F.lower("name")).alias("key")).filter(F.length("key") >= shortest)
    names = stored(keyed.groupBy("key").agg(F.min("id").alias("number")).select("number", F.col("key").alias("name")), "names")
    like = stored(like_names(names, least), "like")
    earlier = like.filter(F.col("forth") > least).select("u", "v")
    members = stored(first_independent(earlier), "members")
    own = earlier.join(members, "v").join(members.select(F.col("v").alias("u")), "u", "left_anti").groupBy(F.col("v").alias("number")).agg(F.min("u").alias("leader"))
    led = names.join(own, "number", "left").select("number", F.col("name").alias("key"), F.coalesce("leader", "number").alias("leader"))
    # Likeness depends on the order of the names: a later entity of a leading name may find it in a cluster that opened meanwhile.
    taken = names.join(members, names.number == members.v, "left_anti").select("number")
    later = like.filter(F.col("back") > least).select("u", "v").join(taken.withColumnRenamed("number", "u"), "u").join(taken.withColumnRenamed("number", "v"), "v")
    rows = keyed.join(led, "key")
    moved = rows.select("id", F.col("number").alias("u")).join(later, "u").filter(F.col("v") < F.col("id")).groupBy("id").agg(F.min("v").alias("moved"))
    return rows.join(moved, "id", "left").select("id", "key", F.coalesce("moved", "leader").alias("leader"), "number"), like


def cluster_links(entities: DataFrame, least: float = 0.8, shortest: int = 4, weight: float = 0.8) -> DataFrame:
    """(src, dst, leader, ratio, weight): like names of one cluster that spans several documents, by their first entities, the earlier first.

    Entities of equal names stand behind their first one (``greedy_clusters`` has them all), so a name that very many documents have costs no
    more than another. ``entities``: id, name, document_id.
    """
    rows, like = _clusters(entities, least, shortest)
    rows = stored(rows.join(entities.select("id", "document_id"), "id"), "clustered")
    wide = rows.groupBy("leader").agg(F.min("document_id").alias("lo"), F.max("document_id").alias("hi")).filter("lo < hi").select("leader")
    firsts = rows.withColumn("n", F.row_number().over(Window.partitionBy("leader", "number").orderBy("id"))).filter("n = 1").join(wide, "leader")
    a, b = firsts.select("leader", F.col("number").alias("u"), F.col("id").alias("a")), firsts.select("leader", F.col("number").alias("v"), F.col("id").alias("b"))
    pairs = like.join(a, "u").join(b, ["v", "leader"])
    ratio = F.when(F.col("a") < F.col("b"), F.col("back")).otherwise(F.col("forth"))
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "leader", ratio.alias("ratio")).filter(F.col("ratio") > least).withColumn("weight", F.col("ratio") * weight)
