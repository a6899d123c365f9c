"""Dates in texts, decay and life cycles. ``now`` is always an argument, so that results can be repeated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tidepool import values
from tidepool.functions.scoring import contains_any


def decay(age_days: Column, doc_type: Column) -> Column:
    """Weibull survival by document class; timeless classes and unknown ages keep 1, the future counts as age 0."""
    age = F.greatest(age_days.cast("double"), F.lit(0.0))
    curve = lambda k, scale, least: F.greatest(F.lit(least), F.exp(-F.pow(age / scale, F.lit(k))))
    by_class = F.when(doc_type == "project", curve(*values.DECAY["project"])).when(doc_type == "meeting", curve(*values.DECAY["meeting"])).otherwise(curve(*values.DECAY["default"]))
    return F.when(doc_type.isin(values.TIMELESS) | age_days.isNull(), F.lit(1.0)).otherwise(by_class)


def temporal_weight(query: Column) -> Column:
    """How much age counts for a query."""
    q = F.lower(query)
    return F.when(contains_any(q, values.RECENT), 0.5).when(contains_any(q, values.HISTORICAL), 0.1).otherwise(0.3)


def temporal_mix(score: Column, freshness: Column, weight: Column) -> Column:
    return (1 - weight) * score + weight * freshness


def doc_type(path: Column, content: Column) -> Column:
    """Class of a document by words of its path, then of its first 500 characters."""
    p, c = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.substring(F.coalesce(content, F.lit("")), 1, 500))
    rules = [(p, kind, words) for kind, words in values.PATH_TYPES.items()] + [(c, kind, words) for kind, words in values.TEXT_TYPES.items()]
    first, *rest = rules
    return reduce(lambda col, r: col.when(contains_any(r[0], r[2]), r[1]), rest, F.when(contains_any(first[0], first[2]), first[1])).otherwise("default")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_date(text: Column) -> Column:
    """The first of ISO, US and written dates in the text that is a real date; null if none is."""
    month = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    tries = [(r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"), (r"(\d{1,2}/\d{1,2}/\d{4})", "M/d/yyyy"), (rf"({month}[a-z]* \d{{1,2}},? \d{{4}})", "MMMM d, yyyy"), (rf"({month} \d{{1,2}},? \d{{4}})", "MMM d, yyyy")]
    return F.coalesce(*(F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.lit(f))) for p, f in tries))


def lifecycle(created: Column, expires: Column, now: Column) -> Column:
    """expired or active if an end is known, else by age: up to 30 days current, up to 90 recent, then historical."""
    age = F.datediff(now, created)
    return F.when(expires.isNotNull(), F.when(expires < now, "expired").otherwise("active")).when(created.isNull(), None).when(age <= 30, "current").when(age <= 90, "recent").otherwise("historical")


def relevance_window(created: Column, expires: Column, milestone: Column, sprint: Column, now: Column) -> Column:
    """Weight of a document by what is left of its term, its milestone or sprint, or its age."""
    left, age = F.datediff(expires, now), F.datediff(now, created)
    ended = F.when(left < -30, 0.1).when(left < 0, 0.3).when(left < 7, 0.9).otherwise(1.0)
    aged = F.when(age <= 7, 1.0).when(age <= 30, 0.8).when(age <= 90, 0.5).otherwise(0.3)
    return F.when(expires.isNotNull(), ended).when(milestone.isNotNull(), 0.8).when(sprint.isNotNull(), 0.7).when(created.isNotNull(), aged).otherwise(0.5)


def _dated(text: Column, patterns: list[str]) -> Column:
    """The date after the first of the phrases whose first occurrence is followed by one."""
    return F.coalesce(*(_let(F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")), parse_date) for p in patterns))


def temporal_metadata(content: Column, filename: Column, now: Column) -> Column:
    """Struct of created_at, expires_at (timestamps, UTC), sprint, milestone, version and lifecycle_stage that a text and its file's name tell.

    Creation dates are looked for in the first 1,000 characters, sprints and milestones in the first 500, ends anywhere. A sprint without
    a date began two weeks before ``now`` for each sprint before it; a dated milestone is an end; a date in the name is the last resort.
    """
    first = lambda n, p: F.nullif(F.regexp_extract(F.substring(content, 1, n), f"(?i){p}", 1), F.lit(""))
    sprint, milestone = first(500, r"sprint[:\s#]+(\d+)").try_cast("int"), first(500, r"milestone[:\s]+([^\n]+)")
    in_name = lambda p: F.nullif(F.regexp_extract(filename, p, 1), F.lit(""))
    named = F.coalesce(
        F.try_to_timestamp(F.replace(in_name(r"(\d{4}[-_]\d{2}[-_]\d{2})"), F.lit("_"), F.lit("-")), F.lit("yyyy-MM-dd")), F.try_to_timestamp(in_name(r"(\d{8})"), F.lit("yyyyMMdd"))
    )
    began = F.when(sprint.isNotNull(), now - F.make_dt_interval((sprint - 1) * 14))
    created = F.coalesce(_dated(F.substring(content, 1, 1000), values.CREATED).cast("timestamp"), began, named)
    expires = F.coalesce(_dated(content, values.EXPIRES), _let(milestone, parse_date)).cast("timestamp")

    def described(x: Column) -> Column:
        age = (F.unix_seconds(now) - F.unix_seconds(x["created_at"])) / 86400
        stage = F.when(x["expires_at"].isNotNull(), F.when(x["expires_at"] < now, "expired").otherwise("active")).when(age < 30, "current").when(age < 90, "recent").when(age.isNotNull(), "historical")
        version = in_name(r"[_\-\.]v?(\d+(?:\.\d+)*)")
        return F.struct(x["created_at"].alias("created_at"), x["expires_at"].alias("expires_at"), sprint.alias("sprint"), F.trim(milestone).alias("milestone"), version.alias("version"), stage.alias("lifecycle_stage"))

    return _let(F.struct(created.alias("created_at"), expires.alias("expires_at")), described)


def enriched(known: dict[str, Column], content: Column, filename: Column, now: Column) -> Column:
    """``temporal_metadata`` merged over what is known: a known created_at or doc_type stays, the rest is replaced where the text tells it; created_at is ``now`` at last."""
    old = lambda name, kind: known.get(name, F.lit(None)).cast(kind)

    def merged(got: Column) -> Column:
        newer = [F.coalesce(got[c], old(c, k)).alias(c) for c, k in (("expires_at", "timestamp"), ("sprint", "int"), ("milestone", "string"), ("version", "string"), ("lifecycle_stage", "string"))]
        return F.struct(F.coalesce(old("created_at", "timestamp"), got["created_at"], now).alias("created_at"), *newer, F.coalesce(old("doc_type", "string"), doc_type(filename, content)).alias("doc_type"))

    return _let(temporal_metadata(content, filename, now), merged)
