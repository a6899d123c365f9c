"""Importance resampling and the source audit against plain Python, on rows with every odd case."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidepool.llm import resampling, source_audit
from tidepool.llm.common import merged_vector, word_pieces

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rows():
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "gamma9", "été", "日本", "ÀB", "x y", "o'clock", "42", "the"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60)), p=np.arange(1, 11) / 55)), ["en", "fr", None, ""][int(rng.integers(4))], ["a", "b", "é", None, "z"][int(rng.integers(5))]) for i in range(160)]
    rows += [(200, None, "en", "a"), (201, "", "de", "only"), (202, "the " * 5000 + "\x00end", "en", "hot"), (None, "the the " * 20, "en", "b"), (5, rows[5][1], rows[5][2], rows[5][3])]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, rank string, weight int")


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_its_definition(spark, longest):
    rows, target = _rows(), ["the 42 the", None, "Alpha beta alpha", "日本"]
    got = resampling.resample(_frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), percent=30, longest=longest)

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        return len(w), Counter(" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))

    def buckets(texts):
        out = np.zeros(10_000)
        for t in texts:
            for f, n in features(t)[1].items():
                out[zlib.crc32(f.encode()) % 10_000] += n
        return out

    s, t = buckets(r[1] for r in rows), buckets(target)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t, strict=True)]
    want = []
    for i, text, *_ in rows:
        n, f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10_000] * k for x, k in f.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    able = sorted((r for r in want if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    drawn = Counter((*r[:4], k + 1) for k, r in enumerate(able[: len(able) * 30 // 100]))
    drawn += Counter((*r[:4], None) for r in able[len(able) * 30 // 100 :]) + Counter((*r[:4], None) for r in want if not r[4])
    assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == drawn
    assert [k for _, k in got.dtypes] == ["bigint"] * 5


def test_resampling_of_nothing(spark):
    docs = _frame(spark, _rows())
    assert resampling.resample(docs.limit(0), docs).count() == 0
    assert resampling.resample(docs, docs.limit(0)).count() == docs.count()


def test_long_texts_are_read_in_pieces():
    text = "Ab é " * 1000 + "tail"
    assert [w for piece in word_pieces(text, resampling._WORDS, 64) for w in piece] == text.lower().encode().split()
    assert list(word_pieces(None, resampling._WORDS)) == []
    known = resampling.Buckets(97, limit=3)
    whole, pieces = list(resampling.Buckets(97).of(text, 3)), [zlib.crc32(f) % 97 for f in _runs(text.lower().encode().split(), 3)]
    assert sorted(np.concatenate(whole)) == sorted(pieces)
    assert sorted(np.concatenate(list(known.of(text, 3)))) == sorted(pieces), "a cache that overflows gives the same"


def _runs(words, longest):
    return [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def test_vectors_add_up_in_a_tree(spark):
    rows = spark.range(0, 500, 1, 90).selectExpr("cast('' as binary) v").rdd.map(lambda _: (bytearray(np.arange(4).tobytes()),)).toDF("v binary")
    assert list(merged_vector(rows, 4)) == [0, 500, 1000, 1500]


def audit_by_definition(rows, least_docs, top):
    """The definition on plain dictionaries: every group times every kept term, zeros included."""
    docs, n, groups = defaultdict(int), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW)))
        n[lang, source] += terms
        for t in terms:
            docs[lang, t] += 1
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), k in docs.items() if x == lang and k >= least_docs]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, x.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, x) in enumerate(found)]
    return out


@pytest.mark.parametrize(("least", "top"), [(1, 2), (12, 50), (10_000, 50)])
def test_audit_equals_its_definition(spark, least, top):
    rows = _rows()
    got = source_audit.audit_sources(_frame(spark, rows), least_docs=least, top=top)
    assert Counter(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == Counter(audit_by_definition(rows, least, top))
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_audit_of_nothing_and_of_small_shards_and_blocks(spark):
    docs = _frame(spark, _rows())
    assert source_audit.audit_sources(docs.limit(0)).count() == 0
    counts = source_audit.term_counts(docs, block=7).groupBy("lang", "source", "term").sum("n", "docs")
    assert sorted(map(str, counts.collect())) == sorted(map(str, source_audit.term_counts(docs).groupBy("lang", "source", "term").sum("n", "docs").collect()))


def test_joint_histograms_hold_every_kept_term_once(spark):
    kept = spark.createDataFrame([("l", s, f"t{i}", 1 + i % 3) for s in "abc" for i in range(40) if (i + ord(s)) % 4], "lang string, source string, term string, n long")
    groups = spark.createDataFrame([("l", s, 30, 40) for s in "abc"] + [("l", "none", 0, 40)], "lang string, source string, own long, terms long")
    cells = source_audit.joint_histograms(kept, groups, shard_rows=9).collect()
    n = {s: {f"t{i}": 1 + i % 3 for i in range(40) if (i + ord(s)) % 4} for s in "abc"} | {"none": {}}
    for a, b in [("a", "b"), ("a", "c"), ("b", "c"), ("a", "none")]:
        want = Counter((n[a].get(f"t{i}", 0), n[b].get(f"t{i}", 0)) for i in range(40))
        assert {(r.ca, r.cb): r.m for r in cells if (r.a, r.b) == (a, b)} == dict(want)
