"""Stages keep columns and clean documents and take effect; the whole run equals a brute-force version, stage by stage."""

import zlib

import numpy as np
from test_duplicates import _leaks_by_definition, expected, spans_by_definition
from test_packing import _library

import corpus_pipeline
from tidepool.llm import quality_bayes
from tidepool.llm.common import HASHES, materialize
from tidepool.llm.doc_stats import stats_of

SF = "/root/testdata/sf0.001"


def quality_by_definition(rows, labels, model):
    """(id, site) -> posterior, of rows (id, host, path, text)."""
    logit = model.logit(np.array([stats_of(t, HASHES)[1] for _, _, _, t in rows]))
    p = 1 / (1 + np.exp(-logit))
    e = np.array([labels.get(i, x) for (i, _, _, _), x in zip(rows, p, strict=True)])
    rate = e.mean()

    def strength(groups, parents):
        n, s = (np.array([g[k] for g in groups], float) for k in (0, 1))
        parents = np.array(parents)
        m = (parents * (1 - parents)).mean()
        between = ((n * (s / n - parents) ** 2).sum() - (len(n) - 1) * m) / max(n.sum() - (n * n).sum() / n.sum(), 1e-9)
        return float(np.clip(m / max(between, 1e-12) - 1, 1.0, 1e6)) if len(n) > 1 else 100.0

    sums: dict = {}
    for (_, host, path, _), x in zip(rows, e, strict=True):
        for key in ((host,), (host, path)):
            n, s = sums.get(key, (0, 0.0))
            sums[key] = (n + 1, s + x)
    hosts = {k: v for k, v in sums.items() if len(k) == 1}
    paths = {k: v for k, v in sums.items() if len(k) == 2}
    k_host = strength(list(hosts.values()), [rate] * len(hosts))
    host_rate = {k[0]: (s + k_host * rate) / (n + k_host) for k, (n, s) in hosts.items()}
    k_path = strength(list(paths.values()), [host_rate[k[0]] for k in paths])
    clipped = lambda q: np.log(np.clip(q, 1e-4, 1 - 1e-4) / (1 - np.clip(q, 1e-4, 1 - 1e-4)))
    out = []
    for (i, host, path, _), x, own in zip(rows, e, p, strict=True):
        # As if the document weren't there, on every level.
        without = [(h, q, y) for (j, h, q, _), y in zip(rows, e, strict=True) if j != i]
        others = np.mean([y for *_, y in without])
        near = [y for h, _, y in without if h == host]
        near = (sum(near) + k_host * others) / (len(near) + k_host)
        same = [y for h, q, y in without if (h, q) == (host, path)]
        site = (sum(same) + k_path * near) / (len(same) + k_path)
        out.append((i, site, 1 / (1 + np.exp(-(clipped(own) + clipped(site) - clipped(others))))))
    return out


def test_posteriors_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_bayes.fit(docs, labels)
    got = sorted((r.doc_id, r.site_rate, r.posterior, r.kept) for r in quality_bayes.quality_bayes(docs, labels, model, docs.source, docs.lang).collect())
    rows = sorted((r.doc_id, r.source, r.lang, r.text) for r in docs.collect())
    want = quality_by_definition(rows, {r.doc_id: float(r.quality) for r in labels.collect()}, model)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1:3] for g in got], [w[1:] for w in want], atol=1e-9) and all(g[3] == (w[2] >= 0.5) for g, w in zip(got, want, strict=True))


def test_a_label_says_nothing_of_its_own_site(spark):
    docs = spark.createDataFrame([(i, f"word{i} and the rest of a sentence. " * (5 + i), f"h{i if i < 3 else 9}", "p") for i in range(30)], "doc_id long, text string, source string, lang string")
    labels = lambda y: spark.createDataFrame([(0, y), *((i, i % 2) for i in range(5, 25))], "doc_id long, quality int")
    model = quality_bayes.fit(docs, labels(1))
    rates = [quality_bayes.quality_bayes(docs, labels(y), model, docs.source, docs.lang).filter("doc_id = 0").first().site_rate for y in (0, 1)]
    assert abs(rates[0] - rates[1]) < 0.02, "but for the strength of the prior, which all documents set"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), name)
        if name == "packed_sequences":
            assert {r.doc_id for r in out.collect()} == set(before)
            break
        assert out.columns == columns
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before)
        if name == "quality_classifier":
            gone = set(before) - set(after)
            assert gone and all(labels.get(i, 0) == 0 for i in gone) and sum(labels.get(i) == 0 for i in after) <= 1
        if name == "near_duplicates":
            assert len(set(after.values())) == len(after) < len(before)
        before, docs = after, out


def test_stages_on_odd_rows(spark):
    """Null ids and texts, repeated rows, an empty and a very long text, extra columns with clashing names; and no rows at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = [tuple(r) for r in docs.orderBy("doc_id").limit(25).collect()]
    good = max((r for r in some), key=lambda r: len(r[1]))
    odd = [(None, good[1] + " null id", "en", "src1", 5), (9001, None, "en", "src1", None), (9002, "", None, None, 0), (9003, good[1] + " again and again", "en", "src2", 9), (9003, good[1] + " again and again", "en", "src2", 9), (9004, (good[1] + "\n") * 60, "fr", None, 1)]
    frame = spark.createDataFrame([*some, *odd], docs.schema).selectExpr("*", "'a' as score", "1 as kept", "doc_id as component_id", "'x' as digest", "2 as start", "array(1) as _spans")
    here, none, columns = frame, frame.limit(0), frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        here, none = materialize(stage(spark, here, SF), name), materialize(stage(spark, none, SF), name)
        assert here.columns == none.columns == columns and none.count() == 0, name
        rows = here.collect()
        assert sum(r.doc_id is None for r in rows) == 1, name
        assert sum(r.doc_id == 9003 for r in rows) in (0, 2), "repeated rows share one verdict"
        assert all(r.score == "a" and r.kept == 1 and r.start == 2 for r in rows), name
    name, stage = corpus_pipeline.STAGES[-1]
    packed = stage(spark, here, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in here.collect()} and stage(spark, none, SF).count() == 0


def test_run_equals_brute_force(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = sorted((r.doc_id, r.source, r.lang, r.text) for r in docs.collect())
    model = quality_bayes.fit(docs, labels)
    kept = {i for i, _, p in quality_by_definition(rows, {r.doc_id: float(r.quality) for r in labels.collect()}, model) if p >= 0.5}
    texts = [(i, t) for i, _, _, t in rows if i in kept]
    first = {i for i, _, c in expected(texts, 5, 80) if i == c}
    texts = [(i, t) for i, t in texts if i in first]
    cut = dict(texts)
    for i, start, stop, _ in sorted(spans_by_definition(texts), reverse=True):
        cut[i] = cut[i][:start] + cut[i][stop:]
    ids = sorted(cut)
    leaked = {ids[d] for d, _ in _leaks_by_definition([cut[i] for i in ids], [(r.item_id, r.text) for r in items.collect()])}
    tokens = _library()
    want = set()
    for i in ids:
        if i in leaked:
            continue
        own = [*tokens.encode(cut[i] or "", add_special_tokens=False).ids, 2]
        k = -(-len(own) // 1024)
        cuts = [0, *range(len(own) - (k - 1) * 1024, len(own) + 1, 1024)]
        want |= {(i, j, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes())) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert len(ids) < len(rows) and all(0 < r.offset + r.length <= 1024 for r in got)
    used = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= 1.02 * -(-used // 1024) + 1
