"""Substring dedup, Jaccard join and decontamination against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from tidepool.llm import components, decontamination, jaccard_join, substring_dedup
from tidepool.llm.common import HASHES, bitmap_of, salted_join, without


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as _text", "1 as n", "2 as h", "3 as label", "4 as start", "5 as _span_id")


def links_of(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    linked = lambda x, y: x and y and 100 * len(x & y) >= percent * len(x | y)
    return sets, [(a, b) for a in sets for b in sets if a < b and any(linked(x, y) for x in sets[a] for y in sets[b])]


def expected(rows, k, percent):
    sets, links = links_of([r for r in rows if r[0] is not None], k, percent)
    label = {i: i for i in sets}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {(i, len(s), label[i]) for i in sets for s in sets[i]}


def near_copies(seed, groups=12, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, words, 3 * words]))]
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((rng.randrange(10**6), " ".join(w[: len(w) - rng.choice([0, 0, 2])])))
    return rows


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_components_equal_brute_force(spark, seed, k, percent):
    rows = near_copies(seed) + [(-1, None), (-2, ""), (-3, " \n"), (-4, "One two"), (-5, "one TWO"), (-6, "One two"), (-6, "other words stand here now yes"), (-7, "other words stand here now yes"), (-8, "x " * 20000), (-9, "X " * 20000), (None, "one two")]
    got = jaccard_join.jaccard_components(docs_of(spark, rows), k=k, percent=percent, chunk_rows=3).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == expected(rows, k, percent)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_repeated_rows_lose_no_link(spark, copies=2):
    """Many small sets whose shared words have the same ends and counts; an id with two texts of one size, and with an empty one."""
    rng = random.Random(1)
    texts = []
    for g in range(60):
        base = [f"c{rng.randrange(6)}", *(f"g{g}x{rng.randrange(9)}" for _ in range(3)), *(f"v{rng.randrange(30)}" for _ in range(4))]
        texts += [" ".join([*base, f"own{g}"]), " ".join([*base, f"other{g}"])]
    low, high = " ".join(f"{x}{i}" for x, n in (("c", 6), ("v", 30)) for i in range(n)), " ".join(f"{x}{i}" for x, n in (("v", 30), ("c", 6)) for i in range(n)) + " end"
    rows = [(0, low), (10**6, high), *enumerate(texts, 1), (500, "a b c d e f g h"), (500, "i j k l m n o p"), (500, ""), (500, None), (501, "a b c d e f g z"), (502, "i j k l m n o z"), (503, "i j k l m n y p")]
    got = jaccard_join.jaccard_components(docs_of(spark, rows * copies), k=1, percent=75, chunk_rows=8).collect()
    assert len(got) == len(rows) * copies
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == expected(rows, 1, 75)


def test_long_texts_at_the_threshold_link(spark):
    """Texts of more shingles than a tile's signature is made for, at 85 % and just under it, in one batch with short ones."""
    rows = [(1, "a few words only here"), (2, None)]
    for t in (100, 103, 104, 120, 250):
        w = [f"b{t}x{j}" for j in range(20 * t + 3)]
        rows += [(10 * t, " ".join(w)), (10 * t + 1, " ".join(w[: 17 * t + 3])), (10 * t + 2, " ".join(w[-17 * t - 2 :]))]
    got = jaccard_join.jaccard_components(docs_of(spark, rows).coalesce(1), k=4, percent=85).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == expected(rows, 4, 85)


def test_an_empty_text_of_an_id_whose_other_text_is_a_copy(spark):
    rows = [(3, "some words stand here now"), (7, "some words stand here now"), (7, ""), (7, None), (8, ""), (9, "others stand there now and then")]
    got = jaccard_join.jaccard_components(docs_of(spark, rows), k=4, percent=85).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == expected(rows, 4, 85)


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("select id as doc_id, cast(unhex(h) as string) as text from values (1L, 'FF41204220432044'), (2L, 'FF61206220630A64'), (3L, 'FE41204220432044'), (4L, 'EDA0BD') t(id, h)")
    got = jaccard_join.jaccard_components(docs, k=4, percent=85).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 4)}


def test_pairs_of_unlike_sizes_shuffle_no_signatures(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(600 if i % 2 else 1500))) for i in range(400)], "_id long, _text string")
    sigs = jaccard_join.materialize(jaccard_join.described(docs, 1, 85, np.empty(0, np.uint64), np.empty(0, np.int64)), "sets")
    pairs = jaccard_join.materialize(spark.range(160_000).selectExpr("id div 400 as a", "id % 400 as b").filter("a < b and a % 2 <> b % 2"), "pairs")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        start = written()
        assert jaccard_join.verified(pairs, sigs, docs, 1, 85).count() == 0
        assert written() - start < 1_100_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shingles_with_the_same_ends_and_count(spark):
    """5 and 6 share words p, 7 and 8 words q, and 1 and 9 have all of both in their prefixes, as what else they have is commoner."""
    p, q, f, g = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("p", 6), ("q", 6), ("f", 36), ("g", 36)))
    rows = [(1, f"{p} {q} {f}"), (9, f"{p} {q} {g}"), (5, f"{p} a"), (6, f"{p} b"), (7, f"{q} c"), (8, f"{q} d"), *((100 + i, f) for i in range(6)), *((200 + i, g) for i in range(6))]
    got = jaccard_join.jaccard_components(docs_of(spark, rows * 2).coalesce(1), k=1, percent=75).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == expected(rows, 1, 75)


def test_no_documents(spark):
    empty = docs_of(spark, [])
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert substring_dedup.repeated_spans(empty).count() == 0
    assert decontamination.leaks(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_tiles_find_every_pair_across_groups(spark):
    """Every row its own group and tiles of few rows: what tiles let through must hold all links."""
    rows = [(i, t) for i, t in enumerate(dict.fromkeys(t for _, t in near_copies(5)))]
    _, links = links_of(rows, 3, 70)
    sets = {i: jaccard_join.shingles(t, 3, HASHES) for i, t in rows}
    band = {i: int(np.floor(np.log(len(s)) / np.log(100 / 70))) for i, s in sets.items()}
    tiles = []
    for i, s in sets.items():
        for low in (False, True):
            for other in range(3):
                c = i % 3
                tiles.append((0, band[i] + low, min(c, other), max(c, other), low, c, i, len(s), i, jaccard_join.signature(s).tolist()))
    df = spark.createDataFrame(tiles, "h long, tile long, i int, j int, lower boolean, chunk int, _id long, n long, label long, sig array<long>")
    got = {(r.a, r.b) for r in jaccard_join.tile_pairs(df, 70).collect()}
    assert set(links) <= got and len(links) > 10


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(0)
    for n in (1, 10, 700, 5000):
        x, y = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) for _ in range(2))
        y = np.unique(np.concatenate([x[: n // 2], y]))
        a, b = (jaccard_join.signature(v).view(np.uint64)[None, :] for v in (x, y))
        for lanes in {min(a.shape[1], b.shape[1]), 16}:
            assert np.bitwise_count(jaccard_join.folded(a, lanes) ^ jaccard_join.folded(b, lanes)).sum() <= len(np.setxor1d(x, y))
        assert (jaccard_join.folded(a, 16)[0].view(np.int64) == jaccard_join.signature(x, 16)).all()


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
        y = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
        common = np.arange(0, 60, 3).astype(np.uint64)
        if 100 * len(np.intersect1d(x, y)) >= 50 * len(np.union1d(x, y)):
            assert len(np.intersect1d(*(jaccard_join.prefix(s, 50, common, np.arange(len(common))[::-1]) for s in (x, y))))


def test_chains_connect(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60) if i != 30] + [(5, 5)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {i: 0 if i <= 30 else 31 for i in range(61)}


def test_a_hub_connects(spark):
    links = spark.range(1, 3000).selectExpr("0 as a", "id as b").union(spark.createDataFrame([(5000, 5001), (5001, 2000)], "a long, b long"))
    assert components.components(links).groupBy("label").count().collect() == [(0, 3002)]


@pytest.mark.parametrize("few", [0, 1000])
def test_rows_without_keys(spark, few):
    rows = spark.createDataFrame([(i % 50 if i % 7 else None, str(i)) for i in range(400)], "k long, text string")
    gone = spark.createDataFrame([(i,) for i in range(0, 60, 2)] + [(None,), (4,)], "k long")
    got = sorted(r.text for r in without(rows, gone, ["k"], few).collect())
    assert got == sorted(str(i) for i in range(400) if i % 7 == 0 or i % 50 % 2)
    assert without(rows, gone.limit(0), ["k"], few).count() == 400 and without(rows.limit(0), gone, ["k"], few).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_joins_are_joins(spark, how):
    big = spark.range(3000).selectExpr("if(id % 3 = 0, 1, id) as k", "id")
    small = spark.range(0, 3000, 2).selectExpr("id as k", "id * 2 as v").union(spark.createDataFrame([(1, 7)], "k long, v long"))
    want = Counter(map(tuple, big.join(small, "k", how).select("k", "id", "v").collect()))
    assert Counter(map(tuple, salted_join(big, small, ["k"], big.id, how, salts=5).select("k", "id", "v").collect())) == want


def test_bitmap_has_every_value(spark):
    df = spark.range(0, 3000, 3)
    bitmap = bitmap_of(df, "id", size=1 << 16)
    there = np.array([r[0] for r in df.select(bitmap.position(df.id)).collect()])
    assert bitmap.at(there).all() and bitmap.at(np.arange(1 << 16)).sum() <= 1000


PASSAGE = "the quick fox jumped over a lazy dog. And then it went home, where supper stood on the table and everyone sat down to eat. Nobody spoke a word until the plates were empty and the fire had burned low; then stories began."


def test_a_passage_is_kept_once(spark):
    rng = random.Random(4)
    filler = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(40))
    rows = [(i, f"{filler()} {PASSAGE} {filler()}") for i in (9, 3, 7)] + [(1, filler()), (2, None), (5, ""), (None, PASSAGE), (8, f"é {filler()}\n{PASSAGE.upper()}\n{filler()}"), (8, f"é {filler()}\n{PASSAGE.upper()}\n{filler()}")]
    docs = docs_of(spark, rows)
    spans = substring_dedup.repeated_spans(docs).collect()
    assert {r.doc_id for r in spans} == {7, 8, 9} and {r.kept_id for r in spans} == {3}
    texts = dict(rows)
    for r in spans:
        if r.doc_id != 8:
            assert texts[r.doc_id][r.start : r.stop].strip() in PASSAGE and r.stop - r.start > 100
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert dict(kept)[3] == texts[3] and dict(kept)[1] == texts[1] and dict(kept)[2] is None and dict(kept)[None] == PASSAGE
    assert sum("supper stood on the table" in (t or "").lower() for i, t in kept if i is not None) == 1


def test_one_id_with_two_texts(spark):
    """The second text repeats nothing, so nothing is cut from it."""
    rng = random.Random(5)
    other = " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(60))
    docs = docs_of(spark, [(3, PASSAGE), (8, f"x y z {PASSAGE}"), (8, other)])
    assert sorted(r.text for r in substring_dedup.remove_repeats(docs).collect() if r.doc_id == 8 and len(r.text) > 60) == [other]


def test_passages_within_lines_are_found_whatever_stands_around_them(spark):
    rng = random.Random(6)
    words = lambda n: [rng.choice("abcdefghijkl") + "".join(rng.choice("aeioust") for _ in range(rng.randrange(1, 8))) for _ in range(n)]
    rows, passages = [], []
    for i in range(120):
        passages.append(words(60))
        rows += [(2 * i, " ".join(words(30) + passages[-1] + words(30))), (2 * i + 1, " ".join(words(17) + passages[-1] + words(9)))]
    docs = docs_of(spark, rows)
    cut = {r.doc_id: len(r.text.split()) for r in substring_dedup.remove_repeats(docs).collect()}
    found = [i for i in range(120) if cut[2 * i + 1] < 86]
    assert len(found) >= 118 and all(cut[2 * i] == 120 for i in range(120))
    assert sum(86 - cut[2 * i + 1] for i in found) > 0.75 * 60 * len(found)


def test_a_hot_unit(spark):
    """One line in every document: hot digests are dealt over many tasks, with the same result."""
    docs = docs_of(spark, [(i, f"own{i} words\n{PASSAGE}\nand{i} more") for i in range(2500)])
    assert {r.doc_id for r in substring_dedup.repeated_spans(docs).collect()} == set(range(1, 2500))


def test_units_tile_the_text():
    text = "  Él dijo: no! Sí. " + "word " * 400 + "\n\n¡fin! x"
    start, stop, words, digest = substring_dedup.units_of(text, HASHES)
    assert start[0] == 2 and stop[-1] == len(text) and (start[1:] == stop[:-1]).all() and (words > 0).all() and len(digest) == len(start)


def spans_by_definition(rows):
    """Counter of (id, start, stop, words) of the runs that go."""
    units = {i: substring_dedup.units_of(t, HASHES) for i, t in rows}
    first = {}
    for i in sorted(units):
        for u, d in enumerate(units[i][3]):
            first.setdefault(int(d), (i, u))
    expect = Counter()
    for i, (start, stop, words, digest) in units.items():
        run = []
        for u in range(len(digest) + 1):
            if u < len(digest) and first[int(digest[u])] != (i, u):
                run.append(u)
            elif run:
                told = sum(words[x] for x in run if words[x] >= 5)
                if words[run].sum() >= 20 and 2 * told >= words[run].sum():
                    expect[i, int(start[run[0]]), int(stop[run[-1]]), int(words[run].sum())] += 1
                run = []
    return expect


def test_spans_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    expect = spans_by_definition([(r.doc_id, r.text) for r in docs.collect()])
    got = Counter((r.doc_id, r.start, r.stop, r.n_words) for r in substring_dedup.repeated_spans(docs).collect())
    assert got == expect and expect


ITEM = "Anna has 12 apples and gives 5 apples to Boris on Monday. How many apples does Anna have left after she has walked 3 km with Boris?"


def leaks_of(spark, texts, items=((7, ITEM),)):
    docs = docs_of(spark, list(enumerate(texts)))
    return {(r.doc_id, r.item_id): r.kind for r in decontamination.leaks(docs, spark.createDataFrame(list(items), "item_id long, text string").selectExpr("*", "1 as hash", "2 as size")).collect()}


def test_leaks_exact_reparameterised_and_inconsistent(spark):
    renamed = ITEM.replace("Anna", "Clara").replace("Boris", "Dmitri").replace("12", "40").replace("5", "9").replace("km", "miles")
    mixed = "Anna has 12 apples and gives 5 apples to Boris on Monday. How many apples does Clara have left after she has walked 3 km with Anna?"
    longer = ITEM.replace("Anna", "Anna Maria").replace("12", "twenty five").replace("Boris", "Old Boris Petrov")
    texts = [f"some words before {ITEM} and after", renamed, mixed, "nothing to see here", None, "", "word " * 30000 + ITEM, longer, ITEM.replace("5 apples", "x apples"), ITEM.replace("12", "3")]
    assert leaks_of(spark, texts) == {(0, 7): "exact", (1, 7): "reparameterised", (6, 7): "exact", (7, 7): "reparameterised", (8, 7): "partial", (9, 7): "reparameterised"}


def test_equal_numbers_may_get_different_values(spark):
    item = "Tom has 2 apples in the basket and buys 2 pears at the market before he gives 3 plums away."
    texts = [item.replace("2 apples", "5 apples").replace("2 pears", "4 pears"), item.replace("3", "2"), item.replace("2", "9").replace("3", "9")]
    assert leaks_of(spark, texts, [(1, item)]) == dict.fromkeys([(0, 1), (1, 1), (2, 1)], "reparameterised")


def test_items_that_say_nothing_are_skipped(spark):
    assert leaks_of(spark, ["1 2 3", "Anna", "a b", "4 5 6 7", None], [(1, "4 5 6"), (2, "Boris"), (3, None), (4, ""), (5, "a b")]) == {}
    assert leaks_of(spark, ["x plain words only here y"], [(1, "plain words only here"), (1, "plain words only here")]) == {(0, 1): "exact"}


def test_items_of_few_plain_words_match_as_they_are(spark):
    assert leaks_of(spark, ["so 12 + 7 = Anna Berta 19 it is", "so 12 + 8 = Anna Berta 19 it is"], [(1, "12 plus 7"), (2, "7 = Anna Berta 19")]) == {(0, 2): "exact"}


def _leaks_by_definition(texts, items, k=8, least=4, share=0.5, agree=0.6):
    out = {}
    for d, text in enumerate(texts):
        for item, body in items:
            tokens, template = decontamination.template_of(text, decontamination.Canon())
            own, g = decontamination.template_of(body, decontamination.Canon())
            slot = decontamination.is_slot(g)
            h = template
            if (~slot).sum() < least:
                (own, g), (tokens, h) = decontamination.words_of(body), decontamination.words_of(text)
                slot = np.zeros(len(g), bool)
                if len(g) < least:
                    continue
            size = min(k, len(g))
            starts = sorted({*range(0, len(g) - size, size), len(g) - size})
            starts = [a for a in starts if 2 * (~slot[a : a + size]).sum() >= size] or starts
            matched, equal = set(), True
            for shift in range(-len(g), len(h)):
                here = [a for a in starts if a + shift >= 0 and a + shift + size <= len(h) and (h[a + shift : a + shift + size] == g[a : a + size]).all()]
                values: dict = {}
                same = True
                for a in here:
                    for i in range(a, a + size):
                        if slot[i]:
                            number = g[i] == decontamination.NUM
                            role = (own[i], int(g[i]), int(g[i + 1]) if number and i + 1 < len(g) else None)
                            values.setdefault(role, {})[i] = tokens[i + shift]
                            same &= own[i] == tokens[i + shift]
                many = [list(x.values()) for x in values.values() if len(x) > 1]
                if here and sum(max(Counter(v).values()) for v in many) >= agree * sum(map(len, many)):
                    matched |= set(here)
                    equal &= same
            if matched and len(matched) >= share * len(starts):
                out[d, item] = "reparameterised" if not equal else "exact" if len(matched) == len(starts) else "partial"
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["Anna", "Boris", "Clara", "12", "7", "3", "km", "apples", "pears", "has", "gives", "walks", "left", "shop", "red", "big"])
    items = [(i, " ".join(word() for _ in range(rng.choice([6, 9, 14, 20])))) for i in range(25)]
    texts = []
    for _, body in items * 3:
        w = body.split()
        for _ in range(rng.choice([0, 1, 2, 4])):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join([*(word() for _ in range(5)), *w, *(word() for _ in range(5))]))
    want = _leaks_by_definition(texts, items)
    assert leaks_of(spark, texts, items) == want and len(set(want.values())) == 3


def test_leaks_of_odd_tables(spark):
    docs = docs_of(spark, [(1, ITEM), (1, ITEM), (None, ITEM), (2, None)])
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (None, ITEM), (8, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.kind) for r in decontamination.leaks(docs, items).collect()] == [(1, 7, "exact")]
    assert decontamination.leaks(docs.limit(0), items).count() == 0 and decontamination.leaks(docs, items.limit(0)).count() == 0


def test_dropping_leaks_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 5), (1, 6)], "doc_id long, item_id long")
    assert sorted(r.text for r in decontamination.drop_leaks(docs, found).collect()) == ["b", "c"]


def test_units_that_no_run_can_hold_are_left_out_before_the_shuffle(spark):
    """Of all runs of repeated units those that can be removed pass, whatever the size of the batches; lonely short repeats don't."""
    from tidepool.llm import substring_dedup as sd

    rng = np.random.default_rng(11)
    rows = [(i // 25, i // 25, i % 25, i, i + 1, int(rng.integers(1, 12)), int(rng.integers(0, 40)), bool(rng.random() < 0.1)) for i in range(3000)]
    units = spark.createDataFrame(rows, "_id long, _doc long, unit int, start int, stop int, words int, digest long, again boolean").coalesce(1)
    repeated = spark.createDataFrame([(d,) for d in range(0, 40, 2)], "digest long")
    bitmap = bitmap_of(repeated, position=repeated.digest, size=1 << 16)
    needed, passing = set(), {(r[0], r[2]) for r in rows if r[7] or r[6] % 2 == 0}
    for doc in range(120):
        run = []
        for u in [*range(25), None]:
            if u is not None and (doc, u) in passing:
                run.append(u)
                continue
            own = [rows[doc * 25 + x] for x in run]
            if sum(r[5] for r in own) >= 20 and 2 * sum(r[5] for r in own if r[5] >= 5) >= 20:
                needed |= {(doc, x) for x in run}
            run = []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (7, 100, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {(r._id, r.unit) for r in sd._passing(units, bitmap, 20, 5).collect()}
            assert needed <= got <= passing
        assert len(got - needed) <= 2 * 25 and len(got) < len(passing)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
