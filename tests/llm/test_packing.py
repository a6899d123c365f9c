"""Packing against brute force: ids by the tokenizers library, gapless places, optimal bins on small instances."""

import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidepool.llm import packing


def _optimum(items: tuple[int, ...], capacity: int) -> int:
    best = len(items)

    def go(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def _histogram(items):
    return {x: items.count(x) for x in set(items)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_dominant_sets_never_cost_a_bin(items):
    fixed, rest = packing.dominant_sets(_histogram(items), 20)
    left = tuple(sorted(itertools.chain.from_iterable([x] * n for x, n in rest.items()), reverse=True))
    assert sum(t for t, _ in fixed) + (_optimum(left, 20) if left else 0) == _optimum(tuple(sorted(items, reverse=True)), 20)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60))
def test_patterns_hold_every_piece_once(items):
    patterns = packing.pack(_histogram(items), 30)
    got: dict[int, int] = {}
    for times, bin_ in patterns:
        assert times > 0 and sum(x * n for x, n in bin_.items()) <= 30
        for x, n in bin_.items():
            got[x] = got.get(x, 0) + times * n
    assert got == _histogram(items)


def test_no_pieces():
    assert packing.pack({}, 10) == []
    assert len(packing.places([])["length"]) == 0


@pytest.mark.parametrize("text", ["", " ", "a  b", "a   b", " x\n y", "don't  stop\t now\n\n\nend ", "Ciónñue. 12 $$$ | é", "x" * 300 + "  ", "  a  b", "a \n b\n  c"])
def test_ids_equal_the_tokenizers_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert np.frombuffer(packing.encoder("byte_bpe_50k").encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def _library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


_SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]
_bits = st.one_of(st.sampled_from(_SPACES), st.sampled_from([" ", "  ", " \xa0 ", "\r\n", "'s", "don't", "é", "12", "$", "\u200b", "\u180e", "🙂", "<|endoftext|>"]), st.text(max_size=3))


@settings(max_examples=1500, deadline=None)
@given(st.lists(_bits, max_size=12).map("".join))
def test_ids_of_any_white_space(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(packing.encoder("byte_bpe_50k").encode(text), "<u4").tolist() == _TOKENS.encode(text, add_special_tokens=False).ids


_TOKENS = _library()


def test_no_break_spaces():
    assert np.frombuffer(packing.encoder("byte_bpe_50k").encode("a \xa0 \xa0 b"), "<u4").tolist() == [64, 11504, 275]


def test_odd_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "x"), (None, None), (2, ""), (3, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length", "3 as _id", "4 as _text", "5 as sequence_id", "6 as rank")
    got = packing.pack_documents(docs, bucket_rows=3).collect()
    assert [sum(r.length for r in got if r.doc_id == i) for i in (1, 2, None)] == [8, 1, 3]
    assert sum(r.length for r in got if r.doc_id == 3) == len(_TOKENS.encode(rows[-1][1], add_special_tokens=False).ids) + 1
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, o, n), (t, p, _) in itertools.pairwise(places):
        assert (t, p) == (s, o + n) if s == t else p == 0
    assert all(o + n <= 1024 for _, o, n in places)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_whole_operator(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = packing.pack_documents(docs, bucket_rows=40).collect()
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    by_doc: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids[doc])
        assert all(r.length == 1024 for r in own[1:]) and own[0].start == 0
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(own)) and own[-1][0] + own[-1][1] <= 1024
    assert len(sequences) <= 1.02 * -(-sum(map(len, ids.values())) // 1024) + 1
