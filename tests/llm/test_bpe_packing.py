"""Tokens against the public libraries, the packing's exactness, and the deficit schedule."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chartmill.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
PLAIN, TOKENIZER = Tokenizer.from_file(JSON), packing.Tokenizer(JSON)
ODD = [None, "", " ", "'s", " 's", "a's'll", "''s", "\n\n x", "x  ", "é́", "日本語 テスト", "🙂🙂", "<|endoftext|>", "12 345", "\r\n\t", "  a", "a b　c", "word " * 3000, "x" * 2500]


def buffers(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def ids_of(texts):
    return lists(*bpe.codec(PATH, bpe.CACHE_PIECES).encode(*buffers(texts)))


def lists(ids, offs):
    return [ids[a:b].tolist() for a, b in zip(offs, offs[1:])]


def test_odd_texts():
    assert ids_of(ODD) == [OWN.encode_ordinary(t or "") for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'srevlltmd  \n\t19é!.ß中🙂́") + ["'"]), max_size=30), max_size=8))
def test_any_texts(texts):
    found = ids_of(texts)
    assert found == [OWN.encode_ordinary(t) for t in texts]
    own = bpe.codec(PATH, bpe.CACHE_PIECES)
    assert [own.decode(np.array(i, np.int64)) for i in found] == [t.encode() for t in texts]


def test_long_scan_is_independent_of_blocks():
    text = "it's 12 a\n\n  b'll!!'s  " * 5000
    assert ids_of([text, text[:77]]) == [OWN.encode_ordinary(text), OWN.encode_ordinary(text[:77])]


@pytest.mark.parametrize("most", [0, 3, 40])
def test_full_cache_forgets(most):
    small = bpe.Codec(PATH, cache_pieces=most)
    for _ in range(3):
        assert lists(*small.encode(*buffers(ODD))) == ids_of(ODD)
        assert len(small.encoder.cache.lo) <= most


def test_long_pieces():
    rnd = np.random.default_rng(1)
    texts = ["".join(chr(97 + c) for c in rnd.integers(0, 26, n)) for n in (1, 14, 15, 16, 17, 127, 128, 129, 400, 2000)] + ["\0\0", "\0", "a\0", "日" * 5, "日" * 6]
    assert ids_of(texts) == ids_of(texts[::-1])[::-1] == [OWN.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab'srevlltmd  \n\t19é!.ß中🙂́", "<|endoftext|>", "<|end"]), max_size=30).map("".join), max_size=8))
def test_tokenizer_is_that_of_the_library(texts):
    assert lists(*TOKENIZER(*buffers(texts))) == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokenizer_on_odd_texts():
    assert lists(*TOKENIZER(*buffers(ODD))) == [PLAIN.encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert lists(*TOKENIZER(*buffers(["<|endoftext|>"]))) == [[50256]]


def test_query_columns(spark):
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(ODD)] + [(None, "a", "n")], "doc_id long, text string, ids string")
    encoded = bpe.encode_documents(docs, PATH)
    assert sorted(r["text"] for r in bpe.decode_documents(encoded, PATH).collect()) == sorted([t or "" for t in ODD] + ["a"])
    assert bpe.encode_documents(docs.filter("false"), PATH).count() == 0


def test_one_phase_drains_all():
    plan = packing.phases({"a": 100, "b": 50, "c": 0})
    assert plan == [(0, {"a": (0, 100), "b": (0, 50)})]
    plan = packing.phases({"a": 100, "b": 50, "c": 30}, {"a": 1, "b": 1})
    assert [begin for begin, _ in plan] == [0, 100, 150] and plan[2][1] == {"c": (0, 30)}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.integers(1, 4000), min_size=1), st.integers(1, 700), st.booleans())
def test_schedule_covers_all_places(totals, window, weighted):
    weights = {s: i for i, s in enumerate(sorted(totals))} if weighted else None
    schedule = packing.Schedule(packing.phases(totals, weights), window)
    spans = sorted((to, to + b - a) for s, n in totals.items() for a, b, to in schedule.place(s, 0, n))
    assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] == sum(totals.values())


def test_windows_hold_the_mixture():
    totals = {"a": 60_000, "b": 30_000, "c": 10_000}
    schedule = packing.Schedule(packing.phases(totals), 1000)
    for w in range(1, 100):
        sent = schedule.sent(0, w)
        assert all(abs(s - w * 1000 * n / 100_000) < 1 for s, n in zip(sent, totals.values()))


@pytest.mark.parametrize("weights", [None, {"x": 2.0, "y": 1.0}])
def test_pack(spark, weights):
    rows = [(i, t, "xyz"[i % 3] if i % 4 else None) for i, t in enumerate(ODD)] + [(3, "again", "x"), (None, "no id", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("start", __import__("pyspark.sql.functions").sql.functions.lit(1))
    got = packing.pack(docs.repartition(3), JSON, weights, sequence=64, window_sequences=2).collect()
    own = PLAIN
    want = sorted((np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t, _ in rows), key=len)
    total = sum(map(len, want))
    assert sum(r["length"] for r in got) == total
    spots = sorted((r["sequence_id"] * 64 + r["offset"], r["length"]) for r in got)
    assert spots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spots, spots[1:]))
    assert all(r["offset"] + r["length"] <= 64 for r in got)
    one = [i for i in range(len(ODD)) if i != 3]
    for i in one:
        ids = np.array([*own.encode(ODD[i] or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got if r["doc_id"] == i)
        assert [s for s, *_ in mine] == np.cumsum([0] + [n for _, n, *_ in mine])[:-1].tolist()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c and d == len(ids) for s, n, c, d in mine) and sum(n for _, n, *_ in mine) == len(ids)


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string"), JSON).count() == 0
