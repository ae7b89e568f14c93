"""Each operator of documents on a table with a text of some MB, an empty one, a null and repeated rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from chartmill.llm import bpe, gif, kneser, langid, licenses, minhash, packing, queries, spotsigs
from test_gif_langid_licenses import plain_scan
from test_minhash import shingles


def texts():
    rnd = random.Random(31)
    words = "the river House of stone, and with Brücke é 日本 a1 all rights reserved".split()
    long = " ".join(rnd.choice(words) + rnd.choice(["", "", str(rnd.randrange(900))]) for _ in range(260_000))
    return [(1, long, "en"), (2, None, "en"), (3, "", None), (4, long, "en"), (5, "short one of two", "en"), (5, "short one of two", "en"), (None, "x" * 40_000, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("long")
    frame = spark.createDataFrame([(*r, "s", 0) for r in texts()], "doc_id long, text string, lang string, source string, n_chars long")
    frame.coalesce(1).write.parquet(str(where / "documents.parquet"))
    spark.createDataFrame([(1, 1), (5, 1)], "doc_id long, quality int").write.parquet(str(where / "labels.parquet"))
    return str(where)


def rows(spark, docs, name):
    return queries.QUERIES[name](spark, docs).collect()


def test_long_media_tokens_and_packing(spark, docs):
    raw = {i: (t or "").encode() for i, t, _ in texts()}
    assert len(raw[1]) > 1_400_000
    for r in rows(spark, docs, "op1_gif_frames"):
        full = raw[r["doc_id"]] + b"\xff" * (max(1, -(-len(raw[r["doc_id"]]) // gif.FRAME)) * gif.FRAME - len(raw[r["doc_id"]]))
        assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw[r["doc_id"]]), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in rows(spark, docs, "op2_byte_bpe"):
        ids = np.array(own.encode_ordinary(raw[r["doc_id"]].decode()), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw[r["doc_id"]]).hexdigest())
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = rows(spark, docs, "op5_mixture_packing")
    ids = np.array([*plain.encode(raw[1].decode(), add_special_tokens=False).ids, 0], "<u4")
    for i in (1, 4):
        mine = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces if r["doc_id"] == i)
        assert sum(n for _, n, *_ in mine) == len(ids) and all(zlib.crc32(ids[s : s + n].tobytes()) == c and d == len(ids) for s, n, c, d in mine)
    spots = sorted((r["sequence_id"] * packing.SEQUENCE + r["offset"], r["length"]) for r in pieces)
    assert spots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spots, spots[1:]))


def test_long_scans(spark, docs):
    by = {r["doc_id"]: r for r in rows(spark, docs, "op4_minhash_forest")}
    assert by[1]["n_shingles"] == len(shingles(texts()[0][1])) and by[4]["component_id"] == 1 and by[5]["component_id"] == 5 and by[2]["n_shingles"] == 0
    told = {i: t for i, t, _ in texts()}
    for r in rows(spark, docs, "op6_license_scan"):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == plain_scan(told[r["doc_id"]])
    prints = {r["doc_id"]: r for r in rows(spark, docs, "op10_spotsigs")}
    assert prints[1]["fingerprint"] == prints[4]["fingerprint"] and prints[1]["n_chars"] == len(told[1]) and prints[2]["n_chars"] == 0 and spotsigs.CHAIN == 3
    lang = {r["doc_id"]: r for r in rows(spark, docs, "op3_ppm_language")}
    assert lang[1]["lang_pred"] == lang[4]["lang_pred"] == "en" and lang[2]["lang_pred"] == langid.UNKNOWN and lang[1]["score"] == lang[4]["score"]
    cost = {r["doc_id"]: r for r in rows(spark, docs, "op9_kneser_ney")}
    assert cost[1]["perplexity"] == cost[4]["perplexity"] > 1 and cost[1]["n_symbols"] == len(told[1].encode()) and not cost[2]["kept"] and kneser.ORDER == 5
    assert len(cost) == 6 and licenses.BASE and minhash.ORDERS == 16
