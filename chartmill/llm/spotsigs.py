"""SpotSigs: chains of content words after common anchor words as a document's signatures.

Each anchor and the next CHAIN content words after it make one signature; the set of a text's
signatures is its fingerprint. Sets are compared only within and between neighbouring length
partitions, and a comparison ends as soon as the rest cannot reach the threshold.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import materialise, prepare, slices
from .licenses import SEPARATORS
from .words import chain, mix, word_hash, word_hashes, word_spans

CHAIN = 3
# Common words of English, French, German and Spanish.
ANCHORS = (
    "the a an of and to in is was are be it that this by for from with on as at or what "
    "le la les un une des du de et est en que qui dans sur par pour au avec pas "
    "der die das den dem und ist ein eine im in zu von mit auf für nicht sich als auch "
    "el la los las un una de del y que en es se no por con para su al lo"
).split()


@lru_cache(maxsize=1)
def _anchors() -> np.ndarray:
    return np.array(sorted({word_hash(w.encode()) for w in ANCHORS}), np.uint64)


def _is_anchor(words: np.ndarray) -> np.ndarray:
    known = _anchors()
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return known[at] == words


def signatures(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): sorted distinct 32-bit signatures; text i has values[first[i]:first[i+1]].

    Near a text's end a chain holds the content words that are left, at least one. A text without
    such chains has its runs of CHAIN words instead, or its whole word sequence if that is shorter.
    """
    starts, ends, first = word_spans(data, offs, SEPARATORS)
    n = len(offs) - 1
    words = word_hashes(data, starts, ends)
    if not len(words):
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    doc = np.repeat(np.arange(n), np.diff(first))
    anchor = _is_anchor(words)
    content = np.flatnonzero(~anchor)
    spots = np.flatnonzero(anchor)
    after = np.searchsorted(content, spots)  # the next content word, as a place in content
    value = words[spots]
    size = np.zeros(len(spots), np.int64)
    padded = np.concatenate([content, np.zeros(CHAIN, np.int64)])
    for k in range(CHAIN):
        at = padded[after + k]
        own = (after + k < len(content)) & (doc[at] == doc[spots])
        value[own] = mix(value[own] + words[at[own]] * np.uint64(2 * k + 3))
        size += own
    held = size > 0
    found, owner = [value[held]], [doc[spots][held]]
    bare = np.setdiff1d(np.flatnonzero(np.diff(first)), owner[0])
    for i in bare.tolist():
        own = words[first[i] : first[i + 1]]
        runs = chain(own, min(CHAIN, len(own)))
        found.append(mix(runs + np.uint64(1)))
        owner.append(np.full(len(runs), i))
    h, owner = (np.concatenate(found) >> np.uint64(32)).astype(np.uint64), np.concatenate(owner).astype(np.uint64)
    both = np.unique(owner << np.uint64(32) | h)
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(both >> np.uint64(32), np.arange(n + 1))


def pruned_jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Likeness of two sorted sets; -1.0 as soon as it must lie below the threshold.

    Two empty sets are alike (1.0); an empty and another are not (0.0). Sets whose sizes alone
    rule the threshold out are not looked at.
    """
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < threshold * len(large):
        return -1.0
    both, at, step = 0, 0, 1024
    while at < len(small):
        part = small[at : at + step]
        where = np.minimum(np.searchsorted(large, part), len(large) - 1)
        both += int((large[where] == part).sum())
        at += step
        best = both + max(0, len(small) - at)
        if best < threshold * (len(a) + len(b) - best):
            return -1.0
    return both / (len(a) + len(b) - both)


def encode(values: np.ndarray) -> str:
    return base64.b64encode(values.astype("<u4").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def _as_buffers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and n_signatures of every whole text; a null text has an empty one."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches, "text"):
            v, first = signatures(data, offs)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([encode(v[a:b]) for a, b in zip(first, first[1:], strict=False)], pa.string()), pa.array(np.diff(first))], ["doc_id", "fingerprint", "n_signatures"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string, n_signatures long")


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [decode(f) for f in batch.column("fingerprint").to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        ids = np.repeat(batch.column("doc_id").to_numpy(), n)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(n, n)), pa.array(np.concatenate([*sets, np.zeros(0, np.uint32)]).astype(np.int64))], ["doc_id", "n", "sig"])


def near_pairs(prints: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of (doc_id, fingerprint): pairs (u, v, likeness) of alike classes with u < v, and
    members (doc_id, class_id), where equal fingerprints are one class named by its smallest doc_id.

    A set meets others only in its own length partition and the next, by a signature among its
    rarest n - ceil(threshold n) + 1, as any set that reaches the threshold must share one of them;
    signatures that many documents hold are thus hardly ever joined on. Empty fingerprints and null
    ids form no class. Likeness is confirmed on the whole sets.
    """
    prepare(prints.sparkSession)
    held = prints.filter("fingerprint <> '' and doc_id is not null").select("doc_id", "fingerprint")
    classes = materialise(held.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")), "fingerprint-classes")
    members = held.join(classes, "fingerprint").select("doc_id", "class_id")
    sets = classes.select(F.col("class_id").alias("doc_id"), "fingerprint")
    each = materialise(sets.mapInArrow(_explode, "doc_id long, n long, sig long"), "signatures")
    common = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "sig"))
    kept = each.join(common, "sig").withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
    # Partition k holds sets of at least g^k signatures with g = 1 / threshold.
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9) if threshold < 1 else F.col("n")
    rows = kept.withColumn("part", part.cast("long")).select("doc_id", "n", "sig", "part")
    left = rows.select(F.col("doc_id").alias("a"), F.col("n").alias("an"), "sig", F.col("part").alias("own"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = rows.select(F.col("doc_id").alias("b"), F.col("n").alias("bn"), "sig", "part")
    fits = (F.least("an", "bn") >= F.lit(threshold) * F.greatest("an", "bn") - 1e-9) & ((F.col("own") < F.col("part")) | (F.col("a") < F.col("b")))
    pairs = left.join(right, ["sig", "part"]).filter(fits).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    one, two = (sets.select(F.col("doc_id").alias(x), F.col("fingerprint").alias(f"f{x}")) for x in "uv")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [pruned_jaccard(decode(x), decode(y), threshold) for x, y in zip(batch.column("fu").to_pylist(), batch.column("fv").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(near, pa.float64())], ["u", "v", "likeness"])
            yield out.filter(pa.array([x >= threshold for x in near], pa.bool_()))

    joined = pairs.join(one, "u").join(two, "v").select("u", "v", "fu", "fv")
    return joined.mapInArrow(confirm, "u long, v long, likeness double"), members


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows bucket, tail, doc_id, text, so dealt and sorted that a row's successor by descending
    doc_id follows it; a bucket ends with a copy (tail) of the row that follows its last.

    Buckets are ranges of doc_id; only their number of ids, one per bucket, reaches the driver.
    Null ids come last; rows that share an id are in order of their texts.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(least))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(key.alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    cuts = sorted({float(c) for c in cuts if c > -9.2e18})
    keyed = docs.withColumn("bucket", F.lit(0))
    if cuts:  # those of at least a cut come before those below it; a binary search per row
        found = Bucketizer(splits=[-float("inf"), *(float(c) for c in cuts), float("inf")], inputCol="_k", outputCol="_b").transform(docs.withColumn("_k", key.cast("double")))
        keyed = found.withColumn("bucket", (F.lit(len(cuts)) - F.col("_b")).cast("int")).drop("_k", "_b")
    heads = {r["bucket"]: r["head"] for r in keyed.groupBy("bucket").agg(F.max(key).alias("head")).collect()}
    order = sorted(heads)
    before = {heads[b]: order[i - 1] for i, b in enumerate(order)}
    target = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[key] if before else F.lit(None)
    copies = F.expr("filter(array(struct(bucket as bucket, false as tail), struct(target as bucket, true as tail)), c -> c.bucket is not null)")
    rows = keyed.withColumn("target", target.cast("int")).select("doc_id", "text", F.explode(copies).alias("c")).select("c.bucket", "c.tail", "doc_id", "text")
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), "text")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    held: list[Row] = []

    def work() -> pa.RecordBatch:
        """All rows but the last, each with its successor."""
        texts = [r[3] for r in held]
        new = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        v, first = signatures(*_as_buffers(texts))
        w, second = signatures(*_as_buffers(new))
        out = []
        for i in range(len(held) - 1):
            if held[i][1] or held[i][0] != held[i + 1][0]:
                continue
            a, b, e = v[first[i] : first[i + 1]], v[first[i + 1] : first[i + 2]], w[second[i] : second[i + 1]]
            out.append((held[i][2], len(texts[i]), hashlib.sha256(new[i].encode()).hexdigest(), encode(a), encode(e), pruned_jaccard(a, e), pruned_jaccard(a, b), len(a)))
        del held[:-1]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")), strict=True):
            held.append(row)
            size += len(row[3])
            if size > 1 << 20 and len(held) > 1:
                yield work()
                size = len(held[-1][3])
    if len(held) > 1:
        yield work()


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and how alike they are.

    The edited text ends with the beginning of the next document by descending doc_id, the first
    following the last; a lone document follows itself. Null texts are empty, with an empty
    fingerprint; two empty fingerprints are alike. Repeated rows follow one another.
    """
    prepare(docs.sparkSession)
    return with_next(docs).mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long")
