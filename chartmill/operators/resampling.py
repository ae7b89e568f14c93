"""Bootstrap intervals, paired differences and permutation tests over documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scoring import f1, ratio

SCHEMA = "condition string, b bigint, micro double, macro double"


def hash_weights(docs: DataFrame, resamples: int, key: str = "doc_id") -> DataFrame:
    """b, key, w: weights 0 to 2 told by a hash, the same on any engine, for small resample numbers."""
    each = docs.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    return each.select("b", key, F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key), F.col("b").cast("string"))), 1, 6), 16, 10).cast("bigint"), F.lit(3)).alias("w"))


def weighted_scores(doc_key: DataFrame, weights: DataFrame, digits: int = 9) -> DataFrame:
    """condition, seed, b, micro, macro by joining weights; for few resamples."""
    summed = doc_key.join(weights, "doc_id").groupBy("condition", "seed", "b", "key").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in ("tp", "fp", "fn")))
    metric = lambda tp, fp, fn: f1(ratio(tp, tp + fp), ratio(tp, tp + fn))
    each = summed.withColumn("f", metric(F.col("tp"), F.col("fp"), F.col("fn"))).withColumn("there", F.col("tp") + F.col("fp") + F.col("fn") > 0)
    return each.groupBy("condition", "seed", "b").agg(F.round(metric(F.sum("tp"), F.sum("fp"), F.sum("fn")), digits).alias("micro"), F.round(F.coalesce(F.avg(F.when(F.col("there"), F.col("f"))), F.lit(0.0)), digits).alias("macro"))


def interval(c: str) -> Column:
    """array(low, high): the middle 95 percent."""
    return F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))


def intervals(scores: DataFrame, digits: int = 9) -> DataFrame:
    """condition, metric, ci_low, ci_high of the seeds' mean score per resample."""
    mean = scores.groupBy("condition", "b").agg(F.avg("micro").alias("micro"), F.avg("macro").alias("macro"))
    told = mean.select("condition", F.explode(F.create_map(F.lit("micro_f1"), F.col("micro"), F.lit("macro_f1"), F.col("macro"))).alias("metric", "x"))
    return told.groupBy("condition", "metric").agg(interval("x").alias("ci")).select("condition", "metric", F.round(F.col("ci")[0], digits).alias("ci_low"), F.round(F.col("ci")[1], digits).alias("ci_high"))


def differences(scores: DataFrame, first: str, second: str, digits: int = 9) -> DataFrame:
    """metric, interval of first - second over paired resamples, and the two-sided bootstrap p."""
    mean = scores.groupBy("condition", "b").agg(F.avg("micro").alias("micro"), F.avg("macro").alias("macro"))
    side = lambda c, p: mean.filter(F.col("condition") == c).select("b", F.col("micro").alias(f"{p}i"), F.col("macro").alias(f"{p}a"))
    both = side(first, "x").join(side(second, "y"), "b")
    told = both.select(F.explode(F.create_map(F.lit("micro_f1"), F.round(F.col("xi") - F.col("yi"), digits), F.lit("macro_f1"), F.round(F.col("xa") - F.col("ya"), digits))).alias("metric", "d"))
    out = told.groupBy("metric").agg(interval("d").alias("ci"), F.avg((F.col("d") <= 0).cast("int")).alias("lo"), F.avg((F.col("d") >= 0).cast("int")).alias("hi"))
    low, high = F.round(F.col("ci")[0], digits), F.round(F.col("ci")[1], digits)
    return out.select("metric", low.alias("ci_low"), high.alias("ci_high"), F.least(F.lit(1.0), F.round(2 * F.least("lo", "hi"), digits)).alias("p_two_sided"), ((low > 0) | (high < 0)).alias("excludes_zero"))


class Tensor:
    """Counts as (seed, document, key) arrays per condition, for the evaluation set of one study.

    The set is what one study scores by hand (some hundred documents); it is refused beyond
    LIMIT cells, where weighted_scores does the same as joins.
    """

    LIMIT = 50_000_000

    def __init__(self, doc_key: DataFrame):
        sizes = doc_key.agg(F.count_distinct("doc_id").alias("d"), F.count_distinct("key").alias("k"), F.count_distinct("condition", "seed").alias("s")).first()
        if sizes["d"] * sizes["k"] * sizes["s"] > self.LIMIT:
            raise ValueError("too many cells for resampling by arrays; use weighted_scores")
        rows = doc_key.groupBy("condition", "seed", "doc_id", "key").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).toPandas()
        self.docs, self.keys = sorted(rows.doc_id.unique()), sorted(rows.key.unique())
        place = {d: i for i, d in enumerate(self.docs)}, {k: i for i, k in enumerate(self.keys)}
        self.counts: dict[str, np.ndarray] = {}
        for condition, sub in rows.groupby("condition"):
            seeds = {s: i for i, s in enumerate(sorted(sub.seed.unique()))}
            x = np.zeros((3, len(seeds), len(self.docs), len(self.keys)))
            at = sub.seed.map(seeds).to_numpy(), sub.doc_id.map(place[0]).to_numpy(), sub.key.map(place[1]).to_numpy()
            for i, c in enumerate(("tp", "fp", "fn")):
                x[i][at] = sub[c].to_numpy()
            self.counts[condition] = x


def f1_array(tp: np.ndarray, fp: np.ndarray, fn: np.ndarray) -> np.ndarray:
    """2 tp / (2 tp + fp + fn), which is the harmonic mean of precision and recall; 0 without any."""
    total = 2 * tp + fp + fn
    return np.divide(2 * tp, total, out=np.zeros(np.shape(tp)), where=total > 0)


def scores_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """micro and macro of counts (3, ..., key); macro averages the keys that are there."""
    there = counts.sum(0) > 0
    macro = (f1_array(*counts) * there).sum(-1) / np.maximum(there.sum(-1), 1)
    return f1_array(*counts.sum(-1)), macro


def bootstrap(spark: SparkSession, doc_key: DataFrame, resamples: int = 10_000, seed: int = 20260924, block: int = 250) -> DataFrame:
    """condition, b, micro, macro (means over seeds): documents drawn with replacement.

    The draws come from one generator on the driver; blocks of resamples are spread over tasks.
    """
    tensor = Tensor(doc_key)
    held = spark.sparkContext.broadcast(tensor)  # at most Tensor.LIMIT cells
    n = len(tensor.docs)
    drawn = np.random.default_rng(seed).integers(0, n, size=(resamples, n))
    blocks = [(a, drawn[a : a + block].astype("<i4").tobytes()) for a in range(0, resamples, block)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for a, raw in zip(batch.column("a").to_pylist(), batch.column("draws").to_pylist(), strict=True):
                draws = np.frombuffer(raw, "<i4").reshape(-1, n)
                w = np.stack([np.bincount(d, minlength=n) for d in draws]).astype(float)
                for condition, x in own.counts.items():
                    mi, ma = scores_of(np.einsum("bd,csdk->csbk", w, x))
                    yield pa.RecordBatch.from_arrays([pa.array([condition] * len(w)), pa.array(np.arange(a, a + len(w))), pa.array(mi.mean(0)), pa.array(ma.mean(0))], ["condition", "b", "micro", "macro"])

    frame = spark.createDataFrame(blocks, "a bigint, draws binary").repartition(max(1, min(len(blocks), 64)))
    return frame.mapInArrow(run, SCHEMA)


def permutation(spark: SparkSession, doc_key: DataFrame, pairs: list[tuple[str, str]], permutations: int = 10_000, seed: int = 20260924, block: int = 250) -> DataFrame:
    """first, second, metric, observed, p of paired label swaps per document, (hits + 1) / (n + 1).

    A condition of one seed is repeated for each seed of the other.
    """
    tensor = Tensor(doc_key)
    held = spark.sparkContext.broadcast(tensor)
    n = len(tensor.docs)
    rng = np.random.default_rng(seed)
    blocks = [(i, a, np.packbits(rng.integers(0, 2, size=(min(block, permutations - a), n)).astype(bool), axis=1).tobytes(), min(block, permutations - a)) for i in range(len(pairs)) for a in range(0, permutations, block)]

    def sides(own: Tensor, i: int) -> tuple[np.ndarray, np.ndarray]:
        x, y = (own.counts[c] for c in pairs[i])
        seeds = max(x.shape[1], y.shape[1])
        return tuple(np.repeat(z, seeds, axis=1) if z.shape[1] == 1 else z for z in (x, y))

    def difference(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        (mx, ax), (my, ay) = scores_of(x.sum(2)), scores_of(y.sum(2))
        return float((mx - my).mean()), float((ax - ay).mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for i, raw, rows in zip(*(batch.column(c).to_pylist() for c in ("pair", "flips", "rows")), strict=True):
                x, y = sides(own, i)
                seen, hits = difference(x, y), [0, 0]
                for flip in np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, :n].astype(bool):
                    f = flip[None, None, :, None]
                    for k, d in enumerate(difference(np.where(f, y, x), np.where(f, x, y))):
                        hits[k] += abs(d) >= abs(seen[k]) - 1e-12
                yield pa.RecordBatch.from_arrays([pa.array([i, i]), pa.array(["micro_f1", "macro_f1"]), pa.array(seen), pa.array(hits, pa.int64())], ["pair", "metric", "observed", "hits"])

    frame = spark.createDataFrame(blocks, "pair int, a bigint, flips binary, rows int").repartition(max(1, min(len(blocks), 64)))
    told = frame.mapInArrow(run, "pair bigint, metric string, observed double, hits bigint").groupBy("pair", "metric").agg(F.first("observed").alias("observed"), F.sum("hits").alias("hits"))
    names = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a, b in pairs))
    return told.select(names[F.col("pair").cast("int")].alias("n"), "metric", "observed", ((F.col("hits") + 1) / F.lit(permutations + 1)).alias("p")).select("n.first", "n.second", "metric", "observed", "p")
