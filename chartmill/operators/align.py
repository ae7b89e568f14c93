"""Keyed loads, joins on ids, resumption, and positional slices."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, trim_u


def present(df: DataFrame, columns: list[str], blank_is_missing: bool = True) -> DataFrame:
    """Rows whose columns are all there; blank text counts as missing if asked."""
    for c in columns:
        df = df.filter(~is_blank(F.col(c).cast("string")) if blank_is_missing else F.col(c).isNotNull())
    return df


def prepared(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns all hold more than white space, as text without white space around it."""
    kept = present(df, columns)
    return kept.withColumns({c: trim_u(F.col(c).cast("string")) for c in columns})


def missing_counter(df: DataFrame, columns: list[str], blank_is_missing: bool = True) -> DataFrame:
    """One row: total, kept, missing."""
    gone = F.lit(False)
    for c in columns:
        gone = gone | (is_blank(F.col(c).cast("string")) if blank_is_missing else F.col(c).isNull())
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(~gone).alias("kept"), F.count_if(gone).alias("missing"))


def last_wins(df: DataFrame, key: str, order: str | Column) -> DataFrame:
    """One row per key, that of the greatest order; partial aggregation runs before the shuffle."""
    rest = [c for c in df.columns if c != key]
    order = F.col(order) if isinstance(order, str) else order
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(key, "row.*")


def pair_by_id(left: DataFrame, right: DataFrame, key: str = "id", limit: int = 0) -> DataFrame:
    """Inner join on id; with a limit, the rows of the first ids in order."""
    return head_rows(left.join(right, key), key, limit)


def probe(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Left rows, duplicates kept, that have a partner on the right."""
    return left.join(right, key)


def unmatched(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Ids of the left that the right lacks: also the rows still to do when resuming."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def members(df: DataFrame, ids: DataFrame, key: str = "id", keep: bool = True) -> DataFrame:
    """The rows whose id is in a set, or with keep=False those whose id is not; a null id is in none."""
    return df.join(ids.select(key).distinct(), key, "left_semi" if keep else "left_anti")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, or a ValueError if it has no rows."""
    if df.isEmpty():
        raise ValueError(f"no {what} left")
    return df


def aligned(gold: DataFrame, pred: DataFrame, key: str = "id", strict: bool = False) -> DataFrame:
    """Rows of ids on both sides; strict raises when an id is on one side only."""
    if not strict:
        return gold.join(pred, key)
    both = gold.withColumn("_g", F.lit(True)).join(pred.withColumn("_p", F.lit(True)), key, "full_outer")
    check = F.assert_true(F.col("_g").isNotNull() & F.col("_p").isNotNull(), F.lit("gold and predicted ids differ"))
    return both.withColumn("_ok", check).filter(F.col("_ok").isNull()).drop("_g", "_p", "_ok")


def slice_rows(df: DataFrame, order: str, start: int, end: int) -> DataFrame:
    """Rows at places start..end-1 by order; an end of 0 or less, or past the last, means all.

    Ranks come from sorted partitions and the counts before them, so no task holds all rows.
    """
    ranked = with_rank(df, order)
    out = ranked.filter(F.col("rank") >= max(0, start))
    return (out.filter(F.col("rank") < end) if end > 0 else out).drop("rank")


def head_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by order, all of them where n is 0 or less: for a try before a long run."""
    return df.orderBy(order).limit(n) if n > 0 else df


def with_rank(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """A dense 0-based rank by a unique order: local ranks plus the sizes of earlier ranges."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    cuts = df.select(F.col(order).alias("_k")).filter("_k is not null")
    kind = dict(df.dtypes)[order]
    if kind in ("bigint", "int", "double"):
        edges = sorted(set(cuts.approxQuantile("_k", [i / int(parts) for i in range(1, int(parts))], 0.01)))
        dealt = df.withColumn("_b", F.lit(0))
        if edges:  # a binary search per row
            cuts = Bucketizer(splits=[-float("inf"), *map(float, edges), float("inf")], inputCol="_k", outputCol="_b")
            dealt = cuts.transform(df.withColumn("_k", F.col(order).cast("double"))).drop("_k")
    else:
        # Cuts between ranges come from about 50 values a range, chosen by hash: the same in every run.
        share = max(1, cuts.count() // (50 * int(parts)))
        some = [r["_k"] for r in cuts.filter(F.pmod(F.xxhash64("_k"), F.lit(share)) == 0).distinct().orderBy("_k").collect()]
        edges = some[:: max(1, len(some) // int(parts))][1:]
        own = F.col(order)

        def upto(low: int, high: int) -> Column:
            """How many of the edges are not past a value, by halving."""
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            return F.when(own < F.lit(edges[mid]), upto(low, mid)).otherwise(upto(mid + 1, high))

        dealt = df.withColumn("_b", F.when(own.isNull(), F.lit(-1)).otherwise(upto(0, len(edges))))
    dealt = dealt.withColumn("_b", F.coalesce(F.col("_b"), F.lit(-1)).cast("int"))  # nulls come first
    sizes = {r["_b"]: r["n"] for r in dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per range
    before, total = {}, 0
    for b in sorted(sizes):
        before[b], total = total, total + sizes[b]
    base = F.create_map(*(F.lit(x) for item in before.items() for x in item))[F.col("_b")] if before else F.lit(0)
    local = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    return dealt.withColumn(name, (local + base).cast("bigint")).drop("_b")


def shard_of(rank: Column, total: int, shards: int) -> Column:
    """Contiguous shards of ceil(total / shards) rows."""
    return F.floor(rank / F.lit(-(-total // shards))).cast("int")


def pair_files(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Files (path, text) paired by the name's prefix before '_' and by place within the prefix."""

    def placed(df: DataFrame, text: str) -> DataFrame:
        prefix = F.substring_index(F.element_at(F.split("path", "/"), -1), "_", 1)
        return df.select(prefix.alias("prefix"), "path", F.col("text").alias(text)).withColumn("pos", F.row_number().over(Window.partitionBy("prefix").orderBy("path"))).drop("path")

    return placed(inputs, "input").join(placed(outputs, "output"), ["prefix", "pos"])
