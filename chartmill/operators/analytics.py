"""Summaries over seeds, folds, tokens, runs and training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import micro, per_key, with_metrics


def stats(df: DataFrame, by: list[str], columns: list[str], digits: int = 9, lone_deviation_zero: bool = True) -> DataFrame:
    """mean, sample deviation, min, max of each column per group; one value deviates by 0 or null."""
    out = []
    for c in columns:
        sd = F.round(F.stddev_samp(c), digits)
        out += [F.round(F.avg(c), digits).alias(f"{c}_mean"), (F.coalesce(sd, F.lit(0.0)) if lone_deviation_zero else sd).alias(f"{c}_std"), F.round(F.min(c), digits).alias(f"{c}_min"), F.round(F.max(c), digits).alias(f"{c}_max")]
    return df.groupBy(*by).agg(*out)


def overall_by_seed(doc_key: DataFrame, digits: int = 9) -> DataFrame:
    """condition, seed, micro_f1 and macro_f1."""
    m = micro(doc_key, ["condition", "seed"]).select("condition", "seed", F.round("f1", digits).alias("micro_f1"))
    k = per_key(doc_key, ["condition", "seed"]).groupBy("condition", "seed").agg(F.round(F.avg("f1"), digits).alias("macro_f1"))
    return m.join(k, ["condition", "seed"])


def dense_counts(doc_key: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Zero rows for the documents and keys of a condition and seed that have no counts.

    The grid is documents x keys, which is the result's own size; keys are a closed small set.
    """
    summed = doc_key.groupBy("condition", "seed", "doc_id", "key").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    every = keys or [r["key"] for r in summed.select("key").distinct().orderBy("key").collect()]  # the key universe
    docs = summed.select("condition", "seed", "doc_id").distinct()  # from the sums: what is read is read once
    grid = docs.select("*", F.explode(F.array(*(F.lit(k) for k in every))).alias("key"))
    return grid.join(summed, ["condition", "seed", "doc_id", "key"], "left").na.fill(0, ["tp", "fp", "fn"])


def few_shot_overall(doc_key: DataFrame, conditions: list[str], digits: int = 9) -> DataFrame:
    kept = doc_key.filter(F.col("condition").isin(*conditions))
    m = micro(kept, ["condition"], digits).select("condition", F.col("precision").alias("micro_precision"), F.col("recall").alias("micro_recall"), F.col("f1").alias("micro_f1"))
    k = per_key(kept, ["condition"]).groupBy("condition").agg(F.round(F.avg("f1"), digits).alias("macro_f1"), F.count(F.lit(1)).alias("n_keys"))
    return m.join(k, "condition")


def per_item(doc_key: DataFrame, condition: str, digits: int = 9) -> DataFrame:
    kept = per_key(doc_key.filter(F.col("condition") == condition), digits=digits)
    return kept.select(F.col("key").alias("item"), F.col("gold_items").alias("reference_instances"), "precision", "recall", "f1")


def per_fold(doc_key: DataFrame, documents: int, digits: int = 9) -> DataFrame:
    """Pooled metrics and sizes per condition, seed and fold."""
    by = ["condition", "seed", "fold"]
    pooled = doc_key.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.count_distinct("doc_id").alias("n_eval"))
    told = with_metrics(pooled, digits)
    return told.select(*by, (F.lit(documents) - F.col("n_eval")).alias("n_train"), "n_eval", (F.col("tp") + F.col("fn")).alias("gold_items"), F.col("precision").alias("micro_precision"), F.col("recall").alias("micro_recall"), F.col("f1").alias("micro_f1"))


def fold_stability(doc_key: DataFrame) -> DataFrame:
    """Documents, and whether each is in one fold under all seeds."""
    first = doc_key.groupBy("seed", "doc_id").agg(F.min("fold").alias("fold"))
    return first.groupBy("doc_id").agg(F.count_distinct("fold").alias("n")).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") == 1).alias("stable"), F.bool_and(F.col("n") == 1).alias("identical"))


def fold_pivot(folds: DataFrame, names: list[str], digits: int = 3) -> DataFrame:
    return folds.groupBy("condition", "seed").pivot("fold", names).agg(F.round(F.avg("micro_f1"), digits))


def length_stats(df: DataFrame, length: str, key: str, limit: int) -> DataFrame:
    """One row: percentiles cut to integers, extremes with all their ids, over-limit share."""
    p = F.percentile(length, F.array(*(F.lit(x) for x in (0.5, 0.9, 0.95, 0.99))))
    ends = df.agg(F.min(length).alias("lo"), F.max(length).alias("hi"))
    named = df.join(F.broadcast(ends)).filter((F.col(length) == F.col("lo")) | (F.col(length) == F.col("hi")))  # one row is broadcast
    ids = lambda end: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(length) == F.col(end), F.col(key)))), lambda x: x.cast("string")), ";")
    texts = named.agg(ids("lo").alias("min_ids"), ids("hi").alias("max_ids"))
    told = df.agg(p.alias("p"), F.min(length).alias("min_len"), F.max(length).alias("max_len"), F.count_if(F.col(length) > limit).alias("over"), F.count(F.lit(1)).alias("n"))
    cut = [F.col("p")[i].cast("int").alias(f"p{q}") for i, q in enumerate((50, 90, 95, 99))]
    return told.join(F.broadcast(texts)).select("n", *cut, "min_len", "min_ids", "max_len", "max_ids", "over", F.round(F.col("over") / F.col("n"), 9).alias("over_ratio"))


def longest(df: DataFrame, length: str, order: str, k: int) -> DataFrame:
    """The k longest rows, earlier ones first among equals; each task keeps only k."""
    return df.orderBy(F.desc(length), F.asc(order)).limit(k)


def operations(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, times and token rates of inference logs."""
    t, s = F.col("n_gen_tokens"), F.col("gen_seconds")
    return log.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(~F.coalesce("final_channel_found", F.lit(True))).alias("final_channel_missing"),
        F.count_if(F.col("pred_annotation") == "[]").alias("empty_prediction"),
        F.count_if(F.coalesce("hit_max_new_tokens", F.lit(False))).alias("hit_max_new_tokens"),
        F.round(F.avg(t), 6).alias("gen_tokens_mean"),
        F.max(t).alias("gen_tokens_max"),
        F.round(F.avg(s), 6).alias("sec_per_doc_mean"),
        F.round(F.percentile(s, 0.5), 6).alias("sec_per_doc_median"),
        F.min(s).alias("sec_per_doc_min"),
        F.max(s).alias("sec_per_doc_max"),
        F.round(F.sum(t) / F.sum(s), 6).alias("tok_per_sec"),
    )


def upper_median(c: str) -> Column:
    """The value at place floor(n / 2) of the sorted column; ranks are counted, not collected."""
    return F.expr(f"percentile_disc(0.5) within group (order by {c} desc)")


def loss_history(log: DataFrame, columns: list[str], step: str = "step", order: str = "ord") -> DataFrame:
    """One row per step with the last value that is there of each column."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return log.filter(F.col(step).isNotNull()).groupBy(step).agg(*last)


def retained_checkpoints(points: DataFrame, top: int, recent: int) -> DataFrame:
    """step, class: the `top` best by loss then later step and the `recent` latest, filled up to their sum
    by rank and then by recency. A checkpoint without a finite loss has no rank.

    Both orders are windows over the checkpoints of one run, a small set by nature.
    """
    finite = F.col("val_loss").isNotNull() & ~F.isnan("val_loss") & (F.abs("val_loss") != F.lit(float("inf")))
    best = F.row_number().over(Window.partitionBy("run").orderBy(F.when(finite, F.col("val_loss")).asc_nulls_last(), F.desc("step")))
    late = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("step")))
    ranked = points.withColumn("best", F.when(finite, best)).withColumn("late", late)
    kind = F.when(F.col("best") <= top, 1).when(F.col("late") <= recent, 2).when(F.col("best").isNotNull(), 3).otherwise(4)
    place = F.when(kind.isin(1, 3), F.col("best")).when(kind == 2, -F.col("late")).otherwise(F.col("late"))
    order = F.row_number().over(Window.partitionBy("run").orderBy("class", "place"))
    return ranked.withColumn("class", kind).withColumn("place", place).withColumn("order", order).filter(F.col("order") <= top + recent).select("run", "step", "class", "order")
