"""What users run end to end: readers, operators and sinks put together.

Paths may be on any store that Spark reaches. Outputs are folders of part files, committed whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lenient_json as lj
from ..functions import schema
from ..functions import text as tx
from ..operators import align, analytics, cleaning, generation, resampling, scoring, splits
from ..sources import files


def _keyed(spark: SparkSession, path: str, key: str, value: str, name: str) -> DataFrame:
    """id and one text column of a JSONL file, blank rows left out."""
    rows = files.read_jsonl(spark, path, f"`{key}` string, `{value}` string").select(F.col(key).alias("id"), F.col(value).alias(name))
    return align.present(rows, ["id", name])


def _last_of_file(spark: SparkSession, path: str, key: str, value: str, name: str) -> DataFrame:
    """The last row of each id in a file's order."""
    lines = files.with_line_numbers(spark, path).filter(F.trim("value") != "")
    rows = lines.select("line_no", F.from_json("value", f"`{key}` string, `{value}` string").alias("r")).select("line_no", F.col(f"r.{key}").alias("id"), F.col(f"r.{value}").alias(name))
    return align.last_wins(rows.filter(F.col("id").isNotNull()), "id", "line_no").drop("line_no")


def unless_there(spark: SparkSession, path: str, make: Callable[[], object]) -> bool:
    """Run a step unless its output is complete; whether it ran."""
    if files.exists(spark, f"{path}/_SUCCESS"):
        return False
    make()
    return True


def clean_dataset(spark: SparkSession, notes: str, annotations: str, out_notes: str, out_annotations: str, allowed_keys: list[str] | None = None, allowed_values: dict[str, list[str]] | None = None, id_key: str = "id", note_key: str = "progress_note", annotation_key: str = "annotation", sites: bool = True, timestamp_only: bool = True, deduplicate: bool = True) -> dict:
    """Clean annotations against their notes, write both and return the counters."""
    left = _keyed(spark, notes, id_key, note_key, "progress_note")
    right = _last_of_file(spark, annotations, id_key, annotation_key, "annotation")
    stages = cleaning.clean(left, right, allowed_keys, allowed_values, sites, timestamp_only, deduplicate)
    kept = cleaning.cleaned(stages)
    files.write_jsonl(kept.select(F.col("id").alias(id_key), F.col("progress_note").alias(note_key)), out_notes)
    files.write_jsonl(kept.select(F.col("id").alias(id_key), F.col("annotation").alias(annotation_key)), out_annotations)
    told = cleaning.counters(stages, allowed_values or {"": [""]}).first().asDict()
    return {"notes_in": left.count(), "missing_annotation": align.unmatched(left, right).count(), **told}


def paired_dataset(spark: SparkSession, notes: str, annotations: str, id_key: str = "id", note_key: str = "progress_note", annotation_key: str = "annotation", limit: int = 0) -> DataFrame:
    """id, progress_note, annotation of ids with both texts, the last of each file; first ids if limited."""
    sides = [align.present(_last_of_file(spark, p, id_key, k, n), [n]) for p, k, n in ((notes, note_key, "progress_note"), (annotations, annotation_key, "annotation"))]
    return align.pair_by_id(*sides, limit=limit)


def score_files(spark: SparkSession, gold: str, pred: str, gold_key: str = "annotation", pred_key: str = "pred_annotation", id_key: str = "id", hierarchical: bool = False, strict: bool = False) -> DataFrame:
    """id, key, tp, fp, fn of predictions against references; strict raises when ids differ."""
    g, p = (_last_of_file(spark, path, id_key, value, "text") for path, value in ((gold, gold_key), (pred, pred_key)))
    if strict:
        align.aligned(g.select("id"), p.select("id"), strict=True).count()
    return scoring.score_texts(g, p, hierarchical)


def score_summary(doc_key: DataFrame) -> dict[str, DataFrame]:
    """Micro totals, metrics per document and per key."""
    return {"summary": scoring.micro(doc_key), "per_example": scoring.micro(doc_key, ["id"]), "per_key": scoring.per_key(doc_key)}


def score_folds(spark: SparkSession, gold: str, folds: dict[str, str], **options) -> dict[str, DataFrame]:
    """Every fold scored on its own, and the folds' counts pooled."""
    parts = [score_files(spark, gold, pred, **options).withColumn("fold", F.lit(name)) for name, pred in folds.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return {"per_fold": scoring.micro(every, ["fold"]), "summary": scoring.micro(every), "per_key": scoring.per_key(every)}


def multiseed_report(doc_key: DataFrame) -> dict[str, DataFrame]:
    """By seed, over seeds, and per key over seeds, from (condition, seed, doc_id, key, tp, fp, fn)."""
    by_seed = analytics.overall_by_seed(doc_key)
    per_key = analytics.stats(scoring.per_key(doc_key, ["condition", "seed"]), ["condition", "key"], ["precision", "recall", "f1", "gold_items", "pred_items"])
    return {"overall_by_seed": by_seed, "overall_summary": analytics.stats(by_seed, ["condition"], ["micro_f1", "macro_f1"]), "per_key_summary": per_key}


def study_tables(spark: SparkSession, doc_key: DataFrame, pairs: list[tuple[str, str]], conditions: list[str], documents: int, resamples: int = 10_000, seed: int = 20260924) -> dict[str, DataFrame]:
    """Intervals, differences, permutation tests, few-shot and fold tables of one study."""
    reported = doc_key.filter(~F.col("key").isin(*schema.UNREPORTED_KEYS))
    draws = resampling.bootstrap(spark, reported, resamples, seed)
    out = {"overall_ci": resampling.intervals(draws), "permutation": resampling.permutation(spark, reported, pairs, resamples, seed)}
    out |= {f"diff_{a}_{b}": resampling.differences(draws, a, b) for a, b in pairs}
    return out | {"few_shot_overall": analytics.few_shot_overall(reported, conditions), "per_fold": analytics.per_fold(reported, documents), "fold_stability": analytics.fold_stability(reported)}


def multilabel_cv_folds(pairs: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """id, fold of annotated documents, stratified by the evaluation keys they hold."""
    parsed = pairs.select("id", lj.parse_events(F.col("annotation"))["events"].alias("events"))
    present = cleaning.presence_matrix(cleaning.keys_present(parsed), list(schema.EVAL_KEYS))
    matrix = pairs.select("id").join(present, "id", "left").na.fill(0).orderBy("id").toPandas()  # the labelled study set
    folds = splits.multilabel_folds(matrix.drop(columns="id").to_numpy(), k, seed)
    return pairs.sparkSession.createDataFrame([(i, int(f)) for i, f in zip(matrix["id"], folds, strict=True)], "id string, fold int")


def fold_counts(pairs: DataFrame, folds: DataFrame) -> DataFrame:
    """Documents per fold and evaluation key."""
    parsed = pairs.select("id", lj.parse_events(F.col("annotation"))["events"].alias("events"))
    return cleaning.keys_present(parsed).join(folds, "id").groupBy("fold", "key").agg(F.count_distinct("id").alias("documents"))


def run_inference(spark: SparkSession, notes: str, out: str, prompt: files.Prompt, call: generation.Generator = generation.echo, id_key: str = "id", note_key: str = "progress_note", start: int = 0, end: int = 0, channels: bool = False, most: int = 64, examples: list[str] | None = None, seed: int = 42) -> dict:
    """Predict the notes at places start..end-1 that the output does not hold yet, and append them.

    The slice is by place in the input, before what is done is left out, so a restart goes on where
    it stopped. Rows whose call fails are written beside the output.
    """
    numbered = files.with_line_numbers(spark, notes).filter(F.trim("value") != "").select("line_no", F.from_json("value", f"`{id_key}` string, `{note_key}` string").alias("r"))
    rows = align.slice_rows(numbered.select("line_no", F.col(f"r.{id_key}").alias("id"), F.col(f"r.{note_key}").alias("text")), "line_no", start, end)
    todo = align.unmatched(align.present(rows, ["id", "text"]), files.read_done_ids(spark, out) if files.exists(spark, out) else rows.select("id").limit(0))
    if examples:
        todo = generation.with_examples(todo, examples, min(3, len(examples)), seed)
    made = generation.generate(todo, prompt.system, prompt.user, call, "context" if examples else None)
    staged = f"{out}.staged"
    made.write.mode("overwrite").parquet(staged)
    made = spark.read.parquet(staged)
    told = generation.predictions(made, channels, most).join(made.select("id", F.col("input").alias(note_key), "n_gen_tokens", "gen_seconds"), "id")
    files.write_jsonl(told, out, "append")
    failed = made.filter("error is not null").select("id", "error")
    files.write_jsonl(failed, f"{out}.errors", "append")
    return {"made": told.count(), "failed": failed.count()}


def token_report(rows: DataFrame, text: str = "text", limit: int = 12_000, top: int = 5, tokenize: Callable[[str], int] | None = None) -> dict[str, DataFrame]:
    """Length statistics and the longest rows of (id, text)."""
    measured = generation.token_lengths(rows, text, tokenize).select("id", F.col("length").cast("bigint").alias("length"))
    return {"stats": analytics.length_stats(measured, "length", "id", limit), "longest": analytics.longest(measured, "length", "id", top)}


def training_texts(pairs: DataFrame, guideline: str, end: str) -> DataFrame:
    """id, text to train on."""
    return pairs.select("id", tx.training_text(guideline, F.col("progress_note"), F.col("annotation"), end).alias("text"))


def split_dataset(pairs: DataFrame, parts: dict) -> DataFrame:
    """pairs with their split, by rank of id; see chartmill.operators.splits for the parts."""
    return splits.assigned(align.with_rank(pairs, "id"), parts)


def reparse_file(spark: SparkSession, path: str, out: str, strict: bool = False, most: int = 64) -> dict:
    """Predictions of a run told anew from its raw texts; counts of what was not found or empty."""
    raw = files.read_jsonl(spark, path, "id string, raw_pred_annotation string, n_gen_tokens int, gen_seconds double")
    told = generation.reparse(raw, strict, most)
    files.write_jsonl(told, out)
    return told.agg(F.count(F.lit(1)).alias("docs"), F.count_if(~F.col("final_channel_found")).alias("no_final_channel"), F.count_if(F.col("pred_annotation") == "[]").alias("empty_prediction")).first().asDict()


def operations_table(spark: SparkSession, runs: dict[str, str], settings: dict[str, str] | None = None) -> DataFrame:
    """One row per run of its log, with the model named in the run's settings file."""
    log = files.read_registry(spark, {c: [p] for c, p in runs.items()}, "id string, pred_annotation string, n_gen_tokens int, gen_seconds double, final_channel_found boolean, hit_max_new_tokens boolean")
    table = analytics.operations(log, ["condition"])
    models = {c: files.read_settings(spark, p).get("MODEL_ID", "") for c, p in (settings or {}).items()}
    return table.join(spark.createDataFrame(list(models.items()), "condition string, model_id string"), "condition", "left")


def experiment(spark: SparkSession, seeds: list[int], conditions: list[str], folds: list[int], stages: list[tuple[str, Callable[[int, str, int, str], None]]], base: str, dry: bool = False) -> list[str]:
    """Run stages for every seed, condition and fold whose output is not there; the paths that ran."""
    ran = []
    for seed in seeds:
        for condition in conditions:
            for fold in folds:
                for name, stage in stages:
                    path = f"{base}/seed={seed}/{condition}/folds/fold={fold}/{name}"
                    if not files.exists(spark, f"{path}/_SUCCESS"):
                        ran.append(path)
                        if not dry:
                            stage(seed, condition, fold, path)
    return ran
