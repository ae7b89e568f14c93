"""The end-to-end plans over small files."""

import json

import numpy as np
from pyspark.sql import functions as F

from chartmill.operators import splits
from chartmill.plans import pipelines
from chartmill.sources import files


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_clean_pair_and_score(spark, tmp_path):
    notes = lines(tmp_path / "n", [{"id": 1, "progress_note": "右上葉"}, {"id": 1, "progress_note": "again"}, {"id": 2, "progress_note": " "}, {"id": 3, "progress_note": "x"}, {"id": 4, "progress_note": "y"}])
    told = lines(tmp_path / "a", [{"id": 1, "annotation": "[]"}, {"id": 1, "annotation": '[{"Site": "右肺", "Bad": 1}]'}, {"id": 3, "annotation": "no"}])
    c = pipelines.clean_dataset(spark, notes, told, str(tmp_path / "on"), str(tmp_path / "oa"), ["Site"], {"Stage": ["I"]})
    assert (c["notes_in"], c["missing_annotation"], c["parse_error"], c["clean_rows"]) == (4, 1, 1, 2)
    assert sorted(r["annotation"] for r in spark.read.json(str(tmp_path / "oa")).collect()) == ['[{"Site": "右肺上葉"}]', '[{"Site": "肺"}]']
    pairs = pipelines.paired_dataset(spark, notes, told)
    assert [(r["id"], r["progress_note"]) for r in pairs.orderBy("id").collect()] == [("1", "again"), ("3", "x")]
    pred = lines(tmp_path / "p", [{"id": "1", "pred_annotation": '[{"Site": "右肺"}]'}, {"id": "3", "pred_annotation": "[]"}])
    counts = pipelines.score_files(spark, told, pred)
    assert [(r["key"], r["tp"], r["fp"], r["fn"]) for r in counts.orderBy("key").collect()] == [("Bad", 0, 0, 1), ("Site", 1, 0, 0)]
    assert pipelines.score_summary(counts)["summary"].first()["f1"] == 2 / 3
    folds = pipelines.score_folds(spark, told, {"0": pred, "1": pred})
    assert folds["summary"].first()["tp"] == 2 and folds["per_fold"].count() == 2


def test_inference_resumes(spark, tmp_path):
    notes = lines(tmp_path / "n", [{"id": i, "progress_note": f"t{i}" if i != 5 else "bad"} for i in range(8)])

    def call(prompts):
        if any("bad" in u for _, u in prompts):
            raise ValueError("no")
        return ['[{"Stage": "I"}]' for _ in prompts]

    prompt, out = files.Prompt("s", "{{INPUT}}"), str(tmp_path / "out")
    assert pipelines.run_inference(spark, notes, out, prompt, call, start=0, end=3) == {"made": 3, "failed": 0}
    assert pipelines.run_inference(spark, notes, out, prompt, call) == {"made": 4, "failed": 1}
    assert pipelines.run_inference(spark, notes, out, prompt, call, end=5) == {"made": 0, "failed": 0}
    got = spark.read.json(out)
    assert sorted(r["id"] for r in got.collect()) == ["0", "1", "2", "3", "4", "6", "7"] and {r["pred_annotation"] for r in got.collect()} == {'[{"Stage": "I"}]'}
    log = pipelines.operations_table(spark, {"a": out, "b": str(tmp_path / "none")}, {"a": lines(tmp_path / "env", []) and str(tmp_path / "env")})
    assert [(r["condition"], r["docs"]) for r in log.collect()] == [("a", 7)]
    raw = lines(tmp_path / "raw", [{"id": "1", "raw_pred_annotation": '<|channel|>final<|message|>[{"a": 1}]<|end|>'}, {"id": "2", "raw_pred_annotation": "x"}])
    assert pipelines.reparse_file(spark, raw, str(tmp_path / "re"), strict=True) == {"docs": 2, "no_final_channel": 1, "empty_prediction": 1}


def test_folds_reports_and_orchestration(spark, tmp_path):
    rows = [(f"{i:02d}", f"note {i}", json.dumps([{"Stage": "I"} if i % 2 else {"EGFR": "+", "ALK": None}])) for i in range(20)]
    pairs = spark.createDataFrame(rows, "id string, progress_note string, annotation string")
    folds = pipelines.multilabel_cv_folds(pairs, 4, 1)
    assert np.bincount([r["fold"] for r in folds.collect()]).tolist() == [5, 5, 5, 5]
    counts = {(r["fold"], r["key"]): r["documents"] for r in pipelines.fold_counts(pairs, folds).collect()}
    assert {k for _, k in counts} == {"Stage", "EGFR"} and all(2 <= n <= 3 for n in counts.values())
    split = pipelines.split_dataset(pairs, splits.holdout(20, 0.1, 0.2, 3))
    assert {r["split"]: r["n"] for r in splits.split_sizes(split).collect()} == {"train": 14, "validation": 2, "test": 4}
    report = pipelines.token_report(pairs.withColumnRenamed("progress_note", "text"), limit=6, top=2)
    assert report["stats"].first()["over"] == 10 and report["longest"].count() == 2
    assert pipelines.training_texts(pairs, "G", "</s>").first()["text"].startswith("G\n\n### Input:\nnote")
    cells = [(c, str(s), str(i % 2), f"d{i}", k, (i + s) % 3, 1, i % 2) for c in ("a", "b") for s in (1, 2) for i in range(6) for k in ("x", "p63")]
    doc_key = spark.createDataFrame(cells, "condition string, seed string, fold string, doc_id string, key string, tp bigint, fp bigint, fn bigint")
    assert {k: v.count() for k, v in pipelines.multiseed_report(doc_key).items()} == {"overall_by_seed": 4, "overall_summary": 2, "per_key_summary": 4}
    tables = pipelines.study_tables(spark, doc_key, [("a", "b")], ["a", "b"], 6, resamples=20)
    assert tables["diff_a_b"].filter("excludes_zero").count() == 0 and tables["per_fold"].filter(F.col("n_train") != 3).count() == 0
    ran = []
    stage = lambda s, c, f, path: (ran.append(path), spark.range(1).write.parquet(path))
    args = ([1, 2], ["a"], [0], [("score", stage)], str(tmp_path / "x"))
    assert len(pipelines.experiment(spark, *args, dry=True)) == 2 and not ran
    assert len(pipelines.experiment(spark, *args)) == 2 == len(ran) and pipelines.experiment(spark, *args) == []
    assert not pipelines.unless_there(spark, ran[0], lambda: 1 / 0)
