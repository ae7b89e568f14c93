"""Assignment against brute force, scoring goldens, cleaning goldens, splits and files."""

import itertools
import json

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartmill.functions import schema
from chartmill.functions.lenient_json import parse_events
from chartmill.operators import align, analytics, cleaning, generation, resampling, scoring, splits
from chartmill.sources import files
from chartmill.streaming.resume import generate_stream


@given(st.integers(1, 5), st.integers(1, 5), st.data())
def test_assignment_is_best(n, m, data):
    score = np.array(data.draw(st.lists(st.lists(st.integers(0, 4), min_size=m, max_size=m), min_size=n, max_size=n)))
    chosen = scoring.best_assignment(score)
    assert len(set(chosen)) == n
    total = sum(score[i, j] for i, j in enumerate(chosen) if j < m)
    wide = np.zeros((n, max(n, m)), int)
    wide[:, :m] = score
    assert total == max(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), n))


@pytest.mark.parametrize(("score", "want"), [([[2, 2], [1, 0]], [1, 0]), ([[2, 1], [1, 0]], [0, 1]), ([[1, 1], [1, 1]], [0, 1]), ([[1], [1]], [0, 1])])
def test_ties(score, want):
    assert scoring.best_assignment(np.array(score)).tolist() == want


def _parsed(spark, rows):
    return spark.createDataFrame([(i, json.dumps(t, ensure_ascii=False)) for i, t in rows], "id string, t string").select("id", parse_events(F.col("t"))["events"].alias("events"))


def test_score(spark):
    gold = _parsed(spark, [("1", [{"Stage": "a"}, {"Stage": "b", "TBB": "x"}]), ("2", [{"Stage": "a"}]), ("3", []), ("4", [{"ProcedureDiagnosis": "肺癌"}])])
    pred = _parsed(spark, [("1", [{"Stage": "b", "TBLB": "x"}, {"Stage": "c"}]), ("2", []), ("3", [{"Stage": "z"}]), ("4", [{"ProcedureDiagnosis": "右肺癌"}]), ("9", [{}])])
    got = {(r["id"], r["key"]): (r["tp"], r["fp"], r["fn"]) for r in scoring.score(gold, pred).collect()}
    assert got == {("1", "Stage"): (1, 1, 1), ("1", "TBB_TBLB"): (1, 0, 0), ("2", "Stage"): (0, 0, 1), ("3", "Stage"): (0, 1, 0), ("4", "ProcedureDiagnosis"): (0, 1, 1)}
    got = {r["id"]: (r["tp"], r["fp"], r["fn"]) for r in scoring.score(gold, pred, hierarchical=True).filter("id = '4'").collect()}
    assert got == {"4": (1, 0, 0)}
    empty = scoring.per_key(scoring.score(gold.filter("false"), pred))
    assert empty.collect() == []


def test_clean(spark):
    notes = spark.createDataFrame([("1", "右上葉に結節"), ("2", ""), ("3", "x"), ("4", "y")], "id string, progress_note string")
    raw = [("1", '[{"Timestamp": "2025", "Site": "右肺, 左肺", "Treatment": "手術, 化学療法, 手術", "Bad": 1}, {"Timestamp": "2025"}, {"Stage": "x"}, {"Stage": "x"}]'), ("2", "oops"), ("3", '[{"Bad": 1}]'), ("4", '[{"Treatment": "未知療法", "Stage": "a\\"b"}]')]
    stages = cleaning.clean(notes, spark.createDataFrame(raw, "id string, annotation string"), ["Timestamp", "Site", "Treatment", "Stage"], {"Treatment": ["手術", "化学療法"]})
    out = {r["id"]: json.loads(r["annotation"]) for r in cleaning.cleaned(stages).collect()}
    assert out == {"1": [{"Timestamp": "2025", "Site": "右肺上葉, 肺", "Treatment": "手術, 化学療法"}, {"Stage": "x"}], "4": [{"Stage": 'a"b'}]}
    c = cleaning.counters(stages, {"Treatment": ["手術", "化学療法"]}).first().asDict()
    assert c == {"annotated": 4, "parse_error": 1, "empty": 1, "clean_rows": 2, "unknown_keys": 2, "events_after_unknown": 1, "other_value_tokens": 1, "keys_after_values": 1, "events_after_values": 0, "timestamp_only_events": 1, "repeated_events": 1}
    assert [tuple(r) for r in cleaning.dropped_tokens_by_key(stages, {"Treatment": ["手術", "化学療法"]}).collect()] == [("Treatment", 1)]


def test_splits():
    parts = splits.holdout(100, 0.1, 0.2, 7)
    assert {k: len(v) for k, v in parts.items()} == {"test": 20, "validation": 10, "train": 70} and sorted(np.concatenate(list(parts.values()))) == list(range(100))
    order = np.arange(100)
    np.random.default_rng(7).shuffle(order)
    assert parts["test"].tolist() == order[:20].tolist()
    assert {k: len(v) for k, v in splits.holdout(3, 0.9, 0.05, 1).items()} == {"test": 1, "validation": 1, "train": 1}
    cv = splits.cross_validation(23, 5, 4, 1, 100)
    assert sorted(np.concatenate(list(cv.values()))) == list(range(23)) and len(cv["train"]) == 1
    y = (np.random.default_rng(0).random((200, 6)) < [0.5, 0.3, 0.1, 0.05, 0.9, 0.02]).astype(int)
    f = splits.multilabel_folds(y, 5, 3)
    assert (f >= 0).all() and np.bincount(f).max() - np.bincount(f).min() <= 6
    for label in range(4):
        n = np.bincount(f[y[:, label] > 0], minlength=5)
        assert n.max() - n.min() <= 2
    mix = splits.epoch_mixture(4, 10, 3, 2, 5)
    assert [len(e) for e in mix] == [7, 7] and set(mix[0].tolist()) >= {0, 1, 2, 3} and mix[0].tolist() != mix[1].tolist()


def test_ranks_and_slices(spark):
    df = spark.createDataFrame([(i * 7 % 101, "x") for i in range(101)], "k bigint, v string")
    got = sorted((r["k"], r["rank"]) for r in align.with_rank(df, "k").collect())
    assert got == [(i, i) for i in range(101)]
    assert sorted(r["k"] for r in align.slice_rows(df, "k", 5, 9).collect()) == [5, 6, 7, 8]
    assert align.slice_rows(df, "k", -3, 0).count() == 101 and align.slice_rows(df, "k", 90, 500).count() == 11
    words = spark.createDataFrame([(f"{i:03d}",) for i in range(60)], "k string")
    assert sorted((r["k"], r["rank"]) for r in align.with_rank(words, "k").collect()) == [(f"{i:03d}", i) for i in range(60)]
    with pytest.raises(Exception, match="differ"):
        align.aligned(words.withColumnRenamed("k", "id"), words.limit(3).withColumnRenamed("k", "id"), strict=True).collect()


def test_resampling_agrees_with_pooling(spark):
    rows = [(c, str(s), "0", str(doc), k, (doc + s) % 3, doc % 2, (doc * s) % 4) for c in ("a", "b") for s in (1, 2) for doc in range(6) for k in ("x", "y")]
    df = spark.createDataFrame(rows, "condition string, seed string, fold string, doc_id string, key string, tp bigint, fp bigint, fn bigint")
    ones = df.select("doc_id").distinct().select("doc_id", F.lit(0).alias("b"), F.lit(1).alias("w"))
    got = {(r["condition"], r["seed"]): (r["micro"], r["macro"]) for r in resampling.weighted_scores(df, ones).collect()}
    want = {(r["condition"], r["seed"]): (r["micro_f1"], r["macro_f1"]) for r in analytics.overall_by_seed(df).collect()}
    assert got == want
    boot = resampling.bootstrap(spark, df, 50, block=20)
    assert boot.count() == 100 and boot.filter("micro < 0 or micro > 1").count() == 0
    p = resampling.permutation(spark, df, [("a", "b")], 30, block=7).collect()
    assert {r["metric"] for r in p} == {"micro_f1", "macro_f1"} and all(r["p"] == 1.0 for r in p)


def test_generation_and_streams(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a"), ("2", "bad"), ("3", None)], "id string, text string")

    def call(prompts):
        if any("bad" in u for _, u in prompts):
            raise ValueError("no")
        return [u.upper() for _, u in prompts]

    got = {r["id"]: (r["output"], r["error"]) for r in generation.job(rows, spark.createDataFrame([], "id string"), "s", "{{INPUT}}", call).collect()}
    assert got == {"1": ("A", None), "2": (None, "ValueError: no")}
    assert generation.example_context("7", list(range(9)), 3, 42) == generation.example_context("7", list(range(9)), 3, 42)
    rows.na.fill("z").write.json(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        generate_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), "s", "{{INPUT}}").awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "é"}\n\n{"id": 2}\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, t string").collect()] == [("1", "é"), ("2", None)]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n[1]\n{"id": \n')
    with pytest.raises(Exception, match="not a JSON row"):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id string").collect()
    assert files.read_done_ids(spark, str(tmp_path / "b.jsonl")).count() == 1 and files.read_done_ids(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "t.tsv").write_text("a\tb\n01\t\n")
    assert files.read_tsv(spark, str(tmp_path / "t.tsv"), "a string, b string", ("b",)).first().asDict() == {"a": "01", "b": ""}
    (tmp_path / "e").write_text("A=1\nB=x=y\nnote\n")
    assert files.read_settings(spark, str(tmp_path / "e")) == {"A": "1", "B": "x=y"}
    user = "- JSONキー: Stage\n  候補値: [“Ⅰ”,\n 'Ⅱ']\n- JSONキー: Site\n"
    assert files.parse_prompt(f'system = "s"\nuser = """{user}"""').system == "s"
    assert files.prompt_keys(user) == ["Site", "Stage"] and files.prompt_candidates(user) == {"Stage": ["Ⅰ", "Ⅱ"]}
    assert files.load_candidates('{"keys": {"K": {"allowed_values": ["a", " "]}}}') == ({"K": ["a"]}, "schema")
    df = spark.createDataFrame([("10", 0.5), ("9", 0.25)], "id string, x double")
    files.write_tsv(df, str(tmp_path / "o"), digits=2)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "o")).collect() if "id" not in r["value"]) == ["10\t0.50", "9\t0.25"]
    files.replace_sorted(df, str(tmp_path / "s"))
    files.replace_sorted(df.limit(1), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 1


def test_sorted_replacement_survives_a_stop(spark, tmp_path):
    path = tmp_path / "s"
    df = spark.createDataFrame([("10", 1), ("9", 2), ("-3", 3)], "id string, x int")
    files.replace_sorted(df, str(path))
    assert [r["id"] for r in files.read_jsonl(spark, str(path), "id string", numbered=True).orderBy("line_no").collect()] == ["-3", "9", "10"]
    for bad in ("x", None, "1.5e"):
        with pytest.raises(Exception, match="no numeric id"):
            files.replace_sorted(spark.createDataFrame([("1", 1), (bad, 2)], "id string, x int"), str(path))
    assert files.read_jsonl(spark, str(path), "id string").count() == 3  # a failure leaves the old rows
    path.rename(f"{path}.old")
    files.restore_replaced(spark, str(path))
    assert files.read_jsonl(spark, str(path), "id string").count() == 3 and not (tmp_path / "s.old").exists()
    files.write_jsonl(df.limit(1), f"{path}.old")
    files.restore_replaced(spark, str(path))
    assert files.read_jsonl(spark, str(path), "id string").count() == 3 and not (tmp_path / "s.old").exists()


def test_shards_lines_and_folds(spark, tmp_path):
    for i in (1, 2, 10):
        (tmp_path / f"shard_{i}.jsonl").write_text(f'{{"id": "{i}a"}}\n\n{{"id": "{i}b"}}\n')
    merged = files.merged_shards(spark, str(tmp_path / "shard_*.jsonl")).orderBy("place").collect()
    assert [r["place"] for r in merged] == list(range(9)) and [json.loads(r["value"])["id"] for r in merged if r["value"]] == ["1a", "1b", "2a", "2b", "10a", "10b"]
    names = spark.createDataFrame([("a10b2",), ("a9b10",), ("a10b",), ("a010b1",), ("b",), ("",)], "n string")
    assert [r["n"] for r in names.orderBy(files.version_key(F.col("n"))).collect()] == ["", "a9b10", "a10b", "a010b1", "a10b2", "b"]
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n\n[2]\n')
    with pytest.raises(Exception, match="bad.jsonl line 3"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id string", numbered=True).collect()
    rows = files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id string", strict=False, numbered=True).collect()
    assert [(r["line_no"], r["id"]) for r in rows] == [(1, "1")]
    told = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "id string, fold int")
    told.write.partitionBy("fold").json(str(tmp_path / "folds"))
    assert {r["id"]: r["fold"] for r in files.read_fold_map(spark, str(tmp_path / "folds")).collect()} == {"a": 0, "b": 1, "c": 1}
    told.withColumn("fold", F.col("fold") + 1).write.mode("append").partitionBy("fold").json(str(tmp_path / "folds"))
    with pytest.raises(Exception, match="in two folds"):
        files.read_fold_map(spark, str(tmp_path / "folds")).collect()


def test_prompt_files_that_are_not_sound():
    sound = 'system = "s"\nuser = """\nAsk {x}  \n"""'
    assert files.prompt_user(sound) == "Ask {x}" and files.prompt_user("system = oops\n" + sound.split("\n", 1)[1]) == "\nAsk {x}"
    with pytest.raises(ValueError):
        files.prompt_user("user = nothing")


def test_retries_preview_and_named_jobs(spark):
    waits, calls = [], []

    def shaky(prompts):
        calls.append(prompts)
        if len(calls) < 4:
            raise TimeoutError("busy")
        return ["ok"] * len(prompts)

    real, generation.time.sleep = generation.time.sleep, waits.append
    try:
        assert generation.with_retries(shaky, first_wait=10, most_wait=30, seed=1)([("a", "b")]) == ["ok"] and len(calls) == 4
        first = list(waits)
        assert [5 <= first[0] <= 10, 10 <= first[1] <= 20, 15 <= first[2] <= 30] == [True] * 3
        calls.clear(), waits.clear()
        generation.with_retries(shaky, first_wait=10, most_wait=30, seed=1)([("a", "b")])
        assert waits == first
        with pytest.raises(KeyError):
            generation.with_retries(lambda p: {}[1], seed=1)([("a", "b")])
        calls.clear()
        with pytest.raises(TimeoutError):
            generation.with_retries(shaky, attempts=2)([("a", "b")])
    finally:
        generation.time.sleep = real
    rows = spark.createDataFrame([("1", "x", "c"), ("2", None, "c"), ("3", "y", "c"), ("4", "z", "c")], "id string, text string, context string")
    shown, counts = generation.preview(rows, rows.filter("id = '1'"), "<{{INPUT}}>", 1)
    assert [tuple(r) for r in shown.collect()] == [("3", "<y>")] and counts.first().asDict() == {"total": 4, "done": 1, "missing": 1, "todo": 2}
    made = {n: generation.named_job(n, rows, None, "s").count() for n in generation.JOBS}
    assert made == dict.fromkeys(generation.JOBS, 3)


def test_rows_that_must_be_there(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "id string")
    assert align.require_rows(df, "rows") is df
    with pytest.raises(ValueError, match="no pairs left"):
        align.require_rows(df.filter("false"), "pairs")
    ids = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    assert [r["id"] for r in align.members(df, ids).collect()] == ["a"] and {r["id"] for r in align.members(df, ids, keep=False).collect()} == {"b", None}


def test_report_in_its_order(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("c", 0.5)], "k string, x double").repartition(3)
    files.write_report(df, str(tmp_path / "r"), ["k"])
    lines = files.with_line_numbers(spark, str(tmp_path / "r")).orderBy("line_no").collect()
    assert [r["value"].split("\t")[0] for r in lines if not r["value"].startswith("k\t")] == ["a", "b", "c"]


def test_line_numbers_of_many_blocks(spark, tmp_path):
    """Files cut into blocks of some lines, numbered where they lie: no line is sorted or moved."""
    (tmp_path / "b").mkdir()
    for k in (10, 2, 1):
        (tmp_path / "b" / f"part_{k}.txt").write_text("".join(f"{k}-{i}\n" for i in range(300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256b")
    try:
        lines = files.with_line_numbers(spark, str(tmp_path / "b"))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning" not in plan
        rows = lines.orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["line_no"], r["value"]) for r in rows] == list(enumerate(f"{k}-{i}" for k in (1, 2, 10) for i in range(300)))


def test_small_assignments_are_those_of_arrays(monkeypatch):
    """Lists and arrays choose the same columns, ties too."""
    rng = np.random.default_rng(5)
    for _ in range(500):
        score = rng.integers(0, rng.integers(1, 6), rng.integers(1, 9, 2))
        small = scoring.best_assignment(score).tolist()
        monkeypatch.setattr(scoring, "SMALL", 0)
        assert scoring.best_assignment(score).tolist() == small
        monkeypatch.undo()


def test_hierarchical_units_of_many_events(spark):
    """Seventeen events a side with two units each, in turned order: every unit finds its partner."""
    labels = list(schema.DIAGNOSES)
    rows = [("d", o if side == "gold" else -o, scoring.DIAGNOSIS, "str", labels[(2 * o + u) % len(labels)], side) for side in ("gold", "pred") for o in range(17) for u in range(2)]
    out = scoring.matched_items(spark.createDataFrame(rows, "id string, ord int, key string, tag string, atom string, side string"), hierarchical=True).first()
    assert (out["tp"], out["fp"], out["fn"]) == (34, 0, 0)
