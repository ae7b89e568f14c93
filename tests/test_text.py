"""Golden cases of the scalar functions."""

import json
import time

import pytest
from pyspark.sql import functions as F

from chartmill.functions import hierarchy, schema, text
from chartmill.functions.lenient_json import parse_events

DATES = {
    "2025/6/1": "2025-06-01", "2025.6.1": "2025-06-01", "2025/6.1": "2025-06-01", "2025-6-1": "2025-06-01", "2025年6月1日": "2025-06-01", "2025/6": "2025-06", "2025.6": "2025-06", "2025-6": "2025-06", "2025年6月": "2025-06",
    " 2025 ": "2025", "2025-13-45": "2025-13-45", "２０２５-６-１": "2025-06-01", "2025-06-01 10:00": "2025-06-01 10:00", "不明": "不明", "2025、6、1": "2025,6,1", "": "", "　": "",
}
ATOMS = [
    ("TumorSize", 24, [("num_int", "24")]), ("TumorSize", "24", [("num_int", "24")]), ("TumorSize", 24.5, [("num_int", "24")]), ("TumorSize", 25.5, [("num_int", "26")]), ("TumorSize", True, [("num_int", "1")]),
    ("TumorSize", "24mm", [("str", "24mm")]), ("TumorSize", "1e3", [("str", "1e3")]), ("TumorSize", ".5", [("str", ".5")]), ("TumorSize", "", [("str", "")]), ("TumorSize", None, [("str", "None")]),
    ("PDL1", 0.35, [("num_float", "0.3")]), ("PDL1", 1.15, [("num_float", "1.1")]), ("PDL1", "12.45", [("num_float", "12.4")]), ("PDL1", "<1", [("str", "<1")]), ("PDL1", "1-49", [("str", "1-49")]), ("PDL1", [1], [("str", "[1]")]),
    ("Treatment", "手術、化学療法", [("str", "手術"), ("str", "化学療法")]), ("Treatment", "手術+化学療法", [("str", "手術"), ("str", "化学療法")]), ("Treatment", ["手術", "化学療法, 手術"], [("str", "手術"), ("str", "化学療法"), ("str", "手術")]),
    ("EGFR", "+", [("str", "+")]), ("EGFR", "-", [("str", "-")]), ("EGFR", ["+"], [("str", "['+']")]), ("EGFR", "＋", [("str", "＋")]), ("EGFR", [], [("str", "[]")]), ("EGFR", 3, [("str", "3")]),
    ("ProcedureDiagnosis", "肺腺癌", [("str", "肺腺がん")]), ("Site", None, []), ("Timestamp", "", []), ("Site", "", []), ("Stage", "", [("str", "")]), ("Stage", None, [("str", "None")]), ("Other", " x ", [("str", "x")]),
]


def test_dates(spark):
    df = spark.createDataFrame(list(DATES.items()), "a string, b string")
    assert [(r["a"], r["c"]) for r in df.select("a", text.normalize_date(F.col("a")).alias("c")).collect()] == list(DATES.items())
    assert spark.range(1).select(text.normalize_date(F.lit(None).cast("string"))).first()[0] == ""


def test_trimming_is_that_of_the_pattern(spark):
    """Every character of the Basic Multilingual Plane at both ends, against the class of white space."""
    texts = [f"{c}a{c}b{c}{c}" for c in (chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000)] + ["", " ", "\u3000 \n", "a \n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(~text.trim_u(F.col("t")).eqNullSafe(F.regexp_replace("t", rf"^{text.SPACE}+|{text.SPACE}+$", ""))).count() == 0
    assert spark.range(1).select(text.normalize_date(F.lit("2025-06-01\n"))).first()[0] == "2025-06-01"


def test_atoms(spark):
    rows = [(i, json.dumps([{k: v}], ensure_ascii=False)) for i, (k, v, _) in enumerate(ATOMS)]
    e = parse_events(F.col("t"))["events"][0]["entries"][0]
    df = spark.createDataFrame(rows, "i int, t string").select("i", e.alias("e")).select("i", text.normalize_atoms(*(F.col(f"e.{c}") for c in ("key", "jtype", "raw", "items", "tenth"))).alias("a"))
    found = {r["i"]: [tuple(x) for x in r["a"]] for r in df.collect()}
    for i, (k, v, want) in enumerate(ATOMS):
        assert found[i] == want, (k, v)


def test_prompts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.render_prompt("A {{CONTEXT}} B {{INPUT}}", F.lit("x"), F.lit("c"))) == "A c B x"
    assert one(text.render_prompt("T", F.lit("x"), F.lit("c"))) == "c\n\nT\n\n### 入力:\nx"
    assert one(text.render_examples(F.array(F.lit("p"), F.lit("q")), "要約")) == "【例1の要約】\np\n\n【例2の要約】\nq"
    raw = "<|channel|>analysis<|message|>a<|end|><|channel|>final<|message|>b<|end|><|channel|>final<|message|> c <|start|><|return|>"
    got, found = text.final_channel(F.lit(raw))
    assert one(got) == "c" and one(found)
    got, found = text.channel_text(F.lit("x<|end|>y"))
    assert one(got) == "x y" and not one(found)


def test_label_masks(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    ids = F.array(*(F.lit(x) for x in (5, 1, 2, 9)))
    assert one(text.mask_labels(ids, [[7], [1, 2]])) == [-100, -100, -100, 9]
    assert one(text.mask_labels(ids, [[7]])) == [5, 1, 2, 9]
    assert one(text.mask_labels(F.array().cast("array<int>"), [[7]])) == []
    assert one(text.pad_labels(ids, F.lit(6))) == [5, 1, 2, 9, -100, -100] and one(text.pad_labels(ids, F.lit(2))) == [5, 1]


def test_label_masks_take_linear_time(spark):
    """Two needles on rows of 3000 ids; one that names its ids or its cut again at each place takes minutes."""
    ids = F.sequence(F.col("id").cast("int"), F.col("id").cast("int") + 2999)
    begin = time.monotonic()
    out = spark.range(20).select("id", text.mask_labels(ids, [[5000, 5002], [2998, 2999]]).alias("m")).collect()
    assert time.monotonic() - begin < 20
    for r in out:
        assert r["m"] == [x if x > 2999 else -100 for x in range(r["id"], r["id"] + 3000)]
    none = spark.range(1).select(text.mask_labels(F.lit(None).cast("array<int>"), [[1]]).alias("m")).first()["m"]
    assert none is None
    holes = F.array(F.lit(None).cast("int"), F.lit(1), F.lit(None).cast("int"), F.lit(2))
    assert spark.range(1).select(text.mask_labels(holes, [[1, 2], [1]]).alias("m")).first()["m"] == [-100, -100, None, 2]


@pytest.mark.parametrize(("pred", "gold", "fits"), [("右上葉肺腺癌", "右肺腺癌", True), ("右肺腺癌", "右上葉肺腺癌", False), ("右上葉肺腺癌", "肺癌", True), ("左上葉肺腺癌", "右肺癌", False), ("肺癌疑い", "肺癌", False), ("肺癌疑い", "肺癌疑い", True), ("謎", "謎", True), ("謎", "肺癌", False), ("右肺門部肺癌", "右肺癌", True)])
def test_hierarchy(spark, pred, gold, fits):
    assert spark.range(1).select(hierarchy.refines(F.lit(pred), F.lit(gold))).first()[0] is fits
    assert hierarchy.refines_text(pred.replace("癌", "がん"), gold.replace("癌", "がん")) is fits


def test_universes():
    assert (len(schema.KEY_TYPES), len(schema.EVAL_KEYS), len(schema.PROMPT_KEYS), len(schema.REPORTED_KEYS), len(schema.DIAGNOSES)) == (41, 40, 39, 37, 53)
