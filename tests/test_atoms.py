"""Atoms told in Python against those of the columns, and scoring of texts against scoring of parsed events."""

import itertools
import json

from pyspark.sql import functions as F

from chartmill.functions import schema, text
from chartmill.functions.atoms import Multisets, atoms_of
from chartmill.functions.lenient_json import parse_events
from chartmill.operators import scoring
from chartmill.plans.registry import QUERIES
from tests.test_text import ATOMS, DATES

KEYS = [*schema.DATE_KEYS, *schema.NUMBER_KEYS, "ProcedureDiagnosis", "Site", "Stage", "TBB", "TBLB", "Other"]
VALUES = [
    None, True, False, 0, -0.0, 1, 1.0, 24, 24.5, 25.5, -2.5, 0.35, 1.15, 10**17, 1e15, [], ["+"], [None, 1, "a、b"], ["", "　"], {"a": "b, c"}, {}, "", " ", "　", "+", "＋", "-", "+5", "＋5", "-0.4", "２４", "２４．５", "24.5", "٣", "1e3", ".5", "5.", "24mm",
    " 肺癌 , 右肺癌", "肺癌 ", "a++b", "、", ",", "x\n", "\x1cx\x85", "2025-06-01\n", "2025-6", "2025年 6月　1日", "２０２５年６月", "2025/06/1x", "None", "null",
    *DATES, *(v for _, v, _ in ATOMS),
]


def test_atoms_are_those_of_the_columns(spark):
    cases = [(k, v) for k, v in itertools.product(KEYS, VALUES)]
    rows = [(i, json.dumps([{k: v}], ensure_ascii=False)) for i, (k, v) in enumerate(cases)]
    e = parse_events(F.col("t"))["events"][0]["entries"][0]
    df = spark.createDataFrame(rows, "i int, t string").repartition(4).select("i", e.alias("e")).select("i", text.normalize_atoms(*(F.col(f"e.{c}") for c in ("key", "jtype", "raw", "items", "tenth"))).alias("a"))
    want = {r["i"]: [tuple(x) for x in r["a"]] for r in df.collect()}
    assert {i: atoms_of(k, v) for i, (k, v) in enumerate(cases)} == want


def test_numbers_past_all_integers_stay_text():
    assert atoms_of("TumorSize", float("nan")) == [("str", "nan")]
    assert atoms_of("TumorSize", float("-inf")) == [("str", "-inf")]
    assert atoms_of("TumorSize", 10**400) == [("str", str(10**400))]
    assert atoms_of("TumorSize", "9" * 400) == [("str", "9" * 400)]
    assert atoms_of("PDL1", 10**400) == [("num_float", None)]


def test_entries_that_are_equal_in_python_stay_apart():
    told = Multisets()
    assert told.events('[{"Other": 1}, {"Other": 1.0}, {"Other": true}, {"Other": "1"}, 5, {}]') == [{"Other": {("str", x): 1}} for x in ("1", "1.0", "True", "1")] + [{}]
    assert told.events('[{"TBB": "x", "TBLB": "x, y"}, {"TBB": "x"}]') == [{"TBB_TBLB": {("str", "x"): 2, ("str", "y"): 1}}, {"TBB_TBLB": {("str", "x"): 1}}]
    assert told.events(None) == told.events("oops") == told.events("5") == []


def test_scored_texts_are_as_scored_events(spark):
    texts = [json.dumps([{k: v, "Stage": "a"}, {"ProcedureDiagnosis": "右肺癌, 肺癌"}], ensure_ascii=False) for k in KEYS for v in VALUES[::3]]
    texts += ["```json\n" + texts[0] + "\n```", texts[1][:-1], texts[2].replace("}", ",}"), "oops", "5", '{"Stage": "a"}', "[]", None]
    rows = [(i, t, texts[(i * 7 + 3) % len(texts)]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, g string, p string").repartition(4).cache()
    side = lambda c: df.select("id", F.col(c).alias("text"))
    parsed = lambda c: df.select("id", parse_events(F.col(c))["events"].alias("events"))
    for hierarchical in (False, True):
        got = {tuple(r) for r in scoring.score_texts(side("g"), side("p"), hierarchical).collect()}
        assert got == {tuple(r) for r in scoring.score(parsed("g"), parsed("p"), hierarchical).collect()} and len(got) > 200


def test_scored_texts_have_a_small_plan(spark):
    """What is told of values is no part of the plan, of which the driver holds copies for each stage."""
    df = spark.createDataFrame([("1", "[]")], "id string, text string")
    plan = lambda x: len(x._jdf.queryExecution().optimizedPlan().toString())
    assert plan(scoring.score_texts(df, df, True)) < 2000


def test_decimals_of_the_query(spark):
    """It failed in analysis while Python's rounding stood within a lambda."""
    d = "/root/testdata/sf0.001"
    want: dict[str, int] = {}
    for r in spark.read.parquet(f"{d}/lineitem.parquet").select("l_discount", "l_quantity").collect():
        atom = f"{r[0] * r[1]:.1f}"
        want[atom] = want.get(atom, 0) + 1
    assert {r["atom"]: r["n"] for r in QUERIES["normalize_number_float"](spark, d).collect()} == want
