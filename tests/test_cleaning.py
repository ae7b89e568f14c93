"""Cleaning: candidates against their statement in Python, what the plan computes, and scans of damaged JSON against plain ones."""

import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartmill.functions import lenient_json as lj
from chartmill.operators import cleaning
from chartmill.plans.registry import QUERIES

ALLOWED = {"Treatment": ["手術", "化学療法", "a,b", 'q"', " x", "", "1", "back\\"], "Only": ["a,b", " x"], "Free": []}
VALUES = ["手術", "手術, 化学療法", "手術、手術，未知", "未知", "", " ", "a,b", 'q"', 'q", 手術', "x", " x", "1", 1, None, True, [], ["手術", "化学療法、手術"], ["a"], "手術 ", "back\\", "a+b"]


def _left(key, value):
    """A value of a limited key: its distinct tokens among the candidates, as one text; None if it goes."""
    texts = [] if value is None else [str(x) for x in value] if isinstance(value, list) else [str(value)]
    tokens = [t for x in texts for t in (p.strip() for p in re.split("[,、，]+", x)) if t]
    return ", ".join(dict.fromkeys(t for t in tokens if t in ALLOWED[key])) or None


def test_values_are_those_among_candidates(spark):
    for allowed in (ALLOWED, {"Only": ALLOWED["Only"]}):
        events = [{k: v, "Stage": "s"} for k in ("Treatment", "Only", "Free", "Other") for v in VALUES] + [{"Treatment": "未知"}, {"Treatment": "手術", "Only": "a,b"}]
        df = spark.createDataFrame([(i, json.dumps([e], ensure_ascii=False)) for i, e in enumerate(events)], "i int, t string").repartition(4)
        kept = df.select("i", cleaning.drop_other_values(lj.parse_events(F.col("t"))["events"], allowed).alias("e"))
        got = {r["i"]: json.loads(r["j"]) for r in kept.select("i", lj.events_json(F.col("e")).alias("j")).collect()}
        for i, e in enumerate(events):
            told = {k: _left(k, v) if allowed.get(k) else v for k, v in e.items()}
            told = {k: v for k, v in told.items() if v is not None or not allowed.get(k)}
            assert got[i] == ([told] if told else []), e


def test_events_made_equal_by_cleaning_are_one(spark):
    """One lost an unknown key or a value, the other is as it was; both hold a list."""
    notes = spark.createDataFrame([(1, "")], "id int, progress_note string")
    events = [{"Treatment": "手術", "Stage": ["x", "y"]}, {"Treatment": "手術", "Stage": ["x", "y"], "Bad": 1}, {"Treatment": "未知、手術", "Stage": ["x", "y"]}]
    raw = spark.createDataFrame([(1, json.dumps(events, ensure_ascii=False))], "id int, annotation string")
    out = cleaning.cleaned(cleaning.clean(notes, raw, ["Treatment", "Stage"], ALLOWED)).collect()
    assert [json.loads(r["annotation"]) for r in out] == [events[:1]]


def test_cleaning_is_computed_once(spark):
    """One pass of Python and one move of the lines of each side; the filter of empty rows repeats nothing."""
    plan = QUERIES["clean_pipeline"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Exchange hashpartitioning") == 2


def _plain_objects(text):
    depth = begin = 0
    for i, token in lj._tokens(text, 0):
        if token == "{":
            begin = begin if depth else i
            depth += 1
        elif token == "}" and depth:
            depth -= 1
            if not depth:
                yield text[begin : i + 1]


def _plain_array(text):
    depth, at = 0, text.find("[")
    for i, token in lj._tokens(text, at) if at >= 0 else ():
        depth += (token == "[") - (token == "]")
        if token == "]" and not depth:
            return text[at : i + 1]
    return None


PIECES = ["{", "}", "[", "]", ",", ":", '"', '"a"', '"k": ', "1", "-2.5e3", "true", "NaN", "\\", '\\"', " ", "\n", "約", '{"a": 1}', '{"a": {"b": ["}"]}}', ",}", '"}"', '"]"', "\x1c", "01", '"\t"', '{"a": NaN}', '{"a": [NaN]}']


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_scans_are_those_of_single_tokens(text):
    assert list(lj.object_texts(text)) == list(_plain_objects(text)) and lj.first_array(text) == _plain_array(text)
    told = []
    for piece in _plain_objects(text):
        try:
            told.append(json.loads(_stepwise(piece)))
        except ValueError:
            continue
    assert repr(lj.salvage(text)) == repr(told)


def _stepwise(piece):
    """sound_pairs without the pattern for plain pairs."""
    pattern, lj.PAIR = lj.PAIR, re.compile(r"(?!)")
    try:
        return lj.sound_pairs(piece)
    finally:
        lj.PAIR = pattern
