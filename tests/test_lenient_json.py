"""Golden cases of lenient parsing, and that sound JSON always survives."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from chartmill.functions import lenient_json as lj

CASES = [
    ('[{"a":"x"}]', [{"a": "x"}]),
    ('```json\n[{"a":"x"}]\n```', [{"a": "x"}]),
    ('[{"a":"x"},{"b":"y"', [{"a": "x"}]),
    ('[{"a":"x",}]', [{}]),
    ('[{"a":"x","b":"y",}]', [{"a": "x"}]),
    ('[{"a": 2.8,4.0, "b":"y"}]', [{"b": "y"}]),
    ('[{"a":"x" "b":"y"}]', [{"a": "x", "b": "y"}]),
    ('[補完情報] [{"a":"x"}]', []),
    ("123", 123),
    ('[{"a": 約44, "b": [1,2], "c": {"d": 1}}]', [{"b": [1, 2], "c": {"d": 1}}]),
    ('[{"a": 3 } , {"b": tru}, {"c": "x\ny"}]', [{"a": 3}, {}]),
    ('[{"a": {"b": 1}, "c": [1, "]"], "d": nul}]', [{"a": {"b": 1}, "c": [1, "]"]}]),
]


@pytest.mark.parametrize(("text", "value"), CASES)
def test_golden(text, value):
    assert lj.parse_lenient(text)[0] == value


@pytest.mark.parametrize("text", ['note: {"a":"x"}', "", "plain"])
def test_no_array_raises(text):
    with pytest.raises(ValueError):
        lj.parse_lenient(text)


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(), c, max_size=3), max_leaves=8)


@given(st.lists(st.dictionaries(st.text(), values, max_size=4), max_size=4), st.text(alphabet="ab \n`:", max_size=8))
def test_sound_arrays_survive_surroundings(events, noise):
    assert lj.parse_lenient(f"{noise}{json.dumps(events)}{noise}")[0] == events


@given(st.text(alphabet='[]{}",:\\ab1 \n', max_size=40))
def test_any_text_ends(text):
    try:
        lj.parse_lenient(text)
    except ValueError:
        pass


def test_canonical_prediction():
    assert lj.canonical_text('<think>[</think>[{"b":1,"a":2},{"a":2,"b":1},{"a":1.0}]', 0) == '[{"b": 1, "a": 2}, {"a": 1.0}]'
    assert lj.canonical_text('[{"a":1},{"a":2},{"a":3}]', 2) == '[{"a": 1}, {"a": 2}]'
    assert lj.canonical_text(None, 5) == "[]" == lj.canonical_text("<thinking>x</thinking>", 5) == lj.canonical_text("no", 5)
    assert lj.canonical_text('{"a": "x"}', 5) == '[{"a": "x"}]'


def test_events_column(spark):
    rows = [(1, '[{"a": [1, "x"], "b": null, "c": 1.25, "d": true}, 5]'), (2, None), (3, "7"), (4, "x")]
    out = {r["id"]: r["p"] for r in spark.createDataFrame(rows, "id int, t string").select("id", lj.parse_events("t").alias("p")).collect()}
    assert [out[i]["status"] for i in (1, 2, 3, 4)] == ["ok", "null", "scalar", "failed"]
    (event,) = out[1]["events"]
    assert [(e["key"], e["jtype"], e["raw"], e["items"], e["tenth"]) for e in event["entries"]] == [("a", "list", "[1, 'x']", ["1", "x"], None), ("b", "null", None, None, None), ("c", "float", "1.25", None, "1.2"), ("d", "bool", "True", None, "1.0")]


def test_values_that_are_equal_stay_apart(spark):
    """1, 1.0, true, 0.0 and -0.0 in one batch keep their own texts; repeated values are told alike in every row."""
    text = '[{"b": 1, "a": 1.0, "c": true}, {"a": 0.0, "b": -0.0, "c": false, "d": 0, "e": {"z": [1], "a": 1}}, 5, {}]'
    out = spark.createDataFrame([(i, text) for i in range(3)] + [(3, None)], "i int, t string").select("i", lj.parse_events("t")["events"].alias("e")).orderBy("i").collect()
    for r in out[:3]:
        assert [[e["json"] for e in ev["entries"]] for ev in r["e"]] == [["1", "1.0", "true"], ["0.0", "-0.0", "false", "0", '{"z": [1], "a": 1}'], []]
        assert [ev["sig"] for ev in r["e"]] == ['{"a":1.0,"b":1,"c":true}', '{"a":0.0,"b":-0.0,"c":false,"d":0,"e":{"a":1,"z":[1]}}', "{}"]
        assert [ev["ord"] for ev in r["e"]] == [0, 1, 2]
    assert out[3]["e"] == []
