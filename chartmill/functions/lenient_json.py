"""Event lists from malformed JSON text: whole, first array, or pair by pair.

What is damaged is dropped at the smallest unit that can be told apart: a key-value pair, else
the object around it. Strings, brackets and primitives are found by patterns; the rules for what
counts as damaged follow the scoring protocol that this library evaluates.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"|["\[\]{},]', re.S)
_TEXT = r'"(?:[^"\\]++|\\.)*+"'
#: Outside objects: a string, a quote that opens none, an object without another inside, or the begin of any other.
OUTER = re.compile(rf'{_TEXT}|"|\{{(?:[^"{{}}]++|{_TEXT})*+\}}|\{{', re.S)
#: Up to the next bracket of a kind, or a quote that opens no string.
NEXT = {b[0]: re.compile(rf'(?:[^"\{b[0]}\{b[1]}]++|{_TEXT})*+["\{b[0]}\{b[1]}]', re.S) for b in ("{}", "[]")}
PRIMITIVE = re.compile(r"true|false|null|[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
NUMERAL = re.compile(r"[+-]?\d+(\.\d+)?")
GAP = re.compile(r"\s*")
NEXT_KEY = re.compile(r'\s*(?=")')
RUN = re.compile(r"[^,}]*")
#: What may stand after a value: a comma and a key, a comma without one, or the object's end.
AFTER = re.compile(r'\s*(?:(?P<more>,\s*(?="))|(?P<lost>,)|(?P<over>\}))?')
#: A pair whose value is a string or a primitive and that a key or the object's end follows.
PAIR = re.compile(rf'[\s,]*+({_TEXT})\s*+:\s*+({_TEXT}|{PRIMITIVE.pattern})\s*+(?:,\s*+(?=")|(\}}))', re.S)
CLOSED_BY = {"{": "}", "[": "]"}
THOUGHTS = [re.compile(rf"<{t}>.*?</{t}>", re.S) for t in ("think", "thinking")]


def _tokens(text: str, at: int) -> Iterator[tuple[int, str]]:
    """Brackets and commas outside strings; an unterminated string ends the text."""
    for m in BRACKETS.finditer(text, at):
        if m[0] == '"':
            return
        if m[0][0] != '"':
            yield m.start(), m[0]


def _closing(text: str, at: int, opening: str, closing: str) -> int | None:
    """Place of the bracket that closes the one at `at`, counting only its own kind."""
    depth = 0
    while m := NEXT[opening].match(text, at):
        at = m.end()
        token = text[at - 1]
        if token == '"':  # an unterminated string ends the text
            return None
        depth += 1 if token == opening else -1
        if not depth:
            return at - 1
    return None


def first_array(text: str) -> str | None:
    """The text from the first '[' to the bracket that closes it."""
    at = text.find("[")
    end = _closing(text, at, "[", "]") if at >= 0 else None
    return None if end is None else text[at : end + 1]


def object_texts(text: str) -> Iterator[str]:
    """Outermost {...} stretches."""
    at = 0
    while m := OUTER.search(text, at):
        at, token = m.end(), m[0]
        if token == '"':
            return
        if token == "{":
            end = _closing(text, m.start(), "{", "}")
            if end is None:
                return
            at = end + 1
            yield text[m.start() : at]
        elif token[0] == "{":
            yield token


def _skip_damage(text: str, at: int) -> int:
    """Place of the next key after a damaged value: a comma outside brackets, then a quote."""
    depth = 0
    for i, token in _tokens(text, at):
        if token in "{[":
            depth += 1
        elif token in "}]":
            depth = max(0, depth - 1)
        elif not depth and (m := NEXT_KEY.match(text, i + 1)):
            return m.end()
    return len(text)


def _value(text: str, at: int) -> tuple[str | None, int, bool]:
    """(value or None if damaged, where to go on, whether the object ends) from a value's begin.

    A value is sound if it ends, and if it is no string or container, if it is a primitive. What
    follows decides the rest: a comma that no key follows damages the value before it.
    """
    opening, sound = text[at : at + 1], True
    if opening == '"':
        whole = STRING.match(text, at)
        stop = whole and whole.end()
    elif opening in CLOSED_BY:
        close = _closing(text, at, opening, CLOSED_BY[opening])
        stop = close and close + 1
    else:
        stop = RUN.match(text, at).end()
        sound = bool(PRIMITIVE.fullmatch(text[at:stop].strip()))
    if stop is None:
        return None, len(text), False
    after = AFTER.match(text, stop)
    go_on = _skip_damage(text, after.end()) if after["lost"] else after.end()
    return text[at:stop].strip() if sound and not after["lost"] else None, go_on, bool(after["over"])


def sound_pairs(text: str) -> str:
    """An object's text with only the pairs whose value can be told."""
    kept, at, n = [], 1, len(text)
    while True:
        if pair := PAIR.match(text, at):
            kept.append(f"{pair[1]}: {pair[2]}")
            at = pair.end()
            if pair[3]:
                break
            continue
        at = GAP.match(text, at).end()
        if at < n and text[at] == ",":
            at += 1
            continue
        key = STRING.match(text, at)
        if not key:
            break
        at = GAP.match(text, key.end()).end()
        if at >= n or text[at] != ":":
            break
        value, at, over = _value(text, GAP.match(text, at + 1).end())
        if value:
            kept.append(f"{key[0]}: {value}")
        if over:
            break
    return "{" + ", ".join(kept) + "}"


def _refuse(name: str) -> Any:
    raise ValueError(name)


#: Sound objects are read as they are: all their pairs can be told. NaN and infinities are no primitives here.
_SOUND = json.JSONDecoder(parse_constant=_refuse).decode


def salvage(text: str) -> list[Any]:
    """Objects of a damaged array; one that still cannot be read is left out."""
    out = []
    for piece in object_texts(text):
        try:
            out.append(_SOUND(piece))
            continue
        except (ValueError, RecursionError):
            pass
        try:
            out.append(json.loads(sound_pairs(piece)))
        except (ValueError, RecursionError):
            continue
    return out


def parse_lenient(text: str) -> tuple[Any, str]:
    """(value, ok | lenient); ValueError where the text has neither a value nor a '['."""
    text = text.strip()
    try:
        return json.loads(text), "ok"
    except (ValueError, RecursionError):
        pass
    array = first_array(text)
    if array is None:
        at = text.find("[")
        if at < 0:
            raise ValueError("no array in the text")
        return salvage(text[at:]), "lenient"
    try:
        return json.loads(array), "lenient"
    except (ValueError, RecursionError):
        return salvage(array), "lenient"


def _kind(value: Any) -> str:
    return "null" if value is None else type(value).__name__


def tenth(value: Any) -> str | None:
    """Python's round to one decimal, as text, of a number or a plain numeral; -0.0 is 0.0."""
    if isinstance(value, str):
        value = value.strip()
        if not NUMERAL.fullmatch(value):
            return None
    elif not isinstance(value, (int, float)):
        return None
    try:
        return repr(round(float(value), 1) + 0.0)
    except OverflowError:
        return None


def _told(value: Any) -> tuple:
    """tenth, jtype, raw, items and json of an entry's value, and its JSON in a signature."""
    raw = None if value is None else value if isinstance(value, str) else str(value)
    items = [str(x) for x in value] if isinstance(value, list) else None
    plain = _PLAIN(value)
    return tenth(value), _kind(value), raw, items, plain, _SORTED(value) if isinstance(value, (list, dict)) else plain


_PLAIN = json.JSONEncoder(ensure_ascii=False).encode
_SORTED = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode


def _list_of(kind: pa.DataType) -> pa.DataType:
    return pa.list_(pa.field("element", kind))


_ENTRY = pa.struct([("key", pa.string()), ("name", pa.string()), ("tenth", pa.string()), ("jtype", pa.string()), ("raw", pa.string()), ("items", _list_of(pa.string())), ("json", pa.string())])
_EVENT = pa.struct([("ord", pa.int32()), ("sig", pa.string()), ("entries", _list_of(_ENTRY))])


class _Distinct:
    """Numbers of things by when they were first met, and what is told of each: told once a batch."""

    def __init__(self, tell: Any):
        self.tell, self.number, self.told = tell, {}, []

    def add(self, value: Any, name: Any) -> int:
        at = self.number.get(name)
        if at is None:
            at = self.number[name] = len(self.told)
            self.told.append(self.tell(value))
        return at

    def column(self, i: int, kind: pa.DataType, at: pa.Array) -> pa.Array:
        return pa.array([t[i] for t in self.told], kind).take(at)


def _lists(offsets: list[int], values: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=kind)


def parse_texts(texts: pa.Array) -> pa.Array:
    """Status null | failed | scalar | ok | lenient and the events (dicts in a list, or one dict) of each text.

    Keys and values are numbered and what is told of them is worked out once for each distinct one.
    """
    keys = _Distinct(lambda k: (k, _PLAIN(k)))
    values = _Distinct(_told)
    status: list[str] = []
    ends, orders, sigs, entry_ends, key_at, value_at = [0], [], [], [0], [], []
    for text in texts.to_pylist():
        value: Any = None
        if text is None:
            told = "null"
        else:
            try:
                value, told = parse_lenient(text)
            except ValueError:
                told = "failed"
            else:
                value = [value] if isinstance(value, dict) else value
                if not isinstance(value, list):
                    value, told = None, "scalar"
        status.append(told)
        order = 0
        for event in value or ():
            if not isinstance(event, dict):
                continue
            pairs = []
            for k, v in event.items():
                kind = type(v)
                # 1, 1.0 and true are equal, and so are 0.0 and -0.0; lists and dicts go by their own JSON.
                name = v if kind is str else (kind, v if kind is int or kind is bool or v is None else repr(v) if kind is float else _PLAIN(v))
                ki, vi = keys.add(k, k), values.add(v, name)
                key_at.append(ki)
                value_at.append(vi)
                pairs.append((k, ki, vi))
            pairs.sort()
            sigs.append("{" + ",".join([f"{keys.told[ki][1]}:{values.told[vi][5]}" for _, ki, vi in pairs]) + "}")
            orders.append(order)
            order += 1
            entry_ends.append(len(key_at))
        ends.append(len(orders))
    at_key, at_value = pa.array(key_at, pa.int32()), pa.array(value_at, pa.int32())
    of = lambda i: values.column(i, _ENTRY.field(i + 2).type, at_value)
    entries = pa.StructArray.from_arrays([keys.column(0, pa.string(), at_key), keys.column(1, pa.string(), at_key), *(of(i) for i in range(5))], fields=list(_ENTRY))
    events = pa.StructArray.from_arrays([pa.array(orders, pa.int32()), pa.array(sigs, pa.string()), _lists(entry_ends, entries, _EVENT.field("entries").type)], fields=list(_EVENT))
    fields = [pa.field("status", pa.string()), pa.field("events", _list_of(_EVENT))]
    return pa.StructArray.from_arrays([pa.array(status, pa.string()), _lists(ends, events, fields[1].type)], fields=fields)


ENTRY = "struct<key: string, name: string, tenth: string, jtype: string, raw: string, items: array<string>, json: string>"
EVENTS = f"array<struct<ord: int, sig: string, entries: array<{ENTRY}>>>"


def parse_events(text: Column) -> Column:
    """struct<status, events> per text; the one place where Python reads JSON."""

    def parsed(texts: pa.Array) -> pa.Array:
        return parse_texts(texts)

    return F.arrow_udf(parsed, f"struct<status: string, events: {EVENTS}>")(text)


def canonical_text(text: str | None, most: int) -> str:
    """A prediction's events as JSON: thoughts cut, repeats dropped, at most `most` if positive."""
    text = (text or "").strip()
    for pattern in THOUGHTS:
        text = pattern.sub("", text).strip()
    try:
        value = parse_lenient(text)[0] if text else []
    except ValueError:
        value = []
    value = [value] if isinstance(value, dict) else value if isinstance(value, list) else []
    distinct: dict[str, dict] = {}
    for e in value:
        if isinstance(e, dict):
            distinct.setdefault(json.dumps(e, ensure_ascii=False, sort_keys=True), e)
    kept = list(distinct.values())
    return json.dumps(kept[:most] if most > 0 else kept, ensure_ascii=False)


def canonicalize_prediction(text: Column, most: int = 64) -> Column:
    return F.udf(lambda t: canonical_text(t, most), "string", useArrow=True)(text)


def events_json(events: Column) -> Column:
    """The events as a JSON list, from the JSON text of each entry's value."""
    pair = lambda e: F.concat(e["name"], F.lit(": "), e["json"])
    one = lambda ev: F.concat(F.lit("{"), F.array_join(F.transform(ev["entries"], pair), ", "), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(events, one), ", "), F.lit("]"))
