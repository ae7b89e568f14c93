"""What normalize_atoms tells of a value, in Python and straight from JSON: for scoring, which aligns in Python anyway."""

from __future__ import annotations

import re
from collections import Counter
from typing import Any

from . import schema
from .lenient_json import parse_lenient, tenth
from .text import DATE_SHAPES, DIGITS, FOLD_FROM, FOLD_TO, ISO_DATE, SPACE, WHITE

Atom = tuple[str, str | None]
FOLD = str.maketrans(FOLD_FROM, FOLD_TO)
ASCII = str.maketrans(DIGITS, "0123456789")
DATES = [(re.compile(p.replace(r"\s", SPACE).replace("$", r"\Z"), re.ASCII), n) for p, n in DATE_SHAPES]
ISO = re.compile(ISO_DATE.replace(r"\z", r"\Z"), re.ASCII)
NUMERIC = re.compile(r"[+-]?[0-9]+(\.[0-9]+)?")
SEPARATORS = re.compile("[,+]+")


def date_text(raw: str) -> str:
    if ISO.match(raw):
        return raw
    text = raw.strip(WHITE).translate(FOLD)
    plain = text.translate(ASCII)
    for pattern, parts in DATES:
        if m := pattern.match(plain):
            return "-".join(m[i + 1].rjust(4 if i == 0 else 2, "0") for i in range(parts))
    return text


def _list_tokens(text: str) -> list[str]:
    return [t for t in (x.strip(WHITE) for x in SEPARATORS.split(text.translate(FOLD))) if t]


def _number(key: str, number: float, value: Any, raw: str) -> list[Atom]:
    if key not in schema.INTEGER_KEYS:
        return [("num_float", tenth(value))]
    try:
        return [("num_int", str(round(number)))]
    except (OverflowError, ValueError):  # no integer is nearest to it
        return [("str", raw)]


def _number_atoms(key: str, value: Any, raw: str, blank: list[Atom]) -> list[Atom]:
    if isinstance(value, (int, float)):
        try:
            return _number(key, float(value), value, raw)
        except OverflowError:
            return _number(key, float("inf"), value, raw)
    if not isinstance(value, str):
        return [("str", raw.strip(WHITE))]
    text = raw.strip(WHITE).translate(FOLD)
    if text == "":
        return blank
    plain = text.translate(ASCII)
    return _number(key, float(plain), value, text) if NUMERIC.fullmatch(plain) else [("str", text)]


def _list_atoms(key: str, value: Any, raw: str, blank: list[Atom]) -> list[Atom]:
    one = (lambda t: t.strip(WHITE).replace("癌", "がん")) if key == "ProcedureDiagnosis" else (lambda t: t.strip(WHITE))
    tokens = [t for x in value for t in _list_tokens(str(x))] if isinstance(value, list) else _list_tokens(raw)
    if tokens:
        return [("str", one(t)) for t in tokens]
    return blank if raw.strip(WHITE) == "" else [("str", one(raw))]


def atoms_of(key: str, value: Any) -> list[Atom]:
    """(tag, atom) of one entry by its key's type, as normalize_atoms has them.

    Where that fails, on an integer key's number past 64 bits or NaN or infinity, the former gives its integer and the others stay text.
    """
    silent = key in schema.SILENT_KEYS
    if value is None:
        return [] if silent else [("str", "None")]
    raw = value if isinstance(value, str) else str(value)
    blank: list[Atom] = [] if silent else [("str", "")]
    if key in schema.DATE_KEYS:
        date = date_text(raw)
        return [("str", date)] if date else []
    if key in schema.NUMBER_KEYS:
        return _number_atoms(key, value, raw, blank)
    if key in schema.LIST_KEYS:
        return _list_atoms(key, value, raw, blank)
    return [("str", raw.strip(WHITE))]


class Multisets:
    """Event multisets {key of evaluation: {(tag, atom): n}} of texts; what is told of an entry is told once.

    What it returns is shared between events and is not to be changed. One serves one batch.
    """

    def __init__(self) -> None:
        self.told: dict[tuple, tuple[str, dict[Atom, int]]] = {}

    def entry(self, key: str, value: Any) -> tuple[str, dict[Atom, int]]:
        kind = type(value)
        # 1, 1.0 and true are equal, and so are 0.0 and -0.0.
        name = (key, value) if kind is str else (key, kind, repr(value))
        found = self.told.get(name)
        if found is None:
            found = self.told[name] = schema.EVAL_ALIASES.get(key, key), dict(Counter(atoms_of(key, value)))
        return found

    def event(self, event: dict[str, Any]) -> dict[str, dict[Atom, int]]:
        out: dict[str, dict[Atom, int]] = {}
        for k, v in event.items():
            key, atoms = self.entry(k, v)
            if key in out:
                out[key] = dict(Counter(out[key]) + Counter(atoms))
            elif atoms:
                out[key] = atoms
        return out

    def events(self, text: str | None) -> list[dict[str, dict[Atom, int]]]:
        """Those of a text, in its order; none where it holds no list or object. Events without atoms keep their place."""
        if text is None:
            return []
        try:
            value = parse_lenient(text)[0]
        except ValueError:
            return []
        held = [value] if isinstance(value, dict) else value if isinstance(value, list) else []
        return [self.event(e) for e in held if isinstance(e, dict)]
