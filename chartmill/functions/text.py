"""Text, date, number and list functions on Columns, with Unicode-aware trimming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import schema
from .lenient_json import tenth

# White space that is trimmed, separators and digits that are folded.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WHITE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"  # the same, one by one
FOLD_FROM, FOLD_TO = "、，＋､", ",,+,"
DIGITS = "０１２３４５６７８９"
SPECIAL_TOKEN = r"<\|(?:start|end|message|channel|return|call|constrain|endoftext)\|>"
FINAL_CHANNEL = r"(?s)<\|channel\|>final<\|message\|>(.*?)(?:<\|return\|>|<\|end\|>|<\|call\|>|\z)"
# The accepted date shapes, and how many of year, month and day they hold.
DATE_SHAPES = [
    (r"^\s*(\d{4})[\/\.](\d{1,2})[\/\.](\d{1,2})\s*$", 3),
    (r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})\s*$", 3),
    (r"^\s*(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日\s*$", 3),
    (r"^\s*(\d{4})[\/\.-](\d{1,2})\s*$", 2),
    (r"^\s*(\d{4})年\s*(\d{1,2})月\s*$", 2),
    (r"^\s*(\d{4})\s*$", 1),
]
ISO_DATE = r"^\d{4}-\d\d-\d\d\z"  # what stays as it is


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: what a lambda names again is computed again."""
    return F.transform(F.array(value), body)[0]


def trim_u(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (trim_u(c) == "")


def fold_separators(c: Column) -> Column:
    return F.translate(c, FOLD_FROM, FOLD_TO)


def normalize_date(c: Column) -> Column:
    """Zero-padded partial ISO date of six accepted shapes; other text folded; null and blank empty."""

    def told(text: Column, plain: Column) -> Column:
        out = text
        for pattern, parts in reversed(DATE_SHAPES):
            whole = pattern.replace(r"\s", SPACE)
            padded = [F.lpad(F.regexp_extract(plain, whole, i + 1), 4 if i == 0 else 2, "0") for i in range(parts)]
            out = F.when(plain.rlike(whole), F.concat_ws("-", *padded)).otherwise(out)
        return out

    shaped = bound(fold_separators(trim_u(c)), lambda text: bound(F.translate(text, DIGITS, "0123456789"), lambda plain: told(text, plain)))
    return F.when(c.isNull(), F.lit("")).when(c.rlike(ISO_DATE), c).otherwise(shaped)


def _tokens(c: Column, separators: str) -> Column:
    """What any of the separators part; a split at one character takes no pattern."""
    return F.filter(F.transform(F.split(F.translate(c, separators, "," * len(separators)), ","), trim_u), lambda t: t != "")


def split_list_tokens(c: Column) -> Column:
    """Tokens between commas and plus signs of either width; null gives none."""
    return F.coalesce(_tokens(c, FOLD_FROM + "+"), F.array().cast("array<string>"))


def split_value_tokens(c: Column) -> Column:
    """Tokens between commas only; plus signs and half-width commas stay."""
    return F.coalesce(_tokens(c, "、，"), F.array().cast("array<string>"))


def normalize_token(key: Column, token: Column) -> Column:
    """Diagnosis labels use one spelling of the word for cancer."""
    return F.when(key == "ProcedureDiagnosis", F.replace(trim_u(token), F.lit("癌"), F.lit("がん"))).otherwise(trim_u(token))


def is_numeric(c: Column) -> Column:
    """An optional sign, digits and an optional fraction; no exponent."""
    return F.translate(c, DIGITS, "0123456789").rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$")


def round_tenth(c: Column) -> Column:
    """Python's round(x, 1) as text: half to even on the binary value, which no built-in gives."""
    return F.udf(tenth, "string", useArrow=True)(c)


def number_atom(key: Column, value: Column, decimal: Column) -> Column:
    """struct<tag, atom> of a number: half-even integer for integer keys, else the decimal text."""
    whole = F.struct(F.lit("num_int").alias("tag"), F.bround(value, 0).cast("bigint").cast("string").alias("atom"))
    return F.when(key.isin(*schema.INTEGER_KEYS), whole).otherwise(F.struct(F.lit("num_float").alias("tag"), decimal.alias("atom")))


def _text(value: Column) -> Column:
    return F.struct(F.lit("str").alias("tag"), value.alias("atom"))


def normalize_atoms(key: Column, jtype: Column, raw: Column, items: Column, decimal: Column) -> Column:
    """array<struct<tag, atom>> of one entry by its key's type.

    jtype names the JSON type; raw is the value as text, items the texts of a list's elements and
    decimal a number's text with one decimal, all as parse_events gives them. No Python runs here.
    """
    none = F.array().cast("array<struct<tag: string, atom: string>>")
    silent = key.isin(*schema.SILENT_KEYS)
    blank = F.when(silent, none).otherwise(F.array(_text(F.lit(""))))
    dates = bound(normalize_date(raw), lambda date: F.when(date == "", none).otherwise(F.array(_text(date))))
    told = F.when(jtype.isin("int", "float"), raw.try_cast("double")).when(jtype == "bool", (raw == "True").cast("double"))
    spelt = bound(
        fold_separators(trim_u(raw)),
        lambda text: F.when(text == "", blank).when(is_numeric(text), F.array(number_atom(key, F.translate(text, DIGITS, "0123456789").try_cast("double"), decimal))).otherwise(F.array(_text(text))),
    )
    numbers = bound(told, lambda n: F.when(n.isNotNull(), F.array(number_atom(key, n, decimal))).when(jtype != "str", F.array(_text(trim_u(raw)))).otherwise(spelt))
    lists = bound(
        F.when(jtype == "list", F.flatten(F.transform(items, split_list_tokens))).otherwise(split_list_tokens(raw)),
        lambda tokens: F.when(F.size(tokens) > 0, F.transform(tokens, lambda t: _text(normalize_token(key, t)))).when(trim_u(raw) == "", blank).otherwise(F.array(_text(normalize_token(key, raw)))),
    )
    nulls = F.when(silent, none).otherwise(F.array(_text(F.lit("None"))))
    return (
        F.when(jtype == "null", nulls)
        .when(key.isin(*schema.DATE_KEYS), dates)
        .when(key.isin(*schema.NUMBER_KEYS), numbers)
        .when(key.isin(*schema.LIST_KEYS), lists)
        .otherwise(F.array(_text(trim_u(raw))))
    )


def eval_key(key: Column) -> Column:
    """The key under which scoring counts a raw key."""
    out = key
    for raw, to in schema.EVAL_ALIASES.items():
        out = F.when(key == raw, to).otherwise(out)
    return out


def id_seed(seed: int, record_id: Column) -> Column:
    """seed XOR the first 32 bits of the id's MD5."""
    return F.lit(seed).cast("bigint").bitwiseXOR(F.conv(F.substring(F.md5(record_id), 1, 8), 16, 10).cast("bigint"))


def final_channel(c: Column) -> tuple[Column, Column]:
    """(text of the last final-channel span without special tokens, whether there is one)."""
    spans = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(FINAL_CHANNEL), F.lit(1))
    last = F.try_element_at(spans, F.lit(-1))
    return F.coalesce(trim_u(F.regexp_replace(last, SPECIAL_TOKEN, "")), F.lit("")), last.isNotNull()


def channel_text(c: Column) -> tuple[Column, Column]:
    """The final channel, or the whole text with special tokens as spaces where there is none."""
    text, found = final_channel(c)
    return F.when(found, text).otherwise(trim_u(F.regexp_replace(F.coalesce(c, F.lit("")), SPECIAL_TOKEN, " "))), found


def strip_thoughts(c: Column) -> Column:
    out = trim_u(c)
    for tag in ("think", "thinking"):
        out = trim_u(F.regexp_replace(out, rf"(?s)<{tag}>.*?</{tag}>", ""))
    return out


def render_prompt(template: str, text: Column, context: Column | None = None) -> Column:
    """Fill {{CONTEXT}} and {{INPUT}}; without its mark the context goes before and the input after."""
    out = F.lit(template)
    if context is not None:
        out = F.replace(out, F.lit("{{CONTEXT}}"), context) if "{{CONTEXT}}" in template else F.concat(context, F.lit("\n\n"), out)
        marked = F.contains(out, F.lit("{{INPUT}}"))
        return F.when(marked, F.replace(out, F.lit("{{INPUT}}"), text)).otherwise(F.concat(out, F.lit("\n\n### 入力:\n"), text))
    return F.replace(out, F.lit("{{INPUT}}"), text) if "{{INPUT}}" in template else F.concat(out, F.lit("\n\n### 入力:\n"), text)


def render_structured(guideline: str, text: Column) -> Column:
    """Guideline, input and an open output section."""
    return F.concat(F.lit(f"{guideline}\n\n### Input:\n"), text, F.lit("\n\n### Output:\n"))


def training_text(guideline: str, note: Column, answer: Column, end: str) -> Column:
    return F.concat(render_structured(guideline, note), answer, F.lit(end))


def chat_text(system: str, user: Column) -> Column:
    """The plain chat form for models without a template of their own."""
    return F.concat(F.lit(f"[System]\n{system}\n\n[User]\n"), user, F.lit("\n\n[Assistant]\n"))


def render_examples(texts: Column, label: str | None = None) -> Column:
    """Numbered examples, parted by blank lines."""
    name = lambda i: F.concat(F.lit("【例"), (i + 1).cast("string"), F.lit(f"の{label}】\n" if label else "】\n"))
    return F.array_join(F.transform(texts, lambda t, i: F.concat(name(i), t)), "\n\n")


def mask_labels(ids: Column, needles: list[list[int]], ignore: int = -100) -> Column:
    """Labels: ids after the first needle found, the needles tried in turn; before it `ignore`.

    ids and the cut are computed once, so a row takes time in proportion to its ids.
    """

    def place(held: Column, needle: list[int]) -> Column:
        begins = F.when(F.size(held) >= len(needle), F.sequence(F.lit(0), F.size(held) - len(needle))).otherwise(F.array().cast("array<int>"))

        def fits(i: Column) -> Column:
            out = F.lit(True)
            for j, x in enumerate(needle):
                out = out & F.get(held, i + j).eqNullSafe(F.lit(x))
            return out

        return F.array_position(F.transform(begins, fits), True)

    def cut(held: Column, left: list[list[int]]) -> Column:
        if not left:
            return F.lit(0)
        return bound(place(held, left[0]), lambda at: F.when(at > 0, at - 1 + len(left[0])).otherwise(cut(held, left[1:])))

    def masked(held: Column) -> Column:
        return bound(cut(held, needles).cast("int"), lambda n: F.concat(F.array_repeat(F.lit(ignore), n), F.slice(held, n + 1, F.size(held))))

    return bound(ids, masked)


def pad_labels(labels: Column, length: Column, ignore: int = -100) -> Column:
    """Labels cut or filled to a length."""
    return F.concat(F.slice(labels, F.lit(1), length), F.array_repeat(F.lit(ignore), F.greatest(F.lit(0), length - F.size(labels))))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
