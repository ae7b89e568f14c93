"""Language identification by prediction by partial matching (PPM) with frozen statistics.

Per language, contexts of up to MAX_ORDER bytes form a tree; each context holds symbol counts
and an escape count (method C: as many escapes as distinct symbols). The code length of a text
is the sum of -log2 of the chances along it, escaping to shorter contexts down to a uniform
order -1. The contexts of all languages make one automaton whose state is the longest known
context, so texts are scored in step, many stretches at once, each begun MAX_ORDER bytes early.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, materialise, prepare, slices

MAX_ORDER = 3
#: Training texts of a language, chosen by hash of doc_id: about so many, however many there are.
TRAIN_TEXTS = 2000
#: A context is kept where it was seen this often in some language.
LEAST_COUNT = 8
#: Bytes that are scored in step; each stretch begins MAX_ORDER bytes early.
STRETCH = 256
UNKNOWN = "und"
#: Symbols at a language's usual cost that a text is judged with beside its own: one odd word, such as
#: a key, must not turn a short clean text away.
PRIOR_SYMBOLS = 256
#: A text in no learned language costs more than the median of its nearest one's labelled texts by
#: so many times the distance from their median to their upper quartile, and by LEAST_BITS at least.
SPREAD, LEAST_BITS = 10.0, 1.5


def fold_table() -> np.ndarray:
    """Symbol of each byte: A-Z as a-z; digits as one, other ASCII as a space."""
    out = np.arange(256)
    out[:128] = 32
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    out[48:58] = 48
    return out.astype(np.uint8)


def folded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts with each text's runs of spaces as one, and the new offsets."""
    x = fold_table().take(data)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    keep[offs[:-1][np.diff(offs) > 0]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return x[keep], total[offs]


def has_letters(texts: list[str | None]) -> np.ndarray:
    """Whether a text has a letter of any script."""
    import re

    found = re.compile(r"[^\W\d_]").search
    return np.array([bool(t and found(t)) for t in texts], bool)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, context and symbol as one number, order, n): one partition's n-grams."""
    claim("langid")
    held: dict[tuple[str, int], list] = {}
    for rows, data, offs in slices(batches, "text", 1 << 22):
        langs = np.array(rows.column("lang").to_pylist(), object)
        x, at = folded(data, offs)
        owner = np.repeat(np.arange(len(langs)), np.diff(at))
        for lang in dict.fromkeys(langs):
            mine = (langs == lang)[owner]
            own, text = x[mine].astype(np.uint64), owner[mine]
            for order in range(MAX_ORDER + 1):
                n = len(own) - order
                if n <= 0:
                    continue
                key = np.zeros(n, np.uint64)
                for i in range(order + 1):
                    key = key << np.uint64(8) | own[i : i + n]
                key = key[text[:n] == text[order:]]  # no n-gram runs from one text into the next
                k, c = np.unique(key, return_counts=True)
                into = held.setdefault((lang, order), [])
                into.append((k, c))
                if len(into) > 8:
                    held[lang, order] = [_add(into)]
    for (lang, order), parts in held.items():
        k, c = _add(parts)
        for a in range(0, len(k), 50_000):
            n = len(k[a : a + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, order), pa.int32()), pa.array(k[a : a + n].view(np.int64)), pa.array(c[a : a + n], pa.int64())], ["lang", "ord", "gram", "n"])


def _add(parts: list) -> tuple[np.ndarray, np.ndarray]:
    k, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return k, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


class Model:
    """Languages, the automaton over contexts, and the bits each (state, symbol) costs them."""

    def __init__(self, counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]):
        self.langs = sorted(counts)
        symbols = sorted({int(g) for c in counts.values() for g in c.get(0, ([], []))[0]} | {32})
        self.symbol = np.full(256, len(symbols), np.uint8)  # the last stands for all unseen
        self.symbol[symbols] = np.arange(len(symbols))
        self.symbol = self.symbol.take(fold_table())
        width = self.width = len(symbols) + 1
        index = np.full(256, len(symbols), np.int64)
        index[symbols] = np.arange(len(symbols))
        kept: dict[bytes, int] = {b"": 0}
        for order in range(1, MAX_ORDER + 1):
            often: set[int] = set()
            for c in counts.values():
                grams, n = c.get(order, (np.zeros(0, np.uint64), np.zeros(0)))
                context, where = np.unique(grams >> np.uint64(8), return_inverse=True)
                often |= {int(x) for x in context[np.bincount(where, n, len(context)) >= LEAST_COUNT]}
            for x in sorted(often):
                name = x.to_bytes(order, "big")
                if name[1:] in kept:  # a state's shorter contexts are states too
                    kept[name] = len(kept)
        states = len(kept)
        self.bits = np.full((states, width, len(self.langs)), np.log2(width), np.float32)
        for li, lang in enumerate(self.langs):
            for order in range(MAX_ORDER + 1):
                grams, n = counts[lang].get(order, (np.zeros(0, np.uint64), np.zeros(0)))
                table = np.zeros((states, width))
                for g, c in zip(grams.tolist(), n.tolist(), strict=True):
                    at = kept.get(g.to_bytes(order + 1, "big")[:-1])
                    if at is not None:
                        table[at, index[g & 255]] += c
                for name, at in kept.items():
                    if len(name) != order:
                        continue
                    lower = self.bits[kept[name[1:]], :, li] if order else np.full(width, np.log2(width))
                    total, kinds = table[at].sum(), (table[at] > 0).sum()
                    if total:
                        escape = np.log2((total + kinds) / kinds)
                        with np.errstate(divide="ignore"):
                            self.bits[at, :, li] = np.where(table[at] > 0, np.log2((total + kinds) / table[at]), escape + lower)
                    else:
                        self.bits[at, :, li] = lower
        self.next = np.zeros((states, width), np.int32)
        for name, at in kept.items():
            for i, s in enumerate(symbols):
                longest = (name + bytes([s]))[-MAX_ORDER:]
                while longest not in kept:
                    longest = longest[1:]
                self.next[at, i] = kept[longest]
        #: Usual bits per symbol of a language's labelled texts, all of them, and what a text may reach.
        self.usual: dict[str, float] = {}
        self.most: dict[str, float] = {}

    def odd(self, lang: str, bits: float, size: int) -> bool:
        """Whether a text of so many bits and symbols costs more than its language's texts do.

        It is judged with PRIOR_SYMBOLS more symbols at the usual cost, which settle short texts.
        """
        return (bits + PRIOR_SYMBOLS * self.usual.get(lang, 0.0)) / (size + PRIOR_SYMBOLS) > self.most.get(lang, float("inf"))

    def code_lengths(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits per text and language, and symbols per text; every symbol counts once."""
        x, at = folded(data, offs)
        x = self.symbol.take(x)
        size = np.diff(at)
        blocks = -(-size // STRETCH)
        owner = np.repeat(np.arange(len(size)), blocks)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = at[owner] + rank * STRETCH
        end = np.minimum(begin + STRETCH, at[owner + 1])
        order = np.argsort(begin - end, kind="stable")  # the longest first
        begin, end, owner = begin[order], end[order], owner[order]
        bits = np.zeros((len(owner), len(self.langs)), np.float64)
        state = np.zeros(len(owner), np.int32)
        following, cost = self.next.ravel(), self.bits.reshape(-1, len(self.langs))
        for back in range(MAX_ORDER, 0, -1):
            spot = begin - back
            known = spot >= at[owner]
            state = np.where(known, following.take(state * self.width + x.take(np.maximum(spot, 0))), state) if len(x) else state
        length = end - begin
        for j in range(int(length.max(initial=0))):
            n = np.searchsorted(-length, -j, side="left")  # stretches longer than j
            place = state[:n] * np.int32(self.width) + x.take(begin[:n] + j)
            bits[:n] += cost.take(place, axis=0)
            state[:n] = following.take(place)
        out = np.zeros((len(size), len(self.langs)))
        for i in range(len(self.langs)):
            out[:, i] = np.bincount(owner, bits[:, i], len(size))
        return out, size


def train(docs: DataFrame) -> Model | None:
    """A model from about TRAIN_TEXTS texts of each non-null lang, chosen by hash of doc_id.

    The counts are summed in Spark; the driver gets the n-grams of that bounded sample. What a text
    may cost (Model.odd) is told by all labelled texts, scored once. Rows without text, doc_id or
    lang teach nothing; without any others there is no model.
    """
    labelled = docs.filter("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    share = {r["lang"]: TRAIN_TEXTS / r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return None
    limit = F.create_map(*(F.lit(x) for lang, s in share.items() for x in (lang, min(1.0, s))))
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < limit[F.col("lang")] * 1_000_003).select("text", "lang")
    grams = chosen.mapInArrow(_count, "lang string, ord int, gram long, n long").groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n"))
    rows = materialise(grams, "ppm-grams").toArrow()
    counts: dict[str, dict[int, tuple]] = {}
    lang, order = np.array(rows.column("lang").to_pylist(), object), rows.column("ord").to_numpy()
    gram, n = rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    for name in share:
        for k in range(MAX_ORDER + 1):
            at = (lang == name) & (order == k)
            pick = np.argsort(gram[at])
            counts.setdefault(name, {})[k] = (gram[at][pick], n[at][pick])
    model = Model(counts)
    rates = _identify_rows(labelled.select("text", "lang"), model, "lang").filter("score > 0").groupBy("lang_pred").agg(F.percentile_approx("bits_per_symbol", [0.5, 0.75], 1000).alias("q")).collect()
    for r in rates:
        middle, upper = r["q"]
        model.usual[r["lang_pred"]], model.most[r["lang_pred"]] = middle, middle + max(LEAST_BITS, SPREAD * (upper - middle))
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_symbol and odd of every row.

    lang_pred is the language of the shortest code, `und` with score 0 where a text is null or has
    no letter, or where there is no model; ties go to the first name. score is that language's
    posterior chance under equal priors; odd is whether the text costs more than texts of that
    language do (Model.odd). Only text is looked at; repeated rows repeat.
    """
    return _identify_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, "doc_id")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs whose text is in a learned language, with all their columns and without a join on ids.

    A text goes whose lang_pred is `und` or whose code is too long for that language (Model.odd).
    In the rows that stay, `lang` is the prediction. Columns may have any names; without a model
    nothing goes and nothing changes.
    """
    if model is None:
        return docs
    names, text = docs.columns, docs.columns.index("text")
    plain = docs.toDF(*(f"_{i}" for i in range(len(names))))
    rows = _identify_rows(plain.select(F.struct("*").alias("row"), F.col(f"_{text}").alias("text")), model, "row")
    kept = rows.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("odd"))
    return kept.select(*(F.col("lang_pred" if x == "lang" else f"row._{i}") for i, x in enumerate(names))).toDF(*names)


def _identify_rows(docs: DataFrame, model: Model | None, passed: str) -> DataFrame:
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        own = held.value
        for rows, data, offs in slices(batches, "text"):
            n = rows.num_rows
            pred, score, rate, odd = [UNKNOWN] * n, np.zeros(n), np.zeros(n), [False] * n
            if own is not None:
                bits, size = own.code_lengths(data, offs)
                best = bits.argmin(axis=1)
                least = bits[np.arange(n), best]
                chance = 1 / np.exp2(np.minimum(0, least[:, None] - bits)).sum(axis=1)
                known = has_letters(rows.column(rows.schema.get_field_index("text")).to_pylist())
                pred = [own.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                odd = [p != UNKNOWN and own.odd(p, b, k) for p, b, k in zip(pred, least.tolist(), size.tolist(), strict=True)]
                score, rate = np.where(known, chance, 0.0), np.where(known, least / np.maximum(size, 1), 0.0)
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(passed)), pa.array(pred, pa.string()), pa.array(score), pa.array(rate), pa.array(odd, pa.bool_())], [passed, "lang_pred", "score", "bits_per_symbol", "odd"])

    kinds = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("bits_per_symbol", T.DoubleType()), ("odd", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([docs.schema[passed], *(T.StructField(n, k) for n, k in kinds)]))


def held_out() -> Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))

