"""Quality by an interpolated modified Kneser-Ney model of byte 5-grams over trusted text.

Counts of the trusted texts are summed by n-gram, continuation counts follow from the distinct
n-grams, and joins on contexts, sharded by key, give each seen n-gram its chance and each context
its weight for the next lower order. The model is a set of tables that grows with the text.

Documents meet it by the distinct n-grams of the whole corpus, which are joined with the model's
tables, sharded by n-gram, so that each has one cost. Up to MOST_BROADCAST of them are broadcast and
texts are scored where they lie. Beyond that neither the driver nor any task holds them all: rows
are packed into parts of bounded size, a part's own n-grams are joined with the costs and come back
to the part as its table. Both ways give the same numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IdFilter, claim, materialise, prepare, slices
from .tables import KeyTable

ORDER = 5
SYMBOLS = 256
#: Bytes of text in a part; a single longer text is a part of its own.
PART_BYTES = 16 << 20
#: Costs of so many n-grams, eight bytes each, may be broadcast; more are joined by part.
MOST_BROADCAST = 1 << 21
#: Share of a language's trusted texts, and of those held out, whose perplexity lies under its threshold.
QUANTILE = 0.999
#: Trusted texts kept from training, one in so many by hash of doc_id: they show what unseen texts cost.
HELD_OUT = 4
#: Bits a symbol that a text may cost beyond the quantile, as few held-out texts show it only roughly.
SLACK_BITS = 0.4
#: Symbols of the language's median cost that every text is judged with; they settle short texts.
PRIOR_SYMBOLS = 128
#: A symbol's cost travels beside its n-gram in one number: under 64 bits, in steps of 2^-17.
COST_BITS, COST_STEPS = 23, 1 << 17


def grams(data: np.ndarray, offs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte, as a number; a text begins as if after new lines."""
    n = len(data)
    padded = np.full(n + order + 8, 10, np.uint8)
    padded[order - 1 : order - 1 + n] = data
    out = np.ndarray((n,), "<u8", padded, 0, (1,)).byteswap() >> np.uint64(64 - 8 * order)
    for j in range(order - 1):  # what came before a text's first bytes is not its own
        at = offs[:-1][np.diff(offs) > j] + j
        own = np.uint64((1 << 8 * (j + 1)) - 1)
        lines = np.uint64(sum(10 << 8 * i for i in range(j + 1, order)))
        out[at] = (out[at] & own) | lines
    return out.view(np.int64)


def distinct(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) of the distinct n-grams, in order."""
    g = np.sort(g)
    new = np.ones(len(g) + 1, bool)
    new[1:-1] = g[1:] != g[:-1]
    at = np.flatnonzero(new)
    return g[at[:-1]], np.diff(at)


#: Distinct n-grams a counting task holds before it hands its counts on.
MOST_HELD = 1 << 22


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("kneser")

    def out() -> Iterator[pa.RecordBatch]:
        keys = held.all()
        for a in range(0, held.n, 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000]), pa.array(total[a : a + 100_000])], ["gram", "n"])

    held, total = KeyTable(), np.zeros(0, np.int64)
    for _, data, offs in slices(batches, "text"):
        g, n = distinct(grams(data, offs))
        at = held.add(g)
        total = np.concatenate([total, np.zeros(held.n - len(total), np.int64)])
        total[at] += n
        if held.n > MOST_HELD:
            yield from out()
            held, total = KeyTable(), np.zeros(0, np.int64)
    yield from out()


def counted(texts: DataFrame) -> DataFrame:
    """(gram, n): how often each n-gram occurs in the column text."""
    return texts.select("text").mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def select_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (doc_id, text) of docs whose doc_id is in ids; a bitmap spares most others the shuffle."""
    kept = IdFilter(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield kept(batch).select(["doc_id", "text"])

    maybe = docs.filter("doc_id is not null and text is not null").select("doc_id", "text", kept.slot().alias("slot")).mapInArrow(run, "doc_id long, text string")
    return maybe.join(ids, "doc_id", "left_semi")


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney from the counts of counts."""
    n = {r["n"]: r["c"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    n1, n2, n3, n4 = (max(n.get(i, 0), 1) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


class Level(NamedTuple):
    """One order of the model: chances (gram, p) of seen n-grams, weights (context, weight) of seen contexts."""

    chances: DataFrame
    weights: DataFrame


def train(texts: DataFrame) -> list[Level]:
    """Levels of order 1, 2, ..., ORDER from all the texts; no levels where there are none.

    Counts of an order below the highest are the numbers of distinct symbols seen before. A context
    has at most 256 n-grams, so no window holds more.
    """
    counts = materialise(counted(texts), "kn-counts")
    if counts.isEmpty():
        return []
    tables = [counts]
    for k in range(ORDER - 1, 0, -1):
        tables.insert(0, materialise(tables[0].groupBy((F.col("gram") % F.lit(1 << 8 * k)).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "kn-counts"))
    out: list[Level] = []
    for k, table in enumerate(tables, 1):
        d1, d2, d3 = _discounts(table)
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        alike = Window.partitionBy("context")
        held = table.withColumn("context", F.shiftright("gram", 8)).withColumns({"total": F.sum("n").over(alike), "weight": F.sum(discount).over(alike)}).withColumn("weight", F.col("weight") / F.col("total"))
        if k == 1:
            held = held.withColumn("below", F.lit(1 / SYMBOLS))
        else:
            held = held.withColumn("suffix", F.col("gram") % F.lit(1 << 8 * (k - 1))).join(out[-1].chances.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        p = (F.col("n") - discount) / F.col("total") + F.col("weight") * F.col("below")
        level = materialise(held.select("gram", "context", "weight", p.alias("p")), "kn-chances")
        out.append(Level(level.select("gram", "p"), level.groupBy("context").agg(F.first("weight").alias("weight"))))
    return out


def chances(wanted: DataFrame, levels: list[Level]) -> DataFrame:
    """(gram, p) of distinct n-grams of the order that levels end with: the seen ones from their table,
    the others by their context's weight and the chance of their suffix."""
    if not levels:
        return wanted.select("gram", F.lit(1 / SYMBOLS).alias("p"))
    k, top = len(levels), levels[-1]
    found = materialise(wanted.join(top.chances, "gram", "left"), "kn-found")
    unseen = found.filter("p is null").select("gram", F.shiftright("gram", 8).alias("context"), (F.col("gram") % F.lit(1 << 8 * (k - 1))).alias("suffix"))
    weighted = unseen.join(top.weights, "context", "left")
    if k == 1:
        rest = weighted.withColumn("below", F.lit(1 / SYMBOLS))
    else:
        below = chances(unseen.select(F.col("suffix").alias("gram")).distinct(), levels[:-1])
        rest = weighted.join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
    return found.filter("p is not null").union(rest.select("gram", (F.coalesce("weight", F.lit(1.0)) * F.col("below")).alias("p")))


def _pack(part_bytes: int) -> object:
    """Rows (part, grams, held): parts of the rows, which are kept as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("kneser")
        task, count, size = TaskContext.get().partitionId(), 0, 0
        seen, rows = KeyTable(), []

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                for r in rows:
                    to.write_batch(r)
            each = pa.array([np.sort(seen.all())], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | count]), each, pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "grams", "held"])

        for batch, data, offs in slices(batches, "_text"):
            if rows and size + len(data) > part_bytes:
                yield out()
                count, size, seen, rows = count + 1, 0, KeyTable(), []
            seen.add(distinct(grams(data, offs))[0])
            rows.append(batch)
            size += len(data)
        if rows:
            yield out()

    return run


class Costs:
    """The cost of each n-gram in bits, from numbers that hold both."""

    def __init__(self, packed: np.ndarray):
        self.bits = (packed & (1 << COST_BITS) - 1) / COST_STEPS
        self.table = KeyTable(max(4, int(4 * len(packed)).bit_length()))
        self.table.add(packed >> COST_BITS)  # numbered in order

    def rows(self, own: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, passed: int) -> pa.RecordBatch:
        """The first columns of a batch with _n and _perplexity of its texts."""
        n = np.diff(offs)
        cost = [None] * len(n)
        if len(self.bits) and len(data):
            total = np.concatenate([[0], np.cumsum(self.bits.take(self.table.find(grams(data, offs))))])[offs]
            cost = [2.0 ** (b / k) if k else None for b, k in zip(np.diff(total).tolist(), n.tolist(), strict=True)]
        columns = [own.column(i) for i in range(passed)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(cost, pa.float64())], [*(f"_{i}" for i in range(passed)), "_n", "_perplexity"])


_costs: list = [None, None]


def _look_up(held, passed: int) -> object:
    """Score rows along the broadcast costs of all n-grams."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("kneser", lambda: _costs.__setitem__(slice(None), [None, None]))
        if _costs[0] != name:  # once in a worker
            _costs[:] = [name, Costs(held.value)]
        for own, data, offs in slices(batches, "_text"):
            yield _costs[1].rows(own, data, offs, passed)

    return run


def _along(passed: int) -> object:
    """Score the rows of each part by the part's own table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("kneser")
        for batch in batches:
            for held, packed in zip(batch.column("held"), batch.column("costs"), strict=True):
                costs = Costs(packed.values.to_numpy() if packed.is_valid else np.zeros(0, np.int64))
                for rows in pa.ipc.open_stream(held.as_buffer()):
                    for own, data, offs in slices(iter([rows]), "_text"):
                        yield costs.rows(own, data, offs, passed)

    return run


def score(docs: DataFrame, levels: list[Level]) -> DataFrame:
    """The rows of docs, whose columns may have any names, with n_symbols and perplexity behind them.

    n_symbols is the length of `text` in bytes; the perplexity of a null or empty text, or without a
    model, is null.
    """
    return _scored(docs, levels).toDF(*docs.columns, "n_symbols", "perplexity")


def _scored(docs: DataFrame, levels: list[Level]) -> DataFrame:
    """As score, but columns are named _0, _1, ... by their places, then _n and _perplexity."""
    prepare(docs.sparkSession)
    names = docs.columns
    plain = docs.withColumn("_text", F.col("text").cast("string")) if "text" in names else docs.withColumn("_text", F.lit(None).cast("string"))
    plain = plain.toDF(*(f"_{i}" for i in range(len(names))), "_text")
    schema = T.StructType([*plain.schema.fields[:-1], T.StructField("_n", T.LongType()), T.StructField("_perplexity", T.DoubleType())])
    if not levels:
        empty = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.int64))
        return plain.mapInArrow(_look_up(empty, len(names)), schema)
    cost = F.least(F.round(-F.log2("p") * COST_STEPS), F.lit((1 << COST_BITS) - 1)).cast("long")
    wanted = counted(plain.select(F.col("_text").alias("text"))).select("gram")
    known = materialise(chances(wanted, levels).select("gram", F.shiftleft("gram", COST_BITS).bitwiseOR(cost).alias("cost")), "kn-costs")
    if known.count() <= MOST_BROADCAST:
        all_costs = known.select("cost").toArrow().column("cost").to_numpy()
        held = docs.sparkSession.sparkContext.broadcast(all_costs)
        return plain.mapInArrow(_look_up(held, len(names)), schema)
    parts = materialise(plain.mapInArrow(_pack(PART_BYTES), "part long, grams array<long>, held binary"), "kn-parts")
    tables = parts.select("part", F.explode("grams").alias("gram")).join(known, "gram").groupBy("part").agg(F.collect_list("cost").alias("costs"))
    return parts.select("part", "held").join(tables, "part", "left").select("held", "costs").mapInArrow(_along(len(names)), schema)


class Judge(NamedTuple):
    """Median and limit of trusted texts by language; entries under () hold for all other languages."""

    medians: dict
    limits: dict

    def usual(self, lang: str | None) -> float:
        """Median perplexity of the language's trusted texts."""
        return self.medians.get(lang) or self.medians.get(()) or 1.0

    def limit(self, lang: str | None) -> float:
        found = self.limits.get(lang, self.limits.get(()))
        return float("inf") if found is None else found * 2**SLACK_BITS


def judged(judge: Judge, lang: Column) -> Column:
    """The perplexity of a scored row with PRIOR_SYMBOLS more symbols at its language's median."""
    usual = F.log2(_by_language(judge.medians, judge.usual, lang))
    return F.pow(F.lit(2.0), (F.col("_n") * F.log2("_perplexity") + PRIOR_SYMBOLS * usual) / (F.col("_n") + PRIOR_SYMBOLS))


def _by_language(known: dict, value, lang: Column) -> Column:
    langs = [x for x in known if isinstance(x, str)]
    table = F.create_map(*(F.lit(y) for x in langs for y in (x, float(value(x))))) if langs else None
    other = F.when(lang.isNull(), F.lit(float(value(None)))).otherwise(F.lit(float(value(()))))
    return F.coalesce(table[F.coalesce(lang, F.lit(""))], other) if langs else other


def _held_out() -> Column:
    return F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(HELD_OUT)) == 0


def _named(docs: DataFrame, name: str, kind: str) -> Column:
    """A column of scored rows by its name in docs; null where docs lack it."""
    return (F.col(f"_{docs.columns.index(name)}") if name in docs.columns else F.lit(None)).cast(kind)


def fit(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, without: tuple[str, ...] = ()) -> tuple[Judge, DataFrame]:
    """The limits from trusted texts, and the rows of docs by places with _n and _perplexity (see
    _scored), written once and without the columns `without`.

    Trained on are the trusted texts but for one in HELD_OUT. A threshold is the larger of the
    quantiles over those and over all trusted texts of a language.
    """
    prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("doc_id is not null")
    trusted = materialise(known.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id"), "trusted")
    texts = select_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), trusted)
    scored = materialise(_scored(docs, train(texts.filter(~_held_out()))).drop(*(f"_{docs.columns.index(x)}" for x in without)), "perplexities")
    # One slim pass over the scores; the texts stay where they are.
    slim = scored.select(_named(docs, "doc_id", "long").alias("doc_id"), _named(docs, "lang", "string").alias("lang"), "_n", "_perplexity").filter("_perplexity is not null")
    sample = materialise(slim.join(trusted, "doc_id", "left_semi").withColumn("held_out", _held_out()), "trusted-scores")

    def quantiles(rows: DataFrame, value: str, share: float) -> dict:
        at = F.percentile_approx(value, share, 10_000).alias("q")
        return {r["lang"]: r["q"] for r in rows.groupBy("lang").agg(at).collect()} | {(): rows.agg(at).first()["q"]}

    fresh = sample.filter("held_out")
    judge = Judge(quantiles(fresh, "_perplexity", 0.5) if not fresh.isEmpty() else quantiles(sample, "_perplexity", 0.5), {})
    with_prior = sample.withColumn("judged", judged(judge, F.col("lang")))
    every, new = quantiles(with_prior, "judged", quantile), quantiles(with_prior.filter("held_out"), "judged", quantile)
    return judge._replace(limits={k: q if new.get(k) is None else max(q, new[k]) for k, q in every.items() if q is not None}), scored


def _within(judge: Judge, lang: Column) -> Column:
    return (F.col("_n") > 0) & F.coalesce(judged(judge, lang) <= _by_language(judge.limits, judge.limit, lang), F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, judged, threshold, kept of every row.

    Trusted are the documents that labels give quality 1; a document labelled both ways is not.
    judged is the perplexity with PRIOR_SYMBOLS more symbols at the median cost of the language's
    held-out trusted texts; kept is whether it is at most the threshold, SLACK_BITS a symbol above
    the quantile over the language's trusted texts, or over all of them where it has none. Null and
    empty texts are not kept; without trusted texts all others are. Repeated rows repeat; null ids
    match no label; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    judge, scored = fit(own, labels, quantile, ("text",))
    out = scored.withColumnsRenamed({"_0": "doc_id", "_2": "lang"}).withColumn("judged", judged(judge, F.col("lang"))).withColumn("threshold", _by_language(judge.limits, judge.limit, F.col("lang")))
    return out.select("doc_id", "lang", F.col("_n").alias("n_symbols"), F.col("_perplexity").alias("perplexity"), "judged", "threshold", _within(judge, F.col("lang")).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of docs that classify keeps, with all their columns, scored once and without a join on ids.

    Columns may have any names; a missing `lang` counts as null.
    """
    judge, scored = fit(docs, labels, quantile)
    return scored.filter(_within(judge, _named(docs, "lang", "string"))).drop("_n", "_perplexity").toDF(*docs.columns)
