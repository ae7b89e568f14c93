"""Scoring of predicted against reference events: multisets, optimal assignment, grouped metrics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.atoms import Multisets
from ..functions.hierarchy import refines_text
from ..functions.text import eval_key, normalize_atoms

DIAGNOSIS = "ProcedureDiagnosis"
PER_KEY = "id string, key string, tp bigint, fp bigint, fn bigint"


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def with_metrics(df: DataFrame, digits: int | None = None) -> DataFrame:
    """precision, recall and f1 from columns tp, fp, fn; 0 where nothing is counted."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    told = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return df.withColumns({"precision": told(p), "recall": told(r), "f1": told(f1(p, r))})


def event_atoms(events: Column) -> Column:
    """array<struct<ord, atoms array<struct<key, tag, atom>>>> of parsed events, without a shuffle."""

    def atoms(e: Column) -> Column:
        told = normalize_atoms(e["key"], e["jtype"], e["raw"], e["items"], e["tenth"])
        return F.transform(told, lambda a: F.struct(eval_key(e["key"]).alias("key"), a["tag"].alias("tag"), a["atom"].alias("atom")))

    return F.transform(events, lambda ev: F.struct(ev["ord"].alias("ord"), F.flatten(F.transform(ev["entries"], atoms)).alias("atoms")))


def items(events: DataFrame) -> DataFrame:
    """id, ord, key, tag, atom, n: the multiset of normalised atoms of parsed events (id, events)."""
    each = events.select("id", F.explode(event_atoms(F.col("events"))).alias("ev")).select("id", F.col("ev.ord").alias("ord"), F.explode("ev.atoms").alias("a"))
    return each.groupBy("id", "ord", "a.key", "a.tag", "a.atom").agg(F.count(F.lit(1)).alias("n"))


def overlap(gold: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """by + (tp, gold_n, pred_n) per joint value of two multisets (by, n): sizes of bag intersections.

    Both sides go through one aggregation, without a join: a row carries its count in its side.
    """
    side = lambda df, g, p: df.select(*by, g.alias("gold_n"), p.alias("pred_n"))
    both = side(gold, F.col("n"), F.lit(0).cast("bigint")).unionByName(side(pred, F.lit(0).cast("bigint"), F.col("n")))
    return both.groupBy(*by).agg(F.sum("gold_n").alias("gold_n"), F.sum("pred_n").alias("pred_n")).withColumn("tp", F.least("gold_n", "pred_n"))


def joint(items: DataFrame, by: list[str], side: str = "side") -> DataFrame:
    """What overlap gives, from one relation of single items with a side, gold or pred: one pass."""
    counted = items.groupBy(*by).agg(F.count_if(F.col(side) == "gold").alias("gold_n"), F.count_if(F.col(side) == "pred").alias("pred_n"))
    return counted.withColumn("tp", F.least("gold_n", "pred_n"))


def counts(joint: DataFrame, by: list[str]) -> DataFrame:
    """by + (tp, fp, fn) from rows of (tp, gold_n, pred_n)."""
    return joint.groupBy(*by).agg(F.sum("tp").alias("tp"), (F.sum("pred_n") - F.sum("tp")).alias("fp"), (F.sum("gold_n") - F.sum("tp")).alias("fn"))


#: Up to so many rows or columns plain lists are faster than arrays.
SMALL = 32


def _small_assignment(score: list[list[int]]) -> list[int]:
    """What best_assignment gives, step by step the same, on lists."""
    n, m = len(score), len(score[0])
    nearest = [row.index(max(row)) for row in score]
    if len(set(nearest)) == n:
        return nearest
    width, most = max(n, m), max(map(max, score))
    cost = [[most - x for x in row] + [most] * (width - m) for row in score]
    row_price, column_price, owner = [0] * n, [0] * width, [-1] * width
    far = np.iinfo(np.int64).max // 4
    for begin in range(n):
        reach, via, open_ = [far] * width, [-1] * width, list(range(width))
        settled: list[int] = []
        row, base, last = begin, 0, -1
        while row >= 0:
            own, ahead, least, pick = cost[row], base - row_price[row], far + 1, -1
            for j in open_:
                through = ahead + own[j] - column_price[j]
                if through < reach[j]:
                    reach[j], via[j] = through, last
                if reach[j] < least:
                    least, pick = reach[j], j
            last, base, row = pick, least, owner[pick]
            settled.append(pick)
            open_.remove(pick)
        row_price[begin] += base
        for j in settled[:-1]:
            row_price[owner[j]] += base - reach[j]
            column_price[j] -= base - reach[j]
        while last >= 0:
            before = via[last]
            owner[last] = owner[before] if before >= 0 else begin
            last = before
    out = [-1] * n
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    return out


def best_assignment(score: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of the greatest total, by shortest augmenting paths.

    Rows are added in order and equal costs go to the first column, which settles ties. Missing
    columns count as empty ones; they are numbered past the real columns.
    """
    n, m = score.shape
    if not n or not m:
        return np.full(n, -1)
    if max(n, m) <= SMALL:
        return np.array(_small_assignment(score.tolist()), np.int64)
    padded = np.zeros((n, max(n, m)), np.int64)
    padded[:, :m] = score
    cost = padded.max() - padded
    width = cost.shape[1]
    nearest = cost.argmin(axis=1)
    if len(set(nearest.tolist())) == n:  # no two rows meet, so no path is ever longer than one step
        return nearest
    row_price, column_price, owner = np.zeros(n, np.int64), np.zeros(width, np.int64), np.full(width, -1)
    far = np.iinfo(np.int64).max // 4
    for begin in range(n):
        reach, via, settled = np.full(width, far), np.full(width, -1), np.zeros(width, bool)
        row, base, last = begin, 0, -1
        while row >= 0:
            through = base + cost[row] - row_price[row] - column_price
            nearer = ~settled & (through < reach)
            reach[nearer], via[nearer] = through[nearer], last
            last = int(np.where(settled, far, reach).argmin())
            base, row = reach[last], owner[last]
            settled[last] = True
        inner = settled.copy()
        inner[last] = False
        row_price[begin] += base
        row_price[owner[inner]] += base - reach[inner]
        column_price[inner] -= base - reach[inner]
        while last >= 0:
            before = via[last]
            owner[last] = owner[before] if before >= 0 else begin
            last = before
    out = np.full(n, -1)
    taken = np.flatnonzero(owner >= 0)
    out[owner[taken]] = taken
    return out


def _label_pairs(gold: dict, pred: dict) -> int:
    """Most diagnosis units that can be paired where the predicted one refines the other."""
    g, p = ([a for a, k in side.items() for _ in range(k)] for side in (gold, pred))
    fit = [[int(_refines(b[1], a[1])) for b in p] for a in g]
    if not any(map(any, fit)):
        return 0
    if len(g) == 1 or len(p) == 1:
        return 1
    chosen = _assigned(fit)
    return sum(fit[i][j] for i, j in enumerate(chosen) if 0 <= j < len(p))


_refines = lru_cache(1 << 14)(refines_text)


def _assigned(score: list[list[int]]) -> list[int]:
    if max(len(score), len(score[0])) <= SMALL:
        return _small_assignment(score)
    return best_assignment(np.array(score, np.int64)).tolist()


def key_matches(key: str, gold: dict, pred: dict, hierarchical: bool) -> int:
    """Size of the bag intersection of two {atom: n}, or of the best pairing by refinement."""
    if hierarchical and key == DIAGNOSIS:
        return _label_pairs(gold, pred)
    return sum([min(k, pred[a]) for a, k in gold.items() if a in pred])


def match_document(gold: list[dict[str, dict]], pred: list[dict[str, dict]], hierarchical: bool = False) -> dict[str, list[int]]:
    """tp, fp, fn per key of one document, its events aligned by the best assignment."""
    out: dict[str, list[int]] = {}

    def add(key: str, tp: int, g: int, p: int) -> None:
        held = out.setdefault(key, [0, 0, 0])
        held[0] += tp
        held[1] += p - tp
        held[2] += g - tp

    # Only atoms that both sides hold make a score: each predicted event is found by its atoms.
    where: dict[tuple, list[tuple[int, int]]] = {}
    plain = lambda event: ((k, atoms) for k, atoms in event.items() if not (hierarchical and k == DIAGNOSIS))
    for j, p in enumerate(pred):
        for k, atoms in plain(p):
            for a, n in atoms.items():
                where.setdefault((k, a), []).append((j, n))
    score = [[0] * len(pred) for _ in gold]
    for i, g in enumerate(gold):
        row = score[i]
        for k, atoms in plain(g):
            for a, n in atoms.items():
                for j, m in where.get((k, a), ()):
                    row[j] += min(n, m)
        if hierarchical and DIAGNOSIS in g:
            for j, p in enumerate(pred):
                if DIAGNOSIS in p:
                    row[j] += _label_pairs(g[DIAGNOSIS], p[DIAGNOSIS])
    chosen = _assigned(score) if gold and pred else [-1] * len(gold)
    left = set(range(len(pred)))
    for i, j in enumerate(chosen):
        p = pred[j] if 0 <= j < len(pred) else {}
        left.discard(j)
        for k in gold[i].keys() | p.keys():
            both = key_matches(k, gold[i][k], p[k], hierarchical) if k in gold[i] and k in p else 0
            add(k, both, sum(gold[i].get(k, {}).values()), sum(p.get(k, {}).values()))
    for j in left:
        for k, atoms in pred[j].items():
            add(k, 0, 0, sum(atoms.values()))
    return out


def _multisets(lists: pa.Array) -> Iterator[list[dict[str, dict]]]:
    """Event multisets {key: {(tag, atom): n}} of each document, in event order; events without items keep their place."""
    events = lists.flatten()
    order, atoms = events.field("ord").to_pylist(), events.field("atoms")
    key, tag, atom = (c.to_pylist() for c in atoms.flatten().flatten())
    ends, begin, at = pa.compute.cumulative_sum(pa.compute.fill_null(atoms.value_lengths(), 0)).to_pylist(), 0, 0
    for n in lists.value_lengths().to_pylist():
        told = []
        for i in range(begin, begin + (n or 0)):
            held: dict[str, dict] = {}
            for j in range(at, ends[i]):
                own = held.setdefault(key[j], {})
                own[tag[j], atom[j]] = own.get((tag[j], atom[j]), 0) + 1
            at = ends[i]
            told.append((order[i], held))
        begin += n or 0
        yield [held for _, held in sorted(told, key=lambda x: x[0])]


_FOUND = pa.struct([("key", pa.string()), ("tp", pa.int64()), ("fp", pa.int64()), ("fn", pa.int64())])


FOUND = "array<struct<key: string, tp: bigint, fp: bigint, fn: bigint>>"


def _found(documents: Iterable[tuple[list, list]], hierarchical: bool) -> pa.Array:
    """What match_document tells of each document, as an Arrow list."""
    rows, ends = [], [0]
    for g, p in documents:
        rows += [(k, *n) for k, n in sorted(match_document(g, p, hierarchical).items())]
        ends.append(len(rows))
    found = pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FOUND)], fields=list(_FOUND))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found, type=pa.list_(pa.field("element", _FOUND)))


def match_arrays(gold: Column, pred: Column, hierarchical: bool = False) -> Column:
    """array<struct<key, tp, fp, fn>> of one document's event atoms, by optimal alignment."""

    def matched(gold: pa.Array, pred: pa.Array) -> pa.Array:
        return _found(zip(_multisets(gold), _multisets(pred), strict=True), hierarchical)

    return F.arrow_udf(matched, FOUND)(gold, pred)


def match_texts(gold: Column, pred: Column, hierarchical: bool = False) -> Column:
    """As match_arrays, from one document's texts: parsed, normalised and aligned where they lie."""

    def matched(gold: pa.Array, pred: pa.Array) -> pa.Array:
        told = Multisets()
        return _found(((told.events(g), told.events(p)) for g, p in zip(gold.to_pylist(), pred.to_pylist(), strict=True)), hierarchical)

    return F.arrow_udf(matched, FOUND)(gold, pred)


def matched_counts(gold: DataFrame, pred: DataFrame, hierarchical: bool = False) -> DataFrame:
    """id, key, tp, fp, fn of the documents on both sides.

    gold and pred are items (id, ord, key, tag, atom, n), gathered per document: a document's own
    size bounds each array. Each side is dealt by id once; both groupings and the join reuse that.
    """
    parts = int(gold.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def gathered(df: DataFrame, name: str) -> DataFrame:
        one = F.flatten(F.collect_list(F.array_repeat(F.struct("key", "tag", "atom"), F.col("n").cast("int"))))
        events = df.repartition(parts, "id").groupBy("id", "ord").agg(one.alias("atoms"))
        return events.groupBy("id").agg(F.collect_list(F.struct("ord", "atoms")).alias(name))

    joined = gathered(gold, "g").join(gathered(pred, "p"), "id")
    return joined.select("id", F.explode(match_arrays(F.col("g"), F.col("p"), hierarchical)).alias("c")).select("id", "c.*")


def matched_items(items: DataFrame, hierarchical: bool = False, side: str = "side") -> DataFrame:
    """As matched_counts, from one relation of single items (id, ord, key, tag, atom) with a side, gold or
    pred: dealt by id once, which both groupings reuse, and without a join."""
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = F.struct((F.col(side) == "gold").alias("gold"), F.col("ord").cast("bigint").alias("ord"), "key", "tag", "atom")
    docs = items.repartition(parts, "id").groupBy("id").agg(F.collect_list(told).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("items")
            gold, order, key, tag, atom = (c.to_pylist() for c in lists.flatten().flatten())
            ends = pa.compute.cumulative_sum(lists.value_lengths()).to_pylist()
            out: list[tuple] = []
            begin = 0
            for name, end in zip(batch.column("id").to_pylist(), ends, strict=True):
                sides: tuple[dict, dict] = {}, {}
                for i in range(begin, end):
                    own = sides[0 if gold[i] else 1].setdefault(order[i], {}).setdefault(key[i], {})
                    own[tag[i], atom[i]] = own.get((tag[i], atom[i]), 0) + 1
                begin = end
                if sides[0] and sides[1]:
                    g, p = ([side[o] for o in sorted(side)] for side in sides)
                    out += [(name, k, *n) for k, n in sorted(match_document(g, p, hierarchical).items())]
            kinds = [batch.schema.field("id").type, pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["id", "key", "tp", "fp", "fn"])

    return docs.select(F.col("id").cast("string").alias("id"), "items").mapInArrow(run, PER_KEY)


def score(gold: DataFrame, pred: DataFrame, hierarchical: bool = False) -> DataFrame:
    """Per-document and key counts of parsed documents (id, events): one join, then one UDF."""
    side = lambda df, name: df.select("id", event_atoms(F.col("events")).alias(name))
    joined = side(gold, "g").join(side(pred, "p"), "id")
    return joined.select("id", F.explode(match_arrays(F.col("g"), F.col("p"), hierarchical)).alias("c")).select("id", "c.*")


def score_texts(gold: DataFrame, pred: DataFrame, hierarchical: bool = False) -> DataFrame:
    """As score, from documents (id, text) not parsed yet: only texts are joined, and the plan holds one UDF."""
    joined = gold.select("id", F.col("text").alias("g")).join(pred.select("id", F.col("text").alias("p")), "id")
    return joined.select("id", F.explode(match_texts(F.col("g"), F.col("p"), hierarchical)).alias("c")).select("id", "c.*")


def per_key(doc_key: DataFrame, by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Metrics per key (and further columns), pooled over documents."""
    pooled = doc_key.groupBy(*(by or []), "key").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return with_metrics(pooled, digits).withColumns({"gold_items": F.col("tp") + F.col("fn"), "pred_items": F.col("tp") + F.col("fp")})


def micro(doc_key: DataFrame, by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Metrics pooled over keys and documents, per group or of all."""
    return with_metrics(doc_key.groupBy(*(by or [])).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn"))), digits)


def macro(per_key_table: DataFrame, by: list[str] | None = None, digits: int = 9) -> DataFrame:
    """Mean F1 over the keys that are there."""
    return per_key_table.groupBy(*(by or [])).agg(F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), digits).alias("macro_f1"), F.count(F.lit(1)).alias("n_keys"))
