"""Mixture-controlled packing by deficit round robin over one queue per source.

Each round (a window of the output) adds to a source's deficit its quantum, its share of the
window's tokens; the source sends the whole tokens of its deficit and carries the fraction on.
What a source has sent after w rounds is therefore floor(w * quantum), so the place of any
token follows from its place in its queue alone, and partitions need only the sums before them.
A target mixture is served until a queue runs dry; the others then share its part, a new phase.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder, Merges, binaries
from .common import claim, materialise, prepare, slices

SEQUENCE = 1024
#: Sequences that one window's worth of tokens fills.
WINDOW_SEQUENCES = 64
#: Distinct pieces a worker remembers; see bpe.PieceCache.
CACHE_PIECES = 400_000


class Tokenizer:
    """The ids of a byte-level BPE file of the tokenizers library, special tokens of a text included."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Plain

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, vocab = told["model"], told["model"]["vocab"]
        odd = [t for t in told["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if told["normalizer"] or told["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or model["type"] != "BPE" or model["ignore_merges"] or odd:
            raise ValueError("not a byte-level BPE file without a normalizer")
        own = Plain.from_file(path)
        letters = own.pre_tokenizer.alphabet()
        # A byte's letter is itself where it can be seen; the others follow from 256 on, in order.
        seen = [chr(b) if chr(b) in letters and b != 0x20 else None for b in range(256)]
        more = iter(range(256, 512))
        names = [x if x else chr(next(more)) for x in seen]
        pairs = [(vocab[a], vocab[b], i, vocab[a + b]) for i, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in model["merges"])]
        merges = Merges(np.array([vocab[x] for x in names]), np.array(pairs, np.int64).reshape(-1, 4))
        self.encoder = Encoder(merges, lambda p: own.encode(p.decode(), add_special_tokens=False).ids, {}, cache_pieces)
        self.special = {t["content"].encode(): t["id"] for t in told["added_tokens"]}
        by_length = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.find = re.compile(b"|".join(by_length)).finditer if by_length else lambda raw: iter(())

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of each text."""
        raw = data.tobytes()
        spots = [m.span() for m in self.find(raw)] if any(x in raw for x in self.special) else []
        if not spots:
            return self.encoder(data, offs)
        # Texts with special tokens in them are encoded stretch by stretch.
        ids, size = [], []
        for a, z in zip(offs.tolist(), offs[1:].tolist(), strict=False):
            at, own = a, []
            for m in self.find(raw[a:z]) if any(x in raw[a:z] for x in self.special) else ():
                own += [self.encoder(data[at : a + m.start()], np.array([0, a + m.start() - at]))[0], [self.special[m[0]]]]
                at = a + m.end()
            own.append(self.encoder(data[at:z], np.array([0, z - at]))[0])
            ids += own
            size.append(sum(map(len, own)))
        return np.concatenate(ids).astype(np.int64), np.concatenate([[0], np.cumsum(size)])


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _encode(path: str, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): each text's ids and a final id 0."""
    ids, at = _tokenizer(path)(data, offs)
    out = np.zeros(len(ids) + len(at) - 1, np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(at) - 1), np.diff(at))] = ids
    return out, at + np.arange(len(at))


def _tokenise(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("packing", _tokenizer.cache_clear)
        part, sent = TaskContext.get().partitionId(), {}
        for rows, data, offs in slices(batches, "text"):
            ids, at = _encode(path, data, offs)
            n, before = np.diff(at).tolist(), []
            for s, k in zip(rows.column("source").to_pylist(), n, strict=True):
                before.append(sent.get(s, 0))
                sent[s] = before[-1] + k
            short = binaries(ids.astype("<u2" if ids.max(initial=0) < 65536 else "<u4"), at)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("source"), pa.array(np.full(len(n), part), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), short], ["doc_id", "source", "part", "before", "n_tokens", "ids"])

    return run


def phases(totals: dict[str, int], weights: dict[str, float] | None = None) -> list[tuple[int, dict[str, tuple[int, int]]]]:
    """[(tokens before, {source: (its tokens before, its tokens)})]: the stretches of constant shares.

    Without weights the target is the corpus's own mixture and one phase drains all queues.
    A source without a weight, or of weight 0, follows when all others are dry.
    """
    left, out, begin = {s: n for s, n in totals.items() if n}, [], 0
    served = dict.fromkeys(left, 0)
    while left:
        share = left if weights is None else {s: weights.get(s, 0) for s in left if weights.get(s, 0) > 0} or left
        rounds, dry = min((left[s] / share[s], s) for s in share)
        amount = {s: left[s] if s == dry or share is left else min(left[s], int(rounds * share[s])) for s in sorted(share)}
        amount = {s: n for s, n in amount.items() if n}
        out.append((begin, {s: (served[s], n) for s, n in amount.items()}))
        begin += sum(amount.values())
        for s, n in amount.items():
            served[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
    return out


class Schedule:
    """Where in the output the tokens of a queue go."""

    def __init__(self, plan: list, window: int):
        self.window, self.plan = window, plan
        self.stretch: dict[str, list] = {}
        for i, (_, amounts) in enumerate(plan):
            for k, (s, (before, n)) in enumerate(amounts.items()):
                self.stretch.setdefault(s, []).append((before, before + n, i, k, n))
        self.sums = [sum(n for _, n in a.values()) for _, a in plan]
        self.counts = [[n for _, n in a.values()] for _, a in plan]
        self.rounds = [-(-t // window) for t in self.sums]
        self.sent = lru_cache(maxsize=1024)(self._sent)

    def _sent(self, i: int, w: int) -> list[int]:
        """Tokens of each source sent in the first w rounds of phase i."""
        if w >= self.rounds[i]:
            return self.counts[i]
        return [w * n * self.window // self.sums[i] for n in self.counts[i]]

    def place(self, source: str, at: int, stop: int) -> Iterator[tuple[int, int, int]]:
        """(from, to, output position) for queue positions at..stop, cut at window edges."""
        for before, after, i, k, n in self.stretch[source]:
            while at < min(stop, after):
                y = at - before
                w = min(((y + 1) * self.sums[i] - 1) // (n * self.window), self.rounds[i] - 1)
                now, then = self.sent(i, w), self.sent(i, w + 1)
                end = min(stop, before + then[k])
                yield at, end, self.plan[i][0] + sum(then[:k]) + sum(now[k:]) + y - now[k]
                at = end


def cut(schedule: Schedule, source: str, at: int, stop: int, sequence: int = SEQUENCE) -> list[list[int]]:
    """[queue position, length, output position] of the pieces; none crosses a sequence's end."""
    out: list[list[int]] = []
    for a, b, to in schedule.place(source, at, stop):
        while a < b:
            n = min(b - a, sequence - to % sequence)
            if out and out[-1][2] + out[-1][1] == to and to % sequence:
                out[-1][1] += n
            else:
                out.append([a, n, to])
            a, to = a + n, to + n
    return out


def _pieces(schedule: Schedule, sequence: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            names = ("doc_id", "source", "queue_at", "n_tokens", "ids")
            for doc, source, at, n, ids in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                wide = np.frombuffer(ids, "<u2").astype("<u4") if len(ids) == 2 * n else np.frombuffer(ids, "<u4")
                for a, k, to in cut(schedule, source, at, at + n, sequence):
                    start = a - at
                    for column, x in zip(rows, (doc, start, k, zlib.crc32(wide[start : start + k].tobytes()), n, to // sequence, to % sequence), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, weights: dict[str, float] | None = None, sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    A document is its ids and a final id 0; a null text is empty and a null source is a queue of
    its own. Rows that repeat are packed once each. Only the last sequence is not full. What the
    driver holds is one number per source; what partitions share is one row per task and source.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"))
    tokens = materialise(docs.mapInArrow(_tokenise(tokenizer), "doc_id long, source string, part int, before long, n_tokens long, ids binary"), "tokens")
    sums = materialise(tokens.groupBy("part", "source").agg(F.sum("n_tokens").alias("n")), "queue-sums")
    totals = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    schedule = Schedule(phases(totals, {f"={s}": w for s, w in weights.items()} if weights else None), sequence * window_sequences)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = sums.select("part", "source", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    queued = tokens.join(begin, ["part", "source"]).select("doc_id", "source", (F.col("begin") + F.col("before")).alias("queue_at"), "n_tokens", "ids")
    plan, window = schedule.plan, schedule.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pieces")
        yield from _pieces(Schedule(plan, window), sequence)(batches)

    return queued.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
