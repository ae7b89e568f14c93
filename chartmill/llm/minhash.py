"""Near duplicates by an LSH forest over MinHash signatures.

Each distinct shingle set gets a signature of 64 minima. Sixteen orders sort all signatures,
each from another component on; rows that agree in the first components of an order form a
region. A region's depth adapts: small regions are compared whole, crowded ones are split at
the next component, and what is still crowded at the last is compared with its neighbours by
longest common prefix and with the region's hub. A byte sketch of the signature screens the
candidates; surviving pairs are confirmed on the full shingle sets. Rows with equal sets are
one class, so groups of copies cost one row each.

What that first pass links is contracted. A second pass screens every remaining pair, of rows
not yet linked, that agree in the first two components of any order; large regions are dealt as
pairs of blocks, so none is cut. There a parity bitmap joins the screen: each shingle flips one
bit, so two bitmaps differ in at most as many bits as the sets in elements, and no pair that
reaches the similarity is turned away, while nearly all others are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, claim, materialise, prepare, slices, text_buffers
from .components import components
from .words import byte_table, chain, mix, word_hashes, word_spans

SPACES = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
COMPONENTS, ORDERS, DEPTH = 64, 16, 8
#: Regions of so many rows or fewer are compared whole and emit every pair that passes.
SMALL = 8
#: Larger ones are compared whole up to this size; each row keeps its best partners and the hub.
BLOCK, BEST = 512, 2
#: A row whose sketch agrees with the hub's in this share needs no other partner in the first pass.
NEAR_HUB = 0.85
#: A screen 4.6 standard deviations below a similarity of 0.75.
SCREEN = 0.5
#: In the second pass cells of so many rows or fewer are screened together.
FEW = 32
#: Larger ones are dealt as pairs of blocks of about so many rows.
WIDE = 2048
#: Bits of the parity bitmap of a shingle set.
PARITY_BITS = 2048


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct k-word shingles of text i are hashes[first[i]:first[i+1]].

    Shorter texts have their whole word sequence as the one shingle; texts without words none.
    """
    starts, ends, first = word_spans(data, offs, SPACES)
    words, n = word_hashes(data, starts, ends), np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    whole = np.flatnonzero(np.arange(len(words)) + k <= first[doc + 1]) if len(words) else np.zeros(0, np.int64)
    found, owner = [chain(words, k)[whole]], [doc[whole]]
    for m in range(1, k):
        few = np.flatnonzero(n == m)
        if len(few):
            found.append(mix(chain(words, m)[first[few]] + np.uint64(m)))
            owner.append(few)
    h, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(len(n) + 1))


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, COMPONENTS + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of big-endian 32-bit minima for each non-empty set."""
    filled = first[:-1][np.diff(first) > 0]
    out = np.empty((len(filled), COMPONENTS), ">u4")
    if len(filled):
        for i, m in enumerate(_multipliers()):
            out[:, i] = np.minimum.reduceat(h * m, filled) >> np.uint64(32)
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """A byte of each component of big-endian signatures: unlike minima agree in one of 256."""
    factors = (mix(np.arange(7, 7 + COMPONENTS, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
    return ((sig.astype(np.uint32) * factors) >> np.uint32(24)).astype(np.uint8)


def parities(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of PARITY_BITS bits for each set: bit i is odd if an odd number of its shingles fall there."""
    n, wide = len(first) - 1, PARITY_BITS
    out = np.empty((n, wide // 8), np.uint8)
    for a in range(0, n, 1024):
        z = min(n, a + 1024)
        part = mix(h[first[a] : first[z]] ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - wide.bit_length() + 1)
        row = np.repeat(np.arange(z - a), np.diff(first[a : z + 1]))
        odd = np.bincount(row * wide + part.astype(np.int64), minlength=(z - a) * wide) & 1
        out[a:z] = np.packbits(odd.astype(np.uint8).reshape(z - a, wide), axis=1)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("minhash")
    for rows, data, offs in slices(batches, "text"):
        h, first = shingle_sets(data, offs)
        n = np.diff(first)
        full = n > 0
        h1, h2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        if full.any():
            at = first[:-1][full]
            h1[full] = np.add.reduceat(mix(h + np.uint64(1)), at)
            h2[full] = np.bitwise_xor.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at)
        sig = signatures(h, first)

        def cells(values: np.ndarray, full=full) -> pa.Array:
            out = np.full(len(full), None, object)
            out[full] = [x.tobytes() for x in values]
            return pa.array(out, pa.binary())

        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), cells(sig), cells(sketches(sig)), cells(parities(h, first)[full])],
            ["doc_id", "n_shingles", "h1", "h2", "sig", "sketch", "parity"],
        )


def _matrix(rows: pa.RecordBatch, column: str, kind, width: int) -> np.ndarray:
    """A column of byte strings of one length as an array."""
    data, _ = text_buffers(rows.column(column))
    return data.view(kind).reshape(-1, width)


def _runs(key: np.ndarray, depth: int) -> np.ndarray:
    """Edges of the runs of rows that agree in the order and its first `depth` components."""
    new = np.ones(len(key) + 1, bool)
    if len(key):
        new[1:-1] = (key[1:, : depth + 1] != key[:-1, : depth + 1]).any(axis=1)
    return np.flatnonzero(new)


def _close(sketch: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that can reach the similarity by size and pass the screen."""
    fits = 4 * np.minimum(size[a], size[b]) >= 3 * np.maximum(size[a], size[b])
    a, b = a[fits], b[fits]
    good = (sketch[a] == sketch[b]).sum(axis=1) >= SCREEN * COMPONENTS
    return np.stack([a[good], b[good]])


def _crowded(lo: int, hi: int, key, sketch, size, depth: int, out: list) -> None:
    """Pairs within a crowded region: hub, best partners, then deeper regions."""
    rows = sketch[lo:hi]
    common = np.array([np.bincount(rows[:, c], minlength=256).argmax() for c in range(COMPONENTS)], np.uint8)
    hub = lo + int((rows == common).sum(axis=1).argmax())
    others = np.arange(lo, hi)
    out.append(_close(sketch, size, np.full(len(others), hub), others))
    far = (rows == sketch[hub]).sum(axis=1) < NEAR_HUB * COMPONENTS
    if hi - lo <= BLOCK:
        agree = np.zeros((hi - lo, hi - lo), np.uint8)
        for c in range(COMPONENTS):
            agree += rows[:, c][:, None] == rows[:, c][None, :]
        np.fill_diagonal(agree, 0)
        best = np.argpartition(agree[far], -BEST, axis=1)[:, -BEST:]
        out.append(_close(sketch, size, np.repeat(others[far], BEST), lo + best.ravel()))
        return
    if depth < DEPTH:
        edges = lo + _runs(key[lo:hi], depth + 1)
        _regions(edges, key, sketch, size, depth + 1, out)
    else:
        for at in range(lo, hi, BLOCK):
            if min(hi, at + BLOCK) - at > 1:
                _crowded(at, min(hi, at + BLOCK), key, sketch, size, depth, out)
    for d in range(1, BEST + 1):
        some = far[:-d] | far[d:]
        out.append(_close(sketch, size, others[:-d][some], others[d:][some]))


def _regions(edges: np.ndarray, key, sketch, size, depth: int, out: list) -> None:
    width = np.diff(edges)
    small = (width > 1) & (width <= SMALL)
    at, left = edges[:-1][small], width[small]
    rank = np.concatenate([np.arange(w) for w in left]) if len(left) else np.zeros(0, np.int64)
    rows, rest = np.repeat(at, left) + rank, np.repeat(left, left) - rank
    for d in range(1, int(left.max(initial=1))):
        a = rows[rest > d]
        out.append(_close(sketch, size, a, a + d))
    for i in np.flatnonzero(width > SMALL):
        _crowded(int(edges[i]), int(edges[i + 1]), key, sketch, size, depth, out)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of one sorted partition; a region that a batch cuts is carried on."""
    claim("minhash")
    held: list[pa.RecordBatch] = []

    def work(last: bool) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        order = rows.column("tree").to_numpy().astype(np.uint32)
        key = np.concatenate([order[:, None], _matrix(rows, "key", ">u4", DEPTH).astype(np.uint32)], axis=1)
        sketch = _matrix(rows, "sketch", np.uint8, COMPONENTS)
        doc, size = rows.column("doc_id").to_numpy(), rows.column("n_shingles").to_numpy()
        edges = _runs(key, 2)
        if not last and edges[-2] > 0:  # the last region may go on
            held[:] = [rows.slice(edges[-2])]
            edges = edges[:-1]
        else:
            held.clear()
        out: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
        _regions(edges, key, sketch, size, 2, out)
        a, b = np.concatenate(out, axis=1)
        pairs = np.unique(np.stack([np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])]), axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= 16384:
            yield from work(False)
            count = sum(x.num_rows for x in held)
    if held:
        yield from work(True)


def candidates(classes: DataFrame) -> DataFrame:
    """Distinct (u, v) with u < v among classes (doc_id, n_shingles, sig, sketch), by sixteen sorted orders."""
    width, step = 4 * DEPTH, 4 * COMPONENTS // ORDERS
    trees = classes.select("doc_id", "n_shingles", "sig", "sketch", F.explode(F.array(*(F.lit(i) for i in range(ORDERS)))).alias("tree"))
    keyed = trees.select("doc_id", "n_shingles", "sketch", "tree", F.expr(f"substring(concat(sig, sig), tree * {step} + 1, {width})").alias("key"))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, "tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")
    return dealt.mapInArrow(_neighbours, "u long, v long").distinct()


class Screen:
    """What decides whether two rows of a batch can reach the similarity: sizes, sketches, parity bitmaps."""

    def __init__(self, rows: pa.RecordBatch, similarity_percent: int):
        self.sketch = _matrix(rows, "sketch", np.uint8, COMPONENTS)
        self.parity = _matrix(rows, "parity", np.uint64, PARITY_BITS // 64)
        self.size, self.label = rows.column("n_shingles").to_numpy(), rows.column("label").to_numpy()
        self.more, self.less = 100 + similarity_percent, 100 - similarity_percent

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pairs that pass. Sets of sizes n and m whose Jaccard similarity is s at least differ in
        (1 - s) / (1 + s) (n + m) elements at most."""
        a, b = _close(self.sketch, self.size, a, b)
        good = np.empty(len(a), bool)
        for i in range(0, len(a), 1 << 16):
            x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            unlike = np.bitwise_count(self.parity[x] ^ self.parity[y]).sum(axis=1, dtype=np.int64)
            good[i : i + (1 << 16)] = self.more * unlike <= self.less * (self.size[x] + self.size[y])
        return np.stack([a[good], b[good]])


def _rest(similarity_percent: int) -> object:
    """All pairs of unlike labels that pass the screen, cell by cell; cells arrive sorted and whole.

    A cell is two blocks of a region; rows of one block meet each other only in its cell with itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        held: list[pa.RecordBatch] = []

        def work(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cell = np.stack([rows.column(c).to_numpy() for c in ("region", "lo", "hi")])
            block, alone = rows.column("block").to_numpy(), cell[1] == cell[2]
            new = np.ones(cell.shape[1] + 1, bool)
            new[1:-1] = (cell[:, 1:] != cell[:, :-1]).any(axis=0)
            edges = np.flatnonzero(new)
            held.clear()
            if not last:  # the last cell may go on
                held.append(rows.slice(edges[-2]))
                edges = edges[:-1]
            screen, doc = Screen(rows, similarity_percent), rows.column("doc_id").to_numpy()
            label, width = screen.label, np.diff(edges)
            few = (width > 1) & (width <= FEW)
            at, left = edges[:-1][few], width[few]
            rank = np.concatenate([np.arange(w) for w in left]) if len(left) else np.zeros(0, np.int64)
            each, more = np.repeat(at, left) + rank, np.repeat(left, left) - rank
            out = [np.zeros((2, 0), np.int64)]
            for d in range(1, int(left.max(initial=1))):
                a = each[more > d]
                a = a[(label[a] != label[a + d]) & (alone[a] | (block[a] != block[a + d]))]
                out.append(screen.close(a, a + d))
            for i in np.flatnonzero(width > FEW):
                inside = np.arange(edges[i], edges[i + 1])
                first = inside[block[inside] == cell[1, edges[i]]]
                second = None if alone[edges[i]] else inside[block[inside] == cell[2, edges[i]]]
                out.extend(_across(first, second, screen))
            a, b = np.concatenate(out, axis=1)
            pairs = np.unique(np.stack([np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= 16384:
                yield from work(False)
                count = sum(x.num_rows for x in held)
        if held:
            yield from work(True)

    return run


def _across(one: np.ndarray, two: np.ndarray | None, screen: Screen) -> Iterator[np.ndarray]:
    """The pairs of unlike labels between two blocks, or within one, that pass the screen; a strip at a time."""
    across, sketch, label = one if two is None else two, screen.sketch, screen.label
    columns = np.ascontiguousarray(sketch[across].T)
    for at in range(0, len(one), BLOCK):
        strip = one[at : at + BLOCK]
        agree = np.zeros((len(strip), len(across)), np.uint8)
        for own, c in zip(sketch[strip].T, columns, strict=True):
            agree += own[:, None] == c[None, :]
        a, b = np.nonzero((agree >= SCREEN * COMPONENTS) & (label[strip][:, None] != label[across][None, :]))
        a, b = strip[a], across[b]
        yield screen.close(*((a, b) if two is not None else (a[a < b], b[a < b])))


def rest(classes: DataFrame, labels: DataFrame, similarity_percent: int = 75) -> DataFrame:
    """Distinct (u, v) with u < v of unlike labels that share a region of two components and pass the screen."""
    step = 4 * COMPONENTS // ORDERS
    trees = classes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    trees = trees.select("h1", "h2", "label", "sig", F.explode(F.array(*(F.lit(i) for i in range(ORDERS)))).alias("tree"))
    keyed = materialise(trees.select("h1", "h2", "label", F.expr(f"xxhash64(tree, substring(sig, tree * {step} + 1, 8))").alias("region")), "regions")
    mixed = keyed.groupBy("region").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.ceil(F.count(F.lit(1)) / WIDE).alias("blocks"))
    # A region of several blocks is dealt as the cells of all pairs of them.
    blocked = keyed.join(mixed.filter("least < most").select("region", "blocks"), "region").withColumn("block", F.pmod(F.xxhash64("h1", "h2", "region"), "blocks"))
    celled = blocked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    dealt = celled.join(classes.select("h1", "h2", "doc_id", "n_shingles", "sketch", "parity"), ["h1", "h2"])
    dealt = dealt.select("region", "lo", "hi", "block", "doc_id", "n_shingles", "label", "sketch", "parity").repartition("region", "lo", "hi").sortWithinPartitions("region", "lo", "hi")
    return dealt.mapInArrow(_rest(similarity_percent), "u long, v long").distinct()


def _sets(kept: IdFilter) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices((kept(b) for b in batches if b.num_rows), "text"):
            h, first = shingle_sets(data, offs)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([h[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())], ["doc_id", "members"])

    return run


def _confirm(similarity_percent: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                keep.append(100 * both >= similarity_percent * ((len(a) + len(b)) // 8 - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    return run


def _confirmed(docs: DataFrame, pairs: DataFrame, similarity_percent: int, more: DataFrame | None = None) -> DataFrame:
    """The pairs (u, v) whose full sets have the similarity, and the links in `more`."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    kept = IdFilter(ids)
    slotted = docs.filter("doc_id is not null").withColumn("slot", kept.slot())
    sets = materialise(slotted.mapInArrow(_sets(kept), "doc_id long, members binary"), "sets")
    left = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("members").alias("one")), "u")
    joined = left.join(sets.select(F.col("doc_id").alias("v"), F.col("members").alias("two")), "v").select("u", "v", "one", "two")
    links = joined.mapInArrow(_confirm(similarity_percent), "u long, v long")
    return materialise(links.union(more) if more is not None else links, "links")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) once more links between nodes, some of them not labelled yet, hold."""
    both = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    all_labels = labels.join(both, "node", "full_outer").select("node", F.coalesce("label", "node").alias("label"))
    at = lambda end: all_labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    heads = links.join(at("u"), "u").join(at("v"), "v").select(F.col("u_label").alias("u"), F.col("v_label").alias("v"))
    further = components(heads).select(F.col("node").alias("label"), F.col("label").alias("far"))
    return materialise(all_labels.join(further, "label", "left").select("node", F.coalesce("far", "label").alias("label")), "labels")


def near_duplicates(docs: DataFrame, similarity_percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link when their 5-word shingle sets have that Jaccard similarity; component_id is
    the smallest doc_id reachable. Null and empty texts have no shingles and link with nothing.
    Repeated rows are copies of each other; rows that share a doc_id are one node. A null doc_id
    gives a null component_id and is not kept. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = materialise(docs.mapInArrow(_describe, "doc_id long, n_shingles long, h1 long, h2 long, sig binary, sketch binary, parity binary"), "signatures")
    filled = described.filter("n_shingles > 0 and doc_id is not null")
    classes = materialise(filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.min_by(F.struct("sig", "sketch", "parity"), "doc_id").alias("like"), F.count(F.lit(1)).alias("copies")).select("h1", "h2", "doc_id", "n_shingles", "like.*", "copies"), "classes")
    links = _confirmed(docs, materialise(candidates(classes.select("doc_id", "n_shingles", "sig", "sketch")), "pairs"), similarity_percent, _same_id(filled))
    labels = components(links)
    missed = materialise(rest(classes, labels, similarity_percent), "pairs")
    if not missed.isEmpty():
        found = _confirmed(docs, missed, similarity_percent)
        labels = _joined(labels, found)
    # A class of several rows points at its smallest id, which the links may lead further.
    heads = classes.filter("copies > 1").select("h1", "h2", F.col("doc_id").alias("head"))
    with_head = described.select("doc_id", "n_shingles", "h1", "h2").join(heads, ["h1", "h2"], "left").withColumn("head", F.when(F.col("n_shingles") > 0, F.coalesce("head", "doc_id")).otherwise(F.col("doc_id")))
    out = with_head.join(labels.select(F.col("node").alias("head"), "label"), "head", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "head").alias("component_id")).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _same_id(filled: DataFrame) -> DataFrame:
    """Links between the classes that rows of one doc_id belong to."""
    twice = filled.groupBy("doc_id").agg(F.count_distinct("h1", "h2").alias("n")).filter("n > 1").select("doc_id")
    heads = filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("head"))
    return filled.join(twice, "doc_id", "left_semi").join(heads, ["h1", "h2"]).select(F.col("doc_id").alias("u"), F.col("head").alias("v"))
