"""Byte-level BPE: pre-tokenisation by an associative scan, cached pair merging, decoding.

The split pattern is a small automaton over codepoint classes. Every character stands for a
transition function on the automaton's states; the functions that occur form a finite monoid,
so composing two is one table lookup and the state before every character is a prefix scan.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import claim, prepare, slices
from .tables import KeyTable
from .words import mix

# Character classes, with what must be known of the characters to the right.
LETTER, NUMBER, OTHER, QUOTE_1, QUOTE_2, SPACE_LAST, SPACE_MORE, WHITE_LAST, WHITE_MORE = range(9)
# States: what the character before belongs to.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_SPACE, SUFFIX_1, SUFFIX_2 = range(8)
#: Code points with the property White_Space.
WHITE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a token begins here)."""
    if state == SUFFIX_2:
        return SUFFIX_1, False
    if state == SUFFIX_1:
        return FRESH, False
    if symbol in (LETTER, NUMBER, OTHER):
        to = (IN_LETTERS, IN_NUMBERS, IN_OTHERS)[symbol]
        return to, state not in (to, AFTER_SPACE)
    if symbol in (QUOTE_1, QUOTE_2):
        if state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, False
        return (SUFFIX_1 if symbol == QUOTE_1 else SUFFIX_2), True
    if symbol == SPACE_LAST:
        return AFTER_SPACE, True
    if symbol == WHITE_LAST:
        return FRESH, True
    return IN_WHITE, state != IN_WHITE


#: Elements are kept multiplied by this, so that a pair's place in the product table is a sum.
STRIDE = 512


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(element of a symbol, products, image of (element, state), begins table, identity).

    Symbols 9 to 17 are those of a text's first character: they forget the state before.
    """
    functions = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
    functions += [(f[FRESH],) * 8 for f in functions]
    identity = tuple(range(8))
    found = {f: i for i, f in enumerate(dict.fromkeys([identity, *functions]))}
    while True:
        new = [g for a in found for b in found if (g := tuple(b[a[s]] for s in range(8))) not in found]
        if not new:
            break
        for g in new:
            found.setdefault(g, len(found))
    m = len(found)
    assert m <= STRIDE
    product = np.zeros((m, STRIDE), np.int32)
    for a, i in found.items():
        for b, j in found.items():
            product[i, j] = found[tuple(b[a[s]] for s in range(8))] * STRIDE
    image = np.array([x for f in found for x in f], np.uint8)
    begins = np.array([[_step(s, x)[1] for x in range(9)] for s in range(8)], bool)
    return np.array([found[f] for f in functions], np.int32), product.ravel(), image, begins.ravel(), found[identity]


def _states(x: np.ndarray, width: int = 64) -> np.ndarray:
    """State after each character: prefix products within blocks, then of the blocks' totals."""
    _, product, image, _, identity = _monoid()
    n = len(x)
    width = min(width, n)
    rows = -(-n // width)
    block = np.full(rows * width, identity, np.int32)
    block[:n] = x
    block = np.ascontiguousarray(block.reshape(rows, width).T)
    block[0] *= STRIDE
    for j in range(1, width):
        block[j] = product.take(block[j - 1] + block[j])
    start = np.zeros(rows, np.uint8)
    if rows > 1:
        start[1:] = _states(block[-1][:-1] // STRIDE, max(2, min(width, rows - 1)))
    block >>= 6  # an element's row in image is 8 wide
    return np.ascontiguousarray(image.take(block + start[None, :]).T).ravel()[:n]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER, SPACE_LAST or WHITE_LAST for every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE] = WHITE_LAST
    out[0x20] = SPACE_LAST
    return out


def codepoints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte offset of each) of valid UTF-8."""
    if not (data & 0x80).any():
        return data, np.arange(len(data))
    at = np.flatnonzero((data & 0xC0) != 0x80)
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), at


def token_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pieces of the split pattern begin, text by text."""
    if not len(data):
        return np.zeros(0, np.int64)
    cp, at = codepoints(data)
    n = len(cp)
    kind = _classes().take(cp)
    filled = np.flatnonzero(np.diff(offs))
    heads = np.searchsorted(at, offs[filled])
    head = np.zeros(n + 1, bool)
    head[heads] = True
    head[n] = True
    symbol = kind.copy()
    white = kind >= SPACE_LAST
    more = np.empty(n, bool)  # white space follows, or nothing
    more[:-1] = white[1:]
    more[-1] = True
    more |= head[1:]
    symbol[white & more] += 1
    quotes = np.flatnonzero(cp == 0x27)
    if len(quotes):
        text = np.concatenate([cp, np.zeros(2, cp.dtype)])
        a, b = text[quotes + 1], text[quotes + 2]
        inner = ~head[quotes + 1]
        one = inner & np.isin(a, [ord(c) for c in "stmd"])
        two = inner & ~head[np.minimum(quotes + 2, n)] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        symbol[quotes[one]] = QUOTE_1
        symbol[quotes[two]] = QUOTE_2
    element, _, _, begins, _ = _monoid()
    first = symbol.copy()
    first[heads] += 9
    before = np.empty(n, np.uint8)
    before[1:] = _states(element.take(first))[:-1]
    before[heads] = FRESH
    before *= 9
    before += symbol
    return at[begins.take(before)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merger(ranks: dict[bytes, int]) -> Callable[[bytes], bytes]:
    """Merge the lowest-ranked adjacent pair again and again; ids as little-endian uint32."""
    get, none = ranks.get, len(ranks) + 1

    def merge(piece: bytes) -> bytes:
        whole = get(piece)
        if whole is not None:
            return whole.to_bytes(4, "little")
        if len(piece) > 500:
            return long_merge(piece)
        cut = list(range(len(piece) + 1))
        rank = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while rank:
            low = min(rank)
            if low == none:
                break
            i = rank.index(low)
            del cut[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(piece[cut[i] : cut[i + 2]], none)
            if i:
                rank[i - 1] = get(piece[cut[i - 1] : cut[i + 1]], none)
        return b"".join([ranks[piece[a:b]].to_bytes(4, "little") for a, b in zip(cut, cut[1:], strict=False)])

    def long_merge(piece: bytes) -> bytes:
        """The same with a heap and a linked list, for very long pieces."""
        import heapq

        n = len(piece)
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, e = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != e:
                continue
            alive[j] = False
            end[i], nxt[i] = e, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                k = end[nxt[i]]
                if (r := get(piece[i:k])) is not None:
                    heapq.heappush(heap, (r, i, k))
            if prv[i] >= 0 and (r := get(piece[prv[i] : e])) is not None:
                heapq.heappush(heap, (r, prv[i], e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]].to_bytes(4, "little"))
            i = nxt[i]
        return b"".join(out)

    return merge


#: Bytes of a piece that the cache can hold, and of one that is merged together with others.
SHORT, TOGETHER = 15, 128
#: Distinct pieces an encoder remembers: about 120 bytes each in every Python worker.
CACHE_PIECES = 400_000
NONE = np.int64(1 << 40)


class Merges:
    """Pair merging of many pieces at once: each round merges the lowest-ranked pair of every piece.

    pairs are rows (left id, right id, rank, id of both); a rank belongs to one id.
    """

    def __init__(self, byte_ids: np.ndarray, pairs: np.ndarray):
        if pairs.size and pairs[:, [0, 1, 3]].max() >= 1 << 20:
            raise ValueError("a vocabulary of more than 2^20 tokens")
        self.byte_ids = byte_ids.astype(np.int64)
        self.table = KeyTable(max(4, int(4 * len(pairs)).bit_length()))
        key, at = np.unique(pairs[:, 0] << 20 | pairs[:, 1], return_index=True)
        self.table.add(key)
        self.rank = np.append(pairs[at, 2], NONE)  # -1, a pair that is not known, is the last
        self.merged = np.zeros(int(pairs[:, 2].max(initial=0)) + 1, np.int64)
        self.merged[pairs[:, 2]] = pairs[:, 3]

    def _ranks(self, ids: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place; NONE at a piece's end."""
        to = np.minimum(at + 1, len(ids) - 1)
        out = self.rank[self.table.find(ids[at] << 20 | ids[to])]
        out[(owner[at] != owner[to]) | (at == to)] = NONE
        return out

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of pieces that lie one after the other; none is empty."""
        n = len(offs) - 1
        if not n:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        ids, owner = self.byte_ids[data], np.repeat(np.arange(n), np.diff(offs))
        rank = self._ranks(ids, owner, np.arange(len(ids)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(first, len(ids)))
            low = np.minimum.reduceat(rank, first)
            live = np.repeat(low < NONE, size)
            if not live.all():
                done.append((owner[~live], ids[~live]))
                ids, owner, rank, low, size = ids[live], owner[live], rank[live], low[low < NONE], size[low < NONE]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, size))
            at = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])]
            ids[at] = self.merged[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            at -= np.arange(len(at))  # one place fewer for each piece before
            rank[at] = self._ranks(ids, owner, at)
            before = at[at > 0] - 1
            rank[before] = self._ranks(ids, owner, before)
        owner, ids = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.searchsorted(owner[order], np.arange(n + 1))


def gather(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the stretches of values that begin at each place, one after the other; their offsets)."""
    offs = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(at - offs[:-1], size) + np.arange(offs[-1])], offs


class PieceCache:
    """Ids of short pieces by their bytes. When full it forgets the pieces met least often."""

    def __init__(self, most: int):
        self.most = most
        self._fill(*(np.zeros(0, np.uint64),) * 2, np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))

    def _fill(self, lo, hi, ids, offs, uses) -> None:
        self.lo, self.hi, self.ids, self.offs, self.uses = lo, hi, ids, offs, uses
        self.table = KeyTable()
        if len(lo):
            self.table.add(self._key(lo, hi))

    @staticmethod
    def _key(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(lo ^ mix(hi)) >> np.uint64(1)).view(np.int64)

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 where it is not held."""
        out = self.table.find(self._key(lo, hi))
        if len(self.lo):
            out[(self.lo[out] != lo) | (self.hi[out] != hi)] = -1
        held = out[out >= 0]
        self.uses += np.bincount(held, minlength=len(self.uses))
        return out

    def add(self, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, offs: np.ndarray) -> None:
        """Hold more pieces, none of them held already; of pieces with one hash the first."""
        key, at = np.unique(self._key(lo, hi), return_index=True)
        at = at[self.table.find(key) < 0]
        ids, offs = gather(ids, offs[at], np.diff(offs)[at])
        lo, hi = lo[at], hi[at]
        if len(self.lo) + len(lo) > self.most:
            often = np.sort(self.uses)[-(self.most // 2) :].min(initial=1) if self.most else 0
            keep = np.flatnonzero(self.uses > max(1, often))[: self.most // 2]
            more = max(0, self.most - len(keep))
            lo, hi, offs = lo[:more], hi[:more], offs[: more + 1]
            ids = ids[: offs[-1]]
            own, own_offs = gather(self.ids, self.offs[keep], np.diff(self.offs)[keep])
            self._fill(self.lo[keep], self.hi[keep], own, own_offs, np.zeros(len(keep), np.int64))
        if not len(lo):
            return
        self.table.add(self._key(lo, hi))
        self.offs = np.concatenate([self.offs, self.offs[-1] + offs[1:]])
        self.ids = np.concatenate([self.ids, ids])
        self.lo, self.hi = np.concatenate([self.lo, lo]), np.concatenate([self.hi, hi])
        self.uses = np.concatenate([self.uses, np.ones(len(lo), np.int64)])


class Encoder:
    """Texts to ids: pieces by the scan, each merged alone; what was merged before is looked up.

    whole are pieces that are one token as they stand; merge_long gives the ids of one long piece.
    """

    def __init__(self, merges: Merges, merge_long: Callable[[bytes], list[int]], whole: dict[bytes, int], cache_pieces: int):
        self.merges, self.merge_long, self.cache = merges, merge_long, PieceCache(cache_pieces)
        self.whole = whole

    def _words(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each short piece as two numbers: its bytes and, on top, its length."""
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
        masks = np.array([(1 << 8 * min(i, 8)) - 1 for i in range(SHORT + 1)], np.uint64)
        lo = eight[at] & masks[size]
        hi = (eight[at + 8] & masks[np.maximum(size - 8, 0)]) | size.astype(np.uint64) << np.uint64(56)
        return lo, hi

    def _merge(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of some pieces."""
        some, offs = gather(data, at, size)
        raw = some.tobytes()
        alone = {}
        for i in np.flatnonzero(size > TOGETHER).tolist():
            alone[i] = self.merge_long(raw[offs[i] : offs[i + 1]])
        if self.whole:
            for i, (a, z) in enumerate(zip(offs.tolist(), offs[1:].tolist(), strict=False)):
                if i not in alone and (token := self.whole.get(raw[a:z])) is not None:
                    alone[i] = [token]
        if not alone:
            return self.merges(some, offs)
        rest = np.setdiff1d(np.arange(len(size)), np.fromiter(alone, np.int64))
        own, own_offs = self.merges(*gather(data, at[rest], size[rest]))
        count = np.zeros(len(size), np.int64)
        count[rest] = np.diff(own_offs)
        for i, x in alone.items():
            count[i] = len(x)
        out_offs = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(out_offs[-1], np.int64)
        out[np.repeat(out_offs[rest] - own_offs[:-1], np.diff(own_offs)) + np.arange(len(own))] = own
        for i, x in alone.items():
            out[out_offs[i] : out_offs[i + 1]] = x
        return out, out_offs

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of each text."""
        starts = token_starts(data, offs)
        size = np.diff(np.append(starts, len(data)))
        number = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(size <= SHORT)
        lo, hi = self._words(data, starts[short], size[short])
        number[short] = found = self.cache.find(lo, hi)
        # Pieces that are not held: short ones once each, all others as they are.
        new = np.flatnonzero(found < 0)
        order = new[np.lexsort((lo[new], hi[new]))]
        head = np.ones(len(order), bool)
        head[1:] = (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])
        once, long = order[head], np.flatnonzero(size > SHORT)
        which = np.concatenate([short[once], long])
        ids, at = self._merge(data, starts[which], size[which])
        held = len(self.cache.ids)
        pool = np.concatenate([self.cache.ids, ids])
        place, count = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        known = number >= 0
        place[known], count[known] = self.cache.offs[number[known]], np.diff(self.cache.offs)[number[known]]
        each = np.cumsum(head) - 1
        place[short[order]], count[short[order]] = held + at[each], np.diff(at)[each]
        place[long], count[long] = held + at[len(once) : -1], np.diff(at)[len(once) :]
        out, piece_offs = gather(pool, place, count)
        if len(once):
            self.cache.add(lo[once], hi[once], ids[: at[len(once)]], at[: len(once) + 1])
        return out, piece_offs[np.searchsorted(starts, offs)]


def _all_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """Every pair of tokens whose bytes together are a token."""
    get = ranks.get
    found = [(a, b, r, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None]
    return np.array(found, np.int64).reshape(-1, 4)


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        ranks = load_ranks(path)
        merges = Merges(np.array([ranks[bytes([i])] for i in range(256)]), _all_pairs(ranks))
        long = merger(ranks)
        # Tokens that merging alone would not give back.
        tokens = [t for t in ranks if len(t) <= TOGETHER]
        offs = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        ids, at = merges(np.frombuffer(b"".join(tokens), np.uint8), offs)
        same = (np.diff(at) == 1) & (ids[at[:-1]] == np.array([ranks[t] for t in tokens]))
        self.encoder = Encoder(merges, lambda p: np.frombuffer(long(p), "<u4").tolist(), {t: ranks[t] for t, s in zip(tokens, same.tolist(), strict=True) if not s}, cache_pieces)
        size = max(ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)])
        joined = bytearray(int(self.at[-1]))
        for token, i in ranks.items():
            joined[self.at[i] : self.at[i + 1]] = token
        self.bytes = np.frombuffer(bytes(joined), np.uint8)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of each text."""
        return self.encoder(data, offs)

    def spans(self, ids: np.ndarray) -> np.ndarray:
        """Byte offsets of the tokens in the decoded text, and its length."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray) -> bytes:
        """Gather the vocabulary's bytes along the retained offsets."""
        return gather(self.bytes, self.at[ids], self.lengths[ids])[0].tobytes()


@lru_cache(maxsize=1)
def codec(path: str, cache_pieces: int) -> Codec:
    return Codec(path, cache_pieces)


def binaries(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Stretches of an array as byte strings."""
    at = (offs * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def encode_documents(docs: DataFrame, path: str, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """doc_id, ids (little-endian uint32), n_tokens, n_bytes per row; a null text is empty.

    Each match of the split pattern is merged separately and no special tokens are known.
    Repeated rows stay; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", codec.cache_clear)
        own = codec(path, cache_pieces)
        for rows, data, offs in slices(batches, "text"):
            ids, at = own.encode(data, offs)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), binaries(ids.astype("<u4"), at), pa.array(np.diff(at)), pa.array(np.diff(offs))], ["doc_id", "ids", "n_tokens", "n_bytes"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, n_tokens long, n_bytes long")


def decode_documents(encoded: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens and the decoded text; with digest, SHA-256 of ids and text instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, CACHE_PIECES)
        for rows, data, offs in slices(batches, "ids"):
            raw = [data[a:b].tobytes() for a, b in zip(offs.tolist(), offs[1:].tolist(), strict=False)]
            every = np.frombuffer(data.tobytes(), "<u4")
            text, at = own.decode(every), own.spans(every)[offs // 4]
            texts = [text[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
            if digest:
                last = [pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_tokens"), *last], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_tokens"), pa.array([x.decode() for x in texts])], ["doc_id", "n_tokens", "text"])

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(run, "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "text string"))
