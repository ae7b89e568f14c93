"""GIF animations: LZW code streams, palettes, disposal and transparency, timed frames.

The writer builds the string tables of many frames in step, one sample of each at a time, and writes
samples that the frame before shows already as transparent ones. The reader takes any GIF: the width
of a code depends only on its place after the last clear code, so the codes of many frames are read
at once; a table entry is the output of one earlier code and the byte that follows it there, so all
strings are resolved together by pointer jumping. Frames are then drawn one after the other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices

SIDE = 24
FRAME = SIDE * SIDE
CLEAR, END = 256, 257
#: Frames whose string tables are built in step, and samples that are resolved together.
TOGETHER, SAMPLES = 4096, 1 << 21
#: Pixels of the largest canvas or frame that is read; a header that states more is refused.
MOST_PIXELS = 1 << 24
DELAY_CS = 4
#: Bins of the colour histogram: four levels of each of red, green and blue.
BINS = 64


class Frame(NamedTuple):
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int | None
    interlaced: bool
    palette: bytes
    code_size: int
    data: bytes


class Gif(NamedTuple):
    width: int
    height: int
    background: int
    palette: bytes
    frames: list[Frame]


def _pack(codes: np.ndarray, width: int) -> np.ndarray:
    """Rows of 9-bit or 10-bit codes, least significant bit first, as bytes; a row's codes fill whole bytes."""
    rows = len(codes)
    bits = np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(rows, -1, 2), axis=2, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits[:, :, :width]).reshape(rows, -1), axis=1, bitorder="little")


def gray_palette() -> bytes:
    return np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


class _Strings:
    """The string tables of many frames: (frame, code, byte) to code, open-addressed."""

    def __init__(self, frames: int):
        self.bits = max(12, int(3 * frames * FRAME // 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int32)
        self.code = np.zeros(1 << self.bits, np.int16)

    def slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The code of each string, -1 for a new one."""
        slot = self.slot(key)
        at = self.keys.take(slot)
        out = np.where(at == key, self.code.take(slot), -1)
        rest = np.flatnonzero((at != key) & (at >= 0))
        slot = slot[rest]
        while len(rest):
            slot = slot + 1 & (1 << self.bits) - 1
            at, own = self.keys.take(slot), key[rest]
            same = at == own
            out[rest[same]] = self.code.take(slot[same])
            go = ~same & (at >= 0)
            rest, slot = rest[go], slot[go]
        return out

    def add(self, key: np.ndarray, code: np.ndarray) -> None:
        slot = self.slot(key)
        while len(key):
            free = self.keys.take(slot) < 0
            self.keys[slot[free]] = key[free]
            held = self.keys.take(slot) == key
            self.code[slot[held]] = code[held]
            key, code, slot = key[~held], code[~held], slot[~held] + 1 & (1 << self.bits) - 1


def lzw_encode(samples: np.ndarray) -> list[bytes]:
    """The code stream of each row of at most FRAME samples, with one clear code at its beginning."""
    frames, n = samples.shape
    table, row = _Strings(frames), np.arange(frames)
    codes = np.zeros((frames, -(-(n + 2) // 256) * 256), np.int32)
    codes[:, 0] = CLEAR
    count = np.ones(frames, np.int64)
    prefix = samples[:, 0].astype(np.int32)
    for j in range(1, n):
        byte = samples[:, j].astype(np.int32)
        key = (row.astype(np.int32) << 18) | prefix << 8 | byte
        found = table.find(key)
        new = np.flatnonzero(found < 0)
        codes[new, count[new]] = prefix[new]
        table.add(key[new], (END + count[new]).astype(np.int16))  # each code written adds a string
        count[new] += 1
        found[new] = byte[new]
        prefix = found.astype(np.int32)
    codes[row, count] = prefix
    codes[row, count + 1] = END
    size = count + 2
    packed = np.concatenate([_pack(codes[:, :256], 9), _pack(codes[:, 256:], 10)], axis=1)  # ten bits from the 256th on
    length = (9 * np.minimum(size, 256) + 10 * np.maximum(size - 256, 0) + 7) // 8
    return [r[:k].tobytes() for r, k in zip(packed, length.tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """An animation per payload, whose length is a positive multiple of FRAME.

    A sample that the frame before shows at its place is written as the frame's transparent index,
    the least value that the frame lacks; a frame with all 256 values has none.
    """
    if not payloads:
        return []
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    out, data, clear = [], [], []
    for a in range(0, len(samples), TOGETHER):
        part = samples[a : a + TOGETHER]
        has = np.zeros((len(part), 256), bool)
        has[np.arange(len(part))[:, None], part] = True
        lacks = np.where(has.all(axis=1), -1, has.argmin(axis=1))
        drawn = part.copy()
        before = samples[a - 1 : a - 1 + len(part)] if a else np.concatenate([part[:1], part[:-1]])
        same = (before == part) & (lacks >= 0)[:, None]
        starts = np.cumsum([0] + [len(p) // FRAME for p in payloads])[:-1]
        same[starts[(starts >= a) & (starts < a + len(part))] - a] = False
        drawn[same] = np.broadcast_to(lacks[:, None], same.shape)[same].astype(np.uint8)
        lacks[~same.any(axis=1)] = -1
        data += lzw_encode(drawn)
        clear += lacks.tolist()
    head = b"GIF89a" + bytes([SIDE, 0, SIDE, 0, 0xF7, 0, 0]) + gray_palette()
    place = bytes([0x2C, 0, 0, 0, 0, SIDE, 0, SIDE, 0, 0, 8])
    at = 0
    for p in payloads:
        parts = [head]
        for i in range(at, at + len(p) // FRAME):
            t, codes = clear[i], data[i]
            parts += [bytes([0x21, 0xF9, 4, 1 << 2 | (t >= 0), DELAY_CS, 0, max(t, 0), 0]), place]
            for k in range(0, len(codes), 255):
                parts += [bytes([min(255, len(codes) - k)]), codes[k : k + 255]]
            parts.append(b"\0")
        out.append(b"".join([*parts, b"\x3b"]))
        at += len(p) // FRAME
    return out


def parse(data: bytes) -> Gif:
    """Screen, palette and frames. What is not a GIF, or has a canvas or frame of more than MOST_PIXELS,
    raises ValueError. A cut file ends with its last frame whose description is whole."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if width * height > MOST_PIXELS:
        raise ValueError("too large a canvas")
    flags, at, size = data[10], 13, len(data)
    palette = b""
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        palette, at = data[at : at + n], at + n
    frames, delay, disposal, transparent = [], 0, 0, None
    while at < size and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            control = data[at + 1 : at + 8]
            if control[:2] == b"\xf9\x04" and len(control) == 7:
                f = control[2]
                delay, disposal, transparent = int.from_bytes(control[3:5], "little"), f >> 2 & 7, control[5] if f & 1 else None
            at += 2
            while at < size and data[at]:
                at += data[at] + 1
            at += 1
        elif kind == 0x2C:
            left, top, w, h = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (1, 3, 5, 7))
            f, own, at = data[at + 9] if at + 9 < size else 0, palette, at + 10
            if f & 0x80:
                n = 3 << (f & 7) + 1
                own, at = data[at : at + n], at + n
            if at >= size or not 1 <= data[at] <= 11:
                break
            if w * h > MOST_PIXELS:
                raise ValueError("too large a frame")
            code_size, at, parts = data[at], at + 1, []
            while at < size and data[at]:
                parts.append(data[at + 1 : at + 1 + data[at]])
                at += data[at] + 1
            at += 1
            frames.append(Frame(left, top, w, h, delay, disposal, transparent, bool(f & 0x40), own, code_size, b"".join(parts)))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("unknown block in a GIF")
    return Gif(width, height, data[11], palette, frames)


@lru_cache(maxsize=64)
def _widths(code_size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each code after a clear code, bits before it)."""
    table = np.minimum((1 << code_size) + 2 + np.maximum(np.arange(count) - 1, 0), 4096)  # entries before the code is read
    width = np.minimum(np.floor(np.log2(table)).astype(np.int64) + 1, 12)
    return width, np.cumsum(width) - width


def _resolved(codes: np.ndarray, owner: np.ndarray, first: np.ndarray, entry: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples, frame of each) of runs of codes, each from one clear code on.

    owner is a code's frame and first the place of its run's first code; entry is the first string's
    code. A run gives no more than its room and the rest of one string.
    """
    index = np.arange(len(codes))
    literal = codes < entry
    parent = np.where(literal, index, first + codes - entry)
    length, jump = np.where(literal, 0, 1), parent
    while (jump[jump] != jump).any():
        length, jump = length + length[jump], jump[jump]
    length += 1
    start = np.cumsum(length) - length
    fits = start - start[first] < room[owner]
    kept = np.flatnonzero(fits)
    # What is left out lies behind all that is kept of its run, so no string refers to it.
    begin = np.cumsum(np.where(fits, length, 0)) - np.where(fits, length, 0)
    each = np.repeat(kept, length[kept])
    source = np.arange(len(each)) - begin[each] + begin[parent[each]]
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    return codes[each[source]], owner[each]


def _decode_alike(frames: list[Frame]) -> list[np.ndarray]:
    """Index streams of frames of one code size; what a damaged or short stream lacks is 0."""
    code_size, pixels = frames[0].code_size, np.array([f.width * f.height for f in frames])
    clear, n = 1 << code_size, len(frames)
    out = [np.zeros(p, np.uint8) for p in pixels.tolist()]
    data = np.frombuffer(b"".join([f.data + b"\0\0\0\0" for f in frames]), np.uint8)
    begin = np.cumsum([0] + [len(f.data) + 4 for f in frames])[:-1]
    words = np.ndarray((max(0, len(data) - 3),), "<u4", data, 0, (1,))
    end = 8 * (begin + np.array([len(f.data) for f in frames]))
    at, got, live = 8 * begin, np.zeros(n, np.int64), np.flatnonzero(pixels)
    while len(live):
        width, before = _widths(code_size, -(-int((pixels[live] - got[live]).max() + 2) // 64) * 64)
        codes_of, owners, firsts, held, again = [], [], [], 0, []
        # Rows of the largest frames are long: as many at once as keep the block small.
        step = max(1, (1 << 22) // len(width))
        for some in (live[i : i + step] for i in range(0, len(live), step)):
            spot = at[some][:, None] + before[None, :]
            inside = spot + width[None, :] <= end[some][:, None]
            spot = np.where(inside, spot, 0)
            codes = (words[spot >> 3] >> (spot & 7).astype(np.uint32)).astype(np.int64) & (1 << width) - 1
            stop = ~inside | (codes == clear) | (codes == clear + 1)
            stop |= codes - clear - 2 >= np.minimum(np.arange(len(width)), 4096 - clear - 2)[None, :]  # no such string yet
            count = np.where(stop.any(axis=1), stop.argmax(axis=1), len(width))
            last = np.minimum(count, len(width) - 1)
            cleared = (count < len(width)) & inside[np.arange(len(some)), last] & (codes[np.arange(len(some)), last] == clear)
            codes_of.append(codes[np.arange(len(width))[None, :] < count[:, None]])
            owners.append(np.repeat(some, count))
            firsts.append(np.repeat(held + np.cumsum(count) - count, count))
            held += int(count.sum())
            at[some] += before[last] + width[last]
            again.append(some[cleared])
        samples, owner = _resolved(np.concatenate(codes_of), np.concatenate(owners), np.concatenate(firsts), clear + 2, pixels - got)
        edges = np.searchsorted(owner, np.append(live, n))
        for i, a, z in zip(live.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            z = min(z, a + int(pixels[i] - got[i]))
            out[i][got[i] : got[i] + z - a] = samples[a:z]
            got[i] += z - a
        live = np.concatenate(again)
        live = live[got[live] < pixels[live]]
    return out


def lzw_decode(data: bytes, code_size: int, pixels: int) -> np.ndarray:
    """The index stream of one frame; what a damaged or short stream lacks is 0."""
    return _decode_alike([Frame(0, 0, pixels, 1, 0, 0, None, False, b"", code_size, data)])[0]


def decode_many(frames: list[Frame]) -> list[np.ndarray]:
    """Index streams of many frames; those of one code size are read together, about SAMPLES samples at once."""
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(frames)
    order = sorted(range(len(frames)), key=lambda i: (frames[i].code_size, frames[i].width * frames[i].height))
    batch, size = [], 0
    for i in [*order, None]:
        if batch and (i is None or frames[i].code_size != frames[batch[0]].code_size or size > SAMPLES):
            for k, x in zip(batch, _decode_alike([frames[k] for k in batch]), strict=True):
                out[k] = x
            batch, size = [], 0
        if i is not None:
            batch.append(i)
            size += frames[i].width * frames[i].height
    return out


def _rows_in_order(index: np.ndarray, f: Frame) -> np.ndarray:
    """Index stream as rows; interlaced rows are put in place."""
    rows = index.reshape(f.height, f.width)
    if not f.interlaced:
        return rows
    order = np.concatenate([np.arange(a, f.height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(rows)
    out[order] = rows
    return out


@lru_cache(maxsize=256)
def _colours(palette: bytes) -> np.ndarray:
    """A palette as 256 RGBA colours; those it lacks are black."""
    out = np.zeros((256, 4), np.uint8)
    known = np.frombuffer(palette, np.uint8)[: min(768, len(palette) // 3 * 3)].reshape(-1, 3)
    out[: len(known), :3] = known
    out[:, 3] = 255
    return out


def compose(gif: Gif, streams: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The canvas (height, width, 4) shown for each frame, as RGBA, good until the next is asked for.

    A frame is drawn over what the one before left: itself (disposal 0, 1), the canvas cleared
    where it stood (2), or what was there before it (3). Transparent samples draw nothing.
    """
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f, stream in zip(gif.frames, streams, strict=True):
        before = canvas.copy() if f.disposal == 3 else None
        rows = _rows_in_order(stream, f)[: max(0, gif.height - f.top), : max(0, gif.width - f.left)]
        place = canvas[f.top : f.top + rows.shape[0], f.left : f.left + rows.shape[1]]
        shown = _colours(f.palette).take(rows, axis=0)
        if f.transparent is None:
            place[...] = shown
        else:
            np.copyto(place, shown, where=(rows != f.transparent)[:, :, None])
        yield canvas
        if f.disposal == 2:
            place[...] = 0
        elif before is not None:
            canvas = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Opaque pixels of a shown canvas per colour bin."""
    level = canvas.astype(np.int64) >> 6
    bins = level[..., 0] * 16 + level[..., 1] * 4 + level[..., 2]
    return np.bincount(bins[canvas[..., 3] > 0], minlength=BINS)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as the samples of an animation.

    A text's UTF-8 bytes, none for null, are filled with bytes 255 to a positive multiple of 576;
    each 24 x 24 frame holds 576 of them. Repeated rows repeat; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches, "text", TOGETHER * FRAME):
            raw = data.tobytes()
            n = np.diff(offs)
            full = [raw[a:b] + b"\xff" * (max(1, -(-(b - a) // FRAME)) * FRAME - (b - a)) for a, b in zip(offs.tolist(), offs[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), pa.array(encode(full), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _decoded(media: list[bytes | None]) -> Iterator[tuple[Gif, list[np.ndarray]] | None]:
    gifs = [None if m is None else parse(m) for m in media]
    streams = decode_many([f for g in gifs if g for f in g.frames])
    at = 0
    for g in gifs:
        yield g and (g, streams[at : at + len(g.frames)])
        at += len(g.frames) if g else 0


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for rows, _, _ in slices(batches, "media"):
        yield rows, rows.column(rows.schema.get_field_index("media")).to_pylist()


def frames(stored: DataFrame) -> DataFrame:
    """A row per frame: doc_id, frame, start_ms, delay_ms, width, height, rgba, histogram.

    A null media has no frames; what is not a GIF raises (see parse).
    """
    names = ["doc_id", "frame", "start_ms", "delay_ms", "width", "height", "rgba", "histogram"]
    kinds = [pa.int64()] * 6 + [pa.binary(), pa.list_(pa.int64())]

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, media in _media(batches):
            out, size = [], 0
            for doc, found in zip(rows.column("doc_id").to_pylist(), _decoded(media), strict=True):
                start = 0
                for i, shown in enumerate(compose(*found) if found else ()):
                    g = found[0]
                    delay = 10 * g.frames[i].delay_cs
                    out.append((doc, i, start, delay, g.width, g.height, shown.tobytes(), histogram(shown).tolist()))
                    start, size = start + delay, size + shown.nbytes
                    if size > 1 << 24:
                        yield batch(out)
                        out, size = [], 0
            yield batch(out)

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id long, frame long, start_ms long, delay_ms long, width long, height long, rgba binary, histogram array<long>")


def digests(stored: DataFrame) -> DataFrame:
    """What the stored animations hold, read back: digests of payload and media, and features.

    The payload is the red channel of all shown canvases in order. A null media has null digests;
    what is not a GIF raises (see parse).
    """

    def told(m: bytes, g: Gif, streams: list[np.ndarray]) -> tuple:
        sha, size, tail, bins = hashlib.sha256(), 0, b"", np.zeros(BINS, np.int64)
        for shown in compose(g, streams):
            red = shown[..., 0].tobytes()
            sha.update(red)
            size, tail = size + len(red), (tail + red)[-32:]
            bins += histogram(shown)
        feature = f"frames={len(g.frames)};ms={10 * sum(f.delay_cs for f in g.frames)};hist=" + ",".join(f"{b}:{bins[b]}" for b in np.flatnonzero(bins).tolist())
        return size, sha.hexdigest(), zlib.crc32(tail), len(m), hashlib.sha256(m).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, media in _media(batches):
            out = [told(m, *found) if found else (None,) * 6 for m, found in zip(media, _decoded(media), strict=True)]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_bytes"), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds))], ["doc_id", "n_bytes", *names])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
