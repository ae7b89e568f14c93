"""GIF against an independent LZW coder and hand-made disposal cases; language and licence queries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartmill.llm import gif, langid, licenses

ODD = [None, "", " ", "a", "é" * 600, "x" * 576, "y" * 575, "z" * 577, "long text " * 20000]


def lzw(data, code_size, clears=()):
    """A plain compressing coder, with further clear codes before the given positions."""
    bits, n, out, clear = 0, 0, bytearray(), 1 << code_size

    def emit(code, width):
        nonlocal bits, n
        bits |= code << n
        n += width
        while n >= 8:
            out.append(bits & 255)
            bits >>= 8
            n -= 8

    table, width, held = {bytes([i]): i for i in range(clear)}, code_size + 1, b""
    size = clear + 2
    emit(clear, width)
    for i, byte in enumerate(data):
        if i in clears and held:
            emit(table[held], width)
            if size < 4096 and size == 1 << width and width < 12:
                width += 1
            emit(clear, width)
            table, width, held, size = {bytes([k]): k for k in range(clear)}, code_size + 1, b"", clear + 2
        longer = held + bytes([byte])
        if longer in table:
            held = longer
            continue
        emit(table[held], width)
        if size < 4096:
            table[longer] = size
            if size == 1 << width and width < 12:
                width += 1
            size += 1
        held = bytes([byte])
    if held:
        emit(table[held], width)
    if size < 4096 and size == 1 << width and width < 12:
        width += 1
    emit(clear + 1, width)
    if n:
        out.append(bits & 255)
    return bytes(out)


@pytest.mark.parametrize(("code_size", "n", "kinds"), [(2, 50, 4), (2, 3000, 2), (8, 1, 256), (8, 5000, 3), (8, 30000, 256), (4, 20000, 1), (3, 0, 1)])
def test_lzw(code_size, n, kinds):
    rnd = random.Random(n + kinds)
    data = bytes(rnd.randrange(kinds) for _ in range(n))
    assert gif.lzw_decode(lzw(data, code_size), code_size, n).tobytes() == data
    assert gif.lzw_decode(lzw(data, code_size, {n // 3, n // 2}), code_size, n).tobytes() == data


def test_damaged_streams_end():
    good = lzw(bytes(range(200)), 8)
    assert gif.lzw_decode(good[:40], 8, 200)[:20].tobytes() == bytes(range(20))
    assert gif.lzw_decode(b"", 8, 5).tolist() == [0] * 5
    rnd = random.Random(0)
    for _ in range(50):
        gif.lzw_decode(bytes(rnd.randrange(256) for _ in range(60)), rnd.choice([2, 5, 8]), 300)


def image(left, top, w, h, pixels, disposal=0, transparent=None, interlaced=False, palette=b""):
    control = bytes([0x21, 0xF9, 4, disposal << 2 | (transparent is not None), 5, 0, transparent or 0, 0])
    head = bytes([0x2C, left, 0, top, 0, w, 0, h, 0, (0x81 if palette else 0) | (0x40 if interlaced else 0)]) + palette
    data = lzw(bytes(pixels), 2)
    return control + head + bytes([2, len(data)]) + data + b"\0"


PALETTE = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])


def animation(*frames, w=2, h=2):
    comment = b"\x21\xfe\x02hi\x00"
    return b"GIF89a" + bytes([w, 0, h, 0, 0x81, 0, 0]) + PALETTE + comment + b"".join(frames) + b"\x3b"


def shown(data):
    g = gif.parse(data)
    return np.array([c.copy() for c in gif.compose(g, gif.decode_many(g.frames))])


def test_disposal_and_transparency():
    full = image(0, 0, 2, 2, [1, 1, 1, 1])
    out = shown(animation(full, image(0, 0, 1, 1, [2], disposal=3), image(1, 1, 1, 1, [3], disposal=2), image(0, 1, 1, 1, [0], transparent=0)))
    red, green, blue = ([255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255])
    assert out[1].tolist() == [[green, red], [red, red]]
    assert out[2].tolist() == [[red, red], [red, blue]]
    assert out[3].tolist() == [[red, red], [red, [0, 0, 0, 0]]]


def test_interlace_local_palette_and_overhang():
    rows = [image(0, 0, 1, 8, [0, 1, 2, 2, 3, 3, 3, 3], interlaced=True)]
    out = shown(animation(*rows, w=1, h=8))[0, :, 0]
    assert [PALETTE[3 * i : 3 * i + 3] for i in (0, 3, 2, 3, 1, 3, 2, 3)] == [bytes(p[:3].tolist()) for p in out]
    out = shown(animation(image(1, 1, 2, 2, [1, 1, 1, 1], palette=bytes([9] * 12))))
    assert out[0, 1, 1].tolist() == [9, 9, 9, 255] and out[0, 0, 0].tolist() == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        gif.parse(b"not a gif")


def test_histogram():
    canvas = np.array([[[0, 64, 255, 255], [1, 100, 200, 255], [9, 9, 9, 0]]], np.uint8)
    assert gif.histogram(canvas).tolist() == [2 if b == 7 else 0 for b in range(64)]


@pytest.mark.parametrize("n", [1, 2, 255, 256, 576])
def test_encoder_writes_what_a_plain_coder_does(n):
    rnd = np.random.default_rng(n)
    rows = np.concatenate([rnd.integers(0, k, (3, n)) for k in (1, 2, 9, 256)]).astype(np.uint8)
    assert gif.lzw_encode(rows) == [lzw(r.tobytes(), 8) for r in rows]


def test_written_animations_need_the_whole_reader():
    """Strings, palettes and transparency decide what the query reads back."""
    text = ("the river and the house " * 60).encode()[: 576 * 2] + bytes(range(256)) * 9
    (data,) = gif.encode([text])
    g = gif.parse(data)
    assert len(g.frames) == 6 and g.palette == gif.gray_palette()
    assert g.frames[0].transparent is None and g.frames[1].transparent is not None and g.frames[-1].transparent is None
    streams = gif.decode_many(g.frames)
    assert len(g.frames[1].data) < 300 and b"".join(s.tobytes() for s in streams) != text
    assert b"".join(c[..., 0].tobytes() for c in gif.compose(g, streams)) == text


def test_cut_files_end_early():
    whole = animation(image(0, 0, 2, 2, [1, 1, 2, 3]), image(0, 0, 2, 2, [1, 2, 1, 3], transparent=2, palette=bytes(range(12))))
    for data in (whole, gif.encode([bytes(range(192)) * 3])[0]):
        frames = []
        for n in range(13, len(data)):
            g = gif.parse(data[:n])
            frames.append(len(g.frames))
            list(gif.compose(g, gif.decode_many(g.frames)))
        assert frames == sorted(frames) and frames[-1] == len(gif.parse(data).frames)
    for n in range(13):
        with pytest.raises(ValueError):
            gif.parse(whole[:n])
    with pytest.raises(ValueError):
        gif.parse(whole[:6] + b"\xff\xff\xff\xff" + whole[10:])


def test_frames_of_many_sizes_together():
    rnd = random.Random(5)
    frames, want = [], []
    for _ in range(60):
        size, w, h = rnd.choice([2, 4, 8]), rnd.randint(0, 40), rnd.randint(1, 40)
        data = bytes(rnd.randrange(1 << size) if rnd.random() < 0.7 else 0 for _ in range(w * h))
        clears = {rnd.randrange(w * h + 1) for _ in range(rnd.randint(0, 3))}
        frames.append(gif.Frame(0, 0, w, h, 0, 0, None, False, b"", size, lzw(data, size, clears)))
        want.append(data)
    assert [x.tobytes() for x in gif.decode_many(frames)] == want


def test_store_and_read_back(spark):
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(ODD)] + [(None, "a", "n")], "doc_id long, text string, media string")
    out = {r["doc_id"]: r for r in gif.digests(gif.store(docs)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert out[0]["media_sha256"] == out[1]["media_sha256"] and out[0]["feature"] == out[1]["feature"]
    rows = gif.frames(gif.store(docs.filter("doc_id = 7"))).orderBy("frame").collect()
    assert [(r["frame"], r["start_ms"], r["delay_ms"], r["width"], sum(r["histogram"])) for r in rows] == [(0, 0, 40, 24, 576), (1, 40, 40, 24, 576)]
    for r in out.values():
        bins = dict(x.split(":") for x in r["feature"].split("hist=")[1].split(","))
        assert sum(map(int, bins.values())) == r["payload_bytes"] and f"frames={r['payload_bytes'] // 576};" in r["feature"]
    assert out[7]["feature"] == "frames=2;ms=80;hist=" + ",".join(f"{b}:{n}" for b, n in sorted(Counter((c >> 6) * 21 for c in b"z" * 577 + b"\xff" * 575).items()))
    assert gif.digests(gif.store(docs.filter("false"))).count() == 0 == gif.frames(gif.store(docs.filter("false"))).count()
    nothing = spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")
    assert gif.frames(nothing).count() == 0 and gif.digests(nothing).first()["payload_sha256"] is None


WORDS = {"en": "the of and house river thing with that which", "de": "der und haus fluss ding mit schon welche nicht", "fr": "le maison rivière chose avec cela étaient pour"}


def language_rows(n=240, seed=3):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(WORDS[k].split()) for _ in range(rnd.randint(4, 60))), k) for i in range(n) for k in [list(WORDS)[i % 3]]]


def test_language_accuracy_and_odd_rows(spark):
    rows = language_rows() + [(1000, None, "en"), (1001, "", "de"), (1002, "123 !!", "fr"), (1003, "the of and", None), (None, "der und haus", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.train(docs.filter(~langid.held_out()))
    out = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert len(out) == len(rows)
    assert sum(out[i]["lang_pred"] == k for i, _, k in language_rows()) >= 235
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert out[1003]["lang_pred"] == "en" and 0 < out[1003]["score"] <= 1 and out[None]["lang_pred"] == "de"
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows} - {1000, 1001, 1002}
    assert langid.train(docs.filter("false")) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def plain_ppm(rows):
    """Code lengths per language by the definition, from counts, escapes and contexts of its own."""

    def fold(text):
        out = bytearray()
        for c in text.encode():
            c = c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 48 if 48 <= c <= 57 else 32
            if not (c == 32 and out and out[-1] == 32):
                out.append(c)
        return bytes(out)

    counts = {}
    for _, text, lang in rows:
        x = fold(text)
        for order in range(4):
            for i in range(order, len(x)):
                counts.setdefault(lang, {}).setdefault(x[i - order : i], Counter())[x[i]] += 1
    width = len({s for c in counts.values() for s in c[b""]} | {32}) + 1
    kept = {b""}
    for order in (1, 2, 3):
        kept |= {x for c in counts.values() for x, n in c.items() if len(x) == order and n.total() >= langid.LEAST_COUNT and x[1:] in kept}

    def cost(tree, context, symbol):
        seen = tree.get(context, {})
        below = cost(tree, context[1:], symbol) if context and not seen.get(symbol) else math.log2(width)
        if not seen:
            return below
        total = sum(seen.values()) + len(seen)
        return math.log2(total / seen[symbol]) if symbol in seen else math.log2(total / len(seen)) + below

    def length(lang, text):
        x, bits = fold(text), 0.0
        for i, symbol in enumerate(x):
            context = next(x[k:i] for k in range(max(0, i - 3), i + 1) if x[k:i] in kept)
            bits += cost(counts[lang], context, symbol)
        return bits, len(x)

    return length


def test_code_lengths_are_those_of_plain_ppm(spark):
    """The automaton over stretches against plain PPM, for texts that stand among others."""
    rows = language_rows()
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    plain = plain_ppm(rows)
    texts = ["x ", "in den ran", "the river und maison " * 40 + "Zé9!", "x", "", " in den ran", "in den ran", "日本 Ünd  12 3", "x " * 700]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    bits, size = model.code_lengths(np.frombuffer(b"".join(raw), np.uint8), offs)
    for i, t in enumerate(texts):
        for k, lang in enumerate(model.langs):
            want, n = plain(lang, t)
            assert size[i] == n and bits[i, k] == pytest.approx(want, rel=1e-5)
    assert bits[1].tolist() == bits[6].tolist()


def test_model_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(language_rows(40), "doc_id long, text string, lang string")
    one, many = langid.train(docs.repartition(1)), langid.train(docs.repartition(40))
    assert np.array_equal(one.bits, many.bits) and np.array_equal(one.next, many.next) and one.most == many.most


def test_language_stage_uses_its_model(spark):
    rows = [(i, t, k, 0) for i, t, k in language_rows()]
    odd = [(2000, "это совсем другой язык и другие буквы " * 4, "en", 0), (2001, "der und haus fluss ding", "en", 0), (2002, "der und haus", None, 0)]
    docs = spark.createDataFrame(rows + odd, ["doc_id", "text", "lang", "a.b"])
    kept = langid.accepted(docs, langid.train(spark.createDataFrame(rows, ["doc_id", "text", "lang", "a.b"])))
    got = {r["doc_id"]: r["lang"] for r in kept.collect()}
    assert kept.columns == docs.columns and 2000 not in got and got[2001] == got[2002] == "de"
    assert set(got) >= {i for i, *_ in rows}


def test_licenses(spark):
    texts = [
        None, "", "All rights reserved.", "all  RIGHTS-reserved and ALL rights reserved", "Licensed under CC BY-NC 4.0.", "under CC_BY and cc\nby", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "apache license", "ccby general public licenses", "x " * 5000 + "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "cc by", 1)], "doc_id long, text string, score int")
    out = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    base = {i: (out[i]["n_words"], out[i]["n_base"], out[i]["first_word"], out[i]["last_word"], out[i]["base_labels"]) for i in range(6)}
    assert base == {0: (0, 0, None, None, ""), 1: (0, 0, None, None, ""), 2: (3, 1, 0, 0, "reserved"), 3: (7, 2, 0, 4, "reserved"), 4: (7, 1, 2, 2, "cc-by"), 5: (6, 2, 1, 4, "cc-by")}
    labels = {i: out[i]["labels"] for i in range(len(texts))}
    assert labels[4] == "cc-by,cc-by-nc" and labels[6] == "gpl,gpl-3" and labels[7] == "apache-2.0" and labels[8] == labels[11] == labels[12] == "mit"
    assert labels[9] == labels[10] == "" and out[None]["base_labels"] == "cc-by" and out[7]["score"] == 1.0 and out[9]["score"] == 0.0
    assert licenses.scan(docs.filter("false")).count() == 0


def plain_scan(text):
    """(n_words, places of base phrases, base labels, labels, score) by trying every place."""
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    places, base, labels, score = [], set(), set(), 0.0
    for k, t in enumerate(licenses.BASE + licenses.TEMPLATES):
        own = t.words.split()
        keys = [(next(i for i in range(len(own)) if own[i : i + len(x)] == x), x) for x in map(str.split, t.keys)]
        for b in range(-len(own), len(words)):
            if all(b + q >= 0 and words[b + q : b + q + len(x)] == x for q, x in keys):
                labels.add(t.label)
                score = max(score, sum(0 <= b + i < len(words) and words[b + i] == w for i, w in enumerate(own)) / len(own))
                if k < len(licenses.BASE):
                    places.append(b)
                    base.add(t.label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), pytest.approx(score)


def test_licence_index_against_brute_force(spark):
    """Every place of every template, no more and no fewer, whatever stands around it."""
    rnd = random.Random(4)
    every = licenses.BASE + licenses.TEMPLATES
    pool = sorted({w for t in every for w in t.words.split()})
    texts = [None, "", *ODD[2:-1]]
    for _ in range(250):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            own = rnd.choice(every).words.split()
            for _ in range(rnd.choice([0, 0, 1, 3])):
                own[rnd.randrange(len(own))] = rnd.choice(pool)
            a = rnd.randrange(len(own)) if rnd.random() < 0.3 else 0
            parts += [" ".join(own[a:]), " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12)))]
        texts.append(rnd.choice([" ", ", ", "\n"]).join(parts).title() if rnd.random() < 0.3 else " ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "cc by")], "doc_id long, text string")
    out = licenses.scan(docs.repartition(3)).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == plain_scan(texts[r["doc_id"]])
    assert len({r["labels"] for r in out}) > 15


def test_key_phrases_at_the_edges_of_a_text(spark):
    texts = ["MIT License", "Apache License Version 2.0", "some words and at last CC BY-NC", "and then MIT", "License of none"]
    out = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert "mit" in out[0] and "apache-2.0" in out[1] and "cc-by-nc" in out[2]
    assert "mit" not in out[3] + out[4]


def test_base_phrases_come_from_the_index(spark, monkeypatch):
    texts = ["cc by and cc by, all rights reserved", "general public license", "by cc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    frequencies = licenses.document_frequencies
    monkeypatch.setattr(licenses, "document_frequencies", lambda d, templates: seen.extend(templates) or frequencies(d, templates))
    out = {r["doc_id"]: (r["n_base"], r["first_word"], r["last_word"]) for r in licenses.scan(docs, []).collect()}
    assert set(licenses.BASE) <= set(seen) and out == {0: (3, 0, 5), 1: (1, 0, 0), 2: (0, None, None)}


def test_thresholds_come_from_all_labelled_texts(spark, monkeypatch):
    """With few training texts a language's usual cost is still the median over all of its labelled texts."""
    monkeypatch.setattr(langid, "TRAIN_TEXTS", 12)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text is not null and lang is not null")
    model = langid.train(docs)
    rates = {}
    for r in langid.identify(docs, model).filter("score > 0").collect():
        rates.setdefault(r["lang_pred"], []).append(r["bits_per_symbol"])
    assert set(model.usual) == set(rates)
    for lang, told in rates.items():
        told.sort()
        assert model.usual[lang] == told[(len(told) + 1) // 2 - 1]
        upper = told[-(-3 * len(told) // 4) - 1]
        assert abs(model.most[lang] - (model.usual[lang] + max(langid.LEAST_BITS, langid.SPREAD * (upper - model.usual[lang])))) < 1e-9
