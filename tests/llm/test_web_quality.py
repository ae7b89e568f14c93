"""Pages, archives, quality and fingerprints, on hand-made cases and brute force; the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chartmill.llm import htmltext, kneser, packing, pipeline_stages, queries, spotsigs, warc
from chartmill.llm.common import shared_dir
from chartmill.llm.tables import KeyTable

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<!-- ad --><div class="ad">Buy</div><div class="cookie-notice">We use cookies</div><article class="post-12"><h1>Head &amp; tail</h1><p>First  <b>bold<br>para&nbsp;x.<p>Second &eacute;&#233;.</p>
<form><input><button>Go</button></form><ul><li>one<li>two</ul><aside>Side</aside></article><div id="comments"><p>Nice post, really nice, a long comment that says much.</p></div><footer>End</footer></body></html>"""


def text_of(html, path=None):
    return htmltext.Page(html).text(path)


def test_main_text():
    assert text_of(PAGE) == "Head & tail\nFirst bold para x.\nSecond éé.\none\ntwo"
    assert text_of("") == "" == text_of("<nav>a</nav>") and text_of("plain  text") == "plain text"
    assert text_of("<body><article><p>cut off here and <a href='x") == "cut off here and"
    assert text_of('<article><p title="a > b">x</p><script>if (a<b) "</p>"</SCRIPT>y</article>') == "x\ny"
    assert text_of("<article><p>a</article></div></p>") == "a"
    assert text_of("<p>a<!-- <p>b") == "a" and text_of("<<p>a</p>") in ("<\na", "a", "<<p>a".replace("<p>", "\n"))


def test_host_paths(spark):
    good = "<html><body><div class='x1'><p>{}</p></div><div class='story-{}'><p>{}</p></div></body></html>"
    rows = [(i, "http://H.example/a", good.format("short", i, "long text of the story " * 9)) for i in range(6)]
    rows += [(6, "http://h.example/b", good.format("a much longer block that is not the story " * 9, 7, "the story of this page, told at some length " * 6)), (7, None, None), (8, "bad url", ""), (9, "http://other/x", PAGE), (9, "http://other/x", PAGE), (None, "http://other/x", "<p>q")]
    pages = spark.createDataFrame([(*r, 3) for r in rows], "page_id long, url string, html string, text int")
    out = [(r["page_id"], r["text"], r["n_chars"]) for r in htmltext.main_text(pages).collect()]
    assert len(out) == len(rows) and all(len(t) == n for _, t, n in out)
    by = {i: t for i, t, _ in out}
    assert by[0] == ("long text of the story " * 9).strip() and by[6] == ("the story of this page, told at some length " * 6).strip()
    assert by[7] == by[8] == "" and by[9].startswith("Head & tail") and by[None] == "q"
    assert htmltext.main_text(pages.filter("false")).count() == 0


def test_page_that_continues_beside_the_path(spark):
    one = "<body><div class='wrap'><div class='content'><p>{}</p></div></div></body>"
    two = "<body><div class='wrap'><div class='content'><p>{}</p></div><div class='more'><p>{}</p></div></div></body>"
    rows = [(i, "http://h/a", one.format("the text of one page " * 9)) for i in range(6)] + [(6, "http://h/b", two.format("first " * 35, "second " * 55))]
    by = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert by[0] == ("the text of one page " * 9).strip()
    assert by[6] == ("first " * 35).strip() + "\n" + ("second " * 55).strip()
    a, b = (htmltext.Page(f"<div class='a b c {x}'><p>t</p></div>").paths[-1] for x in "yz")
    assert a != b


def test_deep_and_long_pages():
    import time
    import tracemalloc

    deep = "<div class='a1 b'>" * 40_000 + "<p>deep text</p>" + "</div>" * 40_000
    wild = "<a><li>" * 30_000 + "</b></p>" * 30_000 + "x"
    long = "<article>" + "<p>some words &amp; more</p>" * 60_000 + "</article>"
    for html, want in ((deep, "deep text"), (wild, "x"), (long, "\n".join(["some words & more"] * 60_000))):
        tracemalloc.start()
        began = time.time()
        assert text_of(html) == want
        assert tracemalloc.get_traced_memory()[1] < 150 << 20 and time.time() - began < 60
        tracemalloc.stop()


def made_page(rnd, kind):
    """(html, its article) by construction; a host's pages share the kind of container."""
    word = lambda: rnd.choice("river house stone water bridge cloud field garden window paper".split())
    said = lambda n: " ".join(word() for _ in range(n))
    blocks = [said(rnd.randint(12, 60)) + "." for _ in range(rnd.randint(2, 7))]
    shape = lambda b: rnd.choice(["<p>{}</p>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<p>{}", "<div>{}</div>", "<ul><li>{}</li></ul>"]).format(b)
    inner = "".join(shape(b.replace(" ", rnd.choice([" ", "  ", "\n", " <b>", "&#32;"]), 1).replace("stone", "st&#111;ne")) for b in blocks)
    container = {"article": "<article class='a-{0}'>{1}</article>", "div": "<div id='post-{0}' class='story'>{1}</div>", "plain": "<section>{1}</section>", "main": "<main><div>{1}</div></main>"}[kind]
    around = [f"<nav><ul><li><a href='/x'>{said(3)}</a></li></ul></nav>", f"<header><h1>{said(3)}</h1></header>", f"<aside>{said(20)}</aside>", f"<div class='ad'>{said(15)}</div>", f"<div id='comments'><p>{said(30)}</p></div>", f"<form><label>{said(4)}</label></form>", f"<script>var x = '{said(5)}';</script>", f"<div class='cookie-notice'>{said(9)}</div>", f"<!-- {said(4)} -->", f"<style>p{{}} {said(2)}</style>"]
    rnd.shuffle(around)
    cut = rnd.randrange(len(around))
    html = f"<html><head><title>{said(3)}</title></head><body>{''.join(around[:cut])}{container.format(rnd.randrange(99), inner)}{''.join(around[cut:])}<footer>{said(6)}</footer></body></html>"
    return html, "\n".join(blocks)


def test_made_pages(spark):
    """Articles that are known because the pages were made around them, on hosts of all kinds."""
    rnd = random.Random(12)
    rows, want = [], {}
    for i in range(240):
        kind = ["article", "div", "plain", "main"][i % 4]
        html, want[i] = made_page(rnd, kind)
        rows.append((i, f"http://{kind}.example/{i}", html, "path"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(pages).collect()}
    assert got == want


def test_warc(spark):
    big, other = "x" * 1500, "é" * 600
    rows = [(1, "u", big), (2, "u", big), (9, None, big), (3, "u", other), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "a\r\nb", "\r\n\r\nWARC/1.1\r\n"), (8, "u", other), (8, "u", other), (None, "u", big), (2, "u", other)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    out = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive(pages).collect())
    want = Counter()
    last = {big: 9, other: 8}
    for i, _, h in rows:
        raw = (h or "").encode()
        to = last.get(h) if i is not None and len(raw) >= 1000 and i < last.get(h, -1) else None
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to else "response", to)] += 1
    assert out == want
    assert warc.archive(pages.filter("false")).count() == 0
    odd = [None, "", " a", "a\tb", "a\r\nb", "ü \u2028 x", "http://h/a b", "http://h/%20?q=a:b", "x: y"]
    rows = [(i, u, f"{i}") for i, u in enumerate(odd)]
    bundles = warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string")).cache()
    assert {r["page_id"]: r["url"] for r in warc.read_bundles(bundles).collect()} == dict(enumerate(odd))
    wanted = spark.createDataFrame([("urn:page:3",), ("urn:page:5",), ("urn:page:3",), ("urn:page:77",)], "record_id string")
    assert sorted(r["page_id"] for r in warc.read_bundles(bundles, wanted).collect()) == [3, 5]


def test_seekable_bundles():
    rnd = random.Random(1)
    writer, payloads = warc.BundleWriter(), {}
    for i in range(300):
        body = bytes(rnd.randrange(97, 105) for _ in range(rnd.choice([0, 10, 5000, 300_000 if i == 7 else 50])))
        name, data = warc.record(i, "u", body, hashlib.sha1(body).hexdigest(), None)
        writer.add(name, data)
        payloads[name] = body
    bundle, index = writer.close()
    reader = warc.BundleReader(bundle)
    assert len(reader.spans) > 3 and len(index) == 300
    assert all(reader.record(p)[1] == payloads[p.record_id] and reader.record(p)[0]["warc-record-id"] == f"<{p.record_id}>" for p in index)
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read()
    assert [b for _, b in warc.parse_records(whole)] == list(payloads.values())
    with pytest.raises(ValueError):
        warc.BundleReader(bundle[:-1] + b"x")


def brute_kneser(texts):
    """Modified Kneser-Ney on tuples of bytes, as defined, with the module's limits on discounts."""
    counts = {kneser.ORDER: Counter()}
    for t in texts:
        s = [10] * (kneser.ORDER - 1) + list(t.encode())
        counts[kneser.ORDER].update(tuple(s[i : i + kneser.ORDER]) for i in range(len(s) - kneser.ORDER + 1))
    for k in range(kneser.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    rules = {}
    for k, c in counts.items():
        n = [max(sum(1 for v in c.values() if v == i), 1) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        rules[k] = [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3)]
    by = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            by[k][g[:-1]].append(v)

    def chance(g):
        k = len(g)
        if not k:
            return 1 / 256
        below = chance(g[1:])
        seen = by[k].get(g[:-1])
        if not seen:
            return below
        d = rules[k]
        held = sum(d[min(v, 3) - 1] for v in seen) / sum(seen)
        v = counts[k].get(g, 0)
        return (v - d[min(v, 3) - 1] if v else 0) / sum(seen) + held * below

    return chance


def test_kneser_against_brute_force(spark, monkeypatch):
    texts = ["the cat sat on the mat\nthe dog", "a cat and a dog", "", "dog!! the END \u00e9\u65e5", "the the the"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    levels, chance = kneser.train(df.select("text")), brute_kneser(texts)
    rnd = random.Random(2)
    number = lambda g: int.from_bytes(bytes(g), "big")
    picks = {tuple(rnd.choice([rnd.randrange(256), *b"the cat dog"]) for _ in range(kneser.ORDER)) for _ in range(300)} | {tuple(w) for w in (b" the ", b"a cat", b"\n\n\n\nt", b"zzzzz", b" ethe", b"g!! t")}
    wanted = spark.createDataFrame([(number(g),) for g in picks], "gram long")
    got = {r["gram"]: r["p"] for r in kneser.chances(wanted, levels).collect()}
    assert len(got) == len(picks)
    for g in picks:
        assert got[number(g)] == pytest.approx(chance(g), rel=1e-9)
    for context in (b"\n\n\n\n", b" the", b"qqqq"):
        every = spark.createDataFrame([(number([*context, c]),) for c in range(256)], "gram long")
        assert kneser.chances(every, levels).agg(F.sum("p")).first()[0] == pytest.approx(1)
    assert kneser.train(df.filter("false").select("text")) == []
    # Whole texts, among them the extremes, in few and in many parts.
    others = [*texts, None, "zebra \u65e5\u672c", "x", "the cat " * 3000]
    rows = spark.createDataFrame([(i, t, t) for i, t in enumerate(others)], "doc_id long, text string, `a.b` string")
    for parts, most in ((1, 1 << 21), (5, 1 << 21), (1, 0), (5, 0)):  # costs broadcast, or joined by part
        monkeypatch.setattr(kneser, "MOST_BROADCAST", most)
        monkeypatch.setattr(kneser, "PART_BYTES", 1 << 20 if parts == 1 else 20)
        for r in kneser.score(rows.repartition(parts), levels).collect():
            raw = [10] * (kneser.ORDER - 1) + list((r["text"] or "").encode())
            bits = [-np.log2(chance(tuple(raw[i : i + kneser.ORDER]))) for i in range(len(raw) - kneser.ORDER + 1)]
            assert r["n_symbols"] == len(bits) and r["a.b"] == r["text"]
            assert r["perplexity"] == (pytest.approx(2 ** np.mean(bits), rel=1e-4) if bits else None)


def test_key_table():
    rnd = np.random.default_rng(3)
    for bits in (3, 16):
        table, want = KeyTable(bits), {}
        for _ in range(12):
            g, n = kneser.distinct(rnd.integers(0, 900, 700) << 30)
            assert n.sum() == 700 and np.array_equal(g, np.unique(g))
            at = table.add(g)
            for x, i in zip(g.tolist(), at.tolist()):
                assert want.setdefault(x, i) == i
            assert sorted(want.values()) == list(range(table.n)) and table.all().tolist() == sorted(want, key=want.get)
        probe = np.arange(1000) << 30
        assert table.find(probe).tolist() == [want.get(x, -1) for x in probe.tolist()]


def quality_rows():
    rnd = random.Random(6)
    words = "the river house thing with that which and of stone water".split()
    good = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 80))) + ".", "en" if i % 5 else None) for i in range(300)]
    bad = [(300 + i, " ".join(rnd.choice(["#$%", "QX!!", "zzkq", "|~|"]) for _ in range(40)), "en") for i in range(40)]
    return good, bad


def test_quality(spark):
    good, bad = quality_rows()
    odd = [(900, None, "en"), (901, "", None), (None, "the river house", "en"), (902, "the river and the house", "xx"), (3, good[3][1], "en")]
    docs = spark.createDataFrame([(*r, 1) for r in good + bad + odd], "doc_id long, text string, lang string, perplexity int")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 250)] + [(300, 0), (301, 1), (301, 0), (None, 1), (900, 1)], "doc_id long, quality int")
    rows = kneser.classify(docs, labels).collect()
    assert len(rows) == len(good + bad + odd)
    out = {r["doc_id"]: r["kept"] for r in rows}
    assert sum(out[i] for i, *_ in good) >= 298 and not any(out[i] for i, *_ in bad)
    assert (out[900], out[901], out[None], out[902]) == (False, False, True, True)
    kept = kneser.accepted(docs, labels)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["kept"])
    lone = {r["doc_id"]: r["kept"] for r in kneser.classify(docs, labels.filter("false")).collect()}
    assert lone[300] and not lone[900]
    odd_names = docs.withColumn("a.b", F.lit(1)).withColumn("_n", F.lit(2))
    assert kneser.accepted(odd_names, labels).columns == odd_names.columns
    assert {r["doc_id"] for r in kneser.accepted(docs.drop("lang"), labels).collect()} >= {i for i, *_ in good[:250]}
    assert kneser.classify(docs.filter("false"), labels).count() == 0


def test_spot_signatures():
    v, first = spotsigs.signatures(*spotsigs._as_buffers(["the big red house of stone", "the BIG red house, of stone!", "", "xyzzy plugh", "plugh xyzzy", "the of"]))
    sets = [set(v[a:b].tolist()) for a, b in zip(first, first[1:])]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and not sets[2] and sets[3] != sets[4] and len(sets[5]) == 1


def test_pruned_jaccard():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        a, b = (np.unique(rnd.integers(0, 60, rnd.integers(0, 80))).astype(np.uint32) for _ in range(2))
        x, y = set(a.tolist()), set(b.tolist())
        want = len(x & y) / len(x | y) if x | y else 1.0
        assert spotsigs.pruned_jaccard(a, b) == pytest.approx(want)
        got = spotsigs.pruned_jaccard(a, b, 0.5)
        assert got == pytest.approx(want) if want >= 0.5 else got in (-1.0, pytest.approx(want))


@pytest.mark.parametrize("threshold", [0.5, 0.75, 1.0])
def test_near_pairs(spark, threshold):
    rnd = random.Random(3)
    words = "river house stone water bridge cloud field garden window paper".split()
    texts = []
    for i in range(120):
        if i % 3 and texts:
            own = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            texts.append(" ".join(own))
        else:
            texts.append(" ".join(f"the {rnd.choice(words)} {rnd.choice(words)}" for _ in range(rnd.randint(2, 25))))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "doc_id long, text string")
    prints = spotsigs.fingerprints(docs)
    sets = {r["doc_id"]: frozenset(spotsigs.decode(r["fingerprint"]).tolist()) for r in prints.collect()}
    pairs, members = spotsigs.near_pairs(prints, threshold)
    first = {}
    for i in sorted(sets):
        if sets[i]:
            first.setdefault(sets[i], i)
    assert {(r["doc_id"], r["class_id"]) for r in members.collect()} == {(i, first[x]) for i, x in sets.items() if x}
    reps = sorted(first.values())
    want = {(a, b) for k, a in enumerate(reps) for b in reps[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    got = [(r["u"], r["v"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def plain_spots(text):
    """The set of spot signatures as tuples of words, by the definition."""
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    anchors = set(spotsigs.ANCHORS)
    found = set()
    for i, w in enumerate(words):
        after = [x for x in words[i + 1 :] if x not in anchors][: spotsigs.CHAIN]
        if w in anchors and after:
            found.add((w, *after))
    if not found and words:
        k = min(spotsigs.CHAIN, len(words))
        found = {("run", *words[i : i + k]) for i in range(len(words) - k + 1)}
    return found


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_texts(spark):
    rnd = random.Random(8)
    words = "the River of house Stone and water, with bridge é日 x1 Und DER".split()
    texts = {i * 3: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) for i in range(120)}
    texts |= {50: None, 53: "", 56: "!!", 59: "river", 62: "the the", 65: "the river " * 4000, 68: texts[30], 71: "river stone bridge water"}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, bucket int")
    out = {r["doc_id"]: r for r in spotsigs.edit_likeness(docs).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(out) == sorted(texts)
    prints = {}
    for k, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        own, changed, other = plain_spots(text), plain_spots(new), plain_spots(following)
        r = out[i]
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and r["n_chars"] == len(text)
        assert r["n_signatures"] == len(own) == len(spotsigs.decode(r["fingerprint"])) and len(spotsigs.decode(r["edited_fingerprint"])) == len(changed)
        assert r["near_edited"] == pytest.approx(likeness(own, changed)) and r["near_next"] == pytest.approx(likeness(own, other))
        for s, f in ((own, r["fingerprint"]), (changed, r["edited_fingerprint"])):
            assert prints.setdefault(frozenset(s), f) == f
    assert len(set(prints.values())) == len(prints)


def test_edited_odd_rows(spark):
    def run(rows):
        return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in spotsigs.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert run([]) == [] and run([(5, "abcd")]) == [(5, 4, sha("abab"))]
    assert run([(5, "abcd"), (5, "abcd")]) == [(5, 4, sha("abab"))] * 2
    assert run([(None, "wxyz"), (7, "abcd")]) == [(7, 4, sha("abwx")), (None, 4, sha("wxab"))]


def test_pipeline(spark, tmp_path):
    good, bad = quality_rows()
    rnd = random.Random(9)
    words = "the river house thing with that which and of stone water".split()
    base = [rnd.choice(words) + str(i % 9).replace("0", "") for i in range(120)]
    copy = " ".join(base)
    docs = [(i, t, lang, "a" if i % 3 else "b", len(t)) for i, t, lang in good + bad] + [(500, copy, "en", "a", 1), (501, copy, "en", None, 1), (502, "12 34", "en", "a", 1), (503, None, "en", "a", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in list(range(250)) + [500]], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in pieces}
    assert not ids & {i for i, *_ in bad} and 500 in ids and not ids & {501, 502, 503} and len(ids) > 200
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame.limit(0), str(tmp_path)).columns == frame.columns, name


def test_repeated_ids_in_the_pipeline(spark):
    same = "one two three four five six seven"
    rows = [(1, "b c d", 1), (1, "a b c", 2), (2, "q r s", 3), (None, "t", 4), (None, same, 5), (7, same, 6), (6, same, 7), (6, same, 7), (8, None, 8), (8, "", 9)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "a.b"])
    out = pipeline_stages.near_duplicates_stage(spark, docs, "")
    got = sorted(((r["doc_id"], r["text"], r["a.b"]) for r in out.collect()), key=str)
    assert got == sorted([r for r in set(rows) if r[2] not in (5, 6)], key=str) and out.columns == docs.columns
    plain = docs.filter("doc_id in (2, 7)")
    assert sorted(r["doc_id"] for r in pipeline_stages.near_duplicates_stage(spark, plain, "").collect()) == [2, 7]


def test_stages_on_odd_tables(spark, tmp_path):
    """Null ids, null languages, missing texts, repeated rows and names of any kind go through each stage."""
    good, bad = quality_rows()
    rows = [(i, t, lang, "s", i) for i, t, lang in good] + [(None, "water stone of and which that with thing house river the the river and that", None, None, 1), (None, None, None, None, 2), (5000, "", "en", "s", 3), (5001, "!! 12", None, "s", 4), (10, good[10][1], "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `n.chars` long")
    spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        kept = out.collect()
        assert out.columns == docs.columns and len(kept) >= 250, name
        assert any(r["doc_id"] is None and r["text"] for r in kept), name
        texts = {t for _, t, *_ in rows}
        assert {r["text"] for r in kept} <= texts, name
    assert pipeline_stages.packing_stage(spark, docs, "").agg(F.sum("length")).first()[0] > 1000
    assert pipeline_stages.packing_stage(spark, docs.filter("false"), "").count() == 0


def test_registry():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert len(corpus_pipeline.STAGES) == 4 and packing.SEQUENCE == 1024 and product and F and shared_dir
