"""Components against exact brute force, hot groups of copies, and odd rows."""

import random
import re

from pyspark.sql import functions as F

from chartmill.llm import minhash
from chartmill.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = sorted((find(a), find(b)))
                up[rb] = ra
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(n=150, seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    common = " ".join(word() for _ in range(40))
    rows = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.35 and rows:
            words = rnd.choice(rows)[1].split()
            for _ in range(rnd.randint(0, max(1, len(words) // 25))):
                words[rnd.randrange(len(words))] = word()
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(word() for _ in range(rnd.choice([1, 3, 4, 5, 6, 40, 120]))) + (" " + common if kind > 0.7 else "")))
    return rows


def found(spark, rows, schema="doc_id long, text string"):
    return minhash.near_duplicates(spark.createDataFrame(rows, schema))


def test_against_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found(spark, rows).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(rows).items()}


def test_star_of_near_copies(spark):
    """Copies of one text that are further from each other than from it, and a chain of edits."""
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(120):
        words = list(base)
        for _ in range(5):
            words[rnd.randrange(200)] = f"x{rnd.random()}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(200)]
    for i in range(30):
        chain[(i * 13) % 200] = f"y{i}"
        chain[(i * 29 + 7) % 200] = f"z{i}"
        rows.append((2000 + i, " ".join(chain)))
    got = {r["doc_id"]: r["component_id"] for r in found(spark, rows).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}


def test_copies_and_odd_rows(spark):
    rows = [(i, "one two three four five six") for i in range(5, 300)] + [(1, "One TWO three\tfour  five six"), (2, None), (3, ""), (4, " \n"), (None, "one two three four five six"), (400, "a b"), (401, "A b"), (402, "b a"), (7, "a b")]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found(spark, rows).collect()]
    assert len(got) == len(rows)
    by = {}
    for d, n, c, k in got:
        by.setdefault(d, []).append((n, c, k))
    assert by[1] == [(2, 1, True)] and by[100] == [(2, 1, False)] and by[None] == [(2, None, False)]
    assert [by[i] for i in (2, 3, 4)] == [[(0, i, True)] for i in (2, 3, 4)]
    assert {c for _, c, _ in by[7]} == {1} and by[400][0][1] == 1 and by[401][0][1] == 1 and by[402] == [(1, 402, True)]
    assert found(spark, [], "doc_id long, text string").count() == 0
    clash = spark.createDataFrame([(1, "a", 5, "z")], "doc_id long, text string, component_id long, sig string")
    assert [tuple(r) for r in minhash.near_duplicates(clash).collect()] == [(1, 1, 1, True)]


def test_components_of_a_path(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).union(spark.createDataFrame([(900, 901), (902, 901), (7, 7)], "u long, v long"))
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900, 902: 900}
    assert components(edges.filter("false")).count() == 0


def test_links_within_a_crowd(spark):
    """Near copies among rows that share a long passage, and one bridge between two tight clusters of over 8 rows."""
    rnd = random.Random(3)
    own = lambda n: [f"o{rnd.random()}" for _ in range(n)]
    passage, rows = [f"p{i}" for i in range(174)], []
    for i in range(80):  # 0.73 from each other, and 0.77 from the one near copy
        mine = own(32)
        rows.append((i, " ".join(passage + mine)))
        rows.append((500 + i, " ".join(passage + mine[:6] + own(26))))
    base = [f"b{i}" for i in range(200)]
    left, bridge = base[:172] + own(28), base[:186] + own(14)
    for i in range(12):
        for k, side in ((1000, left), (2000, base)):
            words = list(side)
            words[3 * i] = f"e{rnd.random()}"
            rows.append((k + i, " ".join(words)))
    rows.append((3000, " ".join(bridge)))
    want = {i: c for i, (_, c) in brute(rows).items()}
    got = {r["doc_id"]: r["component_id"] for r in found(spark, rows).collect()}
    assert got == want and [want[500 + i] for i in range(80)] == list(range(80))


def signed(spark, n, far):
    """Classes whose signatures agree in the first two components only, but for `far` pairs, which also agree in every other one but not in one that would deepen the run."""
    import numpy as np

    rnd = np.random.default_rng(2)
    sig = rnd.integers(1, 1 << 32, (n, 64), dtype=np.uint64).astype(">u4")
    sig[:, :2] = 7
    for a, b in far:
        for k in (1, 3):
            sig[b, k::4] = sig[a, k::4]
    parity = rnd.integers(0, 256, (n, minhash.PARITY_BITS // 8), dtype=np.uint8)
    for a, b in far:
        parity[b] = parity[a]
    rows = zip(sig, minhash.sketches(sig), parity)
    return spark.createDataFrame([(i, -i, i, 100, *(x.tobytes() for x in r)) for i, r in enumerate(rows)], "h1 long, h2 long, doc_id long, n_shingles long, sig binary, sketch binary, parity binary")


def test_large_region_is_not_cut(spark, monkeypatch):
    """Pairs far apart in one region of many blocks, at any place of it, meet in the second pass."""
    far = [(i, 2999 - i) for i in range(0, 1400, 7)]
    classes = signed(spark, 3000, far)
    first = {(r["u"], r["v"]) for r in minhash.candidates(classes.select("doc_id", "n_shingles", "sig", "sketch")).collect()}
    assert len(first & set(far)) < len(far)  # what the first pass loses
    none = spark.createDataFrame([], "node long, label long")
    for wide in (2048, 100, 16):
        monkeypatch.setattr(minhash, "WIDE", wide)
        got = sorted((r["u"], r["v"]) for r in minhash.rest(classes, none).collect())
        assert got == far
    linked = spark.createDataFrame([(2999 - i, i) for i in range(0, 700, 7)], "node long, label long")
    assert sorted((r["u"], r["v"]) for r in minhash.rest(classes, linked).collect()) == far[100:]


def test_bridged_groups(spark):
    """Two tight groups that one pair of 0.75 or more joins, of 9, 16 and 31 texts over 20 seeds."""
    rows, want = [], {}
    for seed in range(20):
        for size in (9, 16, 31):
            rnd = random.Random(seed * 100 + size)
            name = f"{seed}x{size}"
            word = lambda: f"{name}w{rnd.random()}"  # noqa: B023, E731
            shared = [word() for _ in range(184)]
            sides = [shared + [word() for _ in range(28)] for _ in range(2)]
            own = []
            for side in sides:
                for i in range(size):
                    words = list(side)
                    words[5 + rnd.randrange(170)] = word()
                    if i == 0:  # the bridge is nearer to the other side
                        words = side[:-3]
                    own.append((len(rows) + len(own), " ".join(words)))
            want |= {i: c for i, (_, c) in brute(own).items()}
            rows += own
    got = {r["doc_id"]: r["component_id"] for r in found(spark, rows).collect()}
    assert got == want and len(set(want.values())) < 120


def test_parity_screen_turns_no_link_away():
    import numpy as np

    rnd = np.random.default_rng(4)
    sizes, sets = [], []
    for n in (1, 3, 7, 40, 400, 5000):
        for _ in range(20):
            a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
            change = rnd.integers(0, len(a) // 7 + 1)
            sets += [a, np.unique(np.concatenate([a[change:], rnd.integers(0, 1 << 63, change).astype(np.uint64)]))]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    odd = minhash.parities(np.concatenate(sets), first)
    for i in range(0, len(sets), 2):
        both = len(np.intersect1d(sets[i], sets[i + 1]))
        total = len(sets[i]) + len(sets[i + 1])
        unlike = int(np.bitwise_count(odd[i] ^ odd[i + 1]).sum())
        assert unlike <= total - 2 * both
        if 100 * both >= 75 * (total - both):
            assert 7 * unlike <= total
