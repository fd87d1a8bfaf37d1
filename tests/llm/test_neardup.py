"""The similarity join against brute force, with hot words, copies and short sets; the index by itself."""

import random

import numpy as np
import pytest

from corpusloom.llm import neardup

SCHEMA = "id long, a string, b string, k long, w string"


def brute(rows, num, den):
    sets = {i: ({x for x in f"{a or ''} {b or ''}".split(" ") if x}, (a or "", b or "")) for i, a, b in rows}
    ids = sorted(sets)
    out = set()
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            (s, t), (u, v) = sets[ids[x]], sets[ids[y]]
            if t != v and s and u and len(s & u) * den >= len(s | u) * num:
                out.add((ids[x], ids[y]))
    return out


def run(spark, rows, num, den):
    df = spark.createDataFrame([(i, a, b, 0, "z") for i, a, b in rows], SCHEMA)
    pairs = neardup.near_duplicates(df, "id", ["a", "b"], num, den)
    return {(r["a"], r["b"]) for r in neardup.expanded(pairs, df, "id", ["a", "b"]).collect()}


@pytest.mark.parametrize("num, den", [(3, 5), (4, 5)])
def test_against_brute_force(spark, num, den):
    rnd = random.Random(7)
    rows = []
    for i in range(700):
        n = rnd.choice([1, 2, 3, 5, 8, 12, 20, 40])
        if rows and rnd.random() < 0.5:
            words = (rnd.choice(rows)[1] or "").split(" ")
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = rnd.choice(["", f"w{rnd.randint(0, 300)}"])
        else:
            words = [f"w{min(rnd.randint(0, 300), rnd.randint(0, 300))}" for _ in range(n)]
        rows.append((i, " ".join(words), rnd.choice([None, "", "tail"])))
    rows += [(1000, None, None), (1001, "", ""), (1002, "  ", None), (1003, "p" * 50_000, ""), (1004, "p" * 50_000, None)]
    want = brute(rows, num, den)
    assert len(want) > 100 and run(spark, rows, num, den) == want


def test_hot_blocks_are_given_back(spark, monkeypatch):
    """A block over the bound is searched by pairs of its parts, in other tasks, and nothing is lost."""
    monkeypatch.setattr(neardup, "PART", 40)
    rnd = random.Random(17)
    rows = [(i, "hot spot " + " ".join(f"w{rnd.randint(0, 3)}" for _ in range(3)), f"t{rnd.randint(0, 9)}" if i % 3 else None) for i in range(400)]
    want = brute(rows, 3, 5)
    assert len(want) > 5000 and run(spark, rows, 3, 5) == want


def test_index_drops_pairs_of_nodes(spark):
    """Clusters of near copies that share a frequent word: nearly all pairs of nodes of different clusters are dropped."""
    rnd = random.Random(18)
    rows = []
    for c in range(60):
        base = [f"c{c}x{j}" for j in range(24)]
        for _ in range(10):
            w = list(base)
            w[rnd.randrange(24)] = f"v{rnd.randint(0, 999)}"
            rows.append((len(rows), "hot " + " ".join(w), None))
    df = spark.createDataFrame([(i, a, b, 0, "z") for i, a, b in rows], SCHEMA)
    got = neardup.index_report(df, "id", ["a", "b"], 3, 5)
    assert got["representatives"] == 600 and got["sketches"] >= 60 * 45
    rnd = np.random.default_rng(19)
    base = rnd.integers(0, 2**63, (60, 2)).astype(np.uint64)
    hi = np.repeat(base[:, 0], 10) ^ (np.uint64(1) << rnd.integers(0, 60, 600).astype(np.uint64))
    lo, key, n = np.repeat(base[:, 1], 10), np.zeros(600, int), np.full(600, 24)
    a, b = neardup.gray_rank(hi, lo)
    order = np.lexsort((b, a))
    tally = {}
    list(neardup.gray_search(key, hi[order], lo[order], n, 3, 5, tally))
    assert tally["upper nodes dropped"] > 0.9 * tally["upper nodes"] and tally["upper nodes"] < 0.2 * 600 * 599 / 2


def test_empty(spark):
    assert run(spark, [], 3, 5) == set() and run(spark, [(1, None, ""), (2, "", None)], 3, 5) == set()


def test_keys_of_frequent_words_meet():
    """Whatever the counts say, two sets over the threshold share a key."""
    rnd = np.random.default_rng(8)
    counts = {}
    vocab = rnd.integers(1, 2**63, 60).astype(np.uint64)
    for v in vocab:
        counts[int(v)] = int(rnd.choice([1, 5, 1500, 3000, 50_000, 900_000, 40_000_000]))

    def keys(words, num, den):
        h = np.array(sorted(words, key=lambda w: (counts[w], w)), np.uint64)
        c = np.array([max(2, counts[int(x)]) for x in h])
        n = len(h)
        _, k = neardup.block_keys(h, np.zeros(n, int), np.arange(n), np.full(n, n), c, num, den)
        return set(k.tolist())

    checked = 0
    for _ in range(400):
        n = int(rnd.choice([1, 2, 3, 4, 6, 7, 8, 9, 12, 13, 14, 24]))
        a = set(map(int, rnd.choice(vocab, n, replace=False)))
        b = set(a)
        for _ in range(int(rnd.integers(0, 6))):
            if b and rnd.random() < 0.5:
                b.discard(rnd.choice(sorted(b)))
            else:
                b.add(int(rnd.choice(vocab)))
        for num, den in ((3, 5), (4, 5)):
            if b and len(a & b) * den >= len(a | b) * num:
                checked += 1
                assert keys(a, num, den) & keys(b, num, den), (len(a), len(b))
    assert checked > 200


def test_index_loses_nothing():
    rnd = np.random.default_rng(9)
    n = 900
    base = rnd.integers(0, 2**63, (30, 2)).astype(np.uint64)
    hi, lo = base[rnd.integers(0, 30, n), 0], base[rnd.integers(0, 30, n), 1]
    flip = np.uint64(1) << rnd.integers(0, 64, n).astype(np.uint64)
    hi = hi ^ flip
    key, size = np.sort(rnd.integers(0, 3, n)), rnd.integers(5, 40, n)
    a, b = neardup.gray_rank(hi, lo)
    order = np.lexsort((b, a, key))
    key, hi, lo, size = key[order], hi[order], lo[order], size[order]
    got = set()
    for i, j in neardup.gray_search(key, hi, lo, size, 3, 5):
        got |= {(min(x, y), max(x, y)) for x, y in zip(i.tolist(), j.tolist())}
    want = set()
    for i in range(n):
        d = np.bitwise_count(hi[i] ^ hi[i + 1 :]).astype(int) + np.bitwise_count(lo[i] ^ lo[i + 1 :])
        ok = (d * 8 <= 2 * (size[i] + size[i + 1 :])) & (key[i + 1 :] == key[i])
        want |= {(i, i + 1 + int(x)) for x in np.flatnonzero(ok)}
    assert got == want and len(want) > 50


def test_sketch_is_a_lower_bound():
    rnd = np.random.default_rng(10)
    for _ in range(200):
        a = set(rnd.integers(0, 2**63, 20).tolist())
        b = set(list(a)[:15]) | set(rnd.integers(0, 2**63, 4).tolist())
        h = np.array([*a, *b], np.uint64)
        hi, lo = neardup.sketch(h, np.array([0, len(a)]))
        d = int(np.bitwise_count(hi[0] ^ hi[1])) + int(np.bitwise_count(lo[0] ^ lo[1]))
        assert d <= len(a ^ b)


def test_components_and_groups(spark):
    rnd = random.Random(13)
    edges = {tuple(sorted(rnd.sample(range(300), 2))) for _ in range(170)} | {(i, i + 1) for i in range(1000, 1060)}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(sorted(edges), "a long, b long")
    assert {r["node"]: r["comp"] for r in neardup.components(df).collect()} == {n: root(n) for n in parent}
    assert neardup.components(df.filter("false")).count() == 0

    rows = [(5, "a b c d e f g h", None), (2, "a b c d e f g h", ""), (3, "a b c d e f g i", ""), (4, "a b c d e f j i", ""), (9, "x y", ""), (10, None, None)]
    rows = spark.createDataFrame([(i, a, b, 0, "z") for i, a, b in rows], SCHEMA)
    got = {r["id"]: (r["rep"], r["grp"], r["links"]) for r in neardup.grouped(neardup.near_duplicates(rows, "id", ["a", "b"], 3, 5), rows, "id", ["a", "b"]).collect()}
    assert got == {2: (2, 2, 2), 5: (2, 2, 2), 3: (3, 2, 2), 4: (4, 2, 2), 9: (9, 9, 0), 10: (10, 10, 0)}
