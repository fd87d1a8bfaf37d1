"""Term counts by deltas, co-occurrence and canonical mapping against plain versions."""

import itertools
import random
from collections import Counter

import pytest

from corpusloom.llm.canonical import Resolver, canonical_list, map_to_list, within_one
from corpusloom.llm.cooccur import pair_statistics, top_partners
from corpusloom.llm.termcounts import TermCounts

REC = "id long, terms array<string>, count long"


def records(spark, rows):
    return spark.createDataFrame([(i, t, 7) for i, t in rows], REC)


def plain(rows):
    occ, rec = Counter(), Counter()
    for _, t in rows:
        t = [x for x in t or [] if x]
        occ.update(t)
        rec.update(set(t))
    return {k: (occ[k], rec[k]) for k in occ}, sum(any(x for x in t or []) for _, t in rows)


def stored(s):
    return {r["term"]: (r["occurrences"], r["records"]) for r in s.counts().collect()}


def test_term_counts(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, [], [None, ""], [rnd.choice("abcde") for _ in range(rnd.randint(1, 6))]])) for i in range(400)]
    s = TermCounts(spark, buckets=4).apply(added=records(spark, rows))
    want, n = plain(rows)
    assert stored(s) == want and s.total() == n
    # change some, remove some, add some: only these are given
    old, gone = rows[:50], rows[50:80]
    changed = [(i, ["a", "zz"]) for i, _ in old]
    new = [(1000 + i, ["new", "new"]) for i in range(3)]
    s.apply(added=records(spark, changed + new), removed=records(spark, old + gone))
    want, n = plain(changed + rows[80:] + new)
    assert stored(s) == want and s.total() == n
    again = TermCounts(spark, s.path, buckets=4)
    assert again.version == 2 and stored(again) == want
    marks = {r["term"]: r["mark"] for r in s.marked().collect()}
    assert marks["new"] is None and all(m == ("rare" if want[t][1] < 3 else "common" if 5 * want[t][1] > n else None) for t, m in marks.items())


def test_term_counts_empty(spark):
    s = TermCounts(spark).apply(added=records(spark, []))
    assert stored(s) == {} and s.total() == 0 and s.marked().count() == 0
    assert TermCounts(spark).apply().version == 0


def test_only_touched_buckets_are_written(spark):
    rows = [(i, [f"t{i}"]) for i in range(200)]
    s = TermCounts(spark, buckets=8).apply(added=records(spark, rows))
    before = dict(s._written)
    s.apply(added=records(spark, [(900, ["t3"])]), removed=records(spark, [(7, ["t7"])]))
    again = TermCounts(spark, s.path)
    changed = {b for b in before if again._written[b] != before[b]}
    # t3, t7; the number of records stays
    assert 1 <= len(changed) <= 2 and again.buckets == 8 and stored(again) == stored(s)
    assert stored(s)["t3"] == (2, 2) and "t7" not in stored(s) and s.total() == 200
    s.apply(removed=records(spark, [(i, t) for i, t in rows if i != 7] + [(900, ["t3"])]))
    assert stored(TermCounts(spark, s.path)) == {} and s.total() == 0


def test_shared_aliases_and_sets_of_words():
    r = Resolver([("PST", "past"), ("PRT", "past"), ("DEFPST", "definite past tense marker"), ("PFV", "perfective"), ("past2", None)])
    # an alias of two values stands for none of them
    assert r.resolve("Past") == "" and r.resolve("pst") == "PST"
    assert r.resolve("tense past definite marker") == "DEFPST" and r.resolve("definite past marker") == "DEFPST"
    assert r.resolve("past marker") == "" and r.resolve("definite marker of the past tense") == ""
    assert r.resolve("definitee pasts tense marker") == "DEFPST"


def test_long_record(spark):
    s = TermCounts(spark).apply(added=records(spark, [(0, ["x"] * 60_000 + ["y"])]))
    assert stored(s) == {"x": (60_000, 1), "y": (1, 1)}


def test_pairs(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, [], ["", None, "q"], [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))]])) for i in range(500)]
    got = {(r["item_a"], r["item_b"]): r for r in pair_statistics(records(spark, rows), "terms").collect()}
    one, two, n = Counter(), Counter(), 0
    for _, t in rows:
        u = sorted({x for x in t or [] if x})
        n += bool(u)
        one.update(u)
        two.update(itertools.combinations(u, 2))
    assert {k: r["n_ab"] for k, r in got.items()} == dict(two)
    assert all((r["n_a"], r["n_b"], r["n_records"]) == (one[a], one[b], n) for (a, b), r in got.items())
    r = got["a", "b"]
    assert r["lift"] == pytest.approx(r["n_ab"] * n / (one["a"] * one["b"])) and r["llr"] >= 0
    assert {x["rank"] for x in top_partners(pair_statistics(records(spark, rows), "terms"), 2).collect()} == {1, 2}
    assert pair_statistics(records(spark, []), "terms").count() == 0


ENTRIES = [("PST", "past tense"), ("3SG.OBJ", "third person singular object"), ("3PL.OBJ", "third person plural object"), ("PRF", "perfect"), ("PFV", "perfective"), ("ALL", "allative"), ("PL", "plural"), ("DU", "dual"), ("NULL", None)]


@pytest.mark.parametrize(
    "value, want",
    [("pst", "PST"), (" PST\u00a0", "PST"), ("P\u200bST", "PST"), ("ＰＳＴ", "PST"), ("РST", "PST"), ("[PST]", "PST"), ("PST (past tense)", "PST"), ("PAST_TENSE", "PST"), ("past tesne", "PST"), ("pas tense", "PST"),
     ("3sg-obj", "3SG.OBJ"), ("3PL OBJ", "3PL.OBJ"), ("3PL.uBJ", "3PL.OBJ"), ("third person singulr objct", "3SG.OBJ"), ("perfe", ""), ("allat.", "ALL"), ("plura", "PL"), ("XQZW", ""), ("late.planting", ""), ("PST PL", ""), ("???", ""), ("", "")],
)
def test_resolver(value, want):
    assert Resolver(ENTRIES).resolve(value) == want


def test_within_one():
    rnd = random.Random(3)
    for _ in range(500):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7)))
        i = rnd.randint(0, len(w))
        assert within_one(w, w[:i] + "x" + w[i:]) and within_one(w[:i] + "x" + w[i:], w) and within_one(w, w[:i] + "x" + w[i + 1 :])
    assert not within_one("abcd", "badc") and within_one("abcd", "bacd") and not within_one("abc", "abcde")


def test_mapping(spark):
    df = spark.createDataFrame([(1, "PST"), (1, "pst"), (1, "pst"), (2, None), (3, ""), (4, "x" * 100_000)], "canonical_id long, value string")
    got = sorted(map(tuple, map_to_list(df, ENTRIES).collect()))
    assert got == [(1, "PST"), (1, "PST"), (4, "")]
    assert [r["canonical"] for r in map_to_list(df.filter("value = 'pst'"), []).collect()] == ["", ""]
    assert canonical_list(spark.createDataFrame([("A", "b"), ("", "c"), (None, None)], "t string, m string"), "t", "m") == [("A", "b")]
