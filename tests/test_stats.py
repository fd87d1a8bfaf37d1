"""Statistics on micro-corpora whose results were worked out by hand."""

import math

import pytest

from corpusloom.operators import stats, tools

IGT = (
    "ord bigint, lang string, example_id string, source string, morpheme string, gloss string, translation string, gloss_tags array<string>, "
    "chapter string, section string, subsection string, subsubsection string, source_section string"
)


def corpus(spark, rows):
    """rows: dicts; missing fields are null."""
    names = [x.split()[0] for x in IGT.split(", ")]
    full = [tuple({"ord": i, "lang": "L", "example_id": f"e{i}"}.get(n) if n not in r else r[n] for n in names) for i, r in enumerate(rows)]
    return stats.examples(spark.createDataFrame(full, IGT))


def tags(spark, *lists):
    return corpus(spark, [{"gloss_tags": t} for t in lists])


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_profiles(spark):
    ex = tags(spark, ["A", "B", "A"], ["B"], [], None, [None, ""])
    p = {r["tag"]: r for r in stats.tag_profiles(ex).collect()}
    assert (p["A"]["cnt"], p["A"]["n_holding"], p["A"]["mean_pos"], p["A"]["std_pos"], p["A"]["position"]) == (2, 1, 0.5, 0.707, "flexible")
    assert (p["B"]["cnt"], p["B"]["mean_pos"], p["B"]["std_pos"], p["B"]["position"]) == (2, 0.5, 0.0, "medial-fixed")
    assert p["A"]["coverage"] == pytest.approx(2 / 5)


def test_pairs_and_ngrams(spark):
    ex = tags(spark, ["A", "B", "A"], ["B"], [])
    assert rows(stats.pair_counts(ex), "a", "b", "cnt") == [("A", "A", 1), ("A", "B", 2)]
    assert rows(stats.frequent_ngrams(ex, 2, 40, least=1), "gram", "cnt") == [("A B", 1), ("B A", 1)]
    assert rows(stats.top_cooccurrents(ex), "tag", "rank", "partner", "cnt") == [("A", 1, "B", 2), ("A", 2, "A", 1), ("B", 1, "A", 2)]


def test_compare(spark):
    ex = tags(spark, ["A", "B", "A"], ["B"], [])
    r = stats.compare_tags(ex, [("a", "b")]).first()
    assert (r["cooc"], r["relation"]) == (1, "INDEPENDENT") and r["pmi"] == pytest.approx(math.log2(0.75), abs=1e-5)
    r = stats.compare_tags(tags(spark, ["A"], ["B"]), [("A", "B")]).first()
    assert r["pmi"] == -math.inf and r["relation"] == "REPEL"


@pytest.mark.parametrize("hits, kind, verdict", [(0, "zero", "STRONG ABSENCE"), (4, "marginal", "WEAK PRESENCE"), (5, None, "WEAK PRESENCE"), (10, None, "LIMITED"), (49, None, "LIMITED"), (50, None, "PRESENT")])
def test_absence(spark, hits, kind, verdict):
    ex = tags(spark, *([["PST"]] * hits + [["X"]] * (1000 - hits)))
    got = {r["category"]: r["kind"] for r in stats.absent_categories(ex).collect()}
    assert got.get("TENSE") == kind
    assert {r["category"]: r["verdict"] for r in stats.absence_verdicts(ex).collect()}["TENSE"] == verdict


def test_resolve_category():
    assert [stats.resolve_category(x) for x in ("tense", "EVIDENTIAL", "", "xyz")] == ["TENSE", "EVIDENTIALITY", "TENSE", None]


def test_morphs(spark):
    ex = corpus(spark, [
        {"morpheme": "ka-lo-ma", "gloss": "3-buy-FUT", "gloss_tags": ["3", "buy", "FUT"]},
        {"morpheme": "ka-lo", "gloss": "3-buy-FUT", "gloss_tags": ["FUT"]},
        {"morpheme": "ma", "gloss": "FUT extra-FUT", "gloss_tags": ["FUT"]},
        {"morpheme": None, "gloss": "FUT", "gloss_tags": ["FUT"]},
    ])
    assert rows(tools.surface_forms(ex, "fut"), "form", "cnt") == [("ma", 2)]
    r = tools.morpheme_positions(ex, "FUT").first()
    assert (r["prefix"], r["suffix"], r["stem"], r["medial"], r["dominant"]) == (0, 1, 1, 0, "suffix")


def test_construction_and_sections(spark):
    ex = corpus(spark, [{"gloss_tags": ["A", "B", "C"]}, {"gloss_tags": ["A", "C"]}, {"gloss_tags": []}])
    assert rows(tools.construction(ex, ["b", "c"]), "ord") == [(0,)]
    assert rows(tools.construction(ex, []), "ord") == [(0,), (1,), (2,)]
    some = corpus(spark, [{"source_section": "Nouns > Case"}] * 10 + [{"source_section": "Verbs"}])
    assert len(tools.section_aware(some, ["nouns"]).collect()) == 6
    assert len(tools.section_aware(some, []).collect()) == 8


def test_ordinal(spark):
    df = spark.createDataFrame([("x", i * 7) for i in range(100)] + [("y", 3)], "lang string, ord long")
    got = stats.ordinal(df, "lang", "ord", "n", width=50).orderBy("lang", "ord").collect()
    assert [r["n"] for r in got] == [*range(1, 101), 1]


def test_empty(spark):
    ex = tags(spark).filter("false")
    for df in (stats.tag_profiles(ex), stats.top_cooccurrents(ex), stats.frequent_ngrams(ex, 2, 5), stats.absent_categories(ex), stats.section_richness(ex), tools.trilines(ex, "x"), tools.search_translations(ex, "x")):
        assert df.collect() == []
