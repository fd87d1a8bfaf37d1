"""Readers, writers, sections, retrieval, dictionary, packed fields and the driver loop."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import abbrev
from corpusloom.operators import retrieval, sections
from corpusloom.operators.packed import SplitModel, read, segment, split_packed
from corpusloom.plans import agent, registry
from corpusloom.plans.model import RuleModel, answers, ask
from corpusloom.sources import readers, sinks


def test_json_readers(spark, tmp_path):
    p = tmp_path / "igt.json"
    p.write_text(json.dumps([{"source": "a", "gloss_tags": [["A", "B"], ["C"]], "chapter": "1 X", "subsection": "s"}, {"example_id": "q", "gloss_tags": ["D"], "source_section": "raw"}, {}]))
    r = readers.igt_json(spark, str(p), "L").orderBy("ord").collect()
    assert [x["gloss_tags"] for x in r] == [["A", "B", "C"], ["D"], []]
    assert [x["example_id"] for x in r] == ["igt_0000", "q", "igt_0002"] and [x["source_section"] for x in r] == ["1 X > s", "raw", ""]
    c = tmp_path / "g.json"
    c.write_text(json.dumps([{"text": "t", "section": "s"}, {"chunk_id": "z", "page": 3}]))
    r = readers.grammar(spark, str(c)).orderBy("ord").collect()
    assert [(x["chunk_id"], x["level"], x["page"]) for x in r] == [("chunk_0000", 2, None), ("z", 1, 3)]


def test_plain_text(spark, tmp_path):
    p = tmp_path / "g.txt"
    long = "\n".join(f"line number {i} of the body" for i in range(122))
    p.write_text(long)
    assert readers.grammar(spark, str(p)).count() == 2
    p.write_text("Chapter 1 Short\n1.1 Also short\nChapter 2 Nouns\n§2.1 Case\n" + "words " * 20 + "\n§2.1.1 Forms\n" + "more " * 20)
    r = readers.grammar(spark, str(p)).orderBy("ord").collect()
    assert [(x["chapter"], x["section"], x["subsection"]) for x in r] == [("Chapter 2 Nouns", "§2.1 Case", ""), ("Chapter 2 Nouns", "§2.1 Case", "§2.1.1 Forms")]


def test_lists(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("pst\tpast\n# no\n\n1, 2, 3  persons\nPST   past tense\nbad\n")
    r = readers.abbreviations(spark, str(p)).orderBy("ord").collect()
    assert [(x["tag"], x["meaning"]) for x in r] == [("PST", "past tense"), ("1, 2, 3", "persons")]
    u = tmp_path / "u.csv"
    u.write_text("\ufeffid,statement,antecedent,consequent,logic,domain,source\nU1,\"a, \"\"b\"\"\",x,y,Absolute,,z\n,skip,,,,,\nU2,s,,,,D,\n", encoding="utf-8")
    r = readers.universals(spark, str(u)).orderBy("id").collect()
    assert [(x["id"], x["statement"], x["logic"], x["domain"]) for x in r] == [("U1", 'a, "b"', "absolute", "UNKNOWN"), ("U2", "s", "implication", "D")]
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"languages": [{"name": "A", "igt_only": True}]}))
    with pytest.raises(ValueError):
        readers.config(str(c))
    work = spark.createDataFrame([("a",), ("b",)], "k string")
    assert [x["k"] for x in readers.pending(work, work.filter("k = 'a'"), ["k"]).collect()] == ["b"]
    assert readers.empty(spark, "igt").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("q", 1, "flexible", 2, 66, "A, B"), ("q", 2, "fixed", 1, 33, "C")], "question string, rank int, value string, n int, share int, languages string")
    assert "| flexible | 2 | 66 | A, B |" in sinks.types_report(df)
    sinks.write_json(df, str(tmp_path / "j"), ["question"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_pretty_json(df, str(tmp_path / "p.json"))
    assert len(json.loads((tmp_path / "p.json").read_text())) == 2
    for i in range(2):
        sinks.append_csv_row(str(tmp_path / "r.csv"), ["a", "b"], {"a": i, "b": "x,y"})
    assert (tmp_path / "r.csv").read_text().splitlines() == ["a,b", '0,"x,y"', '1,"x,y"']


def test_mmr(spark):
    rows = [("q", 1, 1.0, [1.0, 0.0]), ("q", 2, 0.9, [1.0, 0.0]), ("q", 3, 0.8, [0.0, 1.0])]
    pool = spark.createDataFrame(rows, "query string, doc int, score double, vec array<double>")
    order = lambda lam: [r["doc"] for r in retrieval.mmr(pool, 3, lam).orderBy("rank").collect()]
    assert order(1.0) == [1, 2, 3] and order(0.6) == [1, 3, 2]


def test_sections(spark):
    rows = [(i, "L", f"c{i}", t, "1 A", s, "", "", lab, "") for i, (t, s, lab) in enumerate([("See §2 and \\ref{sec:b}. The Serial Verb is productive in all clauses here.", "A", "sec:a"), ("Tense Marker. Tense Marker.", "B", "sec:b"), ("cf. 9.", "C", "sec:2")])]
    v = sections.chunk_view(spark.createDataFrame(rows, "ord bigint, lang string, chunk_id string, text string, chapter string, section string, subsection string, subsubsection string, label string, summary string"))
    s = sections.with_key_terms(sections.assemble(v))
    assert sorted((r["src"], r["dst"]) for r in sections.resolved_refs(s).collect()) == [("c0", "c1"), ("c0", "c2")]
    assert [r["term"] for r in sections.key_terms(s).collect()] == ["Tense Marker"]
    assert {(r["id"], r["hop"]) for r in sections.follow_refs(s, "serial verb").collect()} == {("c0", 0), ("c1", 1), ("c2", 1)}
    claims = sections.author_claims(sections.search_sections(s, "serial")).collect()
    assert any("[A / ] The Serial Verb is productive" in r["claim"] for r in claims)


def test_every_chunk_has_a_window(spark, tmp_path):
    from corpusloom.operators.queries import QUERIES

    names = "ord bigint, lang string, chunk_id string, text string, chapter string, section string, subsection string, subsubsection string, label string, summary string"
    # ids loaded twice, labels of all kinds and none
    rows = [(o, "ab"[o % 3 > 0], f"c{o % 17}", f"{o} " + "x" * 700, "", "", "", "", [None, "", "sec:1.1", "sec:2"][o % 4], "") for o in range(40)]
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "chunk.parquet"))
    got = sorted((r["tord"], r["lang"], r["target"], r["offset"], r["chunk_id"], r["text"]) for r in QUERIES["context_window_all"](spark, str(tmp_path)).collect())
    want = []
    for lang in "ab":
        own = [r for r in rows if r[1] == lang]
        want += [(t[0], lang, t[2], j - i, n[2], n[3][:600]) for i, t in enumerate(own) for j, n in enumerate(own) if abs(i - j) <= 2]
    assert got == sorted(want)


def test_annotate(spark):
    ab = spark.createDataFrame([(0, "PST", "past"), (1, "NEG", "negation"), (2, "AGR", "agreement")], "ord bigint, tag string, meaning string")
    df = spark.createDataFrame([("PST: 140, NEG (x), 3SG.AGR",), (None,), ("",)], "t string")
    assert [r["annotated"] for r in abbrev.annotate(df, "t", ab).collect()] == ["PST (past): 140, NEG (x), 3SG.AGR (agreement)", None, ""]
    assert abbrev.legend([("A", "b")] * 2) == "GLOSS ABBREVIATION LEGEND:\nA=b | A=b"


def test_packed_reading():
    vals = lambda t: [a[0] for a in read(t) if a[0]]
    assert vals('a-"so-called ""x"""-b; c') == ["a", 'so-called "x"', "b", "c"]
    assert vals("“so-called \"x\"”=y ño'so") == ['so-called "x"', "y", "ño'so"]
    assert vals('[["A", "1, 2"], [], ["B.C", null]]') == ["A", "1, 2", "B.C"]
    assert vals("'open x") == ["'open", "x"] and vals("  ") == [] and vals(" , ;") == []
    assert segment(None, SplitModel()) == []


def test_packed_values_of_many_words():
    from corpusloom.operators.packed import SplitModel, cells, expected, segment

    text = "one of the very old houses"
    assert segment(text, SplitModel(divides={" ": 0.02})) == [text]
    # seen often as a whole, its words never
    m = SplitModel(divides={" ": 0.6}, total=100.0)
    m.longest = 5
    m.counts[list(cells(text))] = 50
    assert segment(f"{text};x", m) == [text, "x"]
    runs = {}
    expected(text, m, {}, runs)
    assert "\0005" in runs


def test_packed_column(spark):
    rows = [(i, f"m{i % 40}-k{i % 7}; w{i % 11}={'PL'}") for i in range(300)] + [(300, None), (301, ""), (302, "x" * 50_000), (303, "y z " * 5000)]
    got = split_packed(spark.createDataFrame(rows, "k long, f string"), "k", ["f"]).groupBy("k").agg(F.count("*").alias("n"), F.max("pos").alias("p"))
    n = {r["k"]: (r["n"], r["p"]) for r in got.collect()}
    assert all(n[i] == (4, 3) for i in range(300)) and 300 not in n and 301 not in n and n[302] == (1, 0) and n[303] == (10000, 9999)
    assert split_packed(spark.createDataFrame([], "k long, f string"), "k", ["f"]).count() == 0


def test_models(spark):
    m = RuleModel([("CLAIMS", '{"claims": [{"text": "t", "type": "igt_pattern", "confidence": 0.9, "supports": true}]}'), ("PLAN", '{"igt_tags_to_check": ["PST"], "target_sections": ["A"]}')])
    assert ask(m, "query_plan", "PLAN")["target_sections"] == ["A"] and ask(RuleModel(otherwise="x"), "label", "q") == {"label": "?"}
    rows = spark.createDataFrame([("PLAN",), (None,)], "prompt string")
    assert [r["answer"] for r in answers(rows, lambda: m, "plan").collect()] == [m.rules[1][1], "{}"]
    igt = spark.createDataFrame([(0, "L", "e0", "", "", "", "he went", ["PST"], "", "A", "", "", "")], "ord bigint, lang string, example_id string, source string, morpheme string, gloss string, translation string, gloss_tags array<string>, chapter string, section string, subsection string, subsubsection string, source_section string")
    chunk = spark.createDataFrame([(0, "L", "c0", "Past is marked.", "", "A", "", "", "", "")], "ord bigint, lang string, chunk_id string, text string, chapter string, section string, subsection string, subsubsection string, label string, summary string")
    ab = spark.createDataFrame([(0, "PST", "past")], "ord bigint, tag string, meaning string")
    c = registry.Corpus(igt, chunk, ab)
    a = agent.answer(spark, c, m, "Is past marked?", iterations=2)
    assert a.value == "Yes" and a.confidence > 0.9 and len(a.claims) == 3
    assert registry.call(c, "read_full_section", query="c0").first()["text"] == "Past is marked."
    assert {r["part"] for r in registry.call(c, "get_igt_summary").collect()} == {"tag", "absent", "paradigm", "section"}
    with pytest.raises(KeyError):
        registry.call(c, "nothing")
