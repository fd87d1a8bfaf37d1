"""Steps of the driver loops with a deterministic model: discovery, plans, conclusions, contradictions."""

from corpusloom.operators import evidence
from corpusloom.plans import agent, model, survey
from corpusloom.plans.model import RuleModel, Usage
from corpusloom.plans.registry import Corpus, call
from corpusloom.sources import readers

IGT = "lang string, ord long, example_id string, source string, morpheme string, gloss string, translation string, gloss_tags array<string>, chapter string, section string, subsection string, subsubsection string, source_section string, tones string, label string"


def corpus(spark):
    rows = [("L", i, f"e{i}", "ka-ti", "ka-ti", "go-PST" if i % 2 else "go-NEG", "the river rose" if i % 2 else "a stone", ["PST"] if i % 2 else ["NEG", None, ""], "", "Tense", "", "", "", "", "") for i in range(12)]
    return Corpus(spark.createDataFrame(rows, IGT), readers.empty(spark, "chunk"), spark.createDataFrame([(0, "PST", "past")], "ord bigint, tag string, meaning string"))


def test_discovery(spark):
    c = corpus(spark)
    m = RuleModel([
        ("DOMAINS", '{"domains": [{"name": "Tense", "tags": ["PST"], "sections": "no list"}, "Case", {"description": "no name"}, 7]}'),
        ("TAGS\nIs past", '{"tags": ["pst", "XYZ", "pst"]}'),
        ("FEATURE PLAN\nTense", '{"questions": ["Is past marked?", {"question": "Is future marked?"}, {}]}'),
    ], "none")
    got = survey.discovered_domains(m, "contents")
    assert [d["name"] for d in got] == ["Tense", "Case", "7"] and got[0]["tags"] == ["PST"] and got[0]["sections"] == []
    assert survey.feature_plan(m, got[0]) == ["Is past marked?", "Is future marked?"]
    assert survey.feature_plan(m, got[1]) == ["Does the language mark case?"]
    assert survey.inferred_tags(c, m, "Is past marked?") == ["PST"]
    assert survey.discovered_domains(RuleModel(), "x") == [] and isinstance(survey.inferred_tags(c, m, "the river"), list)
    qs = survey.planned_questions(spark, RuleModel(), "d", 5, ["Is past tense marked?", "Is past tense marked at all?", "Are there tones?"])
    assert [r["question"] for r in qs.collect()][-1] == "Are there tones?"


def test_conclusion_is_rescued():
    usage = Usage()
    m = RuleModel([("PROSE", " It is a suffix. "), ("RESCUE", '{"key_evidence": ["e1"], "linguistic_definition": "past"}')], "")
    got = agent.concluded(m, "q", [{"claim_type": "igt_pattern", "confidence": 0.9, "text": "t", "source": "s"}], usage)
    assert got == {"answer": "It is a suffix.", "key_evidence": ["e1"], "linguistic_definition": "past", "structural_description": ""} and usage.calls == 3


def test_contradictions_are_put_to_the_model(spark):
    claims = [("g", i, "igt_pattern", f"t{i}", f"s{i}", c, s, []) for i, (c, s) in enumerate([(0.9, True), (0.7, False), (0.8, False), (0.5, False), (0.9, None)])]
    df = spark.createDataFrame(claims, "graph_id string, seq long, claim_type string, text string, source string, confidence double, supports boolean, igt_examples array<string>")
    rules = [("s0\nt0\ns1", '{"resolved": true, "resolution": "older", "revised_confidence_a": 0.95, "revised_confidence_b": 0.2}'), ("s0\nt0\ns2", '{"resolved": true, "revised_confidence_a": "high"}')]
    res = model.resolve_contradictions(df, lambda: RuleModel(rules))
    assert res.count() == 2
    got = {r["seq"]: r["confidence"] for r in evidence.revised(df, res).collect()}
    assert got == {0: 0.95, 1: 0.2, 2: 0.8, 3: 0.5, 4: 0.9}
    graph = [{"graph_id": "g", "text": c[3], "source": c[4], "confidence": c[5], "supports": c[6]} for c in claims]
    agent.resolved(spark, RuleModel(rules), graph, Usage())
    assert [c["confidence"] for c in graph] == [0.95, 0.2, 0.8, 0.5, 0.9]


def test_tag_tool(spark):
    c = corpus(spark)
    r = call(c, "analyse_tag", tag="pst", preferred_sections=["tense"]).first()
    assert r["cnt"] == 6 and [tuple(x) for x in r["places"]] == [(1, "Tense", 6)] and len(r["examples"]) == 6 and [x["form"] for x in r["forms"]] == ["ti"]
    assert call(c, "compare_tags", tag_a="PST", tag_b="NEG", preferred_sections=["x"]).first()["cooc"] == 0
    assert call(c, "analyse_absence", category="TENSE", preferred_sections=["nowhere"]).first()["hits_preferred"] == 0
