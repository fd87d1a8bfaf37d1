"""Evidence, verdicts, labels and repaired JSON on hand-made cases."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.functions.jsonrepair import parse_object
from corpusloom.operators import evidence, verdicts
from corpusloom.schemas import CLAIM


def claims(spark, *cs):
    return spark.createDataFrame([("g", i, t, f"text {i}", "s", c, s, [f"ex:{i % 2}", "chunk_1"]) for i, (s, c, t) in enumerate(cs)], CLAIM)


def test_confidence(spark):
    r = evidence.confidence(claims(spark, (True, 0.9, "grammar_statement"))).first()
    assert r["verdict"] == "Yes" and r["confidence"] == pytest.approx(0.933, abs=1e-3)
    r = evidence.confidence(claims(spark, (True, 0.9, "grammar_statement"), (False, 0.8, "igt_pattern"))).first()
    assert (r["verdict"], r["confidence"], r["n_contradictions"]) == ("Partial", 0.6, 1)
    r = evidence.confidence(claims(spark, (False, 0.9, "absence_evidence"))).first()
    assert r["verdict"] == "No" and r["confidence"] == pytest.approx(0.918, abs=1e-3)
    r = evidence.confidence(claims(spark, (None, 0.9, "inference"), (None, 0.1, "x"))).first()
    assert (r["verdict"], r["confidence"]) == ("Unclear", 0.0)


def test_symmetry(spark):
    cs = [(True, 0.9, "igt_pattern"), (True, 0.55, "inference"), (False, 0.5, "author_caveat")]
    a = evidence.confidence(claims(spark, *cs)).first()
    b = evidence.confidence(claims(spark, *[(not s, c, t) for s, c, t in cs])).first()
    assert (a["ns"], a["nc"]) == (b["nc"], b["ns"])


def test_contradictions(spark):
    c = claims(spark, (True, 0.9, "a"), (False, 0.6, "a"), (False, 0.59, "a"), (None, 0.9, "a"))
    assert [(r["seq_a"], r["seq_b"]) for r in evidence.contradictions(c).collect()] == [(0, 1)]
    assert [r["supports"] for r in evidence.resolve_by_strength(c).orderBy("seq").collect()] == [True, None, False, None]
    notes = {r["example_id"]: r["seq"] for r in evidence.example_notes(c).collect()}
    assert notes == {"ex:0": 0, "ex:1": 3}
    assert [r["example_id"] for r in evidence.example_ids(c).orderBy("rank").collect()] == ["ex:0", "ex:1"]
    assert evidence.gaps(c).first()["coverage"] == "none"


def test_violates(spark):
    three = [True, False, None]
    rows = list(itertools.product(["absolute", "implication", "correlation"], three, three))
    df = spark.createDataFrame(rows, "logic string, a boolean, c boolean").select("*", verdicts.violates(F.col("logic"), F.col("a"), F.col("c")).alias("v"))
    for r in df.collect():
        assert r["v"] == (r["c"] is False if r["logic"] == "absolute" else r["a"] is True and r["c"] is False)


def test_labels(spark):
    got = [r[0] for r in spark.createDataFrame([("1",), (" 1 ",), ("Code 2",), ("yes",), ("",), (None,)], "a string").select(verdicts.normal_label(F.col("a"))).collect()]
    assert got == ["1", "1", "2", "?", "?", "?"]


def test_language_labels(spark):
    schema = "uid string, logic string, language string, antecedent_holds boolean, consequent_holds boolean, violates boolean, confidence double, raw_answer string, assessment string"
    rows = [
        ("u", "implication", "a", True, False, True, 0.9, "x", None), ("u", "implication", "b", True, False, True, 0.9, "The antecedent does not hold", None),
        ("u", "implication", "c", True, True, False, 0.5, "x", None), ("u", "implication", "d", False, None, False, 0.9, "x", None),
        ("u", "implication", "e", True, True, False, 0.9, "x", None), ("u", "implication", "f", None, None, False, 0.9, None, "irrelevant"), ("u", "implication", "g", None, None, False, None, None, "odd"),
    ]
    lab = verdicts.language_labels(spark.createDataFrame(rows, schema))
    assert [r["label"] for r in lab.orderBy("language").collect()] == ["VALID_VIOLATION", "ANTECEDENT_NA", "INSUFFICIENT", "ANTECEDENT_NA", "VALID_SUPPORT", "IRRELEVANT", "INSUFFICIENT"]
    assert verdicts.universal_verdicts(lab).first()["verdict"] == "FALSE"
    model = spark.createDataFrame([("u", "true")], "uid string, verdict string")
    assert verdicts.universal_verdicts(lab, model).first()["verdict"] == "TRUE"


def test_questions(spark):
    qs = ["Does the language have a definite article suffix?", "Does it use a definite article suffix or clitic?", "Is there a dual?", None]
    df = spark.createDataFrame([("L", i, q) for i, q in enumerate(qs)], "language string, ord int, question string")
    assert sorted(r["ord"] for r in verdicts.distinct_questions(df).collect()) == [0, 2, 3]


@pytest.mark.parametrize(
    "given, want",
    [('{"a":1', {}), ('{"a":["x"', {}), ('```json\n{"a": 1}\n```', {"a": 1}), ('Sure: {"a": {"b": 2}} done', {"a": {"b": 2}}), ("none", {}), ('{"a":[{"b":1},{"c":2', {"a": [{"b": 1}]}), (None, {})],
)
def test_json(given, want):
    assert parse_object(given) == want
    json.dumps(parse_object(given, "truncate")), json.dumps(parse_object(given, "strict"))


def test_text_rules(spark):
    df = spark.createDataFrame([("No", "the suffix is attested and found", 0), ("No", "absent; not found", 0), ("Yes", "found", 0)], "v string, t string, n int")
    v, review = text.consistent_value(F.col("v"), F.col("t"), F.col("n"))
    assert [tuple(r) for r in df.select(v, review).collect()] == [("Partial", True), ("No", False), ("Yes", False)]
    one = spark.range(1)
    assert one.select(text.query_id(F.lit("abc"))).first()[0] == "Q900150"
    assert one.select(text.without_claim_ids(F.lit("As shown (claim_id=C012) here"))).first()[0] == "As shown here"
    assert one.select(text.claim_type(F.lit("grammar/IGT_PATTERN|x"))).first()[0] == "igt_pattern"


def test_summary(spark):
    cs = claims(spark, *[(True, 0.9, "igt_pattern")] * 5, (None, 0.5, "inference"))
    r = evidence.summary(cs, shown=3).first()
    assert (r["n"], r["neutral"], r["verdict"]) == (6, 1, "Yes")
    assert [c["claim_id"] for c in json.loads(r["claims"])] == ["C001", "C002", "C003"]


def test_every_claim_is_listed(spark):
    rows = [(g, i * 700, "inference", f"{i} " + "x" * 300, "s", 0.1234, None if i % 2 else False, ["ex:1"]) for g, n in (("g", 450), ("h", 1)) for i in range(n)]
    got = evidence.listed(spark.createDataFrame(rows, CLAIM).repartition(5)).orderBy("graph_id", "seq").collect()
    assert [(r["graph_id"], r["claim_id"]) for r in got] == [("g", f"C{i + 1:03d}") for i in range(450)] + [("h", "C001")]
    want = [{"id": f"C{i + 1:03d}", "type": r[2], "text": r[3], "source": "s", "confidence": 0.123, "supports": r[6], "igt_examples": ["ex:1"]} for i, r in enumerate(rows[:450])]
    assert [json.loads(r["claim"]) for r in got[:450]] == want


def test_summary_query_gives_every_claim(spark, tmp_path):
    from corpusloom.operators.queries import QUERIES

    e = spark.range(450).selectExpr("id AS event_id", "1L AS user_id", "'click' AS event_type", "0.5D AS value", "repeat('x', 300) AS props")
    e.write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["evidence_summary"](spark, str(tmp_path)).collect()
    assert len(got) == 450 and {(r["n"], r["ns"], r["nc"], r["neutral"]) for r in got} == {(450, 150, 150, 150)}
    assert {len(json.loads(r["claim"])["text"]) for r in got} == {300}


def test_select_universals(spark):
    u = spark.createDataFrame([("U1", "CASE"), ("U2", "TENSE")], "id string, domain string")
    ids = lambda **kw: sorted(r["id"] for r in verdicts.select_universals(u, **kw).collect())
    assert ids(ids=["U2", "U9"]) == ["U2"] and ids(domain="case") == ["U1"] and ids(every=True) == ["U1", "U2"]
    with pytest.raises(ValueError):
        verdicts.select_universals(u)
