"""The command line and feature coding, with a deterministic model."""

import json

from corpusloom.__main__ import main
from corpusloom.plans import coding
from corpusloom.plans.model import RuleModel

MODEL = RuleModel([
    ("LABEL", '{"label": "code 1", "reasoning": "seen"}'),
    ("PLAN", '{"igt_tags_to_check": ["PST"], "constructions": [["PST"]], "absence_category": "TENSE"}'),
    ("CLAIMS", '{"claims": [{"text": "t", "type": "igt_pattern", "confidence": 0.9, "supports": true}]}'),
    ("ANSWER", '{"answer": "Yes, by a suffix."}'),
])


def files(tmp_path):
    igt = tmp_path / "igt.json"
    igt.write_text(json.dumps([{"source": "a", "gloss": "go-PST", "morpheme": "a-b", "translation": "he went", "gloss_tags": ["PST"], "section": "Tense"}] * 3))
    ab = tmp_path / "ab.txt"
    ab.write_text("PST\tpast\n")
    f = tmp_path / "f.csv"
    f.write_text("ID,Query,Coding,Definition,Grambank_ID_desc\nF1,Is past marked?,0 or 1,,\nF2,Is there a dual?,0 or 1,,\n")
    return str(igt), str(ab), str(f)


def test_tool_and_ask(spark, tmp_path, capsys):
    igt, ab, _ = files(tmp_path)
    assert main(["tool", "analyse_tag", "--igt", igt, "--args", '{"tag": "pst"}']) == 0
    assert '"cnt": 3' in capsys.readouterr().out
    assert main(["ask", "--language", "L", "--igt", igt, "--abbreviations", ab, "--output", str(tmp_path / "o"), "Is past marked?"], MODEL) == 0
    got = json.loads((tmp_path / "o" / "answers.json").read_text())[0]
    assert got["value"] == "Yes" and got["answer"] == "Yes, by a suffix." and len(got["steps"]) == 3


def test_code_and_resume(spark, tmp_path):
    igt, ab, f = files(tmp_path)
    base = ["code", "--language", "L", "--igt", igt, "--features", f, "--output", str(tmp_path / "c")]
    main([*base, "--ids", "F1"], MODEL)
    main([*base, "--resume"], MODEL)
    r = spark.read.parquet(str(tmp_path / "c" / "coding")).orderBy("feature_id").collect()
    assert [(x["feature_id"], x["label"], x["verdict"]) for x in r] == [("F1", "1", "upheld"), ("F2", "1", "upheld")]


def test_baseline(spark):
    f = spark.createDataFrame([("F1", "q", "c"), ("F2", "q2", "c")], "ID string, Query string, Coding string")
    langs = spark.createDataFrame([(0, "A"), (1, "B")], "ord int, language string")
    got = coding.zero_resource(f, langs, lambda: RuleModel([("A\nq\n", "1"), ("B", "code 7")], "?")).orderBy("language", "gb_id").collect()
    assert [x["baseline_code"] for x in got] == ["1", "?", "?", "?"]


MANY = RuleModel([
    ("GLOBAL PLAN", '{"questions": ["Is past marked?", {"question": "Is there a dual number?"}]}'),
    ("UNIVERSAL PLAN", '{"A": {"search_focus": "endings"}}'),
    ("UNIVERSAL EXTRACT\nA", '{"antecedent_holds": true, "consequent_holds": false, "confidence": 0.9, "antecedent_evidence": "ex. 1", "notes": "clear"}'),
    ("UNIVERSAL EXTRACT\nB", '{"antecedent_holds": true, "consequent_holds": true, "confidence": 0.9}'),
    ("UNIVERSAL SYNTHESIS", '{"language_assessments": {"B": {"assessment": "IRRELEVANT", "reason": "off topic"}}}'),
    ("SYNTHESIS\nIs past marked?", '{"types": [{"label": "suffix", "languages": ["A"]}]}'),
    *MODEL.rules,
])


def test_survey_universals_and_baseline(spark, tmp_path):
    igt, ab, f = files(tmp_path)
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"languages": [{"name": n, "igt": igt, "igt_only": True} for n in "AB"], "planning": {"n_questions": 2}}))
    out = str(tmp_path / "s")
    main(["survey", "--config", str(config), "--output", out, "--max-iterations", "1"], MANY)
    got = {(r["question"], r["value"]): r["languages"] for r in json.loads((tmp_path / "s" / "report.json").read_text())}
    assert got[("Is past marked?", "suffix")] == "A" and got[("Is past marked?", "Unclear")] == "B" and got[("Is there a dual number?", "Yes")] == "A, B"
    main(["survey", "--config", str(config), "--output", out, "--report-only"], MANY)
    main(["survey", "--config", str(config), "--output", out, "--skip-existing", "--no-report"], RuleModel([("GLOBAL PLAN", MANY.rules[0][1])]))
    assert spark.read.parquet(out + "/answers").count() == 4
    u = tmp_path / "u.csv"
    u.write_text('id,statement,antecedent,consequent,logic,domain,source\nU1,"If past, then so",past,so,,Tense,s\nU2,x,y,z,absolute,Case,s\n')
    main(["universals", "--config", str(config), "--universals", str(u), "--domain", "tense", "--output", out, "--max-iterations", "1"], MANY)
    report = (tmp_path / "s" / "universals.md").read_text()
    assert "| U1 | FALSE | 0 | 1 | 0 |" in report and "- VALID_VIOLATION: A\n  - antecedent holds: ex. 1" in report and "reason: off topic" in report
    langs = tmp_path / "l.txt"
    langs.write_text("A\n# no\nB\n")
    main(["baseline", "--languages", str(langs), "--features", f, "--output", out], RuleModel([("A\nIs past", "1")], "9"))
    rows = spark.read.csv(out + "/baseline.csv", header=True).collect()
    assert sorted((r["language"], r["gb_id"], r["baseline_code"]) for r in rows) == [("A", "F1", "1"), ("A", "F2", "?"), ("B", "F1", "?"), ("B", "F2", "?")]
