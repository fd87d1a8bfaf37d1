"""Command line: tools, questions and feature coding over one language's files.

    python -m corpusloom tool analyse_tag --igt igt.json --args '{"tag": "PST"}'
    python -m corpusloom ask --language L --grammar g.json --igt igt.json --abbreviations a.txt "How is past marked?"
    python -m corpusloom code --language L --igt igt.json --features coding.csv --ids F1 F2 --output out --resume
    python -m corpusloom survey --config languages.json --output out --skip-existing
    python -m corpusloom universals --config languages.json --universals u.csv --domain tense --output out
    python -m corpusloom baseline --languages languages.txt --features coding.csv --output out

Without --model-url a deterministic stand-in answers, so that everything but the model's words can be tried.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import functions as F

from corpusloom.operators import verdicts
from corpusloom.plans import agent, coding, survey, universals
from corpusloom.plans.model import HttpModel, LanguageModel, RuleModel
from corpusloom.plans.registry import TOOLS, Corpus, call
from corpusloom.schemas import UNIVERSAL
from corpusloom.session import local_session, ship
from corpusloom.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description="Corpus analytics on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    for name, note in (("tool", "run one tool"), ("ask", "answer questions"), ("code", "code features")):
        s = sub.add_parser(name, help=note)
        s.add_argument("--language", default="")
        s.add_argument("--grammar", help="JSON chunks or plain text")
        s.add_argument("--igt", help="JSON examples")
        s.add_argument("--abbreviations")
        s.add_argument("--igt-only", action="store_true")
        s.add_argument("--output")
        s.add_argument("--max-iterations", type=int, default=8)
        s.add_argument("--confidence-threshold", type=float, default=0.75)
        s.add_argument("--model-url")
        s.add_argument("--model-name", default="default")
        s.add_argument("--cpus", type=int, default=4)
        if name == "tool":
            s.add_argument("name", choices=sorted(TOOLS))
            s.add_argument("--args", type=json.loads, default={})
        elif name == "ask":
            s.add_argument("questions", nargs="+")
        else:
            s.add_argument("--features", required=True)
            s.add_argument("--ids", nargs="*")
            s.add_argument("--resume", action="store_true")
    for name, note in (("survey", "questions over many languages"), ("universals", "test universals over many languages"), ("baseline", "code features by the model alone")):
        s = sub.add_parser(name, help=note)
        s.add_argument("--output", default="output")
        s.add_argument("--max-iterations", type=int, default=10)
        s.add_argument("--confidence-threshold", type=float, default=0.75)
        s.add_argument("--model-url")
        s.add_argument("--model-name", default="default")
        s.add_argument("--cpus", type=int, default=4)
        if name == "baseline":
            s.add_argument("--languages", required=True, help="one language a line")
            s.add_argument("--features", required=True)
            continue
        s.add_argument("--config", required=True)
        s.add_argument("--skip-existing", action="store_true")
        s.add_argument("--report-only", action="store_true")
        if name == "survey":
            s.add_argument("--no-report", action="store_true")
            s.add_argument("--questions", nargs="*", default=[], help="asked where the configuration and the model have none")
        else:
            s.add_argument("--universals", required=True)
            s.add_argument("--ids", nargs="*")
            s.add_argument("--domain")
            s.add_argument("--all", action="store_true")
            s.add_argument("--statement", help="a universal of one's own")
            s.add_argument("--antecedent", default="")
            s.add_argument("--consequent", default="")
            s.add_argument("--logic", default="implication")
    return p


def _corpora(spark, config: dict) -> dict[str, Corpus]:
    """The corpus of each language of a configuration."""
    out = {}
    for e in config["languages"]:
        name = e["name"]
        igt = readers.igt_json(spark, e["igt"], name) if e.get("igt") else readers.empty(spark, "igt")
        chunk = readers.grammar(spark, e["grammar"], name) if e.get("grammar") and not e.get("igt_only") else readers.empty(spark, "chunk")
        ab = readers.abbreviations(spark, e["abbreviations"]) if e.get("abbreviations") else spark.createDataFrame([], "ord bigint, tag string, meaning string")
        out[name] = Corpus(igt, chunk, ab)
    return out


def _digest(corpus: Corpus) -> str:
    """What a plan sees of a corpus: its contents and its most frequent tags, cut."""
    toc = agent.shown(call(corpus, "get_toc_with_summaries", skip_subsections=True).select("section", "summary").filter("section <> ''"))
    return toc[:2000] + "\n" + agent.shown(call(corpus, "get_tag_inventory", top_n=20).select("tag", "cnt"))[:1000]


def _save(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def run_survey(spark, a, model) -> None:
    if a.report_only and a.no_report:
        raise SystemExit("--report-only and --no-report exclude each other")
    config = readers.config(a.config)
    names, path = [e["name"] for e in config["languages"]], os.path.join(a.output, "answers")
    corpora = {} if a.report_only else _corpora(spark, config)
    if a.report_only:
        results = spark.read.parquet(path)
    else:
        asked = [q for q in config.get("queries", []) if q]
        if asked:
            questions = spark.createDataFrame([("", i, q) for i, q in enumerate(asked)], "language string, ord int, question string")
        else:
            digests = "\n\n".join(f"{n}\n{_digest(c)}" for n, c in corpora.items())
            questions = survey.planned_questions(spark, model, digests, int(config.get("planning", {}).get("n_questions", 15)), a.questions)

        def one(question: str, language: str) -> tuple[str, str, float]:
            r = agent.answer(spark, corpora[language], model, question, iterations=a.max_iterations, threshold=a.confidence_threshold)
            return r.value, r.text, r.confidence

        results = survey.investigate(spark, questions, names, one, path, a.skip_existing)
    if a.report_only or not a.no_report:
        placed = survey.types(results, lambda: model)
        order = results.select("question", "language", "ord")
        groups = verdicts.value_groups(placed.join(order, ["question", "language"]).select("question", "ord", "language", F.col("type_label").alias("value"), F.lit("").alias("answer")))
        _save(os.path.join(a.output, "report.md"), sinks.types_report(groups))
        sinks.write_pretty_json(groups, os.path.join(a.output, "report.json"))


def run_universals(spark, a, model) -> None:
    path = os.path.join(a.output, "language_verdicts")
    own = None
    if a.statement:
        own = spark.createDataFrame([("OWN", a.statement, a.antecedent, a.consequent, a.logic, "", "")], UNIVERSAL)
    chosen = verdicts.select_universals(readers.universals(spark, a.universals), readers.universals_defaults(own) if own is not None else None, a.ids, a.domain, a.all)
    found = spark.read.parquet(path) if os.path.isdir(path) and (a.skip_existing or a.report_only) else None
    if not a.report_only:
        todo = readers.pending(chosen, found.select(F.col("uid").alias("id")).distinct() if found is not None else None, ["id"])
        corpora = _corpora(spark, readers.config(a.config))
        langs = spark.createDataFrame([(n, _digest(c)) for n, c in corpora.items()], "language string, digest string")
        asked = universals.questions(universals.plan(todo, langs, lambda: model))
        rows = []
        for r in asked.orderBy("id", "language").toLocalIterator():
            got = agent.answer(spark, corpora[r["language"]], model, r["prompt"], iterations=a.max_iterations, threshold=a.confidence_threshold)
            rows.append((r["id"], r["language"], got.text, got.confidence))
        said = spark.createDataFrame(rows, "id string, language string, answer string, confidence double")
        new = universals.extract(asked.drop("prompt").join(said, ["id", "language"]), lambda: model)
        new.write.mode("append" if found is not None else "overwrite").parquet(path)
        found = spark.read.parquet(path)
    if found is None:
        raise SystemExit("nothing to report yet")
    labels, totals = universals.synthesise(chosen, found, lambda: model)
    _save(os.path.join(a.output, "universals.md"), sinks.verdict_report(totals, labels))
    sinks.write_pretty_json(totals, os.path.join(a.output, "universals.json"))


def run_baseline(spark, a, model) -> None:
    coded = coding.zero_resource(readers.coding_features(spark, a.features), readers.language_list(spark, a.languages), lambda: model)
    sinks.write_csv(coded.orderBy("language", "gb_id"), os.path.join(a.output, "baseline.csv"))


def main(argv: list[str] | None = None, model: LanguageModel | None = None) -> int:
    a = parser().parse_args(argv)
    many = {"survey": run_survey, "universals": run_universals, "baseline": run_baseline}
    if a.command in many:
        spark = local_session(a.cpus)
        ship(spark)
        many[a.command](spark, a, model or (HttpModel(a.model_url, a.model_name, os.environ.get("MODEL_KEY", "")) if a.model_url else RuleModel()))
        return 0
    if not a.igt and (a.igt_only or not a.grammar):
        raise SystemExit("give --grammar or --igt; --igt-only needs --igt")
    spark = local_session(a.cpus)
    ship(spark)
    igt = readers.igt_json(spark, a.igt, a.language) if a.igt else readers.empty(spark, "igt")
    chunk = readers.grammar(spark, a.grammar, a.language) if a.grammar and not a.igt_only else readers.empty(spark, "chunk")
    ab = readers.abbreviations(spark, a.abbreviations) if a.abbreviations else spark.createDataFrame([], "ord bigint, tag string, meaning string")
    corpus = Corpus(igt, chunk, ab)
    model = model or (HttpModel(a.model_url, a.model_name, os.environ.get("MODEL_KEY", "")) if a.model_url else RuleModel())
    kw = {"iterations": a.max_iterations, "threshold": a.confidence_threshold}
    if a.command == "tool":
        print(agent.shown(call(corpus, a.name, **a.args)))
        return 0
    if a.command == "ask":
        out = []
        for q in a.questions:
            r = agent.answer(spark, corpus, model, q, **kw)
            out.append({"language": a.language, "question": q, "value": r.value, "confidence": r.confidence, "answer": r.text, "steps": r.steps, "calls": r.usage.calls})
        print(json.dumps(out, ensure_ascii=False, indent=2))
        if a.output:
            os.makedirs(a.output, exist_ok=True)
            with open(os.path.join(a.output, "answers.json"), "w", encoding="utf-8") as f:
                json.dump(out, f, ensure_ascii=False, indent=2)
        return 0
    path = os.path.join(a.output or "output", "coding")
    done = spark.read.parquet(path) if a.resume and os.path.isdir(path) else None
    r = coding.code_features(spark, corpus, model, readers.coding_features(spark, a.features), a.language, a.ids, done, **kw)
    sinks.append_results(r, path, ["language"])
    sinks.write_csv(sinks.coding_rows(r), os.path.join(a.output or "output", "summary.csv"))
    print(agent.shown(r))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
