"""The driver loops: a question over one corpus, over many languages, and hypotheses over languages.

The driver decides which tool runs next and keeps the claims of a question, a few dozen rows; all corpus work is in
the tools' DataFrames. Only bounded results (the tools' top-k) reach the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions.abbrev import for_phenomenon
from corpusloom.operators import evidence, verdicts
from corpusloom.operators.constants import CONTRADICTION_FROM
from corpusloom.operators.tools import plan_tags
from corpusloom.plans.model import BUDGETS, LanguageModel, Usage, ask
from corpusloom.plans.registry import TOOLS, Corpus, call
from corpusloom.schemas import CLAIM

#: Rows of a tool's result that a prompt shows, characters of it, and claims and sections before a conclusion.
ROWS, CHARS, MIN_CLAIMS = 20, 2500, 3


@dataclass
class Answer:
    question: str
    value: str
    confidence: float
    text: str
    claims: list[dict] = field(default_factory=list)
    steps: list[str] = field(default_factory=list)
    usage: Usage = field(default_factory=Usage)
    #: key_evidence (a list), linguistic_definition, structural_description.
    details: dict = field(default_factory=dict)


def shown(df: DataFrame) -> str:
    return "\n".join(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str) for r in df.limit(ROWS).collect())[:CHARS]


def _claims(model: LanguageModel, question: str, step: str, text: str, graph: list[dict], usage: Usage) -> None:
    got = ask(model, "claims", f"CLAIMS\nQuestion: {question}\nSource: {step}\n{text}", usage).get("claims", [])
    for c in got if isinstance(got, list) else []:
        if isinstance(c, dict) and c.get("text"):
            graph.append(
                {
                    "graph_id": question, "seq": len(graph), "claim_type": str(c.get("type", "inference")), "text": str(c["text"]), "source": step,
                    "confidence": float(c.get("confidence", 0.5) or 0.0), "supports": c.get("supports") if isinstance(c.get("supports"), bool) else None, "igt_examples": [],
                }
            )


def judged(spark: SparkSession, graph: list[dict]) -> tuple[str, float]:
    """Verdict and confidence of a question's claims."""
    if not graph:
        return "Unclear", 0.0
    df = spark.createDataFrame([tuple(c[k] for k in ("graph_id", "seq", "claim_type", "text", "source", "confidence", "supports", "igt_examples")) for c in graph], CLAIM)
    r = evidence.confidence(df).first()
    return r["verdict"], r["confidence"]


DETAILS = ("key_evidence", "linguistic_definition", "structural_description")


def concluded(model: LanguageModel, question: str, graph: list[dict], usage: Usage) -> dict:
    """The answer with its details. Without an answer the model is asked again for prose; details that are missing then
    are asked for by themselves, once."""
    told = "\n".join(f"- [{c['claim_type']}] {c['confidence']:.2f} | {c['text']} ({c['source']})" for c in graph)[:3000]
    said = ask(model, "answer", f"ANSWER\nQuestion: {question}\n{told}", usage)
    text = str(said.get("answer") or "").strip()
    if not text:
        prompt = f"PROSE\nQuestion: {question}\n{told}"
        try:
            text = model.generate(prompt, BUDGETS["prose"], False).strip()
        except Exception:  # noqa: BLE001 - as in ask
            text = ""
        usage.add(prompt, text)
    got = {k: said.get(k) or ([] if k == "key_evidence" else "") for k in DETAILS}
    missing = [k for k in DETAILS if not got[k]]
    if missing:
        found = ask(model, "rescue", f"RESCUE\nQuestion: {question}\n{text[:800]}\n{told}", usage)
        got |= {k: found[k] for k in missing if found.get(k)}
    return {"answer": text, **got}


def resolved(spark: SparkSession, model: LanguageModel, graph: list[dict], usage: Usage) -> None:
    """Puts the contradictions of a question's claims to the model; confidences that it revises are changed in place."""
    sides = [(c["supports"], c["confidence"] >= CONTRADICTION_FROM) for c in graph]
    for i, a in enumerate(graph):
        for j in range(i + 1, len(graph)):
            b = graph[j]
            if all(x[1] and x[0] is not None for x in (sides[i], sides[j])) and sides[i][0] != sides[j][0]:
                got = ask(model, "contradiction", f"CONTRADICTION\n{a['graph_id']}\n{a['source']}\n{a['text']}\n{b['source']}\n{b['text']}", usage)
                if got.get("resolved"):
                    for c, k in ((a, "revised_confidence_a"), (b, "revised_confidence_b")):
                        if isinstance(got.get(k), (int, float)):
                            c["confidence"] = float(got[k])


def answer(spark: SparkSession, corpus: Corpus, model: LanguageModel, question: str, iterations: int = 8, threshold: float = 0.75) -> Answer:
    """Plan, upfront reads, then tools chosen by the model until it concludes, the evidence suffices or the iterations end."""
    usage, graph, steps = Usage(), [], []

    def step(name: str, args: dict) -> None:
        label = f"{name}({json.dumps(args, ensure_ascii=False, sort_keys=True)})"
        if name not in TOOLS or label in steps:
            return
        steps.append(label)
        try:
            text = shown(call(corpus, name, **args))
        except (TypeError, KeyError, ValueError) as e:
            text = f"error: {e}"
        _claims(model, question, label, text, graph, usage)

    plan = ask(model, "query_plan", f"PLAN\nQuestion: {question}\nTools: {', '.join(sorted(TOOLS))}", usage)
    for s in plan.get("target_sections", [])[:3]:
        step("read_full_section", {"query": s})
    known = [r["tag"] for r in for_phenomenon(corpus.abbrev, question).collect()]
    for t in plan_tags(plan.get("igt_tags_to_check", []), known)[:5]:
        step("analyse_tag", {"tag": t})
    for c in plan.get("constructions", [])[:3]:
        step("analyse_construction", {"tags": c})
    for a, b in plan.get("tag_pairs", [])[:2]:
        step("compare_tags", {"tag_a": a, "tag_b": b})
    if plan.get("absence_category"):
        step("analyse_absence", {"category": plan["absence_category"]})
    for _ in range(iterations):
        verdict, conf = judged(spark, graph)
        if len(graph) >= MIN_CLAIMS and conf >= threshold and verdict in ("Yes", "No"):
            break
        act = ask(model, "action", f"ACTION\nQuestion: {question}\nClaims: {len(graph)}\nSteps: {steps}", usage)
        if act.get("action") == "conclude" or act.get("action") not in TOOLS:
            if len(graph) >= MIN_CLAIMS or "search_text" in "".join(steps):
                break
            act = {"action": "search_text", "args": {"query": question}}
        step(act["action"], act.get("args") or {})
    resolved(spark, model, graph, usage)
    verdict, conf = judged(spark, graph)
    said = concluded(model, question, graph, usage)
    audit = ask(model, "audit", f"AUDIT\n{question}\n{said.get('answer', '')}", usage)
    return Answer(question, str(audit.get("revised_value") or verdict), float(audit.get("revised_confidence") or conf), said["answer"], graph, steps, usage, {k: said[k] for k in DETAILS})


def over_languages(spark: SparkSession, corpus: Corpus, model: LanguageModel, questions: list[str], languages: list[str], done: set[tuple[str, str]] = frozenset(), **kw) -> DataFrame:
    """question, ord, language, value, answer, confidence for each pair that has no result yet."""
    rows = []
    for q in questions:
        for i, lang in enumerate(languages):
            if (q, lang) not in done:
                a = answer(spark, corpus.for_language(lang), model, q, **kw)
                rows.append((q, i, lang, a.value, a.text, a.confidence))
    return spark.createDataFrame(rows, "question string, ord int, language string, value string, answer string, confidence double")


def universal_results(results: DataFrame, universals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, verdicts) of language results: uid, language, antecedent, consequent (texts), confidence, raw_answer,
    assessment; universals: id, logic."""
    from pyspark.sql import functions as F

    u = universals.select(F.col("id").alias("uid"), "logic")
    v = results.join(F.broadcast(u), "uid").withColumn("antecedent_holds", verdicts.tribool("antecedent")).withColumn("consequent_holds", verdicts.tribool("consequent"))
    v = v.withColumn("violates", verdicts.violates(F.col("logic"), F.col("antecedent_holds"), F.col("consequent_holds")))
    labels = verdicts.language_labels(v)
    return labels, verdicts.universal_verdicts(labels)
