"""Questions over many languages: a plan of questions, answers per language with resuming, types of languages per
question; and the discovery of what a language's corpus can be asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.jsonrepair import repaired
from corpusloom.operators import tools, verdicts
from corpusloom.plans.model import LanguageModel, Usage, answers, ask
from corpusloom.plans.registry import Corpus
from corpusloom.sources import readers, sinks

#: Characters of an answer in a synthesis prompt.
SHOWN = 600


def planned_questions(spark: SparkSession, model: LanguageModel, digests: str, most: int, otherwise: list[str]) -> DataFrame:
    """language (empty: all of them), ord, question: the model's questions, near repetitions left out, at most so many;
    without any, those given."""
    got = ask(model, "global_plan", f"GLOBAL PLAN\nQuestions: {most}\n{digests}").get("questions", [])
    texts = [q.get("question", "") if isinstance(q, dict) else str(q) for q in got if q] if isinstance(got, list) else []
    rows = [("", i, q) for i, q in enumerate([t for t in texts if t] or otherwise)]
    q = verdicts.distinct_questions(spark.createDataFrame(rows, "language string, ord int, question string"))
    return q.orderBy("ord").limit(most)


def investigate(spark: SparkSession, asked: DataFrame, languages: list[str], answer_one: Callable[[str, str], tuple[str, str, float]], path: str | None = None, skip_existing: bool = False) -> DataFrame:
    """question, ord, language, value, answer, confidence. answer_one(question, language) runs an agent. With a path
    finished answers are stored one by one, and a run that skips existing ones asks only for the rest."""
    names = spark.createDataFrame(list(enumerate(languages)), "ord int, language string")
    work = asked.select("question").crossJoin(F.broadcast(names))
    done = _stored(spark, path) if path else None
    todo = readers.pending(work, done if skip_existing else None, ["question", "language"])
    schema = "question string, ord int, language string, value string, answer string, confidence double"
    rows = []
    for r in todo.orderBy("question", "ord").toLocalIterator():
        value, text, confidence = answer_one(r["question"], r["language"])
        rows.append((r["question"], r["ord"], r["language"], value, text, confidence))
        if path:
            sinks.append_results(spark.createDataFrame(rows[-1:], schema), path, ["language"])
    new = spark.createDataFrame(rows, schema)
    return new.unionByName(done.select(new.columns)) if done is not None and skip_existing else new


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def types(results: DataFrame, factory: Callable[[], LanguageModel]) -> DataFrame:
    """question, type_label, language: the model sorts the languages of a question into types; a language that it leaves
    out is Unclear. Where it gives no types, languages go by their values."""
    line = F.concat_ws(": ", "language", F.coalesce("value", F.lit("Unclear")), F.substring(F.coalesce("answer", F.lit("")), 1, SHOWN))
    per = results.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    said = answers(per.withColumn("prompt", F.concat_ws("\n", F.lit("SYNTHESIS"), "question", "lines")).select("question", "prompt"), factory, "synthesis")
    got = F.from_json(F.get_json_object(repaired(F.col("answer"), "strict"), "$.types"), "array<struct<label: string, languages: array<string>>>")
    sorted_ = said.select("question", F.explode_outer(got).alias("t")).select("question", F.col("t.label").alias("type_label"), F.explode("t.languages").alias("language"))
    asked = results.select("question", "language").distinct()
    placed = sorted_.filter("type_label <> ''").join(asked, ["question", "language"], "left_semi").groupBy("question", "language").agg(F.min("type_label").alias("type_label"))
    some = placed.select("question").distinct()
    by_value = results.join(some, "question", "left_anti").select("question", F.coalesce("value", F.substring(F.coalesce("answer", F.lit("Unclear")), 1, 30)).alias("type_label"), "language")
    return verdicts.with_unplaced(placed.unionByName(by_value), asked)


def discovered_domains(model: LanguageModel, digest: str, usage: Usage | None = None) -> list[dict]:
    """Domains that a corpus can be asked about: name, description, sections, tags; items without a name are dropped."""
    got = ask(model, "domains", f"DOMAINS\n{digest}", usage).get("domains", [])
    out = []
    for g in got if isinstance(got, list) else []:
        name = str(g.get("name") or g.get("domain") or "") if isinstance(g, dict) else str(g)
        if name:
            lists = {k: [str(x) for x in g.get(k, [])] if isinstance(g, dict) and isinstance(g.get(k), list) else [] for k in ("sections", "tags")}
            out.append({"name": name, "description": str(g.get("description", "")) if isinstance(g, dict) else "", **lists})
    return out


def inferred_tags(corpus: Corpus, model: LanguageModel, question: str, usage: Usage | None = None, most: int = 6) -> list[str]:
    """Tags that bear on a question: those of the model's that the corpus holds, else those of examples whose translations
    hold the question's words."""
    said = ask(model, "tags", f"TAGS\n{question}", usage).get("tags", [])
    names = [str(t).upper() for t in said if t] if isinstance(said, list) else []
    held = {r["tag"] for r in corpus.ex.select(F.explode("tags").alias("tag")).filter(F.col("tag").isin(names)).distinct().collect()} if names else set()
    kept = [t for t in dict.fromkeys(names) if t in held][:most]
    return kept or [r["tag"] for r in tools.tags_for_question(corpus.ex, question, most).orderBy("rank").limit(most).collect()]


def feature_plan(model: LanguageModel, domain: dict, usage: Usage | None = None) -> list[str]:
    """The questions of a domain; one about its presence if the model gives none."""
    got = ask(model, "feature_plan", f"FEATURE PLAN\n{domain['name']}\n{domain['description']}\nSections: {', '.join(domain['sections'])}\nTags: {', '.join(domain['tags'])}", usage).get("questions", [])
    texts = [q.get("question", "") if isinstance(q, dict) else str(q) for q in got if q] if isinstance(got, list) else []
    return [t for t in texts if t] or [f"Does the language mark {domain['name'].lower()}?"]
