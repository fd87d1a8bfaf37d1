"""Feature coding: each feature of a list is asked of a language and coded with one of a few labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.constants import VALID_CODES
from corpusloom.operators.verdicts import normal_label
from corpusloom.plans.agent import answer
from corpusloom.plans.model import LanguageModel, answers, ask
from corpusloom.plans.registry import Corpus, call

RESULT = "feature_id string, language string, label string, label_reasoning string, value string, confidence double, verdict string, answer string"


def code_features(spark: SparkSession, corpus: Corpus, model: LanguageModel, features: DataFrame, language: str, ids: list[str] | None = None, done: DataFrame | None = None, **kw) -> DataFrame:
    """One row per feature (ID, Query, Coding) that has no result yet. A feature that fails is coded ? and overturned."""
    todo = features.filter(F.col("ID").isin(ids)) if ids else features
    if done is not None:
        todo = todo.join(done.filter(F.col("language") == language).select(F.col("feature_id").alias("ID")), "ID", "left_anti")
    rows = []
    for f in todo.orderBy("ID").toLocalIterator():
        try:
            a = answer(spark, corpus, model, f["Query"], **kw)
            said = ask(model, "label", f"LABEL\n{f['Query']}\nCoding: {f['Coding']}\nAnswer: {a.value}. {a.text}", a.usage)
            rows.append((f["ID"], language, str(said.get("label", "?")), str(said.get("reasoning", "")), a.value, a.confidence, "upheld", a.text))
        except Exception as e:  # noqa: BLE001 - one feature must not end the run
            rows.append((f["ID"], language, "?", f"failed: {type(e).__name__}", "", 0.0, "overturned", ""))
    return spark.createDataFrame(rows, RESULT).withColumn("label", normal_label(F.col("label")))


def zero_resource(features: DataFrame, languages: DataFrame, factory) -> DataFrame:
    """The baseline without a corpus: every language (ord, language) with every feature, coded by the model alone."""
    pairs = languages.crossJoin(F.broadcast(features.select(F.col("ID").alias("gb_id"), F.col("Query").alias("query"), F.col("Coding").alias("coding"))))
    asked = pairs.withColumn("prompt", F.concat_ws("\n", F.lit("CODE"), "language", "query", "coding"))
    code = normal_label(F.col("answer"))
    return answers(asked, factory, "code").select("language", "gb_id", "query", F.when(code.isin(VALID_CODES), code).otherwise("?").alias("baseline_code"))


def tag_usage(corpus: Corpus, model: LanguageModel, tag: str, max_examples: int = 10) -> str:
    """Prose on the use of a tag, from examples of it."""
    rows = call(corpus, "get_triline_examples", query=tag, max_examples=max_examples).join(corpus.ex.select("ord", "source", "gloss", "translation"), "ord").orderBy("ord").collect()
    return model.generate("USAGE\n" + tag + "\n" + "\n".join(f"{r['source']}\n{r['gloss']}\n'{r['translation']}'" for r in rows), 800) if rows else ""


def example_structure(corpus: Corpus, model: LanguageModel, query: str, max_examples: int = 5) -> str:
    """Prose on the structure of matching examples."""
    rows = call(corpus, "get_triline_examples", query=query, max_examples=max_examples).join(corpus.ex.select("ord", "morpheme", "gloss"), "ord").orderBy("ord").collect()
    return model.generate("STRUCTURE\n" + query + "\n" + "\n".join(f"{r['morpheme']}\n{r['gloss']}" for r in rows), 900) if rows else ""
