"""Hypotheses over languages: plan, ask, extract and synthesise, each step one batch of model rows.

universals: id, statement, antecedent, consequent, logic, domain, source. languages: language, digest (an excerpt of its
contents and tags, cut to DIGEST characters). What a model leaves out or gets wrong falls back to a defined value: a plan
without strategies searches by the statement, an answer without a verdict is unknown with confidence 0.5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.jsonrepair import repaired
from corpusloom.operators import verdicts
from corpusloom.plans.model import LanguageModel, answers

#: Characters of a digest, of an answer in an extraction prompt and in a verdict, of evidence, of notes, of a search focus.
DIGEST, ANSWER, RAW, EVIDENCE, NOTES, FOCUS = 3000, 3000, 400, 300, 200, 100
_STRATEGY = "map<string, struct<target_sections: array<string>, diagnostic_tags: array<string>, search_focus: string>>"


def _hypothesis():
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.col(c)) for c in ("statement", "antecedent", "consequent", "logic")])


def plan(universals: DataFrame, languages: DataFrame, factory: Callable[[], LanguageModel]) -> DataFrame:
    """The universals with, for each language, target_sections, diagnostic_tags and search_focus."""
    block = languages.agg(F.concat_ws("\n\n", F.array_sort(F.collect_list(F.concat_ws("\n", F.upper("language"), F.substring(F.coalesce("digest", F.lit("(none)")), 1, DIGEST))))).alias("digests"))
    asked = universals.crossJoin(F.broadcast(block)).withColumn("prompt", F.concat_ws("\n", F.lit("UNIVERSAL PLAN"), "id", _hypothesis(), "digests")).drop("digests")
    said = answers(asked, factory, "universal_plan").withColumn("object", repaired(F.col("answer"), "truncate"))
    both = said.crossJoin(F.broadcast(languages.select("language")))
    # strategies stand at the top or under a key of their own
    own = F.element_at(F.from_json("object", _STRATEGY), F.col("language"))
    nested = F.element_at(F.from_json(F.get_json_object("object", "$.language_strategies"), _STRATEGY), F.col("language"))
    s = F.coalesce(own, nested)
    focus = F.coalesce(F.when(s["search_focus"] != "", s["search_focus"]), F.concat(F.lit("Search for evidence relating to: "), F.substring("statement", 1, FOCUS)))
    none = F.array().cast("array<string>")
    return both.select(*universals.columns, "language", F.coalesce(s["target_sections"], none).alias("target_sections"), F.coalesce(s["diagnostic_tags"], none).alias("diagnostic_tags"), focus.alias("search_focus"))


def questions(planned: DataFrame) -> DataFrame:
    """Adds prompt: what is asked of each language."""
    free = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("(use your judgment)")
    return planned.withColumn("prompt", F.concat_ws("\n", F.lit("UNIVERSAL QUERY"), "language", _hypothesis(), free("target_sections"), free("diagnostic_tags"), "search_focus"))


def extract(results: DataFrame, factory: Callable[[], LanguageModel]) -> DataFrame:
    """results: the columns of questions with answer and, if an agent gave it, confidence -> uid, logic, language, the
    three-valued antecedent_holds and consequent_holds, violates, confidence, evidence, notes and raw_answer."""
    given = F.col("confidence") if "confidence" in results.columns else F.lit(None).cast("double")
    r = results.select(F.col("id").alias("uid"), "logic", "language", F.trim(F.coalesce("answer", F.lit(""))).alias("said"), given.alias("given"), _hypothesis().alias("about"))
    asked = r.withColumn("prompt", F.concat_ws("\n", F.lit("UNIVERSAL EXTRACT"), "language", "about", F.substring("said", 1, ANSWER)))
    got = answers(asked, factory, "universal_extract").withColumn("o", repaired(F.col("answer"), "truncate"))
    value = lambda k: F.get_json_object("o", f"$.{k}")
    v = got.select("uid", "logic", "language", "said", "given", *[value(k).alias(k) for k in ("antecedent_holds", "consequent_holds", "violates", "confidence", "antecedent_evidence", "consequent_evidence", "notes")])
    v = v.withColumn("antecedent_holds", verdicts.tribool("antecedent_holds")).withColumn("consequent_holds", verdicts.tribool("consequent_holds"))
    told = F.when(F.col("violates").isNotNull(), ~F.col("violates").isin("false", "0", ""))
    text = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c)
    return v.select(
        "uid", "logic", "language", "antecedent_holds", "consequent_holds",
        F.coalesce(told, verdicts.violates(F.col("logic"), F.col("antecedent_holds"), F.col("consequent_holds"))).alias("violates"),
        F.coalesce(F.expr("try_cast(confidence AS double)"), "given", F.lit(0.5)).alias("confidence"), text("antecedent_evidence", EVIDENCE), text("consequent_evidence", EVIDENCE), text("notes", NOTES),
        F.substring("said", 1, RAW).alias("raw_answer"),
    )


def synthesise(universals: DataFrame, found: DataFrame, factory: Callable[[], LanguageModel]) -> tuple[DataFrame, DataFrame]:
    """(found with label, uid with verdict and counts): a reviewer sees all languages of a universal and may set some of
    them aside; violations and supports are counted by the rules of verdicts."""
    line = F.concat_ws(" | ", "language", *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in ("antecedent_holds", "consequent_holds", "violates", "confidence")], "antecedent_evidence", "consequent_evidence", "notes")
    per = found.groupBy("uid").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    u = universals.withColumnRenamed("id", "uid")
    asked = u.join(per, "uid").withColumn("prompt", F.concat_ws("\n", F.lit("UNIVERSAL SYNTHESIS"), "uid", "domain", _hypothesis(), "lines")).select("uid", "prompt")
    said = answers(asked, factory, "universal_synthesis").withColumn("o", repaired(F.col("answer"), "truncate"))
    views = F.from_json(F.get_json_object("o", "$.language_assessments"), "map<string, struct<assessment: string, reason: string>>")
    seen = said.select("uid", F.explode(views).alias("language", "view")).select("uid", "language", F.col("view.assessment").alias("assessment"), F.col("view.reason").alias("reason"))
    labels = verdicts.language_labels(found.join(seen, ["uid", "language"], "left"))
    return labels, verdicts.universal_verdicts(labels, said.select("uid", F.get_json_object("o", "$.verdict").alias("verdict")))


def run(universals: DataFrame, languages: DataFrame, factory: Callable[[], LanguageModel], ask: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """All steps. ask gives the questions an answer column (an agent over each language's corpus); without it the model
    answers by itself."""
    asked = questions(plan(universals, languages, factory))
    found = extract(ask(asked) if ask else answers(asked, factory, "answer"), factory)
    return synthesise(universals, found, factory)
