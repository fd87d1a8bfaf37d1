"""Verdicts across languages, with three-valued logic, and groupings of answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.constants import ANTECEDENT_FAILS, QUESTION_JACCARD, QUESTION_STOP, VERDICT_LABELS

MIN_CONFIDENCE = 0.65


def tribool(value: str) -> Column:
    """true/Yes and false/No; everything else is unknown."""
    return F.when(F.col(value).isin("true", "Yes"), True).when(F.col(value).isin("false", "No"), False)


def violates(logic: Column, antecedent: Column, consequent: Column) -> Column:
    no = consequent.eqNullSafe(False)
    return F.when(logic == "absolute", no).when(logic.isin("implication", "correlation"), antecedent.eqNullSafe(True) & no).otherwise(False)


def antecedent_fails(answer: Column) -> Column:
    low = F.lower(answer)
    return F.coalesce(F.greatest(*[F.contains(low, F.lit(p)) for p in ANTECEDENT_FAILS]), F.lit(False))


def language_labels(v: DataFrame) -> DataFrame:
    """v: uid, logic, language, antecedent_holds, consequent_holds, violates, confidence, raw_answer, assessment (the
    reviewer's label or null) -> with label."""
    given = F.upper(F.coalesce("assessment", F.lit("INSUFFICIENT")))
    given = F.when(given.isin(VERDICT_LABELS), given).otherwise("INSUFFICIENT")
    pre = (F.col("logic") == "implication") & F.col("violates") & antecedent_fails(F.substring("raw_answer", 1, 400))
    yes_a, yes_c = F.col("antecedent_holds").eqNullSafe(True), F.col("consequent_holds").eqNullSafe(True)
    label = (
        F.when(pre, "ANTECEDENT_NA")
        .when(given.isin("ANTECEDENT_NA", "IRRELEVANT"), given)
        .when(F.coalesce("confidence", F.lit(0.0)) < MIN_CONFIDENCE, "INSUFFICIENT")
        .when(F.col("violates"), "VALID_VIOLATION")
        .when(F.col("antecedent_holds").eqNullSafe(False) & (F.col("logic") == "implication"), "ANTECEDENT_NA")
        .when(yes_a & yes_c, "VALID_SUPPORT")
        .otherwise(given)
    )
    return v.withColumn("label", label)


def universal_verdicts(labelled: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """uid, verdict, counts per label, mean confidence. model: uid, verdict; its TRUE or FALSE wins over the count."""
    n = labelled.groupBy("uid").agg(*[F.count_if(F.col("label") == x).alias(f"n_{x.lower()}") for x in VERDICT_LABELS], F.count("*").alias("n"), F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6).alias("mean_confidence"))
    counted = F.when(F.col("n_valid_violation") > 0, "FALSE").when((F.col("n_valid_support") > 0) | (F.col("n_antecedent_na") == F.col("n")), "TRUE").otherwise("FALSE")
    if model is not None:
        n = n.join(model.select("uid", F.upper("verdict").alias("said")), "uid", "left")
        counted = F.when(F.col("said").isin("TRUE", "FALSE"), F.col("said")).otherwise(counted)
    return n.withColumn("verdict", counted).drop("n", "said")


def select_universals(universals: DataFrame, statement: DataFrame | None = None, ids: list[str] | None = None, domain: str | None = None, every: bool = False) -> DataFrame:
    """Which universals to test: a statement of one's own (a row of the same columns), else ids, else a domain in any
    case, else all. Nothing chosen is an error."""
    if statement is not None:
        return statement
    if ids:
        return universals.filter(F.col("id").isin(ids))
    if domain:
        return universals.filter(F.upper("domain") == domain.upper())
    if every:
        return universals
    raise ValueError("choose a statement, ids, a domain or all")


def display_category(v: DataFrame) -> DataFrame:
    return v.withColumn("category", F.when(F.col("violates"), "VIOLATES").when(~F.col("antecedent_holds").eqNullSafe(False), "SUPPORTS").otherwise("NA"))


def value_groups(answers: DataFrame) -> DataFrame:
    """question, value, n, share, languages: answers (question, ord, language, value or null, answer) grouped by value,
    else the first 30 characters of the answer; groups by size, ties by first language."""
    val = F.coalesce("value", F.substring(F.coalesce("answer", F.lit("Unclear")), 1, 30))
    g = answers.withColumn("v", val).groupBy("question", "v").agg(
        F.count("*").alias("n"), F.min("ord").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "language"))), lambda x: x["language"]), ", ").alias("languages")
    )
    total = F.sum("n").over(Window.partitionBy("question"))
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("n"), F.asc("first")))
    return g.select("question", rank.alias("rank"), F.col("v").alias("value"), "n", F.floor(100 * F.col("n") / F.greatest(total, F.lit(1))).cast("int").alias("share"), "languages")


def with_unplaced(placed: DataFrame, results: DataFrame, label: str = "Unclear") -> DataFrame:
    """placed: question, type_label, language; results: question, language. Languages that no type has get the label."""
    rest = results.select("question", "language").join(placed.select("question", "language"), ["question", "language"], "left_anti")
    return placed.select("question", "type_label", "language").unionByName(rest.withColumn("type_label", F.lit(label)))


def label_histogram(labels: DataFrame, requested: int | None = None) -> DataFrame:
    """label, n, share of all requested features (by default those labelled) in percent."""
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    of = F.sum("n").over(Window.partitionBy()) if requested is None else F.lit(max(requested, 1))
    return n.withColumn("share", F.round(F.col("n") * 100.0 / of, 2))


def normal_label(answer: Column) -> Column:
    """The label itself, else its first digit or question mark, else a question mark."""
    first = F.regexp_extract(F.coalesce(answer, F.lit("")), "([0-9?])", 1)
    return F.when(first == "", "?").otherwise(first)


def confirmed_split(results: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Counts of confirmed and uncertain results per language; null confidences are uncertain."""
    sure = F.coalesce("confidence", F.lit(0.0)) >= threshold
    return results.groupBy("language").agg(F.count("*").alias("n"), F.count_if(sure).alias("confirmed"), F.count_if(~sure).alias("uncertain"))


def question_words(text: str, language: str = "") -> frozenset:
    import re

    own = {t.lower() for t in re.split(r"\W+", language) if len(t) >= 3}
    return frozenset(w for w in re.findall(r"[a-z]+", (text or "").lower()) if len(w) >= 3 and w not in QUESTION_STOP and w not in own)


def content_words(question: Column, language: Column) -> Column:
    """question_words as an expression: sorted, each once."""
    own = F.filter(F.split(F.lower(F.coalesce(language, F.lit(""))), r"\W+"), lambda t: F.length(t) >= 3)
    found = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit("([a-z]+)"), 1)
    return F.array_sort(F.array_except(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*QUESTION_STOP)), own))


def distinct_questions(questions: DataFrame, threshold: float = QUESTION_JACCARD) -> DataFrame:
    """questions: language, ord, question -> those kept. In order, a question is dropped if it shares the threshold of
    its content words with one kept before; sequential within a language, whose list of questions is short."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        kept, rows = [], []
        for i, q in enumerate(pdf["question"]):
            w = question_words(q, pdf["language"].iat[0] or "")
            if all(not w or not k or len(w & k) / len(w | k) < threshold for k in kept):
                kept.append(w)
                rows.append(i)
        return pdf.iloc[rows]

    q = questions.select("language", "ord", "question")
    return q.groupBy("language").applyInPandas(keep, q.schema)
