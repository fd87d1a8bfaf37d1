"""Small text rules: names of files, ids of queries, claim ids in texts, consistency of values, claim types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.constants import SAYS_ABSENT, SAYS_FOUND


def slug(text: Column, most: int = 40) -> Column:
    return F.substring(F.regexp_replace(F.lower(text), r"[^\w]+", "_"), 1, most)


def query_id(text: Column) -> Column:
    return F.concat(F.lit("Q"), F.upper(F.substring(F.md5(text), 1, 6)))


def without_claim_ids(text: Column) -> Column:
    """The text without mentions of internal claim ids."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*[\(\[]?\s*claim_id\s*=\s*C\d+\s*[\)\]]?", ""), r"\s{2,}", " "))


def cleaned(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with no claim ids in the named columns, texts or lists of texts."""
    kinds = dict(df.dtypes)
    clean = lambda c: F.transform(c, without_claim_ids) if kinds[c].startswith("array") else without_claim_ids(F.col(c))
    return df.withColumns({c: clean(c) for c in columns})


def consistent_value(value: Column, text: Column, supporting: Column) -> tuple[Column, Column]:
    """(value, whether a person should look): No becomes Partial if the text says found more often than absent, or
    supporting patterns exist."""
    found, absent = F.regexp_count(text, F.lit(SAYS_FOUND)), F.regexp_count(text, F.lit(SAYS_ABSENT))
    wrong = (value == "No") & ((found > 0) | (supporting > 0)) & (absent < found)
    return F.when(wrong, "Partial").otherwise(value), F.coalesce(wrong, F.lit(False))


def claim_type(text: Column) -> Column:
    """The first known claim type among the words of a free answer; inference if none is."""
    known = ["grammar_statement", "igt_pattern", "absence_evidence", "inference", "counter_evidence", "author_caveat"]
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[|/,; ]+"), lambda w: w.isin(known))
    return F.coalesce(F.get(words, F.lit(0)), F.lit("inference"))
