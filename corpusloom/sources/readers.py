"""Readers of the corpus formats. Every reader gives an order column, since all limits follow document order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.sections import plain_chunks
from corpusloom.schemas import CHUNK, CODING, IGT, UNIVERSAL
from corpusloom.session import read_text

_NAMES = ["chapter", "section", "subsection", "subsubsection"]


def _items(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """The objects of a JSON array per file, with their place in it; values stay text where shapes are mixed."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", "array<string>").alias("a"))
    return whole.select("file", F.posexplode("a").alias("ord", "item")).select("file", F.col("ord").cast("long").alias("ord"), F.from_json("item", fields).alias("r")).select("file", "ord", "r.*")


def _lines(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """The objects of JSON lines, by a scan that can be split; each names its place (ord)."""
    return spark.read.text(path).select(F.from_json("value", f"ord long, {fields}").alias("r")).select("r.*")


def _filled(*names: str):
    return [F.coalesce(n, F.lit("")).alias(n) for n in names]


def chunks_json(spark: SparkSession, path: str, lang: str = "") -> DataFrame:
    """Chunks of a JSON array; missing strings are empty, chunk_id defaults to the place, level follows the names."""
    return _chunks(_items(spark, path, _CHUNK_FIELDS), lang)


def chunks_json_lines(spark: SparkSession, path: str, lang: str = "") -> DataFrame:
    """The same of JSON lines that hold their place, for corpora too large for one array."""
    return _chunks(_lines(spark, path, _CHUNK_FIELDS), lang)


_CHUNK_FIELDS = ", ".join(f"{n} string" for n in ["chunk_id", "text", *_NAMES, "label", "summary"]) + ", page int"


def _chunks(d: DataFrame, lang: str) -> DataFrame:
    level = F.when(F.coalesce("subsubsection", F.lit("")) != "", 4).when(F.coalesce("subsection", F.lit("")) != "", 3).when(F.coalesce("section", F.lit("")) != "", 2).otherwise(1)
    ids = F.coalesce("chunk_id", F.format_string("chunk_%04d", "ord"))
    return d.select(F.lit(lang).alias("lang"), "ord", ids.alias("chunk_id"), *_filled("text", *_NAMES, "label"), "page", level.alias("level"), *_filled("summary"))


def igt_json(spark: SparkSession, path: str, lang: str = "") -> DataFrame:
    """Examples of a JSON array. gloss_tags may be a list or a list of lists, row by row (the first element decides)."""
    return _examples(_items(spark, path, _IGT_FIELDS), lang)


def igt_json_lines(spark: SparkSession, path: str, lang: str = "") -> DataFrame:
    """The same of JSON lines that hold their place, for corpora too large for one array."""
    return _examples(_lines(spark, path, _IGT_FIELDS), lang)


_IGT_FIELDS = ", ".join(f"{n} string" for n in ["example_id", "source", "morpheme", "gloss", "translation", *_NAMES, "tones", "label", "source_section", "gloss_tags"])


def _examples(d: DataFrame, lang: str) -> DataFrame:
    nested = F.col("gloss_tags").rlike(r"^\s*\[\s*\[")
    tags = F.coalesce(F.when(nested, F.flatten(F.from_json("gloss_tags", "array<array<string>>"))).otherwise(F.from_json("gloss_tags", "array<string>")), F.array().cast("array<string>"))
    crumb = F.concat_ws(" > ", *[F.when(F.col(n) != "", F.col(n)) for n in _NAMES])
    sec = F.when(crumb != "", crumb).otherwise(F.coalesce("source_section", F.lit("")))
    ids = F.coalesce("example_id", F.format_string("igt_%04d", "ord"))
    return d.select(F.lit(lang).alias("lang"), "ord", ids.alias("example_id"), *_filled("source", "morpheme", "gloss", "translation"), tags.alias("gloss_tags"), *_filled(*_NAMES, "tones", "label"), sec.alias("source_section"))


def grammar(spark: SparkSession, path: str, lang: str = "") -> DataFrame:
    """A grammar: JSON chunks, or any other suffix as plain text cut at its headings."""
    if path.endswith(".json"):
        return chunks_json(spark, path, lang)
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    p = plain_chunks(docs, "file", "text")
    e = F.lit("")
    level = F.when(F.col("subsection") != "", 3).when(F.col("section") != "", 2).otherwise(1)
    return p.select(
        F.lit(lang).alias("lang"), F.col("no").cast("long").alias("ord"), F.format_string("chunk_%04d", "no").alias("chunk_id"), "text", "chapter", "section", "subsection",
        e.alias("subsubsection"), e.alias("label"), F.lit(None).cast("int").alias("page"), level.alias("level"), e.alias("summary"),
    )


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))


def abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """TAG<tab or two spaces>meaning lines; blank lines and comments are skipped, the last meaning of a tag counts."""
    parts = F.split(F.trim("line"), r"\t| {2,}", 2)
    rows = _numbered_lines(spark, path).filter((F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("#"))).select("ord", F.upper(F.trim(F.get(parts, F.lit(0)))).alias("tag"), F.trim(F.get(parts, F.lit(1))).alias("meaning"))
    rows = rows.filter(F.col("meaning").isNotNull())
    return rows.groupBy("tag").agg(F.min("ord").cast("long").alias("ord"), F.max_by("meaning", "ord").alias("meaning")).select("ord", "tag", "meaning")


def universals_defaults(rows: DataFrame) -> DataFrame:
    """Trimmed texts; rows without id are dropped, logic and domain have defaults."""
    clean = rows.select(*[F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "^\\ufeff", "")).alias(c) for c in rows.columns]).filter("id <> ''")
    return clean.withColumn("logic", F.when(F.col("logic") == "", "implication").otherwise(F.lower("logic"))).withColumn("domain", F.when(F.col("domain") == "", "UNKNOWN").otherwise(F.col("domain")))


def universals(spark: SparkSession, path: str) -> DataFrame:
    return universals_defaults(spark.read.schema(UNIVERSAL).csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=True))


def coding_features(spark: SparkSession, path: str, distinct: bool = True) -> DataFrame:
    d = spark.read.schema(CODING).csv(path, header=True, multiLine=True, quote='"', escape='"')
    return d.dropDuplicates(["ID"]) if distinct else d


def language_list(spark: SparkSession, path: str) -> DataFrame:
    lines = _numbered_lines(spark, path).filter((F.trim("line") != "") & ~F.startswith("line", F.lit("#")))
    return lines.select("ord", F.trim("line").alias("language"))


def config(path: str, spark: SparkSession | None = None) -> dict:
    """A language configuration; raises ValueError if it can't be used. With a session, from any file system it knows."""
    if spark is not None:
        c = json.loads(read_text(spark, path))
    else:
        with open(path, encoding="utf-8") as f:
            c = json.load(f)
    if not c.get("languages"):
        raise ValueError("no languages")
    for entry in c["languages"]:
        if not entry.get("name"):
            raise ValueError("a language without name")
        if entry.get("igt_only") and not entry.get("igt"):
            raise ValueError(f"{entry['name']}: igt_only without igt")
        if not entry.get("igt_only") and not entry.get("grammar"):
            raise ValueError(f"{entry['name']}: without grammar")
    return c


def pending(work: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """The part of a work list without a result yet."""
    return work if done is None else work.join(done.select(*keys), keys, "left_anti")


def empty(spark: SparkSession, what: str) -> DataFrame:
    return spark.createDataFrame([], "lang string, " + {"chunk": CHUNK, "igt": IGT}[what])


def last_version(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Of rows loaded several times under one key, the last."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("lang", key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")
