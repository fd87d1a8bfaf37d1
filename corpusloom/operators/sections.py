"""Sections: assembly from chunks, references between them, search, tables of contents, plain-text documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.constants import CHUNK_LINES, CHUNK_MIN_CHARS, CLAIM_PATTERNS, HEADING, KEY_TERM, XREF_PATTERNS
from corpusloom.operators.stats import text_of, top_per

NAMES = ["chapter", "section", "subsection", "subsubsection"]


def chunk_view(chunks: DataFrame) -> DataFrame:
    """No null strings; level from the deepest name."""
    v = chunks.select("ord", *[text_of(c).alias(c) for c in ["lang", "chunk_id", "text", *NAMES, "label", "summary"]])
    return v.withColumn("level", F.when(F.col("subsubsection") != "", 4).when(F.col("subsection") != "", 3).when(F.col("section") != "", 2).otherwise(1))


def refs(text: Column) -> Column:
    """Distinct reference targets of a text, sorted."""
    found = [F.regexp_extract_all(text, F.lit(p), 1) for p in XREF_PATTERNS]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*found), lambda r: r != "")))


def assemble(view: DataFrame) -> DataFrame:
    """One row per section (language and the four names): chunks in the order of their ids (as strings, then ord)."""
    g = view.groupBy("lang", *NAMES).agg(F.array_sort(F.collect_list(F.struct("chunk_id", "ord", "text", "label", "level"))).alias("c"), F.min("ord").alias("first"))
    g = g.withColumn("full_text", F.array_join(F.transform("c", lambda x: x["text"]), "\n\n"))
    first = F.get("c", F.lit(0))
    return g.select(
        "lang", first["chunk_id"].alias("section_id"), *NAMES, first["label"].alias("label"), first["level"].alias("level"), "full_text",
        F.length("full_text").alias("char_count"), F.transform("c", lambda x: x["chunk_id"]).alias("chunk_ids"), refs(F.col("full_text")).alias("outgoing_refs"), "first",
    )


def key_terms(sections: DataFrame, k: int = 20) -> DataFrame:
    """Capitalised phrases and acronyms that a section repeats, most frequent first, ties by first place."""
    t = sections.select("lang", "section_id", F.posexplode(F.regexp_extract_all("full_text", F.lit(f"({KEY_TERM})"), 1)).alias("i", "term"))
    t = t.withColumn("term", F.trim("term")).filter(F.length("term") >= 3)
    c = t.groupBy("lang", "section_id", "term").agg(F.count("*").alias("cnt"), F.min("i").alias("first_i")).filter("cnt >= 2")
    return top_per(c, ["lang", "section_id"], [F.desc("cnt"), F.asc("first_i")], k).select("lang", "section_id", "rank", "term", "cnt")


def with_key_terms(sections: DataFrame) -> DataFrame:
    terms = key_terms(sections).groupBy("lang", "section_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("key_terms"))
    return sections.join(terms, ["lang", "section_id"], "left").withColumn("key_terms", F.coalesce("key_terms", F.array().cast("array<string>")))


def search_sections(sections: DataFrame, query: str, k: int = 8) -> DataFrame:
    """Sections by query words in their names and key terms (1 each) and in their text (0.4 each), plus 5 if a name
    holds the whole query; ties in document order. sections has key_terms."""
    q = query.lower()
    words = sorted(set(re.findall(r"[a-zA-Z]{3,}", q)))
    header = F.lower(F.concat_ws(" ", *NAMES, F.array_join("key_terms", " ")))
    hits = lambda col: sum((F.when(F.contains(col, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    named = F.greatest(*[F.contains(F.lower(c), F.lit(q)) for c in NAMES[1:]])
    score = F.round(hits(header) + 0.4 * hits(F.lower("full_text")) + F.when(named, 5).otherwise(0), 1)
    s = sections.withColumn("score", score).filter("score > 0")
    return top_per(s, ["lang"], [F.desc("score"), F.asc("first")], k)


def find(sections: DataFrame, names: list[str]) -> DataFrame:
    """The section of each name in each language, with name and how: that of a chunk of this id (1), of this label (2), of
    this own id (3), or of a chunk whose first part has this id (4, ids that end in _p0); of equals the first."""
    asked = sections.sparkSession.createDataFrame([(n,) for n in names], "name string")
    how = (
        F.when(F.array_contains("chunk_ids", F.col("name")), 1)
        .when(F.col("label") == F.col("name"), 2)
        .when(F.col("section_id") == F.col("name"), 3)
        .when(F.array_contains("chunk_ids", F.concat("name", F.lit("_p0"))), 4)
    )
    found = sections.crossJoin(F.broadcast(asked)).withColumn("how", how).filter("how is not null")
    return top_per(found, ["lang", "name"], [F.asc("how"), F.asc("first")], 1)


def resolved_refs(sections: DataFrame) -> DataFrame:
    """lang, src, ref, dst: each reference with the section it names: the last one with that label, else the first
    section whose label contains it. Labels are reduced to distinct ones; the containment
    join is an equi-join on their parts of the lengths that references have."""
    e = sections.select("lang", F.col("section_id").alias("src"), F.explode("outgoing_refs").alias("ref"))
    labels = sections.filter("label <> ''").groupBy("lang", "label").agg(
        F.max_by("section_id", "first").alias("last_id"), F.min(F.struct("first", "section_id")).alias("f")
    )
    asked = e.select("lang", "ref").distinct()
    # a label holds a reference where one of its parts of that length equals it
    lengths = asked.select("lang", F.length("ref").alias("n")).distinct()
    parts = labels.join(lengths, "lang").filter(F.length("label") >= F.col("n"))
    at = F.explode(F.sequence(F.lit(1), F.length("label") - F.col("n") + 1))
    parts = parts.select("*", at.alias("at")).withColumn("ref", F.substr("label", F.col("at"), F.col("n")))
    near = asked.join(parts, ["lang", "ref"])
    best = near.groupBy("lang", "ref").agg(
        F.max(F.when(F.col("label") == F.col("ref"), F.col("last_id"))).alias("exact"), F.min("f").alias("f")
    )
    return e.join(best.select("lang", "ref", F.coalesce("exact", "f.section_id").alias("dst")), ["lang", "ref"])


def follow_refs(sections: DataFrame, query: str, hops: int = 2) -> DataFrame:
    """The three best sections for a query (hop 0) and those their references reach, each once, at its first hop."""
    edges = resolved_refs(sections).select("lang", "src", "dst").distinct()
    frontier = search_sections(sections, query, 3).select("lang", F.col("section_id").alias("id"), F.lit(0).alias("hop"))
    seen = frontier
    for h in range(1, hops + 1):
        step = frontier.withColumnRenamed("id", "src").join(edges, ["lang", "src"]).select("lang", F.col("dst").alias("id")).distinct()
        frontier = step.join(seen.select("lang", "id"), ["lang", "id"], "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(frontier)
    return seen


def author_claims(found: DataFrame, k: int = 25) -> DataFrame:
    """Statements in the three best sections of a search (with rank): over 30 characters, no formula, no percentage."""
    best = found.filter("rank <= 3")
    hits = F.flatten(F.array(*[F.transform(F.regexp_extract_all("full_text", F.lit(f"({p})"), 1), lambda c, i: F.struct(F.lit(j).alias("p"), i.alias("i"), F.trim(c).alias("claim"))) for j, p in enumerate(CLAIM_PATTERNS)]))
    c = best.select("lang", F.col("rank").alias("srank"), "section", "subsection", F.explode(hits).alias("h")).select("lang", "srank", "section", "subsection", "h.*")
    c = c.filter((F.length("claim") > 30) & ~F.startswith("claim", F.lit("\\")) & ~F.contains("claim", F.lit("%")))
    text = F.concat(F.lit("["), "section", F.lit(" / "), "subsection", F.lit("] "), "claim")
    return top_per(c, ["lang"], [F.asc("srank"), F.asc("p"), F.asc("i")], k).select("lang", "rank", text.alias("claim"))


def contents(view: DataFrame, skip_subsections: bool = False, k: int = 300) -> DataFrame:
    """First chunk of each section, in document order, at most k per language; optionally sections only."""
    key = [F.when(F.lit(skip_subsections) & (F.col("subsection") != ""), F.lit(None)).otherwise(F.col(c)).alias(f"k_{c}") for c in NAMES[2:]]
    keyed = view.select("*", *key)
    first = keyed.groupBy("lang", "chapter", "section", "k_subsection", "k_subsubsection").agg(F.min_by(F.struct("chunk_id", "level", "label", "ord"), "ord").alias("c"))
    return top_per(first.select("lang", "chapter", "section", "c.*"), ["lang"], [F.asc("ord")], k).select("lang", "rank", "ord", "chunk_id", "chapter", "section", "level", "label")


def digest(toc: DataFrame, budget: int = 3000) -> DataFrame:
    """Entries of a table of contents (lang, rank, header, summary) as long as their lengths stay within the budget."""
    size = F.length("header") + F.length(F.coalesce("summary", F.lit("")))
    before = F.sum(size).over(Window.partitionBy("lang").orderBy("rank"))
    return toc.withColumn("used", before).filter(F.col("used") <= budget)


def plain_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Chunks of plain-text documents. A heading ends the chunk before it and sets the names; a chunk has 61 lines at
    most; chunks of 50 characters or fewer are dropped. key, no (from 0), text, chapter, section, subsection."""
    lines = docs.select(F.col(key).alias("doc"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("ln", "line"))
    head = F.trim("line").rlike(HEADING)
    order = Window.partitionBy("doc").orderBy("ln")
    h = F.trim("line")
    kind = F.when(head & F.lower(h).startswith("chapter"), 1).when(head & h.rlike(r"^§\d+\.\d+\.\d+"), 3).when(head, 2)
    l = lines.withColumn("head", head).withColumn("kind", kind).withColumn("h", h)
    l = l.withColumn("grp", F.sum(F.col("head").cast("int")).over(order))
    # names hold until the next heading of their level or a higher one
    l = l.withColumn("c_at", F.max(F.when(F.col("kind") == 1, F.col("ln"))).over(order)).withColumn("s_at", F.max(F.when(F.col("kind") <= 2, F.col("ln"))).over(order))
    last = lambda k: F.last(F.when(F.col("kind") == k, F.struct("ln", "h")), ignorenulls=True).over(order)
    l = l.withColumn("c", last(1)).withColumn("s", last(2)).withColumn("u", last(3))
    l = l.withColumn("chapter", F.coalesce("c.h", F.lit(""))).withColumn("section", F.when(F.coalesce("c_at", F.lit(-1)) > F.coalesce("s.ln", F.lit(-1)), "").otherwise(F.coalesce("s.h", F.lit(""))))
    l = l.withColumn("subsection", F.when(F.coalesce("s_at", F.lit(-1)) > F.coalesce("u.ln", F.lit(-1)), "").otherwise(F.coalesce("u.h", F.lit(""))))
    part = F.floor((F.row_number().over(Window.partitionBy("doc", "grp").orderBy("ln")) - 1) / CHUNK_LINES)
    g = l.withColumn("part", part).groupBy("doc", "grp", "part").agg(
        F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("ls"), F.max("chapter").alias("chapter"), F.max("section").alias("section"), F.max("subsection").alias("subsection")
    )
    body = F.trim(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    g = g.withColumn("text", body).filter(F.length("text") > CHUNK_MIN_CHARS)
    no = F.row_number().over(Window.partitionBy("doc").orderBy("grp", "part")) - 1
    return g.select(F.col("doc").alias(key), no.alias("no"), "text", "chapter", "section", "subsection")
