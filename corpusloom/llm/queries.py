"""The pN_ queries: each applies an operator of this subpackage to whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import table


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every tag with its occurrences, the examples that hold it, and its mark: the rows of the first half of the time
    of loading are counted first, then the others are merged as a change."""
    from corpusloom.llm.termcounts import TermCounts

    igt = table(spark, d, "igt").select("gloss_tags", "loaded_at")
    lo, hi = igt.agg(F.min("loaded_at"), F.max("loaded_at")).first()
    early = F.coalesce(F.col("loaded_at") <= F.lit(lo + (hi - lo) / 2), F.lit(False)) if lo is not None else F.lit(False)
    store = TermCounts(spark).apply(added=igt.filter(early), terms="gloss_tags").apply(added=igt.filter(~early), terms="gloss_tags")
    return store.marked().withColumnRenamed("term", "tag")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Tags that are too rare or too common."""
    return p1_counts(spark, d).filter(F.col("mark").isNotNull()).select("tag", "mark")


def _p5_texts(spark: SparkSession, d: str) -> DataFrame:
    chunk = table(spark, d, "chunk").select(F.lit("chunk").alias("tbl"), "ord", "text")
    return chunk.unionByName(table(spark, d, "section_node").select(F.lit("section_node").alias("tbl"), "ord", F.col("full_text").alias("text")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that had to be cut."""
    from corpusloom.llm.splitting import split_offsets

    return split_offsets(_p5_texts(spark, d), ["tbl", "ord"], "text").filter((F.col("seg") == 0) & (F.col("k") == 0)).select("tbl", "ord")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all oversized texts, in order."""
    from corpusloom.llm.splitting import split_texts

    return split_texts(_p5_texts(spark, d), ["tbl", "ord"], "text")


def p5_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Each oversized text put together again from its pieces, less what they repeat: its digest, whether no piece is over
    the limit and whether each begins at or before the end of the one before."""
    p = p5_pieces(spark, d)
    ps = p.groupBy("tbl", "ord").agg(F.array_sort(F.collect_list(F.struct("piece", "begin", "end", "text"))).alias("ps"))
    new = F.transform("ps", lambda x, i: F.substr(x["text"], F.when(i == 0, 1).otherwise(F.get("ps", i - 1)["end"] - x["begin"] + 1).cast("int")))
    sound = F.forall("ps", lambda x: (F.char_length(x["text"]) <= 2000) & (F.char_length(x["text"]) == x["end"] - x["begin"]))
    linked = F.forall(F.transform("ps", lambda x, i: (i == 0) | (x["begin"] <= F.get("ps", i - 1)["end"])), lambda ok: ok)
    return ps.select("tbl", "ord", F.md5(F.array_join(new, "")).alias("text_md5"), sound.alias("sound"), linked.alias("linked"))


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    """The same texts written as text files, one after another, and cut as files are, by byte ranges: for each file its
    characters, the characters of all pieces, what they repeat, and the longest piece."""
    from corpusloom.llm.splitting import split_files
    from corpusloom.session import fresh_path

    path = fresh_path(spark, "texts")
    _p5_texts(spark, d).filter("text <> ''").select("text").write.text(path)
    ps = split_files(spark, [path])
    return ps.groupBy("path").agg(F.max("end").alias("chars"), F.sum(F.col("end") - F.col("begin")).alias("in_pieces"), F.count("*").alias("pieces"), F.max(F.char_length("text")).alias("longest")).drop("path")


def p6_partners(spark: SparkSession, d: str) -> DataFrame:
    """For each tag the ten that it stands with most often."""
    from corpusloom.llm.cooccur import pair_statistics, top_partners

    return top_partners(pair_statistics(table(spark, d, "igt"), "gloss_tags"), 10).select(F.col("item").alias("tag"), "rank", "partner", "n_ab")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of tags that stand in the same example, with counts, lift and log-likelihood ratio."""
    from corpusloom.llm.cooccur import pair_statistics

    pairs = pair_statistics(table(spark, d, "igt"), "gloss_tags")
    return pairs.select(
        F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_ab", "n_a", "n_b", "n_records", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr")
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of tags in 5 examples or more and three times as often as chance, or more."""
    from corpusloom.llm.cooccur import pair_statistics

    pairs = pair_statistics(table(spark, d, "igt"), "gloss_tags")
    lifted = F.col("n_ab") * F.col("n_records") >= 3 * F.col("n_a") * F.col("n_b")
    return pairs.filter((F.col("n_ab") >= 5) & lifted).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def _versions(igt: DataFrame, until) -> DataFrame:
    """The rows that are the last version of their example among those loaded until then; rows without id stand alone."""
    key = F.when(F.col("example_id") != "", F.col("example_id")).otherwise(F.concat(F.lit("\u0001"), F.col("ord").cast("string")))
    seen = igt.filter(F.col("loaded_at") <= until).withColumn("k", key)
    last = seen.groupBy("lang", "k").agg(F.max(F.struct("loaded_at", "ord")).alias("m")).select(F.col("m.ord").alias("ord"))
    return igt.join(last, "ord", "left_semi")


def p1_current(spark: SparkSession, d: str) -> DataFrame:
    """Counts over the current version of each example, kept up to date: the versions as of the middle of the loads
    first, then only what was added, replaced or changed since."""
    from corpusloom.llm.termcounts import TermCounts

    igt = table(spark, d, "igt").select("ord", "lang", "example_id", "gloss_tags", "loaded_at")
    lo, hi = igt.agg(F.min("loaded_at"), F.max("loaded_at")).first()
    if lo is None:
        return TermCounts(spark).apply(added=igt, terms="gloss_tags").marked().withColumnRenamed("term", "tag")
    old, new = _versions(igt, F.lit(lo + (hi - lo) / 2)), _versions(igt, F.lit(hi))
    added, removed = new.join(old.select("ord"), "ord", "left_anti"), old.join(new.select("ord"), "ord", "left_anti")
    store = TermCounts(spark).apply(added=old, terms="gloss_tags").apply(added=added, removed=removed, terms="gloss_tags")
    return store.marked().withColumnRenamed("term", "tag")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Tags that are not written as in the list, with the tag of the list they stand for or the empty string."""
    from corpusloom.llm.canonical import canonical_list, map_to_list

    igt = table(spark, d, "igt").select(F.lit("igt").alias("tbl"), F.col("ord").alias("row_id"), F.posexplode("gloss_tags").alias("pos", "value"))
    prof = table(spark, d, "tag_profile").select(F.lit("tag_profile").alias("tbl"), F.col("profile_id").alias("row_id"), F.lit(0).alias("pos"), F.col("tag").alias("value"))
    entries = canonical_list(table(spark, d, "abbrev"), "tag", "meaning")
    values = igt.unionByName(prof).withColumn("pos", F.col("pos").cast("long"))
    return map_to_list(values, entries).select("tbl", "row_id", "pos", "canonical")


def _p4_texts(spark: SparkSession, d: str) -> DataFrame:
    igt = table(spark, d, "igt").select("ord", F.explode(F.create_map(F.lit("igt.source"), "source", F.lit("igt.morpheme"), "morpheme")).alias("field", "text"))
    chunk = table(spark, d, "chunk").select("ord", F.lit("chunk.text").alias("field"), "text")
    return igt.unionByName(chunk).select("field", F.col("ord").alias("id"), "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose field looks the same but is stored as different characters."""
    from corpusloom.llm.lookalike import lookalike_pairs

    return lookalike_pairs(_p4_texts(spark, d)).select("field", F.col("id_a").alias("ord_a"), F.col("id_b").alias("ord_b"))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of each line."""
    from corpusloom.llm.lookalike import consistent_forms

    return consistent_forms(_p4_texts(spark, d), with_text=True).select("field", F.col("id").alias("ord"), F.col("form_text").alias("form"))


P7_COLS = ["source", "gloss", "translation"]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of examples that share 60 % of their words without being equal."""
    from corpusloom.llm.neardup import expanded, near_duplicates

    igt = table(spark, d, "igt").select("ord", *P7_COLS)
    pairs = near_duplicates(igt, "ord", P7_COLS, 3, 5)
    return expanded(pairs, igt, "ord", P7_COLS).select(F.col("a").alias("ord_a"), F.col("b").alias("ord_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each example with its class of equal texts, its group of similar ones (60 % of their words, as in p7_found) and
    the number of different texts it is linked to."""
    from corpusloom.llm.neardup import grouped, near_duplicates

    igt = table(spark, d, "igt").select("ord", *P7_COLS)
    pairs = near_duplicates(igt, "ord", P7_COLS, 3, 5)
    return grouped(pairs, igt, "ord", P7_COLS).select(F.col("id").alias("ord"), "rep", F.col("grp").alias("group_id"), "links")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of each document."""
    from corpusloom.llm.encoding import encode

    return encode(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The ids of each document turned back into text: its digest and length."""
    from corpusloom.llm.encoding import decode

    texts = decode(p8_ids(spark, d), "doc_id", "ids")
    return texts.select("doc_id", F.md5("text").alias("text_md5"), F.char_length("text").alias("chars"))


#: Tokens that a container holds.
P9_CAPACITY = 2048


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document, in parts if it is larger than a container."""
    from corpusloom.llm.encoding import token_counts
    from corpusloom.llm.packing import pack

    sizes = token_counts(table(spark, d, "documents"), "doc_id", "text")
    return pack(sizes, "doc_id", "n_tokens", P9_CAPACITY).select("doc_id", "part", F.col("n").alias("n_tokens"), "container")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: tokens used, number of parts."""
    return p9_pack(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("parts"))


def p9_sound(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the packing: documents, containers over their capacity, documents split without need, documents
    whose parts don't add up to their tokens or aren't numbered from 0."""
    from corpusloom.llm.encoding import token_counts

    placed = p9_pack(spark, d)
    over = placed.groupBy("container").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > P9_CAPACITY).alias("over"))
    sizes = token_counts(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("n_tokens", "size")
    per = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"), F.max("part").alias("last"))
    both = sizes.join(per, "doc_id", "left")
    split = (F.col("parts") > 1) & (F.col("size") <= P9_CAPACITY)
    wrong = F.col("n").isNull() | (F.col("n") != F.col("size")) | (F.col("last") != F.col("parts") - 1)
    return both.agg(F.count("*").alias("documents"), F.count_if(split).alias("split"), F.count_if(wrong).alias("wrong")).crossJoin(over)


def _p10(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents and the accepted spans of their texts."""
    from corpusloom.llm.pii import fit, proposed, spans

    docs, names = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "name_list")
    spans_of = proposed(docs, "doc_id", names)
    return docs, spans(spans_of, "doc_id", fit(spans_of, names))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal information as it stands in the texts."""
    return _p10(spark, d)[1].select("doc_id", "kind", "val").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with placeholders."""
    from corpusloom.llm.pii import redacted

    docs, found = _p10(spark, d)
    return redacted(docs, "doc_id", found)


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p1_current, p3_found, p4_found, p4_forms, p5_found, p5_pieces, p5_rebuilt, p5_files, p6_found, p6_pairs, p6_partners, p7_found, p7_groups, p8_ids, p8_decoded, p9_pack, p9_containers, p9_sound, p10_found, p10_redacted)}

_TAGS = "r AS (SELECT list_distinct(v) AS u, v FROM (SELECT list_filter(gloss_tags, lambda t: t IS NOT NULL AND t <> '') AS v FROM igt) WHERE len(v) > 0), n AS (SELECT count(*) AS n FROM r)"
_COUNTS = f"{_TAGS}, o AS (SELECT tag, count(*) AS occurrences FROM (SELECT unnest(v) AS tag FROM r) GROUP BY tag), h AS (SELECT tag, count(*) AS records FROM (SELECT unnest(u) AS tag FROM r) GROUP BY tag)"
_MARK = "CASE WHEN records < 3 THEN 'rare' WHEN 5 * records > n THEN 'common' END"
_PAIRS = f"{_TAGS}, c AS (SELECT tag, count(*) AS k FROM (SELECT unnest(u) AS tag FROM r) GROUP BY tag), i AS (SELECT row_number() OVER () AS id, u FROM r), e AS (SELECT id, unnest(u) AS tag FROM i), p AS (SELECT x.tag AS tag_a, y.tag AS tag_b, count(*) AS n_ab FROM e x JOIN e y ON x.id = y.id AND x.tag < y.tag GROUP BY ALL), q AS (SELECT tag_a, tag_b, n_ab, a.k AS n_a, b.k AS n_b, n AS n_records FROM p JOIN c a ON a.tag = tag_a JOIN c b ON b.tag = tag_b CROSS JOIN n)"


def _cell(k: str, r: str, c: str) -> str:
    return f"CASE WHEN {k} > 0 THEN {k} * ln({k} * n_records::DOUBLE / (({r})::DOUBLE * ({c}))) ELSE 0 END"


_LLR = " + ".join(
    _cell(*x)
    for x in (
        ("n_ab", "n_a", "n_b"),
        ("(n_a - n_ab)", "n_a", "n_records - n_b"),
        ("(n_b - n_ab)", "n_records - n_a", "n_b"),
        ("(n_records - n_a - n_b + n_ab)", "n_records - n_a", "n_records - n_b"),
    )
)



def _form_sql(x: str) -> str:
    """The form of a text with every look-alike replaced, whether or not the vocabulary has the result: the relation of
    equal forms is the same on these tables."""
    import unicodedata

    from corpusloom.llm.lookalike import COMPOSED, LOOKALIKES

    wide = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFF5F)}
    one = wide | LOOKALIKES | {chr(c): " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)} | {chr(c): "-" for c in (0x2010, 0x2011, 0x2D7, 0xFE63)}
    q = lambda t: "'" + t.replace("'", "''") + "'"
    hidden = "[" + "".join(f"\\x{{{c:x}}}" for c in (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF)) + "]"
    out = f"regexp_replace({x}, {q(hidden)}, '', 'g')"
    for c in sorted(COMPOSED):
        d = unicodedata.normalize("NFD", c)
        if len(d) == 2:
            out = f"replace({out}, {q(c)}, {q(LOOKALIKES[d[0]] + d[1])})"
    return f"nfc_normalize(translate({out}, {q(''.join(one))}, {q(''.join(one.values()))}))"


#: SQL where DuckDB can say the same on whole tables.
ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_COUNTS} SELECT tag, {_MARK} AS mark FROM h CROSS JOIN n WHERE {_MARK} IS NOT NULL",
    "p1_counts": f"WITH {_COUNTS} SELECT tag, occurrences, records, {_MARK} AS mark FROM o JOIN h USING (tag) CROSS JOIN n",
    "p1_current": f"""WITH {_COUNTS.replace("FROM igt)", "FROM (SELECT * FROM igt QUALIFY row_number() OVER (PARTITION BY lang, CASE WHEN example_id <> '' THEN example_id ELSE chr(1) || ord END ORDER BY loaded_at DESC, ord DESC) = 1))")} SELECT tag, occurrences, records, {_MARK} AS mark FROM o JOIN h USING (tag) CROSS JOIN n""",
    "p3_found": f"""WITH a AS (SELECT 'igt' AS tbl, ord AS row_id, unnest(range(len(gloss_tags))) AS pos, unnest(gloss_tags) AS v FROM igt UNION ALL SELECT 'tag_profile', profile_id, 0, tag FROM tag_profile),
 b AS (SELECT * FROM a WHERE v IS NOT NULL AND v <> '' AND v NOT IN (SELECT tag FROM abbrev)),
 f AS (SELECT v, regexp_replace(regexp_replace(lower({_form_sql("v")}), '^[^a-z0-9]+', ''), '[^a-z0-9]+$', '') AS f FROM (SELECT DISTINCT v FROM b)), k AS (SELECT v, f, regexp_replace(f, '[\\s._:/-]+', '', 'g') AS k FROM f),
 n AS (SELECT tag, lower(tag) AS w, regexp_replace(lower(tag), '[\\s._:/-]+', '', 'g') AS k, false AS alias, NULL AS long FROM abbrev UNION ALL SELECT tag, lower(meaning), regexp_replace(lower(meaning), '[\\s._:/-]+', '', 'g'), true, tag FROM abbrev),
 j AS (SELECT k.v, n.tag, CASE WHEN k.k = n.k AND NOT n.alias THEN 1 WHEN k.k = n.k THEN 2 WHEN n.alias AND length(k.k) >= 4 AND starts_with(n.k, k.k) THEN 3 WHEN n.alias AND starts_with(k.f, lower(n.tag) || ' (') AND ends_with(k.f, n.w) THEN 4
  WHEN length(k.k) >= 4 AND (n.alias OR length(n.k) >= 6) AND damerau_levenshtein(k.k, n.k) <= 1 THEN 5 END AS tier FROM k CROSS JOIN n WHERE k.k <> ''),
 m AS (SELECT v, CASE WHEN count(DISTINCT tag) = 1 THEN min(tag) ELSE '' END AS canonical FROM (SELECT * FROM j WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY v)) GROUP BY v)
 SELECT tbl, row_id, pos, coalesce(canonical, '') AS canonical FROM b LEFT JOIN m USING (v)""",
    "p4_found": f"""WITH t AS (SELECT 'igt.source' AS field, ord, source AS x FROM igt UNION ALL SELECT 'igt.morpheme', ord, morpheme FROM igt UNION ALL SELECT 'chunk.text', ord, text FROM chunk),
 f AS (SELECT field, ord, x, {_form_sql("x")} AS form FROM t WHERE x <> '') SELECT a.field, a.ord AS ord_a, b.ord AS ord_b FROM f a JOIN f b ON a.field = b.field AND a.form = b.form AND a.ord < b.ord AND a.x <> b.x""",
    "p5_found": "SELECT 'chunk' AS tbl, ord FROM chunk WHERE length(text) > 2000 UNION ALL SELECT 'section_node', ord FROM section_node WHERE length(full_text) > 2000",
    "p6_found": f"WITH {_PAIRS} SELECT tag_a, tag_b FROM q WHERE n_ab >= 5 AND n_ab * n_records >= 3 * n_a * n_b",
    "p6_pairs": f"WITH {_PAIRS} SELECT tag_a, tag_b, n_ab, n_a, n_b, n_records, round(n_ab * n_records / (n_a * n_b), 6) AS lift, round(2 * ({_LLR}), 4) AS llr FROM q",
    "p5_rebuilt": "SELECT 'chunk' AS tbl, ord, md5(text) AS text_md5, true AS sound, true AS linked FROM chunk WHERE length(text) > 2000 UNION ALL SELECT 'section_node', ord, md5(full_text), true, true FROM section_node WHERE length(full_text) > 2000",
    "p6_partners": f"""WITH {_PAIRS}, b AS (SELECT tag_a AS item, tag_b AS partner, n_ab, round(2 * ({_LLR}), 6) AS llr FROM q UNION ALL SELECT tag_b, tag_a, n_ab, round(2 * ({_LLR}), 6) FROM q)
 SELECT item AS tag, row_number() OVER (PARTITION BY item ORDER BY llr DESC, n_ab DESC, partner) AS rank, partner, n_ab FROM b QUALIFY rank <= 10""",
    "p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, length(coalesce(text, '')) AS chars FROM documents",
    "p9_sound": "SELECT count(*) AS documents, 0 AS split, 0 AS wrong, 0 AS over FROM documents",
    "p7_found": """WITH t AS (SELECT ord, source, gloss, translation, list_distinct(list_filter(string_split(concat(coalesce(source, ''), ' ', coalesce(gloss, ''), ' ', coalesce(translation, '')), ' '), lambda x: x <> '')) AS w FROM igt),
 e AS (SELECT ord, len(w) AS l, unnest(w) AS w FROM t), f AS (SELECT w, count(*) AS n FROM e GROUP BY w), p AS (SELECT ord, e.w, l, row_number() OVER (PARTITION BY ord ORDER BY n, e.w) AS pos FROM e JOIN f USING (w)),
 k AS (SELECT * FROM p WHERE pos <= l - ceil(0.6 * l) + 1), c AS (SELECT DISTINCT a.ord AS ord_a, b.ord AS ord_b FROM k a JOIN k b ON a.w = b.w AND a.ord < b.ord AND a.l * 5 >= b.l * 3 AND b.l * 5 >= a.l * 3)
 SELECT ord_a, ord_b FROM c JOIN t a ON a.ord = ord_a JOIN t b ON b.ord = ord_b WHERE (coalesce(a.source, ''), coalesce(a.gloss, ''), coalesce(a.translation, '')) <> (coalesce(b.source, ''), coalesce(b.gloss, ''), coalesce(b.translation, ''))
 AND 5 * len(list_intersect(a.w, b.w)) >= 3 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))""",
}

_P7_CTES = ORACLES["p7_found"].removeprefix("WITH ").replace("\n SELECT ord_a, ord_b FROM c JOIN", ",\n pr AS (SELECT ord_a, ord_b FROM c JOIN", 1)
ORACLES["p7_groups"] = f"""WITH RECURSIVE {_P7_CTES}), cls AS (SELECT ord, min(ord) OVER (PARTITION BY coalesce(source, ''), coalesce(gloss, ''), coalesce(translation, '')) AS rep FROM igt),
 ce AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM pr JOIN cls a ON a.ord = ord_a JOIN cls b ON b.ord = ord_b WHERE a.rep <> b.rep), ed AS (SELECT a, b FROM ce UNION SELECT b, a FROM ce),
 rc AS (SELECT a, b FROM ed UNION SELECT rc.a, ed.b FROM rc JOIN ed ON ed.a = rc.b), g AS (SELECT a, least(a, min(b)) AS grp FROM rc GROUP BY a), l AS (SELECT a, count(*) AS links FROM ed GROUP BY a)
 SELECT ord, rep, coalesce(grp, rep) AS group_id, coalesce(links, 0) AS links FROM cls LEFT JOIN g ON g.a = rep LEFT JOIN l ON l.a = rep"""
