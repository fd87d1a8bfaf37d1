"""Queries of the core operators on the tables of a data directory, with SQL for DuckDB that gives the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import abbrev as ab
from corpusloom.functions.jsonrepair import repaired
from corpusloom.operators import evidence, retrieval, sections, stats, tools, verdicts
from corpusloom.operators.constants import ANTECEDENT_FAILS, CLAIM_PATTERNS, CLAIM_WEIGHTS, PARADIGM_SLOTS, SEMANTIC_CLUSTERS, TAG_CLUSTERS, TRANSLATION_STOP
from corpusloom.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _ex(spark: SparkSession, d: str) -> DataFrame:
    return stats.examples(table(spark, d, "igt"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return sections.chunk_view(table(spark, d, "chunk"))


_EX = """ex AS (SELECT ord, coalesce(lang,'') AS lang, coalesce(example_id,'') AS example_id, coalesce(source,'') AS source, coalesce(morpheme,'') AS morpheme,
 coalesce(gloss,'') AS gloss, coalesce(translation,'') AS translation, coalesce(chapter,'') AS chapter, coalesce(section,'') AS section, coalesce(subsection,'') AS subsection,
 coalesce(subsubsection,'') AS subsubsection, coalesce(source_section,'') AS source_section,
 coalesce(list_filter(gloss_tags, lambda t: t IS NOT NULL AND t <> ''), []::VARCHAR[]) AS tags,
 CASE WHEN coalesce(source_section,'') <> '' THEN source_section ELSE coalesce(section,'') END AS sec FROM igt)"""
_TOK = "tok AS (SELECT lang, ord, example_id, sec, translation, len(tags) AS n, unnest(range(len(tags))) AS i, unnest(tags) AS tag FROM ex)"
_SIZE = "size AS (SELECT lang, count(*) AS n_examples FROM ex GROUP BY lang)"
_PROF = """prof AS (SELECT lang, tag, cnt, n_holding, m, s, first, n_examples, cnt / n_examples AS coverage, round(m, 3) AS mean_pos, round(s, 3) AS std_pos FROM
 (SELECT lang, tag, count(*) AS cnt, count(DISTINCT ord) AS n_holding, round(avg(p), 9) AS m, round(coalesce(stddev_samp(p), 0), 9) AS s, min(ord * 1000 + i) AS first
  FROM (SELECT *, CASE WHEN n > 1 THEN i / (n - 1) ELSE 0.5 END AS p FROM tok) GROUP BY lang, tag) JOIN size USING (lang))"""
_PAIRS = """pairs AS (SELECT lang, a, b, count(*) AS cnt, min(first) AS first FROM (SELECT x.lang, least(x.tag, y.tag) AS a, greatest(x.tag, y.tag) AS b, (x.ord * 1000 + x.i) * 1000 + y.i AS first
 FROM tok x JOIN tok y ON x.ord = y.ord AND x.i < y.i) GROUP BY lang, a, b),
 partners AS (SELECT lang, a AS tag, b AS partner, cnt, first FROM pairs UNION ALL SELECT lang, b, a, cnt, first FROM pairs WHERE a <> b),
 top8 AS (SELECT lang, tag, partner, cnt, row_number() OVER (PARTITION BY lang, tag ORDER BY cnt DESC, first) AS rank FROM partners QUALIFY rank <= 8)"""
_BASE = f"WITH {_EX}, {_TOK}, {_SIZE}"


@query(f"""{_BASE}, {_PROF} SELECT lang, tag, cnt, round(coverage, 9) AS coverage, n_holding, mean_pos, std_pos,
 CASE WHEN s >= 0.15 THEN 'flexible' WHEN m < 0.25 THEN 'preverbal/initial' WHEN m > 0.75 THEN 'postverbal/final' ELSE 'medial-fixed' END AS position FROM prof""")
def tag_profile(spark, d):
    return stats.tag_profiles(_ex(spark, d)).withColumn("coverage", F.round("coverage", 9)).drop("first", "n_examples")


@query(f"{_BASE}, {_PAIRS} SELECT lang, tag, rank, partner, cnt FROM top8")
def tag_cooccurrence_top8(spark, d):
    return stats.top_cooccurrents(_ex(spark, d))


@query(f"""{_BASE} SELECT lang, tag, rank, sec, cnt FROM (SELECT *, row_number() OVER (PARTITION BY lang, tag ORDER BY cnt DESC, first) AS rank
 FROM (SELECT lang, tag, sec, count(*) AS cnt, min(ord * 1000 + i) AS first FROM tok GROUP BY lang, tag, sec)) WHERE rank <= 5""")
def tag_section_top5(spark, d):
    return stats.top_sections(_ex(spark, d))


def _grams(n: int) -> str:
    more = " || ".join(["tag", *[f"' ' || lead(tag, {k}) OVER w" for k in range(1, n)]])
    return f"grams AS (SELECT lang, ord, example_id, translation, i, gram FROM (SELECT *, {more} AS gram FROM tok WINDOW w AS (PARTITION BY ord ORDER BY i)) WHERE gram IS NOT NULL)"


def _frequent(k: int) -> str:
    return f"""freq AS (SELECT lang, gram, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, first) AS rank
 FROM (SELECT lang, gram, count(*) AS cnt, min(ord * 1000 + i) AS first FROM grams GROUP BY lang, gram HAVING count(*) >= 5) QUALIFY rank <= {k})"""


@query(f"{_BASE}, {_grams(2)}, {_frequent(40)} SELECT lang, rank, gram, cnt FROM freq")
def tag_bigrams(spark, d):
    return stats.frequent_ngrams(_ex(spark, d), 2, 40)


@query(f"{_BASE}, {_grams(3)}, {_frequent(20)} SELECT lang, rank, gram, cnt FROM freq")
def tag_trigrams(spark, d):
    return stats.frequent_ngrams(_ex(spark, d), 3, 20)


@query(f"""{_BASE}, {_grams(2)}, {_frequent(40)}, occ AS (SELECT g.*, f.rank, f.cnt, row_number() OVER (PARTITION BY g.lang, g.gram ORDER BY ord, i) AS r,
 sum(CASE WHEN translation <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY g.lang, g.gram ORDER BY ord, i ROWS UNBOUNDED PRECEDING) AS t FROM grams g JOIN freq f ON g.lang = f.lang AND g.gram = f.gram)
 SELECT lang, gram, rank, cnt, coalesce(string_agg(example_id, ' | ' ORDER BY r) FILTER (WHERE r <= 5), '') AS ids,
 coalesce(string_agg(substr(translation, 1, 80), ' | ' ORDER BY r) FILTER (WHERE translation <> '' AND t <= 3), '') AS translations FROM occ GROUP BY lang, gram, rank, cnt""")
def bigram_samples(spark, d):
    return stats.ngram_samples(_ex(spark, d))


def _values(name: str, values: dict) -> str:
    rows = ", ".join(f"('{k}', '{t}')" for k, ts in values.items() for t in ts)
    keys = ", ".join(f"('{k}')" for k in values)
    return f"""grp({name}, tag) AS (VALUES {rows}), keys({name}) AS (VALUES {keys}),
 found AS (SELECT lang, {name}, sum(cnt) AS hits, string_agg(tag, ' ' ORDER BY tag) AS present, count(*) AS forms FROM (SELECT lang, tag, count(*) AS cnt FROM tok GROUP BY lang, tag) JOIN grp USING (tag) GROUP BY lang, {name}),
 hits AS (SELECT lang, {name}, n_examples, coalesce(hits, 0)::BIGINT AS hits, coalesce(present, '') AS present, coalesce(forms, 0) AS forms FROM size CROSS JOIN keys LEFT JOIN found USING (lang, {name}))"""


@query(f"""{_BASE}, {_values('category', TAG_CLUSTERS)} SELECT lang, category, CASE WHEN hits = 0 THEN 'zero' ELSE 'marginal' END AS kind, hits, round(hits / n_examples, 4) AS rate, present
 FROM hits WHERE hits / n_examples < 0.005""")
def absent_categories(spark, d):
    return stats.absent_categories(_ex(spark, d))


@query(f"""{_BASE}, {_values('category', TAG_CLUSTERS)} SELECT lang, category, hits, round(hits / n_examples, 6) AS rate,
 CASE WHEN hits = 0 THEN 'STRONG ABSENCE' WHEN hits / n_examples < 0.01 THEN 'WEAK PRESENCE' WHEN hits / n_examples < 0.05 THEN 'LIMITED' ELSE 'PRESENT' END AS verdict FROM hits""")
def absence_verdict(spark, d):
    return stats.absence_verdicts(_ex(spark, d))


@query(f"{_BASE}, {_values('slot', PARADIGM_SLOTS)} SELECT lang, slot, hits, forms, present, hits > 0 AS attested FROM hits")
def paradigm_slots(spark, d):
    return stats.paradigm_slots(_ex(spark, d))


@query(f"""{_BASE}, t AS (SELECT lang, sec, tag, count(*) AS cnt, min(ord * 1000 + i) AS first FROM tok GROUP BY lang, sec, tag),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, sec ORDER BY cnt DESC, first) AS rank FROM t)
 SELECT lang, sec, n_examples, coalesce(n_tags, 0) AS n_tags, coalesce(top_tags, '') AS top_tags FROM (SELECT lang, sec, count(*) AS n_examples FROM ex GROUP BY lang, sec)
 LEFT JOIN (SELECT lang, sec, count(*) AS n_tags, string_agg(tag, ' ' ORDER BY rank) FILTER (WHERE rank <= 8) AS top_tags FROM r GROUP BY lang, sec) USING (lang, sec)""")
def section_richness(spark, d):
    return stats.section_richness(_ex(spark, d))


_RESOLVE = ["PST", "pst", "3sg", "c", "NOSUCHTAG"]


@query(f"""{_BASE}, {_PROF}, q(name) AS (VALUES {', '.join(f"('{x}')" for x in _RESOLVE)}),
 h AS (SELECT lang, name, tag, first, CASE WHEN tag = name THEN 0 WHEN tag = upper(name) THEN 1 WHEN starts_with(lower(tag), lower(name)) THEN 2 END AS tier FROM prof CROSS JOIN q),
 b AS (SELECT * FROM h WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY lang, name))
 SELECT lang, name, row_number() OVER (PARTITION BY lang, name ORDER BY first) AS rank, tag, tier FROM b QUALIFY rank <= 5""")
def tag_resolve(spark, d):
    return tools.resolve_tag(stats.tag_profiles(_ex(spark, d)), _RESOLVE)


@query(f"""{_BASE}, {_PROF}, q(name) AS (VALUES ('pst'), ('INC'), ('1')),
 h AS (SELECT lang, name, tag, first, CASE WHEN tag = upper(name) THEN 1 WHEN starts_with(tag, upper(name)) THEN 2 END AS tier FROM prof CROSS JOIN q),
 b AS (SELECT * FROM h WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY lang, name))
 SELECT lang, name, row_number() OVER (PARTITION BY lang, name ORDER BY first) AS rank, tag, tier FROM b QUALIFY rank <= 1""")
def tag_resolve_strict(spark, d):
    return tools.resolve_tag(stats.tag_profiles(_ex(spark, d)), ["pst", "INC", "1"], "strict")


@query(f"""{_BASE}, h AS (SELECT lang, ord, example_id, count(*) OVER (PARTITION BY lang) AS n_hits FROM (SELECT DISTINCT x.lang, x.ord, x.example_id FROM tok x JOIN tok y ON x.ord = y.ord AND y.i = x.i + 1 WHERE x.tag = 'PST' AND y.tag = 'NEG'))
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY ord) AS rank, ord, example_id, n_hits FROM h QUALIFY rank <= 8""")
def construction_search(spark, d):
    return tools.construction(_ex(spark, d), ["pst", "neg"])


_COMPARE = [("PST", "NEG"), ("3SG", "ERG"), ("PFV", "IPFV")]


@query(f"""{_BASE}, {_PROF}, q(tag_a, tag_b) AS (VALUES {', '.join(str(p) for p in _COMPARE)}),
 c AS (SELECT lang, tag_a, tag_b, count(*) AS cooc FROM ex CROSS JOIN q WHERE list_contains(tags, tag_a) AND list_contains(tags, tag_b) GROUP BY ALL),
 r AS (SELECT x.lang, q.tag_a, q.tag_b, x.cnt AS cnt_a, y.cnt AS cnt_b, coalesce(c.cooc, 0) AS cooc, x.n_examples AS n, x.mean_pos AS ma, y.mean_pos AS mb
  FROM q JOIN prof x ON x.tag = q.tag_a JOIN prof y ON y.tag = q.tag_b AND y.lang = x.lang LEFT JOIN c ON c.lang = x.lang AND c.tag_a = q.tag_a AND c.tag_b = q.tag_b),
 p AS (SELECT *, CASE WHEN cooc = 0 THEN '-inf'::DOUBLE ELSE log2(cooc * n / (cnt_a * cnt_b)) END AS pmi FROM r)
 SELECT lang, tag_a, tag_b, cnt_a, cnt_b, cooc, round(pmi, 6) AS pmi, CASE WHEN pmi > 1.5 THEN 'ATTRACT' WHEN pmi < -1 THEN 'REPEL' ELSE 'INDEPENDENT' END AS relation, abs(ma - mb) < 0.1 AS similar_position FROM p""")
def compare_tags(spark, d):
    return stats.compare_tags(_ex(spark, d), _COMPARE)


@query(f"""{_BASE}, {_PROF}, {_PAIRS}, r AS (SELECT t.lang, t.tag AS seed, t.partner, t.cnt AS cooc, x.cnt * y.cnt / x.n_examples AS expected FROM top8 t
 JOIN prof x ON x.lang = t.lang AND x.tag = t.tag JOIN prof y ON y.lang = t.lang AND y.tag = t.partner)
 SELECT lang, seed, row_number() OVER (PARTITION BY lang, seed ORDER BY pmi DESC, cooc DESC, partner) AS rank, partner, cooc, pmi FROM (SELECT *, round(log2(cooc / expected), 6) AS pmi FROM r WHERE expected >= 1) QUALIFY rank <= 12""")
def tag_cluster_pmi(spark, d):
    return stats.tag_neighbours(_ex(spark, d))


_LAST = {t: k for k, ts in TAG_CLUSTERS.items() for t in ts}


@query(f"""{_BASE}, {_PROF}, cl(tag, category) AS (VALUES {', '.join(str(x) for x in _LAST.items())})
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, first) AS rank, tag, cnt, coalesce(category, 'OTHER') AS category FROM prof LEFT JOIN cl USING (tag) QUALIFY rank <= 60""")
def tag_inventory(spark, d):
    return stats.tag_inventory(_ex(spark, d))


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"""{_BASE}, kw(domain, o, k) AS (VALUES {', '.join(f"('{dm}', {i}, {_lit(k)})" for i, (dm, ks) in enumerate(SEMANTIC_CLUSTERS.items()) for k in ks)}),
 tg AS (SELECT lang, ord, lower(translation) AS tr, count(*) OVER (PARTITION BY lang) AS n_tagged FROM ex WHERE list_contains(tags, 'PST')),
 h AS (SELECT lang, n_tagged, domain, o, count(DISTINCT ord) AS cnt FROM tg JOIN kw ON contains(tr, k) GROUP BY ALL)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, o) AS rank, domain, cnt, n_tagged FROM h""")
def semantic_context(spark, d):
    return tools.semantic_domains(_ex(spark, d), "pst")


@query(f"""{_BASE}, w AS (SELECT lang, ord, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM (SELECT lang, ord, regexp_extract_all(lower(translation), '\\b[a-z]{{3,}}\\b') AS ws FROM ex WHERE list_contains(tags, 'PST'))),
 f AS (SELECT lang, word, count(*) AS cnt, min(ord * 1000 + i) AS first FROM w WHERE word NOT IN ({', '.join(map(repr, TRANSLATION_STOP))}) GROUP BY lang, word)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, first) AS rank, word, cnt FROM f QUALIFY rank <= 15""")
def translation_words(spark, d):
    return tools.translation_words(_ex(spark, d), "PST")


@query(f"""{_BASE}, h AS (SELECT *, contains(lower(translation), 'young') AS hit, count(*) OVER (PARTITION BY lang) AS n_all FROM ex),
 k AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n_hits FROM h WHERE hit)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY ord) AS rank, ord, example_id, replace(replace(translation, 'young', '**young**'), 'Young', '**Young**') AS shown, n_hits, round(n_hits / n_all, 6) AS share FROM k QUALIFY rank <= 15""")
def search_translations(spark, d):
    return tools.search_translations(_ex(spark, d), " young ")


_QUESTION = "Does the language mark how a woman will throw or carry something across the river?"


def _discovery_sql() -> str:
    terms = ", ".join(f"({i}, {_lit(t)})" for i, t in enumerate(tools.question_terms(_QUESTION)))
    return f"""{_BASE}, {_PROF}, q(o, t) AS (VALUES {terms}), h AS (SELECT lang, ord, tags, o FROM ex JOIN q ON contains(lower(translation), t)),
 tot AS (SELECT lang, count(*) AS total_hits FROM h GROUP BY lang), c AS (SELECT lang, o, ord, unnest(range(len(tags))) AS i, unnest(tags) AS tag FROM h),
 s AS (SELECT lang, tag, count(*) AS cnt, min(o * 10000000000000 + ord * 1000 + i) AS first FROM c GROUP BY lang, tag),
 t20 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, first) AS r FROM s QUALIFY r <= 20)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY r) AS rank, tag, t20.cnt, total_hits FROM t20 JOIN tot USING (lang) JOIN prof USING (lang, tag)
 WHERE coverage <= 0.30 AND t20.cnt >= 2 AND t20.cnt / total_hits < 0.65 AND length(tag) >= 2 QUALIFY rank <= 6"""


@query(_discovery_sql())
def tag_discovery(spark, d):
    return tools.tags_for_question(_ex(spark, d), _QUESTION)


_SEC = "(contains(lower(source_section), 'tense') OR contains(lower(section), 'tense') OR contains(lower(chapter), 'tense') OR contains(lower(subsubsection), 'tense'))"


@query(f"{_BASE} SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY ord) AS rank, ord, example_id, sec FROM ex WHERE {_SEC} QUALIFY rank <= 15")
def section_igt(spark, d):
    return tools.section_examples(_ex(spark, d), "Tense")


@query(f"""WITH {_EX}, e2 AS (SELECT * FROM ex WHERE {_SEC}), tok AS (SELECT lang, ord, unnest(range(len(tags))) AS i, unnest(tags) AS tag FROM e2),
 f AS (SELECT lang, tag, count(*) AS cnt, min(ord * 1000 + i) AS first FROM tok GROUP BY lang, tag)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, first) AS rank, tag, cnt FROM f QUALIFY rank <= 10""")
def section_igt_tags(spark, d):
    return tools.section_tags(_ex(spark, d), "Tense")


@query(f"""{_BASE}, t AS (SELECT *, CASE WHEN list_contains(tags, 'prog') OR list_contains(tags, 'PROG') THEN 1 WHEN contains(lower(translation), 'prog') THEN 2 WHEN contains(lower(source_section), 'prog') THEN 3 END AS tier FROM ex),
 b AS (SELECT * FROM t WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY lang))
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY ord) AS rank, tier, ord, example_id FROM b QUALIFY rank <= 8""")
def triline_cascade(spark, d):
    return tools.trilines(_ex(spark, d), "prog")


@query(f"""{_BASE}, c AS (SELECT *, contains(lower(source_section), 'nouns') OR contains(lower(source_section), 'tense') AS pref FROM ex WHERE list_contains(tags, 'PST')),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, pref ORDER BY ord) AS rn, least(count(*) FILTER (WHERE pref) OVER (PARTITION BY lang), 5) AS quota FROM c),
 k AS (SELECT * FROM r WHERE (pref AND rn <= quota) OR (NOT pref AND rn <= 8 - quota))
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY pref DESC, ord) AS rank, pref, ord, example_id FROM k""")
def section_aware_ids(spark, d):
    return tools.section_aware(_ex(spark, d).filter(F.array_contains("tags", "PST")), ["Nouns", "Tense"])


_MORPH = """wd AS (SELECT lang, ord, unnest(range(k)) AS w, unnest(ms[1:k]) AS word, unnest(gs[1:k]) AS gl FROM (SELECT lang, ord, ms, gs, least(len(ms), len(gs)) AS k FROM
 (SELECT lang, ord, list_filter(string_split_regex(trim(morpheme), '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '') AS ms, list_filter(string_split_regex(trim(gloss), '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '') AS gs FROM ex WHERE list_contains(tags, 'PST'))) WHERE k > 0),
 mo AS (SELECT lang, ord, w, len(a) AS n, unnest(range(len(a))) AS m, unnest(a) AS form, unnest(b) AS g FROM (SELECT *, string_split_regex(word, '[-=]') AS a, string_split_regex(gl, '[-=]') AS b FROM wd) WHERE len(a) = len(b)),
 hit AS (SELECT * FROM mo WHERE g = 'PST' OR starts_with(g, 'PST.'))"""


@query(f"""{_BASE}, {_MORPH}, f AS (SELECT lang, form, count(*) AS cnt, min((ord * 1000 + w) * 1000 + m) AS first FROM hit GROUP BY lang, form)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, first) AS rank, form, cnt FROM f QUALIFY rank <= 8""")
def morpheme_forms(spark, d):
    return tools.surface_forms(_ex(spark, d), "PST")


@query(f"""{_BASE}, {_MORPH}, s AS (SELECT lang, CASE WHEN n = 1 THEN 'stem' WHEN m = 0 THEN 'prefix' WHEN m = n - 1 THEN 'suffix' ELSE 'medial' END AS slot FROM hit),
 c AS (SELECT lang, count(*) FILTER (WHERE slot = 'prefix') AS prefix, count(*) FILTER (WHERE slot = 'suffix') AS suffix, count(*) FILTER (WHERE slot = 'stem') AS stem, count(*) FILTER (WHERE slot = 'medial') AS medial, count(*) AS total FROM s GROUP BY lang)
 SELECT *, CASE greatest(prefix, suffix, stem, medial) WHEN prefix THEN 'prefix' WHEN suffix THEN 'suffix' WHEN stem THEN 'stem' ELSE 'medial' END AS dominant FROM c""")
def morpheme_position(spark, d):
    return tools.morpheme_positions(_ex(spark, d), "PST")


@query(f"""{_BASE}, s AS (SELECT *, 2 * (list_contains(tags, 'PST')::INT + list_contains(tags, 'NEG')::INT) + (contains(lower(translation), 'young') OR contains(lower(gloss), 'young'))::INT + (contains(lower(translation), 'river') OR contains(lower(gloss), 'river'))::INT AS score FROM ex)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, ord DESC) AS rank, ord, example_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""")
def igt_candidates(spark, d):
    return tools.candidates(_ex(spark, d), ["PST", "NEG"], "a young man by the river")


@query(f"""{_BASE}, t AS (SELECT lang, tag, count(*) AS n, min(ord * 1000 + i) AS first FROM tok GROUP BY lang, tag), s AS (SELECT lang, source_section AS tag, count(*) AS n, min(ord) AS first FROM ex WHERE source_section <> '' GROUP BY ALL)
 SELECT lang, 'tag' AS part, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first) AS rank, tag AS name, n FROM t QUALIFY rank <= 50
 UNION ALL SELECT lang, 'place', row_number() OVER (PARTITION BY lang ORDER BY n DESC, first) AS rank, tag, n FROM s QUALIFY rank <= 20
 UNION ALL SELECT lang, 'examples', 1, '', n_examples FROM size UNION ALL SELECT coalesce(lang, ''), 'tones', 1, '', count(*) FROM igt WHERE tones <> '' GROUP BY ALL UNION ALL SELECT lang, 'tags', 1, '', count(*) FROM t GROUP BY lang""")
def gloss_statistics(spark, d):
    return stats.gloss_statistics(_ex(spark, d))


@query(f"""{_BASE}, s AS (SELECT *, (contains(upper(gloss), 'YOUNG') OR contains(upper(translation), 'YOUNG') OR list_contains(tags, 'YOUNG'))::INT + (contains(upper(gloss), 'PST') OR contains(upper(translation), 'PST') OR list_contains(tags, 'PST'))::INT AS score FROM ex)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, ord DESC) AS rank, ord, example_id, score FROM s WHERE score > 0 QUALIFY rank <= 5""")
def keyword_examples(spark, d):
    return tools.keyword_examples(_ex(spark, d), "a young PST")


@query(f"{_BASE} SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY ord) AS rank, ord, example_id FROM ex WHERE list_has_any(tags, {TAG_CLUSTERS['NEGATION']}) QUALIFY rank <= 8")
def category_examples(spark, d):
    return tools.category_examples(_ex(spark, d), "NEGATION")


def _asked_ids(spark, d):
    """Ids to look up: the chunks of each assembled section, every second one as a sub-chunk that doesn't exist."""
    s = table(spark, d, "section_node").select("lang", "ord", F.posexplode("chunk_ids").alias("i", "c"))
    return s.select("lang", (F.col("ord") * 100000 + F.col("i")).alias("pos"), F.when(F.col("i") % 2 == 0, F.col("c")).otherwise(F.concat("c", F.lit("_p1"))).alias("id")).filter("lang is not null and id is not null")


@query("""WITH a AS (SELECT lang, ord * 100000 + i AS pos, CASE WHEN i % 2 = 0 THEN c ELSE c || '_p1' END AS id FROM (SELECT lang, ord, unnest(range(len(chunk_ids))) AS i, unnest(chunk_ids) AS c FROM section_node)),
 o AS (SELECT lang, id, min(pos) AS pos FROM a WHERE lang IS NOT NULL AND id IS NOT NULL GROUP BY lang, id), s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pos) AS rank FROM o QUALIFY rank <= 12),
 l AS (SELECT coalesce(lang, '') AS lang, coalesce(chunk_id, '') AS chunk_id, arg_max(coalesce(summary, ''), ord) AS summary FROM chunk GROUP BY ALL)
 SELECT s.lang, rank, id, coalesce(x.summary, y.summary) AS summary FROM s LEFT JOIN l x ON x.lang = s.lang AND x.chunk_id = s.id LEFT JOIN l y ON y.lang = s.lang AND y.chunk_id = regexp_replace(s.id, '_p[0-9]+$', '') WHERE coalesce(x.summary, y.summary) <> ''""")
def summaries_fallback_join(spark, d):
    return tools.summaries(_asked_ids(spark, d), _chunks(spark, d))


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY lang, example_id ORDER BY ord DESC) AS r FROM igt WHERE example_id <> '' AND lang IS NOT NULL),
 a AS (SELECT lang, raw_id AS pos, example_id AS id FROM igt_raw)
 SELECT a.lang, a.pos, a.id, i.ord, coalesce(i.translation, '') AS translation FROM a JOIN i ON i.lang = a.lang AND i.example_id = a.id AND r = 1""")
def lookup_examples(spark, d):
    ids = table(spark, d, "igt_raw").select("lang", F.col("raw_id").alias("pos"), F.col("example_id").alias("id"))
    return tools.lookup(ids, _ex(spark, d).filter("example_id <> ''"), "example_id").select("lang", "pos", "id", "ord", "translation")


@query("""WITH r AS (SELECT lang AS language, example_coverage AS confidence FROM tag_profile WHERE lang IS NOT NULL)
 SELECT language, count(*) AS n, count(*) FILTER (WHERE coalesce(confidence, 0) >= 0.75) AS confirmed, count(*) FILTER (WHERE coalesce(confidence, 0) < 0.75) AS uncertain FROM r GROUP BY language""")
def confirmed_split(spark, d):
    return verdicts.confirmed_split(table(spark, d, "tag_profile").filter("lang is not null").select(F.col("lang").alias("language"), F.col("example_coverage").alias("confidence")))


# ---- retrieval ------------------------------------------------------------------------------------------------------

_BM25_QUERY = "negation of past tense clauses; negation in questions"


def _bm25_sql(k: int, name: str = "b") -> str:
    import re

    q = re.findall("[a-z0-9]+", _BM25_QUERY)
    vals = ", ".join(f"('{t}', {q.count(t)})" for t in dict.fromkeys(q))
    return f"""docs AS (SELECT ord AS doc, regexp_extract_all(lower(concat_ws(' ', coalesce(chapter,''), coalesce(section,''), coalesce(subsection,''), coalesce(text,''))), '[a-z0-9]+') AS ts FROM chunk),
 st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM docs), q(term, qtf) AS (VALUES {vals}),
 p AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(ts) AS dl, unnest(ts) AS term FROM docs) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
 {name} AS (SELECT doc, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN df USING (term) JOIN q USING (term) CROSS JOIN st GROUP BY doc ORDER BY score DESC, doc LIMIT {k})"""


def _chunk_docs(spark, d):
    v = _chunks(spark, d)
    return v.select("ord", F.concat_ws(" ", "chapter", "section", "subsection", "text").alias("text"))


@query(f"WITH {_bm25_sql(20)} SELECT row_number() OVER (ORDER BY score DESC, doc) AS rank, doc, score FROM b WHERE score > 0")
def bm25_topk(spark, d):
    return retrieval.bm25(_chunk_docs(spark, d), "ord", "text", _BM25_QUERY, 20)


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM documents), p AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY ALL)
 SELECT term, count(*) AS df, sum(c)::BIGINT AS tf, round(ln(((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM p GROUP BY term""")
def bm25_statistics(spark, d):
    return retrieval.term_statistics(table(spark, d, "documents"), "doc_id", "text")


_DOT = "list_sum(list_transform(list_zip(e.embedding, qv.v), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_DENSE = f"""qv AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), dn AS (SELECT e.vec_id AS doc, round({_DOT} / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(qv.v, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-9), 6) AS score FROM embeddings e CROSS JOIN qv)"""


def _query_vector(spark, d):
    return table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]


@query(f"WITH {_DENSE} SELECT row_number() OVER (ORDER BY score DESC, doc) AS rank, doc, score FROM dn ORDER BY score DESC, doc LIMIT 10")
def dense_topk(spark, d):
    return retrieval.dense(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 10)


@query(f"""WITH {_bm25_sql(25)}, {_DENSE}, s AS (SELECT doc, score FROM dn ORDER BY score DESC, doc LIMIT 25), f AS (SELECT doc, round(0.5 * coalesce(s.score, 0) + 0.5 * coalesce(b.score / (SELECT max(score) FROM b), 0), 6) AS score FROM s FULL JOIN b USING (doc))
 SELECT row_number() OVER (ORDER BY score DESC, doc) AS rank, doc, score FROM f ORDER BY score DESC, doc LIMIT 5""")
def hybrid_fusion(spark, d):
    lex = retrieval.bm25(_chunk_docs(spark, d), "ord", "text", _BM25_QUERY, 25)
    sem = retrieval.dense(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 25)
    return retrieval.fuse(lex, sem, 5)


@query()
def mmr_rerank(spark, d):
    e = table(spark, d, "embeddings")
    pool = retrieval.dense(e, "vec_id", "embedding", _query_vector(spark, d), 25)
    vec = e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"))
    return retrieval.mmr(pool.join(vec, "doc").select(F.lit("q0").alias("query"), "doc", "score", "vec"))


# ---- sections -------------------------------------------------------------------------------------------------------

_HEAD = "^(?:chapter\\s+\\d+|section\\s+\\d+|§[\\d.]+|\\d+\\.(?:\\d+\\.?)*)\\s*.+$"


@query(f"""WITH l AS (SELECT ord, unnest(range(len(ls))) AS ln, unnest(ls) AS line FROM (SELECT ord, string_split(coalesce(text, ''), chr(10)) AS ls FROM chunk)),
 h AS (SELECT *, regexp_matches(lower(trim(line)), '{_HEAD}') AS head FROM l),
 k AS (SELECT *, CASE WHEN head AND starts_with(lower(trim(line)), 'chapter') THEN 1 WHEN head AND regexp_matches(trim(line), '^§\\d+\\.\\d+\\.\\d+') THEN 3 WHEN head THEN 2 END AS kind FROM h),
 g AS (SELECT *, sum(head::INT) OVER w AS grp, max(CASE WHEN kind = 1 THEN ln END) OVER w AS c_at, max(CASE WHEN kind = 2 THEN ln END) OVER w AS s_at, max(CASE WHEN kind = 3 THEN ln END) OVER w AS u_at FROM k WINDOW w AS (PARTITION BY ord ORDER BY ln)),
 n AS (SELECT *, (row_number() OVER (PARTITION BY ord, grp ORDER BY ln) - 1) // 61 AS part, CASE WHEN c_at IS NULL THEN '' ELSE c_at::VARCHAR END AS c, CASE WHEN s_at IS NULL OR s_at < coalesce(c_at, -1) THEN -1 ELSE s_at END AS s, CASE WHEN u_at IS NULL OR u_at < greatest(coalesce(c_at, -1), coalesce(s_at, -1)) THEN -1 ELSE u_at END AS u FROM g),
 t AS (SELECT ord, grp, part, trim(string_agg(line, chr(10) ORDER BY ln)) AS text, max(s) AS s, max(u) AS u FROM n GROUP BY ord, grp, part)
 SELECT t.ord, row_number() OVER (PARTITION BY t.ord ORDER BY grp, part) - 1 AS no, t.text, coalesce(trim(a.line), '') AS section, coalesce(trim(b.line), '') AS subsection FROM t LEFT JOIN l a ON a.ord = t.ord AND a.ln = t.s LEFT JOIN l b ON b.ord = t.ord AND b.ln = t.u WHERE length(t.text) > 50""")
def plain_text_chunks(spark, d):
    return sections.plain_chunks(table(spark, d, "chunk"), "ord", "text").drop("chapter")


_CH = "ch AS (SELECT ord, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in ("lang", "chunk_id", "text", "chapter", "section", "subsection", "subsubsection", "label", "summary")) + " FROM chunk)"
_SECTION = f"""{_CH}, sn AS (SELECT lang, chapter, section, subsection, subsubsection, arg_min(chunk_id, (chunk_id, ord)) AS section_id, arg_min(label, (chunk_id, ord)) AS label,
 string_agg(text, chr(10) || chr(10) ORDER BY chunk_id, ord) AS full_text, string_agg(chunk_id, ' ' ORDER BY chunk_id, ord) AS chunk_ids, min(ord) AS first FROM ch GROUP BY lang, chapter, section, subsection, subsubsection)"""


@query(f"""WITH {_SECTION} SELECT lang, section_id, chapter, section, subsection, subsubsection, label, CASE WHEN subsubsection <> '' THEN 4 WHEN subsection <> '' THEN 3 WHEN section <> '' THEN 2 ELSE 1 END AS level, md5(full_text) AS text_md5, length(full_text) AS char_count, chunk_ids FROM sn""")
def section_assembly(spark, d):
    s = sections.assemble(_chunks(spark, d))
    return s.select("lang", "section_id", *sections.NAMES, "label", "level", F.md5("full_text").alias("text_md5"), F.col("char_count").cast("long").alias("char_count"), F.array_join("chunk_ids", " ").alias("chunk_ids"))


_REFS = """rf AS (SELECT lang, section_id, first, unnest(list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(full_text, '(?i)(?:see|cf\\.?|→|discussed in|see also|as in)\\s+(?:§|section|chapter)?\\s*([\\d.]+)', 1),
 regexp_extract_all(full_text, '§\\s*([\\d.]+)', 1), regexp_extract_all(full_text, '\\\\label\\{(sec:[^}]+)\\}', 1), regexp_extract_all(full_text, '\\\\ref\\{(sec:[^}]+)\\}', 1)), lambda r: r <> '')))) AS ref FROM sn)"""


@query(f"WITH {_SECTION}, {_REFS} SELECT lang, section_id, first, ref FROM rf")
def xref_extract(spark, d):
    return sections.assemble(_chunks(spark, d)).select("lang", "section_id", "first", F.explode("outgoing_refs").alias("ref"))


_LINKS = f"""lb AS (SELECT lang, label, arg_max(section_id, first) AS last_id, min(first) AS f, arg_min(section_id, first) AS f_id FROM sn WHERE label <> '' GROUP BY lang, label),
 nr AS (SELECT a.lang, a.ref, max(CASE WHEN lb.label = a.ref THEN last_id END) AS exact, arg_min(f_id, f) AS near FROM (SELECT DISTINCT lang, ref FROM rf) a JOIN lb ON lb.lang = a.lang AND contains(lb.label, a.ref) GROUP BY a.lang, a.ref)"""


@query(f"""WITH {_SECTION}, {_REFS}, {_LINKS}
 SELECT rf.lang, rf.ref, rf.section_id AS src, coalesce(exact, near) AS dst FROM rf JOIN nr ON nr.lang = rf.lang AND nr.ref = rf.ref""")
def xref_resolved(spark, d):
    return sections.resolved_refs(sections.assemble(_chunks(spark, d)))


def _hits(col: str) -> str:
    return "(" + " + ".join(f"contains({col}, '{w}')::INT" for w in ("tense", "and", "aspect")) + ")"


@query(f"""WITH {_SECTION}, {_REFS}, {_LINKS}, e AS (SELECT DISTINCT rf.lang, rf.section_id AS src, coalesce(exact, near) AS dst FROM rf JOIN nr ON nr.lang = rf.lang AND nr.ref = rf.ref),
 s AS (SELECT lang, section_id, first, round({_hits('lower(concat_ws(chr(32), chapter, section, subsection, subsubsection))')} + 0.4 * {_hits('lower(full_text)')} + CASE WHEN contains(lower(section), 'tense and aspect') OR contains(lower(subsection), 'tense and aspect') OR contains(lower(subsubsection), 'tense and aspect') THEN 5 ELSE 0 END, 1) AS score FROM sn),
 h0 AS (SELECT lang, section_id AS id FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, first) <= 3),
 h1 AS (SELECT DISTINCT e.lang, dst AS id FROM h0 JOIN e ON e.lang = h0.lang AND e.src = h0.id WHERE (e.lang, dst) NOT IN (SELECT (lang, id) FROM h0)),
 h2 AS (SELECT DISTINCT e.lang, dst AS id FROM h1 JOIN e ON e.lang = h1.lang AND e.src = h1.id WHERE (e.lang, dst) NOT IN (SELECT (lang, id) FROM h0) AND (e.lang, dst) NOT IN (SELECT (lang, id) FROM h1))
 SELECT lang, id, 0 AS hop FROM h0 UNION ALL SELECT lang, id, 1 FROM h1 UNION ALL SELECT lang, id, 2 FROM h2""")
def xref_2hop(spark, d):
    s = sections.assemble(_chunks(spark, d)).withColumn("key_terms", F.array().cast("array<string>"))
    return sections.follow_refs(s, "tense and aspect")


@query()
def xref_2hop_terms(spark, d):
    return sections.follow_refs(sections.with_key_terms(sections.assemble(_chunks(spark, d))), "tense and aspect")


@query()
def key_terms(spark, d):
    return sections.key_terms(sections.assemble(_chunks(spark, d)))


@query(f"""WITH {_SECTION},
 s AS (SELECT lang, section_id, first, round((contains(hd, 'tense')::INT + contains(hd, 'verbs')::INT) + 0.4 * (contains(lower(full_text), 'tense')::INT + contains(lower(full_text), 'verbs')::INT)
 + CASE WHEN contains(lower(section), 'tense verbs') OR contains(lower(subsection), 'tense verbs') OR contains(lower(subsubsection), 'tense verbs') THEN 5 ELSE 0 END, 1) AS score FROM (SELECT *, lower(concat_ws(' ', chapter, section, subsection, subsubsection)) AS hd FROM sn))
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, first) AS rank, section_id, score FROM s WHERE score > 0 QUALIFY rank <= 8""")
def section_search(spark, d):
    s = sections.assemble(_chunks(spark, d)).withColumn("key_terms", F.array().cast("array<string>"))
    return sections.search_sections(s, "Tense verbs").select("lang", "rank", "section_id", F.col("score").cast("double").alias("score"))


@query()
def section_search_terms(spark, d):
    s = sections.with_key_terms(sections.assemble(_chunks(spark, d)))
    return sections.search_sections(s, "past tense suffix").select("lang", "rank", "section_id", F.col("score").cast("double").alias("score"))


@query()
def author_claims(spark, d):
    s = sections.with_key_terms(sections.assemble(_chunks(spark, d)))
    return sections.author_claims(sections.search_sections(s, "negation"))


@query(f"""WITH {_CH}, n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ord) AS n FROM ch), t AS (SELECT lang, chunk_id AS target, n AS tn, ord AS tord FROM n WHERE starts_with(label, 'sec:1.'))
 SELECT t.lang, target, tord, n.n - tn AS "offset", n.chunk_id, substr(n.text, 1, 600) AS text FROM t JOIN n ON n.lang = t.lang AND n.n BETWEEN tn - 2 AND tn + 2""")
def context_window(spark, d):
    v = _chunks(spark, d)
    hit = v.filter(F.startswith("label", F.lit("sec:1.")))
    # a target is a row: ids that were loaded twice are told apart by ord
    keyed = v.withColumn("chunk_id", F.concat_ws("\u0001", "chunk_id", "ord"))
    w = tools.context_window(keyed, hit.select("lang", F.concat_ws("\u0001", "chunk_id", "ord").alias("chunk_id")))
    plain = lambda c: F.substring_index(c, "\u0001", 1)
    return w.withColumn("target", plain("target")).withColumn("chunk_id", plain("chunk_id"))


@query(f"""WITH {_CH}, n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ord) AS n FROM ch)
 SELECT t.lang, t.chunk_id AS target, t.ord AS tord, n.n - t.n AS "offset", n.chunk_id, substr(n.text, 1, 600) AS text FROM n t JOIN n ON n.lang = t.lang AND n.n BETWEEN t.n - 2 AND t.n + 2""")
def context_window_all(spark, d):
    # context_window's SQL takes labels of sec:1. only; this one takes every chunk
    return tools.context_window(_chunks(spark, d))


@query(f"""WITH {_CH}, f AS (SELECT lang, chapter, section, subsection, subsubsection, min(ord) AS ord FROM ch GROUP BY ALL)
 SELECT f.lang, row_number() OVER (PARTITION BY f.lang ORDER BY f.ord) AS rank, c.chunk_id, f.chapter, f.section, CASE WHEN f.subsubsection <> '' THEN 4 WHEN f.subsection <> '' THEN 3 WHEN f.section <> '' THEN 2 ELSE 1 END AS level, c.label FROM f JOIN ch c ON c.ord = f.ord QUALIFY rank <= 300""")
def toc_first_chunk(spark, d):
    return sections.contents(_chunks(spark, d)).drop("ord")


@query(f"""WITH {_CH}, f AS (SELECT lang, chapter, section, subsection, subsubsection, min(ord) AS ord FROM ch GROUP BY ALL), t AS (SELECT f.lang, row_number() OVER (PARTITION BY f.lang ORDER BY f.ord) AS rank, f.chapter || ' > ' || f.section AS header, c.summary FROM f JOIN ch c ON c.ord = f.ord)
 SELECT lang, rank, header, used FROM (SELECT *, sum(length(header) + length(summary)) OVER (PARTITION BY lang ORDER BY rank) AS used FROM t WHERE rank <= 300) WHERE used <= 3000""")
def toc_digest(spark, d):
    v = _chunks(spark, d)
    toc = sections.contents(v).join(v.select("ord", "summary"), "ord")
    return sections.digest(toc.withColumn("header", F.concat_ws(" > ", "chapter", "section"))).select("lang", "rank", "header", "used")


# ---- dictionary -----------------------------------------------------------------------------------------------------


@query(f"""{_BASE} SELECT lang, tok.tag, count(*) AS cnt, coalesce(meaning, tok.tag) AS label, CASE WHEN meaning IS NULL THEN upper(tok.tag) ELSE upper(tok.tag) || ' (' || meaning || ')' END AS expanded FROM tok LEFT JOIN abbrev a ON a.tag = upper(tok.tag) GROUP BY lang, tok.tag, meaning""")
def abbrev_lookup(spark, d):
    t = stats.tokens(_ex(spark, d)).groupBy("lang", "tag").agg(F.count("*").alias("cnt"))
    return ab.labelled(t, table(spark, d, "abbrev"))


@query("""WITH w(w) AS (VALUES ('definite'), ('past'), ('person'), ('plural')), s AS (SELECT tag, meaning, ord, sum(CASE WHEN list_contains(regexp_extract_all(lower(meaning), '[a-z]{3,}'), w) THEN 2 WHEN contains(lower(meaning), w) THEN 1 ELSE 0 END + CASE WHEN contains(lower(tag), w) THEN 1 ELSE 0 END)::INT AS score FROM abbrev CROSS JOIN w GROUP BY ALL)
 SELECT row_number() OVER (ORDER BY score DESC, ord) AS rank, tag, meaning, score FROM s WHERE score > 0 ORDER BY rank LIMIT 10""")
def abbrev_phenomenon(spark, d):
    return ab.for_phenomenon(table(spark, d, "abbrev"), "definite person plural in the past")


@query()
def annotate_text(spark, d):
    c = table(spark, d, "chunk").select("ord", F.coalesce("text", F.lit("")).alias("text"))
    return ab.annotate(c, "text", table(spark, d, "abbrev")).select("ord", F.md5("annotated").alias("annotated_md5"), F.length("annotated").alias("chars"))


# ---- evidence -------------------------------------------------------------------------------------------------------

_TYPES = {"click": "grammar_statement", "view": "igt_pattern", "purchase": "absence_evidence", "signup": "counter_evidence", "error": "author_caveat"}


def _claims(spark, d):
    """Claims out of events: one graph per user, type by event type, confidence from value, side from the id."""
    e = table(spark, d, "events")
    kind = F.lit("inference")
    for k, t in _TYPES.items():
        kind = F.when(F.col("event_type") == k, t).otherwise(kind)
    side = F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False)
    conf = F.round(F.pmod(F.floor(F.col("value") * 7), F.lit(100)) / 100, 2)
    return e.select(
        F.col("user_id").cast("string").alias("graph_id"), F.col("event_id").alias("seq"), kind.alias("claim_type"), F.col("props").alias("text"), F.col("event_type").alias("source"),
        conf.alias("confidence"), side.alias("supports"), F.array(F.format_string("ex:%d", F.col("event_id") % 50), F.format_string("chunk_%d", F.col("event_id") % 7)).alias("igt_examples"),
    )


_CLAIMS = f"""cl AS (SELECT user_id::VARCHAR AS graph_id, event_id AS seq, CASE event_type {' '.join(f"WHEN '{k}' THEN '{t}'" for k, t in _TYPES.items())} ELSE 'inference' END AS claim_type, props AS text, event_type AS source,
 round((floor(value * 7)::BIGINT % 100) / 100, 2) AS confidence, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS supports, 'ex:' || (event_id % 50) AS example_id FROM events)"""


@query(f"""WITH {_CLAIMS} SELECT a.graph_id, a.seq AS seq_a, b.seq AS seq_b, a.confidence AS conf_a, b.confidence AS conf_b FROM cl a JOIN cl b ON a.graph_id = b.graph_id AND a.seq < b.seq AND a.supports <> b.supports WHERE a.confidence >= 0.6 AND b.confidence >= 0.6""")
def contradictions(spark, d):
    return evidence.contradictions(_claims(spark, d))


_W = "CASE claim_type " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in CLAIM_WEIGHTS.items()) + " ELSE 0.8 END"
_CONFIDENCE = f"""{_CLAIMS}, g AS (SELECT graph_id, count(*) FILTER (WHERE supports) AS ns, count(*) FILTER (WHERE NOT supports) AS nc,
 coalesce(sum(CASE WHEN supports THEN 1 WHEN NOT supports THEN -1 END * {_W} * ln(least(greatest(confidence, 0.01), 0.99) / (1 - least(greatest(confidence, 0.01), 0.99)))), 0) AS lo, max(confidence) FILTER (WHERE NOT supports) AS ta,
 count(*) FILTER (WHERE supports AND confidence >= 0.6) * count(*) FILTER (WHERE NOT supports AND confidence >= 0.6) AS n_contradictions FROM cl GROUP BY graph_id),
 r AS (SELECT *, round(1 / (1 + exp(-CASE WHEN ns > 0 AND nc > 0 THEN lo / sqrt(ns + nc) ELSE lo END)), 9) AS raw FROM g)"""


@query(f"""WITH {_CONFIDENCE} SELECT graph_id, ns, nc, n_contradictions, CASE WHEN ns = 0 AND nc = 0 THEN 'Unclear' WHEN n_contradictions > 0 AND ta > 0.7 THEN 'Partial' WHEN raw >= 0.75 THEN 'Yes' WHEN raw <= 0.3 THEN 'No' WHEN raw BETWEEN 0.45 AND 0.6 THEN 'Unclear' ELSE 'Partial' END AS verdict,
 round(CASE WHEN ns = 0 AND nc = 0 THEN 0 WHEN n_contradictions > 0 AND ta > 0.7 THEN least(0.6, raw) WHEN raw >= 0.75 THEN raw WHEN raw <= 0.3 THEN 1 - raw WHEN raw BETWEEN 0.45 AND 0.6 THEN 0.4 ELSE raw END, 4) AS confidence FROM r""")
def evidence_confidence(spark, d):
    return evidence.confidence(_claims(spark, d))


@query(f"""WITH {_CLAIMS}, m AS (SELECT graph_id, max(confidence) FILTER (WHERE supports AND confidence >= 0.6) AS y, max(confidence) FILTER (WHERE NOT supports AND confidence >= 0.6) AS n FROM cl GROUP BY graph_id)
 SELECT graph_id, seq, confidence, CASE WHEN confidence >= 0.6 AND ((supports AND n - confidence > 0.25) OR (NOT supports AND y - confidence > 0.25)) THEN NULL ELSE supports END AS supports FROM cl JOIN m USING (graph_id)""")
def contradiction_resolution(spark, d):
    return evidence.resolve_by_strength(_claims(spark, d)).select("graph_id", "seq", "confidence", "supports")


@query(f"""WITH {_CLAIMS}, g AS (SELECT graph_id, bool_or(claim_type = 'grammar_statement') AS a, bool_or(claim_type = 'igt_pattern') AS b, bool_or(claim_type = 'absence_evidence') AS c, count(*) FILTER (WHERE NOT supports) > 0 AS e,
 count(*) FILTER (WHERE supports AND confidence >= 0.6) * count(*) FILTER (WHERE NOT supports AND confidence >= 0.6) AS x, count(*) FILTER (WHERE claim_type IN ('igt_pattern', 'absence_evidence')) AS n_igt, count(*) FILTER (WHERE claim_type IN ('igt_pattern', 'absence_evidence') AND confidence >= 0.6) AS n_sure FROM cl GROUP BY graph_id)
 SELECT graph_id, concat_ws('; ', CASE WHEN NOT a THEN 'grammar prose' END, CASE WHEN NOT b THEN 'igt pattern' END, CASE WHEN NOT c THEN 'absence check' END, CASE WHEN NOT e THEN 'counter-evidence' END, CASE WHEN x > 0 THEN 'contradictions' END) AS gaps,
 CASE WHEN n_igt = 0 THEN 'none' WHEN n_sure = 0 OR n_igt = 1 THEN 'limited' ELSE '' END AS coverage, n_igt, n_sure FROM g""")
def evidence_gaps(spark, d):
    return evidence.gaps(_claims(spark, d))


@query(f"""WITH {_CLAIMS}, g AS (SELECT graph_id, bool_or(claim_type = 'grammar_statement') AS p, bool_or(claim_type = 'igt_pattern') AS i, bool_or(claim_type = 'absence_evidence') AS a, coalesce(bool_or(NOT supports), false) AS c, count(*) AS n,
 count(*) FILTER (WHERE supports AND confidence >= 0.6) * count(*) FILTER (WHERE NOT supports AND confidence >= 0.6) AS x FROM cl GROUP BY graph_id) SELECT graph_id, p AND i AND c AND x = 0 AS ready, i AND a AND c AND n >= 4 AS ready_igt FROM g""")
def evidence_gates(spark, d):
    return evidence.gates(_claims(spark, d))


@query()
def evidence_summary(spark, d):
    c = _claims(spark, d)
    return evidence.listed(c).join(evidence.figures(c), "graph_id")


@query(f"""WITH {_CLAIMS} SELECT graph_id, example_id, substr(text, 1, 120) AS note, source, claim_type, seq FROM cl QUALIFY row_number() OVER (PARTITION BY graph_id, example_id ORDER BY confidence DESC, seq) = 1""")
def example_best_note(spark, d):
    return evidence.example_notes(_claims(spark, d))


@query(f"""WITH {_CLAIMS}, f AS (SELECT graph_id, example_id, min(seq) AS s FROM cl GROUP BY ALL) SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY s) AS rank, example_id FROM f""")
def example_ids(spark, d):
    return evidence.example_ids(_claims(spark, d))


# ---- verdicts -------------------------------------------------------------------------------------------------------


def _language_verdicts(spark, d):
    """Verdicts out of tag profiles: a universal per tag, a language per row (the last report of each counts)."""
    p = table(spark, d, "tag_profile").filter("tag is not null and lang is not null")
    p = p.withColumn("_r", F.row_number().over(Window.partitionBy("tag", "lang").orderBy(F.desc("profile_id")))).filter("_r = 1")
    i = F.col("profile_id")
    logic = F.when(F.length("tag") % 3 == 0, "absolute").when(F.length("tag") % 3 == 1, "implication").otherwise("correlation")
    tri = lambda n: F.when(F.floor(i / n) % 3 == 0, True).when(F.floor(i / n) % 3 == 1, False)
    v = p.select(
        F.col("tag").alias("uid"), F.col("lang").alias("language"), logic.alias("logic"), tri(1).alias("antecedent_holds"), tri(3).alias("consequent_holds"),
        F.coalesce("mean_position", F.lit(0.0)).alias("confidence"), F.when(i % 11 == 0, "Here the Antecedent fails, clearly.").otherwise("It holds.").alias("raw_answer"),
        F.when(i % 7 == 0, "IRRELEVANT").when(i % 7 == 1, "valid_support").when(i % 7 == 2, "nonsense").alias("assessment"),
    )
    return v.withColumn("violates", verdicts.violates(F.col("logic"), F.col("antecedent_holds"), F.col("consequent_holds")))


_VERDICTS = f"""p AS (SELECT * FROM tag_profile WHERE tag IS NOT NULL AND lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tag, lang ORDER BY profile_id DESC) = 1),
 v0 AS (SELECT tag AS uid, lang AS language, CASE length(tag) % 3 WHEN 0 THEN 'absolute' WHEN 1 THEN 'implication' ELSE 'correlation' END AS logic, CASE profile_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS an, CASE (profile_id // 3) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS co,
 coalesce(mean_position, 0) AS confidence, CASE WHEN profile_id % 11 = 0 THEN 'Here the Antecedent fails, clearly.' ELSE 'It holds.' END AS raw, CASE profile_id % 7 WHEN 0 THEN 'IRRELEVANT' WHEN 1 THEN 'VALID_SUPPORT' ELSE 'INSUFFICIENT' END AS given FROM p),
 v1 AS (SELECT *, CASE WHEN logic = 'absolute' THEN co IS NOT DISTINCT FROM false ELSE an IS NOT DISTINCT FROM true AND co IS NOT DISTINCT FROM false END AS violates FROM v0),
 lab AS (SELECT *, CASE WHEN logic = 'implication' AND violates AND ({' OR '.join(f"contains(lower(substr(raw, 1, 400)), {_lit(x)})" for x in ANTECEDENT_FAILS)}) THEN 'ANTECEDENT_NA' WHEN given = 'IRRELEVANT' THEN given WHEN confidence < 0.65 THEN 'INSUFFICIENT' WHEN violates THEN 'VALID_VIOLATION'
 WHEN an IS NOT DISTINCT FROM false AND logic = 'implication' THEN 'ANTECEDENT_NA' WHEN an IS NOT DISTINCT FROM true AND co IS NOT DISTINCT FROM true THEN 'VALID_SUPPORT' ELSE given END AS label FROM v1)"""


@query(f"WITH {_VERDICTS} SELECT uid, language, logic, violates, label, CASE WHEN violates THEN 'VIOLATES' WHEN an IS DISTINCT FROM false THEN 'SUPPORTS' ELSE 'NA' END AS category FROM lab")
def universal_language_label(spark, d):
    return verdicts.display_category(verdicts.language_labels(_language_verdicts(spark, d))).select("uid", "language", "logic", "violates", "label", "category")


@query(f"""WITH {_VERDICTS}, n AS (SELECT uid, {', '.join(f"count(*) FILTER (WHERE label = '{x}') AS n_{x.lower()}" for x in verdicts.VERDICT_LABELS)}, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM lab GROUP BY uid)
 SELECT uid, n_valid_support, n_valid_violation, n_antecedent_na, n_irrelevant, n_insufficient, mean_confidence, CASE WHEN n_valid_violation > 0 THEN 'FALSE' WHEN n_valid_support > 0 OR n_antecedent_na = n THEN 'TRUE' ELSE 'FALSE' END AS verdict FROM n""")
def universal_verdict(spark, d):
    return verdicts.universal_verdicts(verdicts.language_labels(_language_verdicts(spark, d)))


_ANSWERS = "an AS (SELECT coalesce(tag, '?') AS question, profile_id AS ord, coalesce(lang, '?') AS language, CASE WHEN profile_id % 4 = 0 THEN NULL ELSE position_label END AS value, concat('mean position ', coalesce(position_label, 'unknown'), ' in this corpus') AS answer FROM tag_profile)"


def _answers(spark, d):
    p = table(spark, d, "tag_profile")
    value = F.when(F.col("profile_id") % 4 == 0, F.lit(None)).otherwise(F.col("position_label"))
    return p.select(F.coalesce("tag", F.lit("?")).alias("question"), F.col("profile_id").alias("ord"), F.coalesce("lang", F.lit("?")).alias("language"), value.alias("value"), F.concat(F.lit("mean position "), F.coalesce("position_label", F.lit("unknown")), F.lit(" in this corpus")).alias("answer"))


@query(f"""WITH {_ANSWERS}, g AS (SELECT question, coalesce(value, substr(answer, 1, 30)) AS value, count(*) AS n, min(ord) AS first, string_agg(language, ', ' ORDER BY ord, language) AS languages FROM an GROUP BY question, coalesce(value, substr(answer, 1, 30)))
 SELECT question, row_number() OVER (PARTITION BY question ORDER BY n DESC, first) AS rank, value, n, floor(100 * n / sum(n) OVER (PARTITION BY question))::INT AS share, languages FROM g""")
def value_grouping(spark, d):
    return verdicts.value_groups(_answers(spark, d))


@query(f"""WITH {_ANSWERS}, r AS (SELECT DISTINCT question, language FROM an), pl AS (SELECT DISTINCT question, value AS type_label, language FROM an WHERE value = 'flexible')
 SELECT question, type_label, language FROM pl UNION ALL SELECT question, 'Unclear', language FROM r ANTI JOIN pl USING (question, language)""")
def unclear_bucket(spark, d):
    a = _answers(spark, d)
    placed = a.filter("value = 'flexible'").select("question", F.col("value").alias("type_label"), "language").distinct()
    return verdicts.with_unplaced(placed, a.select("question", "language").distinct())


@query("""WITH l AS (SELECT CASE WHEN regexp_extract(coalesce(text, ''), '([0-9?])', 1) = '' THEN '?' ELSE regexp_extract(text, '([0-9?])', 1) END AS label FROM documents)
 SELECT label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 2) AS share FROM l GROUP BY label""")
def label_histogram(spark, d):
    return verdicts.label_histogram(table(spark, d, "documents").select(verdicts.normal_label(F.col("text")).alias("label")))


@query("SELECT doc_id, CASE WHEN regexp_extract(coalesce(text, ''), '([0-9?])', 1) = '' THEN '?' ELSE regexp_extract(text, '([0-9?])', 1) END AS label FROM documents")
def label_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", verdicts.normal_label(F.col("text")).alias("label"))


@query()
def question_dedupe(spark, d):
    q = table(spark, d, "section_node").select(F.coalesce("lang", F.lit("")).alias("language"), "ord", F.concat_ws(" ", F.lit("How does the language express"), "section", "subsection", F.lit("?")).alias("question"))
    return verdicts.distinct_questions(q)


@query()
def json_repair(spark, d):
    """Event properties, whole, broken off and wrapped in prose, parsed and repaired."""
    e = table(spark, d, "events").select("event_id", F.coalesce("props", F.lit("")).alias("p"))
    t = F.when(F.col("event_id") % 3 == 0, F.col("p")).when(F.col("event_id") % 3 == 1, F.concat(F.lit('Answer: {"a": ['), "p", F.lit(", {\"b\": 2"))).otherwise(F.concat(F.lit("```json\n"), "p", F.lit("\n``` done")))
    return e.select("event_id", repaired(t).alias("object"))


@query("SELECT n_name AS language, tag AS feature, '?' AS code FROM nation CROSS JOIN abbrev")
def coding_crossjoin(spark, d):
    """Every language with every feature: both are fixed lists."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("language"))
    return n.crossJoin(F.broadcast(table(spark, d, "abbrev").select(F.col("tag").alias("feature")))).withColumn("code", F.lit("?"))


def _packed_sql() -> str:
    """Values cut off one by one: separators divide everywhere outside quotes. Lists add brackets to the separators."""
    from corpusloom.operators.packed import QUOTES, SEPARATORS

    seps = "".join(f"\\x{{{ord(c):x}}}" for c in sorted(SEPARATORS))

    def cases(more: str) -> tuple[str, str]:
        """(what is taken off the rest, the value in it)"""
        stop = seps + more
        taken, value = "", ""
        for o, c in QUOTES.items():
            pat = f"^\\x{{{ord(o):x}}}(.*?)\\x{{{ord(c):x}}}(?:$|[{stop}])"
            same = "replace({}, chr(%d) || chr(%d), chr(%d))" % ((ord(c),) * 3) if o == c else "{}"
            got = f"regexp_extract(rest, '{pat}', 1, 's')"
            taken += f" WHEN starts_with(rest, chr({ord(o)})) AND regexp_matches(rest, '{pat}', 's') THEN length({got}) + 2"
            value += f" WHEN starts_with(rest, chr({ord(o)})) AND regexp_matches(rest, '{pat}', 's') THEN {same.format(got)}"
        plain = f"regexp_extract(rest, '^[^{stop}]*', 0, 's')"
        return f"CASE{taken} ELSE length({plain}) END", f"CASE{value} ELSE {plain} END"

    (n0, v0), (n1, v1) = cases(""), cases("\\[\\]")
    strip = lambda x: f"CASE WHEN lst THEN regexp_replace({x}, '^[{seps}\\[\\]]+', '') ELSE regexp_replace({x}, '^[{seps}]+', '') END"
    return f"""WITH RECURSIVE t AS (SELECT raw_id, unnest(['morpheme', 'gloss', 'gloss_tags']) AS field, unnest([morpheme, gloss, gloss_tags]) AS txt FROM igt_raw),
 u AS (SELECT raw_id, field, txt, starts_with(ltrim(txt), '[') AS lst FROM t WHERE txt <> ''),
 r AS (SELECT raw_id, field, lst, 0 AS step, NULL::VARCHAR AS val, {strip('txt')} AS rest FROM u UNION ALL
  SELECT raw_id, field, lst, step + 1, val, {strip('substr(rest, n + 1)')} FROM (SELECT raw_id, field, lst, step, rest, CASE WHEN lst THEN {n1} ELSE {n0} END AS n, CASE WHEN lst THEN {v1} ELSE {v0} END AS val FROM r WHERE rest <> ''))
 SELECT raw_id, field, row_number() OVER (PARTITION BY raw_id, field ORDER BY step) - 1 AS pos, val FROM r WHERE val <> ''"""


@query(_packed_sql())
def p2_found(spark, d):
    """The values of the packed fields of igt_raw, one per row."""
    from corpusloom.operators.packed import split_packed

    return split_packed(table(spark, d, "igt_raw"), "raw_id", ["morpheme", "gloss", "gloss_tags"])
