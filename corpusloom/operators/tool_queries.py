"""Further queries of the core: text rules, tools of the registry, readers and writers by round trips."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.functions import text as rules
from corpusloom.operators import queries as base
from corpusloom.operators import evidence, retrieval, sections, stats, tools, verdicts
from corpusloom.operators.constants import KEY_TERM, QUESTION_STOP
from corpusloom.operators.queries import _BASE, _CH, _PROF, _REFS, _SECTION, _chunks, _ex, _grams, query
from corpusloom.plans import model, registry, survey, universals
from corpusloom.plans.model import RuleModel
from corpusloom.session import table
from corpusloom.sources import readers, sinks

# ---- text rules -----------------------------------------------------------------------------------------------------


@query("SELECT ord, substr(regexp_replace(lower(translation), '[^a-zA-Z0-9_]+', '_', 'g'), 1, 40) AS slug, 'Q' || upper(substr(md5(translation), 1, 6)) AS query_id FROM igt WHERE translation IS NOT NULL")
def text_slugs(spark, d):
    t = table(spark, d, "igt").filter("translation is not null")
    return t.select("ord", rules.slug(F.col("translation")).alias("slug"), rules.query_id(F.col("translation")).alias("query_id"))


_MENTION = "coalesce(translation, '') || CASE ord % 4 WHEN 0 THEN ' (claim_id = C' || ord || ')' WHEN 1 THEN ' [claim_id=C1]  and claim_id=C22 ' WHEN 2 THEN '' ELSE '  twice   ' END || coalesce(gloss, '')"
_NO_IDS = r"trim(regexp_replace(regexp_replace({x}, '\s*[\(\[]?\s*claim_id\s*=\s*C\d+\s*[\)\]]?', '', 'g'), '\s{{2,}}', ' ', 'g'))"


@query(f"WITH t AS (SELECT ord, {_MENTION} AS x FROM igt) SELECT ord, {_NO_IDS.format(x='x')} AS notes, {_NO_IDS.format(x='upper(x)')} AS raw_answer, {_NO_IDS.format(x='x')} || ' | ' || 'kept' AS evidence FROM t")
def claim_ids_removed(spark, d):
    """Mentions of claim ids leave every text of a record, lists of texts too."""
    tail = F.when(F.col("ord") % 4 == 0, F.format_string(" (claim_id = C%d)", "ord")).when(F.col("ord") % 4 == 1, " [claim_id=C1]  and claim_id=C22 ").when(F.col("ord") % 4 == 2, "").otherwise("  twice   ")
    x = F.concat(F.coalesce("translation", F.lit("")), tail, F.coalesce("gloss", F.lit("")))
    rows = table(spark, d, "igt").select("ord", x.alias("notes"), F.upper(x).alias("raw_answer"), F.array(x, F.lit("kept")).alias("evidence"))
    return rules.cleaned(rows, ["notes", "raw_answer", "evidence"]).withColumn("evidence", F.array_join("evidence", " | "))


_COUNT = "len(regexp_extract_all(lower(x), '{p}'))"
_FOUND_SQL = _COUNT.format(p=r"\b(?:found|attested|appears?|present|occurs?|exists?|marked|used|shown|observed|detected)\b")
_ABSENT_SQL = _COUNT.format(p=r"\b(?:not found|not attested|absent|zero|0 occurrence|does not (?:appear|occur|exist)|no (?:evidence|examples?|instance))\b")
_SAID = "CASE ord % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' ELSE 'Partial' END"


@query(f"""WITH t AS (SELECT ord, {_SAID} AS v, coalesce(text, '') || CASE ord % 5 WHEN 0 THEN ' not found, no evidence' WHEN 1 THEN ' is attested' ELSE '' END AS x FROM chunk), n AS (SELECT ord, v, {_FOUND_SQL} AS f, {_ABSENT_SQL} AS a, ord % 7 AS s FROM t)
 SELECT ord, CASE WHEN v = 'No' AND (f > 0 OR s > 0) AND a < f THEN 'Partial' ELSE v END AS value, v = 'No' AND (f > 0 OR s > 0) AND a < f AS look FROM n""")
def value_consistency(spark, d):
    said = F.when(F.col("ord") % 3 == 0, "No").when(F.col("ord") % 3 == 1, "Yes").otherwise("Partial")
    more = F.when(F.col("ord") % 5 == 0, " not found, no evidence").when(F.col("ord") % 5 == 1, " is attested").otherwise("")
    value, look = rules.consistent_value(said, F.concat(F.coalesce("text", F.lit("")), more), F.col("ord") % 7)
    return table(spark, d, "chunk").select("ord", value.alias("value"), look.alias("look"))


_KINDS = "CASE event_id % 6 WHEN 0 THEN 'igt_pattern|inference' WHEN 1 THEN 'Grammar_Statement' WHEN 2 THEN 'type: absence_evidence, strong' WHEN 3 THEN 'none/author_caveat' WHEN 4 THEN event_type END"
_KNOWN = "('grammar_statement', 'igt_pattern', 'absence_evidence', 'inference', 'counter_evidence', 'author_caveat')"


@query(f"SELECT event_id, coalesce(list_filter(string_split_regex(lower(coalesce({_KINDS}, '')), '[|/,; ]+'), lambda w: w IN {_KNOWN})[1], 'inference') AS claim_type FROM events")
def claim_types(spark, d):
    k = F.col("event_id") % 6
    said = F.when(k == 0, "igt_pattern|inference").when(k == 1, "Grammar_Statement").when(k == 2, "type: absence_evidence, strong").when(k == 3, "none/author_caveat").when(k == 4, F.col("event_type"))
    return table(spark, d, "events").select("event_id", rules.claim_type(said).alias("claim_type"))


_TRI = "CASE event_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'Yes' WHEN 2 THEN 'false' WHEN 3 THEN 'No' WHEN 4 THEN 'yes' WHEN 5 THEN event_type END"


@query(f"SELECT event_id, CASE WHEN v IN ('true', 'Yes') THEN 'T' WHEN v IN ('false', 'No') THEN 'F' ELSE 'U' END AS state FROM (SELECT event_id, {_TRI} AS v FROM events)")
def tri_state(spark, d):
    k = F.col("event_id") % 7
    said = F.when(k == 0, "true").when(k == 1, "Yes").when(k == 2, "false").when(k == 3, "No").when(k == 4, "yes").when(k == 5, F.col("event_type"))
    t = table(spark, d, "events").select("event_id", said.alias("v")).withColumn("b", verdicts.tribool("v"))
    return t.select("event_id", F.when(F.col("b"), "T").when(~F.col("b"), "F").otherwise("U").alias("state"))


_STOPS = ", ".join(f"'{w}'" for w in QUESTION_STOP)


@query(f"""SELECT ord, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(translation, '')), '[a-z]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOPS}) AND NOT list_contains(list_filter(string_split_regex(lower(coalesce(lang, '')), '[^a-zA-Z0-9_]+'), lambda t: length(t) >= 3), w)))), ' ') AS words FROM igt""")
def question_content_words(spark, d):
    return table(spark, d, "igt").select("ord", F.array_join(verdicts.content_words(F.col("translation"), F.col("lang")), " ").alias("words"))


# ---- tools ----------------------------------------------------------------------------------------------------------


def _corpus(spark: SparkSession, d: str) -> registry.Corpus:
    return registry.Corpus(table(spark, d, "igt"), table(spark, d, "chunk"), table(spark, d, "abbrev"))


_ASKED = ["chunk_00000008", "chunk_00000026", "sec:4.11.28", "sec:1.13.83", "chunk_00000017", "nowhere"]


@query(f"""WITH {_SECTION}, q(name) AS (VALUES {', '.join(f"('{x}')" for x in _ASKED)}), h AS (SELECT lang, name, section_id, first, CASE WHEN list_contains(string_split(chunk_ids, ' '), name) THEN 1 WHEN label = name THEN 2 WHEN section_id = name THEN 3 WHEN list_contains(string_split(chunk_ids, ' '), name || '_p0') THEN 4 END AS how, full_text FROM sn CROSS JOIN q)
 SELECT lang, name, how, section_id, md5(substr(full_text, 1, 8000)) AS text_md5 FROM h WHERE how IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang, name ORDER BY how, first) = 1""")
def find_section(spark, d):
    s = sections.assemble(_chunks(spark, d))
    found = sections.find(s, _ASKED)
    return found.select("lang", "name", "how", "section_id", F.md5(F.substring("full_text", 1, 8000)).alias("text_md5"))


@query(f"""WITH {_SECTION} SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY section_id) AS rank, section_id, chapter, section, subsection, subsubsection, label, CASE WHEN subsubsection <> '' THEN 4 WHEN subsection <> '' THEN 3 WHEN section <> '' THEN 2 ELSE 1 END AS level, length(full_text) AS char_count
 FROM sn QUALIFY count(*) OVER (PARTITION BY lang, section_id) = 1 AND rank <= 300""")
def toc_by_id(spark, d):
    """Sections by their ids. Ids that two sections share have no order of their own and are left out of the comparison."""
    toc = registry.get_toc(_corpus(spark, d))
    twice = toc.groupBy("lang", "section_id").agg(F.count("*").alias("n")).filter("n > 1")
    return toc.join(twice, ["lang", "section_id"], "left_anti").select("lang", "rank", "section_id", *sections.NAMES, "label", "level", F.col("char_count").cast("long").alias("char_count"))


@query(f"""WITH {_CH}, f AS (SELECT lang, chapter, section, subsection, subsubsection, min(ord) AS ord FROM ch GROUP BY ALL), s AS (SELECT lang, chunk_id, replace(substr(summary, 1, 120), chr(10), ' ') AS summary FROM ch QUALIFY row_number() OVER (PARTITION BY lang, chunk_id ORDER BY ord) = 1)
 SELECT f.lang, row_number() OVER (PARTITION BY f.lang ORDER BY f.ord) AS rank, c.chunk_id, f.section, s.summary FROM f JOIN ch c ON c.ord = f.ord LEFT JOIN s ON s.lang = f.lang AND s.chunk_id = c.chunk_id QUALIFY rank <= 300""")
def toc_with_summaries(spark, d):
    return registry.get_toc_with_summaries(_corpus(spark, d)).select("lang", "rank", "chunk_id", "section", "summary")


def _gram_cte(n: int, k: int, name: str) -> str:
    grams = _grams(n).replace("grams AS", f"g{n} AS")
    return f"""{grams}, {name} AS (SELECT lang, gram, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, first) AS rank FROM (SELECT lang, gram, count(*) AS cnt, min(ord * 1000 + i) AS first FROM g{n} GROUP BY lang, gram HAVING count(*) >= 5) QUALIFY rank <= {k})"""


@query(f"{_BASE}, {_gram_cte(2, 30, 'f2')}, {_gram_cte(3, 15, 'f3')} SELECT lang, rank, gram, cnt, 2 AS size FROM f2 UNION ALL SELECT lang, rank, gram, cnt, 3 FROM f3")
def construction_inventory(spark, d):
    return registry.get_construction_inventory(_corpus(spark, d))


def _group_cte(name: str, values: dict) -> str:
    rows = ", ".join(f"('{k}', '{t}')" for k, ts in values.items() for t in ts)
    keys = ", ".join(f"('{k}')" for k in values)
    return f"""{name}_g(k, tag) AS (VALUES {rows}), {name}_k(k) AS (VALUES {keys}), {name}_f AS (SELECT lang, k, sum(cnt) AS hits FROM (SELECT lang, tag, count(*) AS cnt FROM tok GROUP BY lang, tag) JOIN {name}_g USING (tag) GROUP BY lang, k),
 {name}_h AS (SELECT lang, k, n_examples, coalesce(hits, 0)::BIGINT AS hits FROM size CROSS JOIN {name}_k LEFT JOIN {name}_f USING (lang, k))"""


@query(f"""{_BASE}, {_PROF}, {_gram_cte(2, 20, 'f2')}, {_group_cte('cat', base.TAG_CLUSTERS)}, {_group_cte('slot', base.PARADIGM_SLOTS)},
 sr AS (SELECT e.lang, e.sec, count(DISTINCT tag) AS n FROM ex e LEFT JOIN tok t ON t.ord = e.ord GROUP BY e.lang, e.sec)
 SELECT lang, 'tag' AS part, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, first) AS rank, tag AS name, cnt::VARCHAR AS value FROM prof QUALIFY rank <= 30
 UNION ALL SELECT lang, 'pattern', rank, gram, cnt::VARCHAR FROM f2
 UNION ALL SELECT lang, 'absent', 0, k, CASE WHEN hits = 0 THEN 'zero' ELSE 'marginal' END FROM cat_h WHERE hits / n_examples < 0.005
 UNION ALL SELECT lang, 'paradigm', 0, k, hits::VARCHAR FROM slot_h
 UNION ALL SELECT lang, 'section', row_number() OVER (PARTITION BY lang ORDER BY n DESC, sec) AS rank, sec, n::VARCHAR FROM sr QUALIFY rank <= 15""")
def igt_summary(spark, d):
    return registry.get_igt_summary(_corpus(spark, d))


_PLANNED = {"none known": ["XYZ", "QQQ"], "one known": ["XYZ", "pst"], "empty": []}


@query("""WITH c AS (SELECT tag FROM abbrev WHERE contains(lower(meaning), 'past') AND list_contains(regexp_extract_all(lower(meaning), '[a-z]{3,}'), 'past') ORDER BY ord LIMIT 5), n AS (SELECT count(*) AS n, max((tag = 'PST')::INT) AS has FROM c)
 SELECT 'none known' AS plan, tag FROM c UNION ALL SELECT 'empty', tag FROM c UNION ALL SELECT 'one known', unnest(['XYZ', 'pst']) FROM n WHERE has = 1 UNION ALL SELECT 'one known', tag FROM c CROSS JOIN n WHERE has = 0""")
def plan_tag_choice(spark, d):
    """Planned tags, or the first five that the dictionary offers if none of the planned ones is among them."""
    words = F.regexp_extract_all(F.lower("meaning"), F.lit("([a-z]{3,})"), 1)
    offered = [r["tag"] for r in table(spark, d, "abbrev").filter(F.array_contains(words, "past")).orderBy("ord").limit(5).collect()]
    rows = [(name, t) for name, planned in _PLANNED.items() for t in tools.plan_tags(planned, offered)]
    return spark.createDataFrame(rows, "plan string, tag string")


def _universals(spark, d) -> DataFrame:
    a = table(spark, d, "abbrev")
    domain = F.when(F.col("ord") % 3 == 0, "Tense").when(F.col("ord") % 3 == 1, "CASE").otherwise("")
    logic = F.when(F.col("ord") % 4 == 0, "Absolute").when(F.col("ord") % 4 == 1, "implication").when(F.col("ord") % 4 == 2, "correlation").otherwise("")
    return a.select(F.format_string("U%d", "ord").alias("id"), F.concat(F.lit('If "'), "tag", F.lit('", then '), "meaning").alias("statement"), F.concat(F.lit(" has "), "tag").alias("antecedent"), F.col("meaning").alias("consequent"), logic.alias("logic"), domain.alias("domain"), F.lit("s, 1").alias("source"))


_UNIVERSALS = """u AS (SELECT 'U' || ord AS id, 'If "' || tag || '", then ' || meaning AS statement, 'has ' || tag AS antecedent, meaning AS consequent, CASE ord % 4 WHEN 0 THEN 'absolute' WHEN 2 THEN 'correlation' ELSE 'implication' END AS logic,
 CASE ord % 3 WHEN 0 THEN 'Tense' WHEN 1 THEN 'CASE' ELSE 'UNKNOWN' END AS domain, 's, 1' AS source FROM abbrev)"""


@query(f"WITH {_UNIVERSALS} SELECT 'ids' AS chosen, id FROM u WHERE id IN ('U3', 'U7', 'U9999') UNION ALL SELECT 'domain', id FROM u WHERE upper(domain) = 'TENSE' UNION ALL SELECT 'all', id FROM u")
def universal_selection(spark, d):
    u = _universals(spark, d)
    picks = {"ids": {"ids": ["U3", "U7", "U9999"]}, "domain": {"domain": "tense"}, "all": {"every": True}}
    out = [verdicts.select_universals(u, **args).select(F.lit(name).alias("chosen"), "id") for name, args in picks.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# ---- key terms and what hangs on them -------------------------------------------------------------------------------

#: Letters beyond ASCII belong to a word, but never to a term; a term doesn't end before one.
_LETTERS = r"[\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2c1}\x{2c6}-\x{2d1}\x{2e0}-\x{2e4}\x{300}-\x{377}\x{37a}-\x{1fff}\x{2c00}-\x{2dff}\x{3040}-\x{d7ff}]"
_TERMS = f"""kt AS (SELECT lang, section_id, first AS sfirst, trim(term) AS term, i FROM (SELECT lang, section_id, first, unnest(range(len(ts))) AS i, unnest(ts) AS term FROM (SELECT lang, section_id, first, regexp_extract_all(regexp_replace(full_text, '{_LETTERS}', '_', 'g'), '{KEY_TERM}') AS ts FROM sn)) WHERE length(trim(term)) >= 3),
 kc AS (SELECT lang, section_id, term, count(*) AS cnt, min(i) AS fi FROM kt GROUP BY lang, section_id, term HAVING count(*) >= 2),
 kr AS (SELECT lang, section_id, term, cnt, row_number() OVER (PARTITION BY lang, section_id ORDER BY cnt DESC, fi) AS rank FROM kc QUALIFY rank <= 20)"""


def search_sql(asked: str, k: int) -> str:
    """The sections of a search: names, key terms and texts."""
    import re

    words = sorted(set(re.findall("[a-zA-Z]{3,}", asked)))
    hits = lambda col: "(" + " + ".join(f"contains({col}, '{w}')::INT" for w in words) + ")"
    named = " OR ".join(f"contains(lower({c}), '{asked}')" for c in sections.NAMES[1:])
    return f"""{_TERMS}, kj AS (SELECT lang, section_id, string_agg(term, ' ' ORDER BY rank) AS terms FROM kr GROUP BY lang, section_id),
 sc AS (SELECT sn.*, lower(concat_ws(' ', chapter, section, subsection, subsubsection, coalesce(terms, ''))) AS hd FROM sn LEFT JOIN kj USING (lang, section_id)),
 ss AS (SELECT *, round({hits('hd')} + 0.4 * {hits('lower(full_text)')} + CASE WHEN {named} THEN 5 ELSE 0 END, 1) AS score FROM sc),
 found AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, first) AS rank FROM ss WHERE score > 0 QUALIFY rank <= {k})"""


base.ORACLES["key_terms"] = f"WITH {_SECTION}, {_TERMS} SELECT lang, section_id, rank, term, cnt FROM kr"
base.ORACLES["section_search_terms"] = f"WITH {_SECTION}, {search_sql('past tense suffix', 8)} SELECT lang, rank, section_id, score FROM found"


# ---- retrieval ------------------------------------------------------------------------------------------------------


def mmr_sql(pool: str, k: int = 5, lam: float = 0.6) -> str:
    """Selection by maximal marginal relevance, step by step; pool has doc, score, v (a vector)."""
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
    out = f"""mp AS ({pool}), ms AS (SELECT a.doc AS a, b.doc AS b, {dot('a.v', 'b.v')} / ((sqrt({dot('a.v', 'a.v')}) + 1e-9) * (sqrt({dot('b.v', 'b.v')}) + 1e-9)) AS sim FROM mp a CROSS JOIN mp b),
 c1 AS (SELECT 1 AS rank, doc, score FROM mp ORDER BY score DESC, doc LIMIT 1)"""
    for i in range(2, k + 1):
        out += f""", c{i} AS (SELECT * FROM c{i - 1} UNION ALL (SELECT {i}, doc, score FROM (SELECT doc, score, {lam} * score - {1 - lam} * (SELECT max(sim) FROM ms WHERE ms.a = mp.doc AND ms.b IN (SELECT doc FROM c{i - 1})) AS gain FROM mp WHERE doc NOT IN (SELECT doc FROM c{i - 1})) ORDER BY gain DESC, score DESC, doc LIMIT 1))"""
    return out


base.ORACLES["mmr_rerank"] = f"WITH {base._DENSE}, {mmr_sql('SELECT doc, score, embedding AS v FROM (SELECT doc, score FROM dn ORDER BY score DESC, doc LIMIT 25) JOIN embeddings ON vec_id = doc')} SELECT 'q0' AS query, rank, doc, score FROM c5"


@query(f"""WITH {base._bm25_sql(25)}, {base._DENSE}, s AS (SELECT doc, score FROM dn ORDER BY score DESC, doc LIMIT 25), f AS (SELECT doc, round(0.5 * coalesce(s.score, 0) + 0.5 * coalesce(b.score / (SELECT max(score) FROM b), 0), 6) AS score FROM s FULL JOIN b USING (doc)),
 pool AS (SELECT doc, score FROM f JOIN embeddings ON vec_id = doc ORDER BY score DESC, doc LIMIT 15), {mmr_sql('SELECT doc, score, embedding AS v FROM pool JOIN embeddings ON vec_id = doc')} SELECT rank, doc, score FROM c5""")
def search_text_hybrid(spark, d):
    """BM25 and dense scores fused, then re-ranked for diversity. Chunks are paired with the vectors of their numbers."""
    e = table(spark, d, "embeddings")
    return retrieval.hybrid(base._chunk_docs(spark, d), "ord", "text", e, "vec_id", "embedding", base._BM25_QUERY, base._query_vector(spark, d), 5)


# ---- readers and writers --------------------------------------------------------------------------------------------


def _fresh(spark, what: str) -> str:
    return session.fresh_path(spark, what)


_IGT_TEXTS = ["source", "morpheme", "gloss", "translation", "chapter", "section", "subsection", "subsubsection", "tones", "label"]


@query(f"""SELECT ord, coalesce(example_id, 'igt_' || lpad(ord::VARCHAR, greatest(4, length(ord::VARCHAR))::INT, '0')) AS example_id, {', '.join(f"coalesce({c}, '') AS {c}" for c in _IGT_TEXTS)}, md5(coalesce(array_to_string(list_transform(gloss_tags, lambda t: coalesce(t, '~')), '|'), '')) AS tags_md5,
 CASE WHEN c <> '' THEN c ELSE coalesce(source_section, '') END AS source_section FROM (SELECT *, array_to_string(list_filter([chapter, section, subsection, subsubsection], lambda x: x IS NOT NULL AND x <> ''), ' > ') AS c FROM igt)""")
def igt_json_round_trip(spark, d):
    """Examples written as JSON lines and read again, by a scan that can be split."""
    path = _fresh(spark, "igt-json")
    sinks.write_json(table(spark, d, "igt").select("ord", "example_id", *_IGT_TEXTS, "source_section", "gloss_tags"), path)
    back = readers.igt_json_lines(spark, path)
    tags = F.md5(F.array_join("gloss_tags", "|", "~"))
    return back.select("ord", "example_id", *_IGT_TEXTS, tags.alias("tags_md5"), "source_section")


_CHUNK_TEXTS = ["text", "chapter", "section", "subsection", "subsubsection", "label", "summary"]


@query(f"""SELECT ord, coalesce(chunk_id, 'chunk_' || lpad(ord::VARCHAR, greatest(4, length(ord::VARCHAR))::INT, '0')) AS chunk_id, {', '.join(f"coalesce({c}, '') AS {c}" for c in _CHUNK_TEXTS)}, page,
 CASE WHEN coalesce(subsubsection, '') <> '' THEN 4 WHEN coalesce(subsection, '') <> '' THEN 3 WHEN coalesce(section, '') <> '' THEN 2 ELSE 1 END AS level FROM chunk""")
def chunk_json_round_trip(spark, d):
    path = _fresh(spark, "chunk-json")
    sinks.write_json(table(spark, d, "chunk").select("ord", "chunk_id", *_CHUNK_TEXTS, "page"), path)
    return readers.chunks_json_lines(spark, path).select("ord", "chunk_id", *_CHUNK_TEXTS, "page", "level")


@query("SELECT row_number() OVER (ORDER BY ord) AS no, upper(trim(tag)) AS tag, trim(meaning) AS meaning FROM abbrev")
def abbreviations_round_trip(spark, d):
    """A dictionary written line by line, with a comment and blank lines, and read again; the list has a fixed size."""
    path = _fresh(spark, "abbrev") + ".txt"
    rows = table(spark, d, "abbrev").orderBy("ord").select("tag", "meaning").collect()
    session.write_text(spark, path, "# tags\n\n" + "\n".join(f"{r['tag']}\t{r['meaning']}" if i % 2 else f"{r['tag']}   {r['meaning']}" for i, r in enumerate(rows)) + "\n\n")
    back = readers.abbreviations(spark, path)
    return stats.ordinal(back.withColumn("one", F.lit(0)), "one", "ord", "no").select("no", "tag", "meaning")


@query(f"WITH {_UNIVERSALS} SELECT * FROM u")
def universals_round_trip(spark, d):
    """Universals as CSV, with commas and quotes in fields; empty fields get their defaults."""
    path = _fresh(spark, "universals")
    sinks.write_csv(_universals(spark, d), path)
    return readers.universals(spark, path)


@query("SELECT 'F' || ord AS ID, 'Is there ' || meaning || '?' AS Query, '0: no, 1: yes' AS Coding, meaning AS Definition, 'F' || ord || ' \"' || tag || '\"' AS Grambank_ID_desc FROM abbrev")
def coding_round_trip(spark, d):
    """A list of features with each line twice: the reader keeps one of each."""
    a = table(spark, d, "abbrev")
    f = F.format_string("F%d", "ord")
    rows = a.select(f.alias("ID"), F.concat(F.lit("Is there "), "meaning", F.lit("?")).alias("Query"), F.lit("0: no, 1: yes").alias("Coding"), F.col("meaning").alias("Definition"), F.concat(f, F.lit(' "'), "tag", F.lit('"')).alias("Grambank_ID_desc"))
    path = _fresh(spark, "coding")
    sinks.write_csv(rows.unionByName(rows), path)
    return readers.coding_features(spark, path)


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS no, trim(n_name) AS language FROM nation")
def language_list_round_trip(spark, d):
    path = _fresh(spark, "languages") + ".txt"
    rows = [r[0] for r in table(spark, d, "nation").orderBy("n_nationkey").select("n_name").collect()]
    session.write_text(spark, path, "# languages\n" + "\n\n".join(f"  {n} " for n in rows))
    back = readers.language_list(spark, path)
    return stats.ordinal(back.withColumn("one", F.lit(0)), "one", "ord", "no").select("no", "language")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS no, n_name AS name, n_nationkey % 2 = 0 AS igt_only FROM nation")
def config_round_trip(spark, d):
    """A configuration of languages, written, read and checked."""
    path = _fresh(spark, "config") + ".json"
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()
    langs = [{"name": r["n_name"], "igt": "x.json", "grammar": "g.txt", "igt_only": r["n_nationkey"] % 2 == 0} for r in rows]
    session.write_text(spark, path, json.dumps({"languages": langs, "planning": {"n_questions": 3}}))
    got = readers.config(path, spark)["languages"]
    return spark.createDataFrame([(i, x["name"], x["igt_only"]) for i, x in enumerate(got, 1)], "no int, name string, igt_only boolean")


@query("SELECT n_name AS language, r_name AS feature FROM nation CROSS JOIN region WHERE NOT (n_regionkey = r_regionkey OR n_name = 'FRANCE')")
def resumed_work(spark, d):
    """Work left after two runs whose results were added to one store."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    work = n.crossJoin(F.broadcast(r)).select(F.col("n_name").alias("language"), F.col("r_name").alias("feature"), (F.col("n_regionkey") == F.col("r_regionkey")).alias("own"))
    path = _fresh(spark, "results")
    sinks.append_results(work.filter("own").select("language", "feature", F.lit("1").alias("label")), path, ["language"])
    sinks.append_results(work.filter("language = 'FRANCE'").select("language", "feature", F.lit("0").alias("label")), path, ["language"])
    return readers.pending(work.select("language", "feature"), spark.read.parquet(path), ["language", "feature"])


@query("""SELECT 'F' || doc_id AS feature_id, coalesce(lang, '') AS language, CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '?' END AS label, 'Yes, "partly"' AS value, round(doc_id % 100 / 100.0, 2) AS confidence, 'upheld' AS verdict, md5(trim(substr(replace(replace(coalesce(doc_kind, ''), chr(10), ' '), chr(13), ' '), 1, 200))) AS reasoning_md5 FROM documents""")
def coding_summary_round_trip(spark, d):
    """The coding summary written as CSV and read again."""
    docs = table(spark, d, "documents")
    kind = F.translate(F.coalesce("doc_kind", F.lit("")), "\n\r", "  ")
    rows = docs.select(
        F.format_string("F%d", "doc_id").alias("feature_id"), F.coalesce("lang", F.lit("")).alias("language"), F.when(F.col("doc_id") % 2 == 0, "1").otherwise("?").alias("label"), F.lit('Yes, "partly"').alias("value"),
        F.round(F.col("doc_id") % 100 / 100, 2).alias("confidence"), F.lit("upheld").alias("verdict"), kind.alias("label_reasoning"), kind.alias("answer"),
    )
    path = _fresh(spark, "summary")
    sinks.write_csv(sinks.coding_rows(rows), path)
    kinds = ", ".join(f"{n} {'double' if n == 'confidence' else 'string'}" for n in ("feature_id", "language", "label", "value", "confidence", "verdict", "label_reasoning", "answer"))
    back = spark.read.schema(kinds).csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="\u0000")
    return back.select("feature_id", F.coalesce("language", F.lit("")).alias("language"), "label", "value", "confidence", "verdict", F.md5(F.trim(F.coalesce("label_reasoning", F.lit("")))).alias("reasoning_md5"))


# ---- samples and distributions --------------------------------------------------------------------------------------


@query(f"""{_BASE}, t AS (SELECT lang, tag, count(*) AS cnt, min(ord * 1000 + i) AS first FROM tok WHERE contains(lower(translation), 'young') GROUP BY lang, tag)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, first) AS rank, tag, cnt FROM t QUALIFY rank <= 12""")
def translation_tags(spark, d):
    return tools.translation_tags(_ex(spark, d), "young")


@query(f"""{_BASE}, {_grams(2)}, {base._frequent(40)}, o AS (SELECT g.lang, g.gram, e.sec, min(g.ord) AS first FROM grams g JOIN freq f ON f.lang = g.lang AND f.gram = g.gram JOIN ex e ON e.ord = g.ord GROUP BY ALL)
 SELECT lang, gram, row_number() OVER (PARTITION BY lang, gram ORDER BY first) AS rank, sec FROM o QUALIFY rank <= 5""")
def bigram_sections(spark, d):
    return stats.ngram_sections(_ex(spark, d))


@query(f"""{_BASE}, {base._MORPH}, g AS (SELECT h.*, row_number() OVER (PARTITION BY h.lang ORDER BY h.ord, h.w, h.m) AS rank FROM hit h QUALIFY rank <= 6)
 SELECT g.lang, g.rank, g.ord, wd.word, wd.gl AS gloss_word, substr(ex.translation, 1, 55) AS translation FROM g JOIN wd ON wd.ord = g.ord AND wd.w = g.w JOIN ex ON ex.ord = g.ord""")
def slot_samples(spark, d):
    return tools.slot_samples(_ex(spark, d), "PST")


@query(f"WITH {base._CLAIMS} SELECT graph_id, seq, 'C' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS claim_id FROM (SELECT graph_id, seq, row_number() OVER (PARTITION BY graph_id ORDER BY seq) AS n FROM cl)")
def claim_numbers(spark, d):
    return evidence.claim_ids(base._claims(spark, d)).select("graph_id", "seq", "claim_id")


base.ORACLES["evidence_summary"] = f"""WITH {base._CONFIDENCE}, f AS (SELECT graph_id, ns, nc, n_contradictions, CASE WHEN ns = 0 AND nc = 0 THEN 'Unclear' WHEN n_contradictions > 0 AND ta > 0.7 THEN 'Partial' WHEN raw >= 0.75 THEN 'Yes' WHEN raw <= 0.3 THEN 'No' WHEN raw BETWEEN 0.45 AND 0.6 THEN 'Unclear' ELSE 'Partial' END AS verdict,
 round(CASE WHEN ns = 0 AND nc = 0 THEN 0 WHEN n_contradictions > 0 AND ta > 0.7 THEN least(0.6, raw) WHEN raw >= 0.75 THEN raw WHEN raw <= 0.3 THEN 1 - raw WHEN raw BETWEEN 0.45 AND 0.6 THEN 0.4 ELSE raw END, 4) AS confidence FROM r),
 n AS (SELECT graph_id, count(*) AS n, count(*) FILTER (WHERE supports IS NULL) AS neutral FROM cl GROUP BY graph_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY seq) AS no FROM cl), c AS (SELECT graph_id, seq, 'C' || CASE WHEN no < 1000 THEN lpad(no::VARCHAR, 3, '0') ELSE no::VARCHAR END AS claim_id, claim_type, text, source, confidence, supports, example_id FROM k)
 SELECT f.*, n.n, n.neutral, c.seq, c.claim_id, to_json({{'id': c.claim_id, 'type': c.claim_type, 'text': c.text, 'source': c.source, 'confidence': round(c.confidence, 3), 'supports': c.supports, 'igt_examples': [c.example_id, 'chunk_' || (c.seq % 7)]}})::VARCHAR AS claim FROM c JOIN f USING (graph_id) JOIN n USING (graph_id)"""

_CLAIM_PARTS = " UNION ALL ".join(f"SELECT lang, srank, section, subsection, {j} AS p, unnest(range(len(cs))) AS i, trim(unnest(cs)) AS claim FROM (SELECT lang, rank AS srank, section, subsection, regexp_extract_all(full_text, '{p}') AS cs FROM found WHERE rank <= 3)" for j, p in enumerate(base.CLAIM_PATTERNS))
base.ORACLES["author_claims"] = f"""WITH {_SECTION}, {search_sql('negation', 8)}, c AS ({_CLAIM_PARTS})
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY srank, p, i) AS rank, '[' || section || ' / ' || subsection || '] ' || claim AS claim FROM c WHERE length(claim) > 30 AND NOT starts_with(claim, '\\') AND NOT contains(claim, '%') QUALIFY rank <= 25"""
base.ORACLES["xref_2hop_terms"] = f"""WITH {_SECTION}, {_REFS}, {base._LINKS}, e AS (SELECT DISTINCT rf.lang, rf.section_id AS src, coalesce(exact, near) AS dst FROM rf JOIN nr ON nr.lang = rf.lang AND nr.ref = rf.ref), {search_sql('tense and aspect', 3)},
 h0 AS (SELECT lang, section_id AS id FROM found), h1 AS (SELECT DISTINCT e.lang, dst AS id FROM h0 JOIN e ON e.lang = h0.lang AND e.src = h0.id WHERE (e.lang, dst) NOT IN (SELECT (lang, id) FROM h0)),
 h2 AS (SELECT DISTINCT e.lang, dst AS id FROM h1 JOIN e ON e.lang = h1.lang AND e.src = h1.id WHERE (e.lang, dst) NOT IN (SELECT (lang, id) FROM h0) AND (e.lang, dst) NOT IN (SELECT (lang, id) FROM h1))
 SELECT lang, id, 0 AS hop FROM h0 UNION ALL SELECT lang, id, 1 FROM h1 UNION ALL SELECT lang, id, 2 FROM h2"""


# ---- rows that a model answers, with the deterministic stand-in ------------------------------------------------------


def _model_of(rules: list[tuple[str, str]], otherwise: str = "{}"):
    return lambda: RuleModel(rules, otherwise)


@query("""WITH r AS (SELECT coalesce(translation, '') AS p, CASE WHEN contains(p, 'young') THEN '{"label": "1"}' WHEN contains(p, 'river') THEN 'no idea' ELSE '{}' END AS a FROM igt) SELECT count(*) AS calls, sum(length(p))::BIGINT AS prompt_chars, sum(length(a))::BIGINT AS answer_chars FROM r""")
def model_usage(spark, d):
    asked = table(spark, d, "igt").select("ord", F.coalesce("translation", F.lit("")).alias("prompt"))
    return model.usage(model.answers(asked, _model_of([("young", '{"label": "1"}'), ("river", "no idea")]), "label"))


@query(f"""WITH {base._CLAIMS}, p AS (SELECT a.graph_id, a.seq AS sa, b.seq AS sb, a.source || chr(10) || a.text || chr(10) || b.source || chr(10) || b.text AS q, a.source AS ca, b.source AS cb FROM cl a JOIN cl b ON a.graph_id = b.graph_id AND a.seq < b.seq AND a.supports <> b.supports WHERE a.confidence >= 0.6 AND b.confidence >= 0.6),
 m AS (SELECT graph_id, sa, sb, CASE WHEN ca = 'click' THEN 0.35 END AS na, CASE WHEN ca = 'click' THEN 0.8 WHEN ca = 'error' THEN 0.1 END AS nb FROM p), n AS (SELECT graph_id, sa AS seq, sa, sb, na AS v FROM m WHERE na IS NOT NULL UNION ALL SELECT graph_id, sb, sa, sb, nb FROM m WHERE nb IS NOT NULL),
 l AS (SELECT graph_id, seq, v FROM n QUALIFY row_number() OVER (PARTITION BY graph_id, seq ORDER BY sa DESC, sb DESC) = 1) SELECT graph_id, seq, coalesce(v, confidence) AS confidence FROM cl LEFT JOIN l USING (graph_id, seq)""")
def contradictions_by_model(spark, d):
    """Contradictions put to a model that revises confidences by the earlier claim's source."""
    c = base._claims(spark, d).withColumn("source", F.concat(F.lit("<"), "source", F.lit(">")))
    first = [("1\n<click>", '{"resolved": true, "revised_confidence_a": 0.35, "revised_confidence_b": 0.8}'), ("1\n<error>", '{"resolved": true, "resolution": "older", "revised_confidence_b": 0.1}'), ("1\n<view>", '{"resolved": false, "revised_confidence_b": 0.1}')]
    asked = c.withColumn("graph_id", F.concat("graph_id", F.lit("#1")))
    got = evidence.revised(asked, model.resolve_contradictions(asked, _model_of(first)))
    return got.select(F.substring_index("graph_id", "#", 1).alias("graph_id"), "seq", "confidence")


_UNIVERSAL_RULES = [
    ("UNIVERSAL PLAN", '{"language_strategies": {"ASIA": {"target_sections": ["Tense", "Aspect"], "diagnostic_tags": ["PST"], "search_focus": "endings"}, "EUROPE": {"search_focus": ""}}}'),
    ("UNIVERSAL EXTRACT\nASIA", '{"antecedent_holds": true, "consequent_holds": false, "confidence": 0.9}'),
    ("UNIVERSAL EXTRACT\nEUROPE", '{"antecedent_holds": "Yes", "consequent_holds": true, "confidence": 0.8, "notes": "seen"}'),
    ("UNIVERSAL EXTRACT\nAFRICA", '```json\n{"antecedent_holds": false, "confidence": 0.7}\n```'),
    ("UNIVERSAL EXTRACT\nAMERICA", '{"antecedent_holds": true, "consequent_holds": true, "confidence": "0.66"}'),
    ("UNIVERSAL EXTRACT", "no object"),
    ("UNIVERSAL SYNTHESIS", '{"verdict": "open", "language_assessments": {"EUROPE": {"assessment": "irrelevant", "reason": "other topic"}, "MIDDLE EAST": {"assessment": "VALID_SUPPORT"}}}'),
    ("person", "So the antecedent does not hold here."),
]
_UNIVERSAL_LABELS = f"""{_UNIVERSALS}, l AS (SELECT id AS uid, logic, statement, r_name AS language FROM u CROSS JOIN region),
 lb AS (SELECT uid, language, CASE language WHEN 'ASIA' THEN CASE WHEN logic = 'implication' AND contains(statement, 'person') THEN 'ANTECEDENT_NA' ELSE 'VALID_VIOLATION' END WHEN 'EUROPE' THEN 'IRRELEVANT'
  WHEN 'AFRICA' THEN CASE WHEN logic = 'implication' THEN 'ANTECEDENT_NA' ELSE 'INSUFFICIENT' END WHEN 'AMERICA' THEN 'VALID_SUPPORT' ELSE 'INSUFFICIENT' END AS label FROM l)"""


def _universals_run(spark, d):
    u = readers.universals_defaults(_universals(spark, d))
    langs = table(spark, d, "region").select(F.col("r_name").alias("language"), F.concat(F.lit("Contents of "), "r_name").alias("digest"))
    return universals.run(u, langs, _model_of(_UNIVERSAL_RULES, "It holds."))


@query(f"WITH {_UNIVERSAL_LABELS} SELECT uid, language, label FROM lb")
def universals_pipeline(spark, d):
    return _universals_run(spark, d)[0].select("uid", "language", "label")


@query(f"WITH {_UNIVERSAL_LABELS} SELECT uid, CASE WHEN count(*) FILTER (WHERE label = 'VALID_VIOLATION') > 0 THEN 'FALSE' ELSE 'TRUE' END AS verdict, count(*) FILTER (WHERE label = 'ANTECEDENT_NA') AS n_antecedent_na FROM lb GROUP BY uid")
def universals_verdicts(spark, d):
    return _universals_run(spark, d)[1].select("uid", "verdict", "n_antecedent_na")


@query(f"""WITH {_UNIVERSALS} SELECT id, r_name AS language, CASE WHEN r_name = 'ASIA' THEN 'Tense|Aspect' ELSE '' END AS target_sections, CASE WHEN r_name = 'ASIA' THEN 'PST' ELSE '' END AS diagnostic_tags, CASE WHEN r_name = 'ASIA' THEN 'endings' ELSE 'Search for evidence relating to: ' || substr(statement, 1, 100) END AS search_focus FROM u CROSS JOIN region""")
def universals_plan(spark, d):
    langs = table(spark, d, "region").select(F.col("r_name").alias("language"), F.lit(None).cast("string").alias("digest"))
    p = universals.plan(readers.universals_defaults(_universals(spark, d)), langs, _model_of(_UNIVERSAL_RULES))
    return p.select("id", "language", F.array_join("target_sections", "|").alias("target_sections"), F.array_join("diagnostic_tags", "|").alias("diagnostic_tags"), "search_focus")


@query(f"""WITH {base._ANSWERS}, a AS (SELECT DISTINCT question, language FROM an), s AS (SELECT question, language, CASE WHEN question = 'PST' AND language = (SELECT min(language) FROM an WHERE question = 'PST') THEN 'suffix' WHEN question = 'PST' THEN 'Unclear' END AS t FROM a),
 v AS (SELECT question, coalesce(value, substr(answer, 1, 30)) AS type_label, language FROM an WHERE question <> 'PST') SELECT question, t AS type_label, language FROM s WHERE t IS NOT NULL UNION ALL SELECT question, type_label, language FROM v""")
def survey_types(spark, d):
    """Languages of each question sorted into types; only one question gets types from the model."""
    a = base._answers(spark, d)
    one = a.filter("question = 'PST'").agg(F.min("language")).first()[0] or ""
    rules_ = [("SYNTHESIS\nPST\n", json.dumps({"types": [{"label": "suffix", "languages": [one, "Nowhere"]}, {"label": "", "languages": ["x"]}]}))]
    return survey.types(a, _model_of(rules_, "cannot say"))


@query("SELECT n_name || '?' AS question, r_name AS language, CASE WHEN r_name = 'ASIA' THEN 'Yes' ELSE 'No' END AS value FROM nation CROSS JOIN region WHERE n_nationkey < 3")
def survey_resumed(spark, d):
    """Questions over languages in two runs, the second of which asks only what the first left."""
    q = table(spark, d, "nation").filter("n_nationkey < 3").select(F.concat("n_name", F.lit("?")).alias("question"))
    langs = [r[0] for r in table(spark, d, "region").orderBy("r_regionkey").select("r_name").collect()]
    path = _fresh(spark, "survey")
    one = lambda question, lang: ("Yes" if lang == "ASIA" else "No", question + lang, 0.9)
    survey.investigate(spark, q.limit(1), langs[:2], one, path)
    return survey.investigate(spark, q, langs, one, path, skip_existing=True).select("question", "language", "value")
