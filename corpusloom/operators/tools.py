"""Look-ups over annotated examples: sections, translations, constructions, surface forms, candidates, neighbours.

Each gives a DataFrame; nothing is rendered. Input is the corpus view of stats.examples, per language; limits follow
document order (ord) unless another order is named.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.constants import KEYWORD_STOP, PHRASES, SEMANTIC_CLUSTERS, TAG_CLUSTERS, TRANSLATION_STOP
from corpusloom.operators.stats import ordinal, place_in_corpus, tag_profiles, tokens, top_per


def first_rows(df: DataFrame, k: int, order: str = "ord") -> DataFrame:
    """The first k rows of each language, with their rank."""
    return top_per(df, ["lang"], [F.asc(order)], k)


def resolve_tag(profiles: DataFrame, names: list[str], rule: str = "profile") -> DataFrame:
    """Tags that a name stands for. Rules: profile (exact, upper case, up to 5 by prefix in any case), first (the same,
    one only), strict (upper case, then one by prefix of the upper form)."""
    asked = profiles.sparkSession.createDataFrame([(n,) for n in names], "name string")
    p = profiles.select("lang", "tag", "first").crossJoin(F.broadcast(asked))
    up, low = F.upper("name"), F.lower("name")
    if rule == "strict":
        tier = F.when(F.col("tag") == up, 1).when(F.col("tag").startswith(up), 2)
    else:
        tier = F.when(F.col("tag") == F.col("name"), 0).when(F.col("tag") == up, 1).when(F.startswith(F.lower("tag"), low), 2)
    hit = p.withColumn("tier", tier).filter("tier is not null")
    hit = hit.withColumn("best", F.min("tier").over(Window.partitionBy("lang", "name"))).filter("tier = best")
    k = 5 if rule == "profile" else 1
    return top_per(hit, ["lang", "name"], [F.asc("first")], k).select("lang", "name", "rank", "tag", "tier")


def in_section(query: str) -> Column:
    q = query.lower()
    return F.greatest(*[F.contains(F.lower(c), F.lit(q)) for c in ("source_section", "section", "chapter", "subsubsection")])


def section_examples(ex: DataFrame, query: str, k: int = 15) -> DataFrame:
    return first_rows(ex.filter(in_section(query)), k).select("lang", "rank", "ord", "example_id", "sec")


def section_tags(ex: DataFrame, query: str, k: int = 10) -> DataFrame:
    t = tokens(ex.filter(in_section(query))).groupBy("lang", "tag").agg(F.count("*").alias("cnt"), F.min(place_in_corpus("i")).alias("first"))
    return top_per(t, ["lang"], [F.desc("cnt"), F.asc("first")], k).select("lang", "rank", "tag", "cnt")


def search_translations(ex: DataFrame, query: str, k: int = 15) -> DataFrame:
    """First matches with the query highlighted, number of matches and their share of the corpus."""
    q = query.strip().lower()
    hit = F.contains(F.lower("translation"), F.lit(q))
    n = ex.groupBy("lang").agg(F.count("*").alias("n_examples"), F.count_if(hit).alias("n_hits"))
    shown = F.replace(F.replace("translation", F.lit(q), F.lit(f"**{q}**")), F.lit(q.capitalize()), F.lit(f"**{q.capitalize()}**"))
    return first_rows(ex.filter(hit), k).join(n, "lang").select("lang", "rank", "ord", "example_id", shown.alias("shown"), "n_hits", F.round(F.col("n_hits") / F.col("n_examples"), 6).alias("share"))


def translation_tags(ex: DataFrame, query: str, k: int = 12) -> DataFrame:
    """The most frequent tags of the examples whose translation holds the query."""
    hit = tokens(ex.filter(F.contains(F.lower("translation"), F.lit(query.strip().lower()))))
    t = hit.groupBy("lang", "tag").agg(F.count("*").alias("cnt"), F.min(place_in_corpus("i")).alias("first"))
    return top_per(t, ["lang"], [F.desc("cnt"), F.asc("first")], k).select("lang", "rank", "tag", "cnt")


def has_run(tags: list[str]) -> Column:
    """Whether the (upper-case) tags stand side by side in this order; the empty run is everywhere."""
    want = F.array(*[F.lit(t.upper()) for t in tags]) if tags else F.array().cast("array<string>")
    n = len(tags)
    if not n:
        return F.lit(True)
    return F.when(F.size("tags") >= n, F.exists(F.sequence(F.lit(0), F.size("tags") - n), lambda i: F.slice("tags", i + 1, n) == want)).otherwise(False)


def construction(ex: DataFrame, tags: list[str], k: int = 8) -> DataFrame:
    hit = ex.filter(has_run(tags))
    return first_rows(hit, k).join(hit.groupBy("lang").agg(F.count("*").alias("n_hits")), "lang").select("lang", "rank", "ord", "example_id", "n_hits")


def trilines(ex: DataFrame, query: str, k: int = 8) -> DataFrame:
    """Examples of the first of three tiers that has any: tag, translation, section."""
    q = query.lower()
    tier = (
        F.when(F.array_contains("tags", query) | F.array_contains("tags", query.upper()), 1)
        .when(F.contains(F.lower("translation"), F.lit(q)), 2)
        .when(F.contains(F.lower("source_section"), F.lit(q)), 3)
    )
    hit = ex.withColumn("tier", tier).filter("tier is not null")
    # the first k rows of the first tier are the first k by tier and place, less those of other tiers
    top = top_per(hit, ["lang"], [F.asc("tier"), F.asc("ord")], k)
    return first_rows(top.join(top.groupBy("lang").agg(F.min("tier").alias("tier")), ["lang", "tier"]).drop("rank"), k).select("lang", "rank", "tier", "ord", "example_id")


def in_any_section(preferred: list[str]) -> Column:
    crumb = F.lower("source_section")
    return F.greatest(F.lit(False), F.lit(False), *[F.contains(crumb, F.lit(p.lower())) for p in preferred])


def section_aware(candidates: DataFrame, preferred: list[str], k: int = 8) -> DataFrame:
    """At most k candidates, those of preferred sections first: no more than half of k and one of them, the rest from
    other sections only."""
    pref = in_any_section(preferred)
    # no more than k of either side matter, so the sides are cut before they are counted
    c = top_per(candidates.withColumn("pref", pref), ["lang", "pref"], [F.asc("ord")], k, "r")
    c = c.join(c.groupBy("lang").agg(F.count_if("pref").alias("n_pref")), "lang")
    quota = F.least("n_pref", F.lit(max(1, k // 2 + 1)))
    kept = c.filter((F.col("pref") & (F.col("r") <= quota)) | (~F.col("pref") & (F.col("r") <= k - quota)))
    return top_per(kept, ["lang"], [F.desc("pref"), F.asc("ord")], k).select("lang", "rank", "pref", "ord", "example_id")


def _words(col: str) -> Column:
    return F.filter(F.split(F.trim(col), r"(?U)\s+"), lambda w: w != "")


def morphs(ex: DataFrame, tag: str) -> DataFrame:
    """Morphs of examples that hold the tag, aligned with their glosses: words by place (the longer line is cut), parts
    by place where a word has as many on both lines. lang, ord, w, m, n (parts of the word), form, word, gloss_word, is_tag."""
    up = tag.upper()
    a, b = _words("morpheme"), _words("gloss")
    k = F.least(F.size(a), F.size(b))
    rows = ex.filter(F.array_contains("tags", up)).select("lang", "ord", F.when(k > 0, F.arrays_zip(F.slice(a, 1, k).alias("a"), F.slice(b, 1, k).alias("b"))).alias("ws"))
    w = rows.select("lang", "ord", F.posexplode("ws").alias("w", "p")).select("lang", "ord", "w", F.col("p.a").alias("word"), F.col("p.b").alias("gloss_word"), F.split("p.a", "[-=]").alias("ms"), F.split("p.b", "[-=]").alias("gs"))
    same = w.filter(F.size("ms") == F.size("gs"))
    m = same.select("lang", "ord", "w", "word", "gloss_word", F.size("ms").alias("n"), F.posexplode(F.arrays_zip("ms", "gs")).alias("m", "x"))
    is_tag = (F.col("x.gs") == up) | F.startswith(F.col("x.gs"), F.lit(up + "."))
    return m.select("lang", "ord", "w", "m", "n", "word", "gloss_word", F.col("x.ms").alias("form"), is_tag.alias("is_tag"))


def surface_forms(ex: DataFrame, tag: str, k: int = 8) -> DataFrame:
    f = morphs(ex, tag).filter("is_tag").groupBy("lang", "form").agg(F.count("*").alias("cnt"), F.min(place_in_corpus("w", "m")).alias("first"))
    return top_per(f, ["lang"], [F.desc("cnt"), F.asc("first")], k).select("lang", "rank", "form", "cnt")


def morpheme_positions(ex: DataFrame, tag: str) -> DataFrame:
    """How often the tag's morph is prefix, suffix, stem or medial; the dominant slot (earlier of this list on ties)."""
    m = morphs(ex, tag).filter("is_tag")
    slot = F.when(F.col("n") == 1, "stem").when(F.col("m") == 0, "prefix").when(F.col("m") == F.col("n") - 1, "suffix").otherwise("medial")
    names = ["prefix", "suffix", "stem", "medial"]
    c = m.withColumn("slot", slot).groupBy("lang").agg(*[F.count_if(F.col("slot") == s).alias(s) for s in names], F.count("*").alias("total"))
    top = F.greatest(*names)
    return c.select("lang", *names, "total", F.coalesce(*[F.when(F.col(s) == top, s) for s in names]).alias("dominant"))


def slot_samples(ex: DataFrame, tag: str, k: int = 6) -> DataFrame:
    """The first words that hold the tag's morph, with their gloss and the beginning of the translation."""
    hit = morphs(ex, tag).filter("is_tag")
    first = top_per(hit, ["lang"], [F.asc("ord"), F.asc("w"), F.asc("m")], k)
    return first.join(ex.select("ord", F.substring("translation", 1, 55).alias("translation")), "ord").select("lang", "rank", "ord", "word", "gloss_word", "translation")


def semantic_domains(ex: DataFrame, tag: str) -> DataFrame:
    """Translations of the tag's examples with a keyword of each domain; domains without any are left out."""
    tagged = ex.filter(F.array_contains("tags", tag.upper())).select("lang", F.lower("translation").alias("tr"))
    flags = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(i).alias("o"), F.greatest(*[F.contains("tr", F.lit(k)) for k in ks]).alias("hit")) for i, (d, ks) in enumerate(SEMANTIC_CLUSTERS.items())])
    n = tagged.groupBy("lang").agg(F.count("*").alias("n_tagged"))
    hits = tagged.select("lang", F.explode(flags).alias("f")).filter("f.hit").groupBy("lang", F.col("f.domain").alias("domain"), F.col("f.o").alias("o")).agg(F.count("*").alias("cnt"))
    return top_per(hits.join(n, "lang"), ["lang"], [F.desc("cnt"), F.asc("o")], 99).select("lang", "rank", "domain", "cnt", "n_tagged")


def translation_words(ex: DataFrame, tag: str, k: int = 15) -> DataFrame:
    """The most frequent words (three lower-case ASCII letters or more) of the tag's translations, without stop-words."""
    ws = F.regexp_extract_all(F.lower("translation"), F.lit(r"(?U)(\b[a-z]{3,}\b)"), 1)
    w = ex.filter(F.array_contains("tags", tag.upper())).select("lang", "ord", F.posexplode(ws).alias("i", "word")).filter(~F.col("word").isin(TRANSLATION_STOP))
    f = w.groupBy("lang", "word").agg(F.count("*").alias("cnt"), F.min(place_in_corpus("i")).alias("first"))
    return top_per(f, ["lang"], [F.desc("cnt"), F.asc("first")], k).select("lang", "rank", "word", "cnt")


def question_terms(question: str, stop: set[str] = frozenset(), k: int = 8) -> list[str]:
    """Phrases, then content words of a question, each once."""
    q = question.lower()
    found = [m.group() for p in PHRASES for m in re.finditer(p, q)]
    found += [w for w in re.findall(r"[a-z]{3,}", q) if w not in KEYWORD_STOP and w not in stop]
    return list(dict.fromkeys(found))[:k]


def tags_for_question(ex: DataFrame, question: str, k: int = 6) -> DataFrame:
    """Tags that examples share whose translations hold the question's terms. An example counts once per term."""
    ts = question_terms(question)
    hits = ex.select("lang", "ord", "tags", F.explode(F.array(*[F.struct(F.lit(i).alias("term"), F.contains(F.lower("translation"), F.lit(t)).alias("hit")) for i, t in enumerate(ts)])).alias("h")).filter("h.hit")
    total = hits.groupBy("lang").agg(F.count("*").alias("total_hits"))
    # first seen: by term, then example, then place
    c = hits.select("lang", "ord", F.col("h.term").alias("term"), F.posexplode("tags").alias("i", "tag"))
    c = c.groupBy("lang", "tag").agg(F.count("*").alias("cnt"), F.min(F.struct("term", "ord", "i")).alias("first"))
    top = top_per(c, ["lang"], [F.desc("cnt"), F.asc("first")], 20, "r")
    prof = tag_profiles(ex).select("lang", "tag", "coverage")
    kept = top.join(total, "lang").join(prof, ["lang", "tag"]).filter((F.col("coverage") <= 0.30) & (F.col("cnt") >= 2) & (F.col("cnt") / F.col("total_hits") < 0.65) & (F.length("tag") >= 2))
    return top_per(kept, ["lang"], [F.asc("r")], k).select("lang", "rank", "tag", "cnt", "total_hits")


def candidates(ex: DataFrame, tags: list[str], text: str, k: int = 10) -> DataFrame:
    """Examples by twice the number of query tags present plus keywords (over three letters) in translation or gloss;
    of equal scores the later example first."""
    words = [w for w in text.lower().split() if len(w) > 3]
    parts = [F.when(F.array_contains("tags", t), 2).otherwise(0) for t in tags]
    parts += [F.when(F.contains(F.lower("translation"), F.lit(w)) | F.contains(F.lower("gloss"), F.lit(w)), 1).otherwise(0) for w in words]
    score = sum(parts[1:], parts[0]) if parts else F.lit(0)
    return top_per(ex.withColumn("score", score).filter("score > 0"), ["lang"], [F.desc("score"), F.desc("ord")], k).select("lang", "rank", "ord", "example_id", "score")


def keyword_examples(ex: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Examples by the number of query words (three letters or more, upper case) in gloss, translation or tags; of equal
    numbers the later example first."""
    words = [w.upper() for w in re.findall(r"[a-zA-Z]{3,}", query)]
    hit = lambda w: F.contains(F.upper("gloss"), F.lit(w)) | F.contains(F.upper("translation"), F.lit(w)) | F.array_contains("tags", w)
    score = sum((F.when(hit(w), 1).otherwise(0) for w in words), F.lit(0))
    return top_per(ex.withColumn("score", score).filter("score > 0"), ["lang"], [F.desc("score"), F.desc("ord")], k).select("lang", "rank", "ord", "example_id", "score")


def category_examples(ex: DataFrame, category: str, k: int = 8) -> DataFrame:
    """The first examples with any tag of a category."""
    return first_rows(ex.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in TAG_CLUSTERS[category]]))), k).select("lang", "rank", "ord", "example_id")


def plan_tags(planned: list[str], candidates: list[str]) -> list[str]:
    """Planned tags if any of them is a candidate; else the first five candidates."""
    up = {t.upper() for t in candidates}
    return candidates[:5] if candidates and not any(t.upper() in up for t in planned) else planned


def lookup(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """ids: lang, pos, id -> the (last) row of each id, in the order asked, missing ones left out."""
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy("lang", key).orderBy(F.desc("ord")))).filter("_r = 1").drop("_r")
    return ids.join(last.withColumnRenamed(key, "id"), ["lang", "id"])


def summaries(ids: DataFrame, chunks: DataFrame, k: int = 12) -> DataFrame:
    """ids: lang, pos, id. Distinct ids in order, the first k; each is looked up as it is, else without a suffix _p<n>.
    Empty summaries are left out."""
    once = ids.groupBy("lang", "id").agg(F.min("pos").alias("pos"))
    some = top_per(once, ["lang"], [F.asc("pos")], k).withColumn("base", F.regexp_replace("id", r"_p\d+$", ""))
    last = chunks.groupBy("lang", "chunk_id").agg(F.max_by(F.coalesce("summary", F.lit("")), "ord").alias("summary"))
    own = last.select("lang", F.col("chunk_id").alias("id"), F.col("summary").alias("s1"))
    base = last.select("lang", F.col("chunk_id").alias("base"), F.col("summary").alias("s2"))
    r = some.join(own, ["lang", "id"], "left").join(base, ["lang", "base"], "left").withColumn("summary", F.coalesce("s1", "s2"))
    return r.filter("summary <> ''").select("lang", "rank", "id", "summary")


def context_window(chunks: DataFrame, targets: DataFrame | None = None, window: int = 2) -> DataFrame:
    """Chunks within window places of each target (lang, chunk_id; every chunk without targets), in document order; text
    cut to 600 characters.

    Neighbours share a bucket of places or stand in the next one, so the band join is an equi-join on buckets."""
    size = 2 * window + 1
    c = ordinal(chunks, "lang", "ord", "n")
    hit = c if targets is None else c.join(targets.select("lang", "chunk_id"), ["lang", "chunk_id"], "left_semi")
    t = hit.select("lang", F.col("chunk_id").alias("target"), F.col("n").alias("tn"), "ord")
    t = t.select("lang", "target", "tn", F.col("ord").alias("tord"), F.explode(F.array_distinct(F.array(F.floor((F.col("tn") - window) / size), F.floor((F.col("tn") + window) / size)))).alias("bucket"))
    both = t.join(c.withColumn("bucket", F.floor(F.col("n") / size)), ["lang", "bucket"]).filter(F.col("n").between(F.col("tn") - window, F.col("tn") + window))
    return both.select("lang", "target", "tord", (F.col("n") - F.col("tn")).alias("offset"), "chunk_id", F.substring(F.coalesce("text", F.lit("")), 1, 600).alias("text"))
