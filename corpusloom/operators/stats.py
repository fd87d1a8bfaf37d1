"""Statistics of annotated examples: tag profiles, co-occurrence, n-grams, categories, sections.

The hot table is the exploded view of tags (tokens). All statistics are per language, the unit of one corpus; every
limit has a total order (ties go to what the corpus has first). Null and empty tags are no tags; examples without tags
count among the examples of their language.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.constants import PARADIGM_SLOTS, TAG_CLUSTERS


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def examples(igt: DataFrame) -> DataFrame:
    """The corpus view: no null strings, tags without null and empty ones, sec: the place an example comes from."""
    strings = ["lang", "example_id", "source", "morpheme", "gloss", "translation", "chapter", "section", "subsection", "subsubsection", "source_section"]
    tags = F.coalesce(F.filter("gloss_tags", lambda t: t.isNotNull() & (t != "")), F.array().cast("array<string>"))
    sec = F.when(text_of("source_section") != "", F.col("source_section")).otherwise(text_of("section"))
    tones = text_of("tones") if "tones" in igt.columns else F.lit("")
    return igt.select("ord", *[text_of(c).alias(c) for c in strings], tones.alias("tones"), tags.alias("tags"), sec.alias("sec"))


def tokens(ex: DataFrame) -> DataFrame:
    """One row per tag: lang, ord, example_id, sec, n (tags of the example), i (place), tag."""
    return ex.select("lang", "ord", "example_id", "sec", F.size("tags").alias("n"), F.posexplode("tags").alias("i", "tag"))


def marked_tokens(ex: DataFrame) -> DataFrame:
    """tokens with new: 1 at one of the places of each distinct tag of an example, else 0, so that examples are counted
    without a distinct aggregation. Tags are sorted within the example, equal ones stand together."""
    s = ex.select("lang", "ord", F.array_sort(F.transform("tags", lambda t, i: F.struct(t.alias("tag"), i.alias("i")))).alias("s"))
    new = F.transform("s", lambda x, k: F.struct(x["tag"].alias("tag"), x["i"].alias("i"), F.when((k > 0) & (F.get("s", k - 1)["tag"] == x["tag"]), 0).otherwise(1).alias("new")))
    return s.select("lang", "ord", F.size("s").alias("n"), F.explode(new).alias("e")).select("lang", "ord", "n", "e.*")


def corpus_sizes(ex: DataFrame) -> DataFrame:
    return ex.groupBy("lang").agg(F.count("*").alias("n_examples"))


def steady(x: Column) -> Column:
    """A mean without the noise of summation order, so that thresholds and rounding are stable."""
    return F.round(x, 9)


def place_in_corpus(*parts: str) -> Column:
    """Order of first appearance: example, then places within it: up to a million tags or words a line, a thousand parts a
    word, and 2^33 examples."""
    out = F.col("ord")
    for p, most in zip(parts, (1 << 20, 1 << 10)):
        out = out * most + F.col(p)
    return out


def tag_profiles(ex: DataFrame) -> DataFrame:
    """Count, coverage (tokens per example), relative position and its label, by language and tag."""
    t = marked_tokens(ex).withColumn("pos", F.when(F.col("n") > 1, F.col("i") / (F.col("n") - 1)).otherwise(0.5))
    mean, std = steady(F.avg("pos")), steady(F.coalesce(F.stddev_samp("pos"), F.lit(0.0)))
    label = (
        F.when(F.col("std") >= 0.15, "flexible")
        .when(F.col("mean") < 0.25, "preverbal/initial")
        .when(F.col("mean") > 0.75, "postverbal/final")
        .otherwise("medial-fixed")
    )
    prof = t.groupBy("lang", "tag").agg(F.count("*").alias("cnt"), F.sum("new").alias("n_holding"), mean.alias("mean"), std.alias("std"), F.min(place_in_corpus("i")).alias("first"))
    return prof.join(corpus_sizes(ex), "lang").select(
        "lang", "tag", "cnt", (F.col("cnt") / F.col("n_examples")).alias("coverage"), "n_holding",
        F.round("mean", 3).alias("mean_pos"), F.round("std", 3).alias("std_pos"), label.alias("position"), "first", "n_examples",
    )


def pair_counts(ex: DataFrame) -> DataFrame:
    """Unordered pairs of tags in one example, counted by token pairs (repeats and a tag with itself included)."""
    idx = F.sequence(F.lit(0), F.size("tags") - 1)
    pairs = F.flatten(
        F.transform(
            idx,
            lambda i: F.transform(
                F.filter(idx, lambda j: j > i),
                lambda j: F.struct(F.least(F.get("tags", i), F.get("tags", j)).alias("a"), F.greatest(F.get("tags", i), F.get("tags", j)).alias("b"), i.alias("i"), j.alias("j")),
            ),
        )
    )
    rows = ex.filter(F.size("tags") > 1).select("lang", "ord", F.explode(pairs).alias("p")).select("lang", "ord", "p.*")
    return rows.groupBy("lang", "a", "b").agg(F.count("*").alias("cnt"), F.min(place_in_corpus("i", "j")).alias("first"))


def partners(pairs: DataFrame) -> DataFrame:
    """Each pair seen from both tags; a tag with itself once."""
    one = pairs.select("lang", F.col("a").alias("tag"), F.col("b").alias("partner"), "cnt", "first")
    return one.unionByName(pairs.filter("a <> b").select("lang", F.col("b").alias("tag"), F.col("a").alias("partner"), "cnt", "first"))


def top_per(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def ordinal(df: DataFrame, by: str, order: str, out: str, width: int = 50_000) -> DataFrame:
    """Adds the place of each row in the order of its group, from 1, without sorting a whole group in one task: places
    within ranges of the (integer) order are added to the sizes of the ranges before."""
    r = df.withColumn("_b", F.floor(F.col(order) / width))
    sizes = r.groupBy(by, "_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_o", F.sum("_n").over(Window.partitionBy(by).orderBy("_b")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy(by, "_b").orderBy(order))
    return r.withColumn("_r", within).join(before, [by, "_b"]).withColumn(out, F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")


def top_cooccurrents(ex: DataFrame, k: int = 8) -> DataFrame:
    return top_per(partners(pair_counts(ex)), ["lang", "tag"], [F.desc("cnt"), F.asc("first")], k).select("lang", "tag", "rank", "partner", "cnt")


def top_sections(ex: DataFrame, k: int = 5) -> DataFrame:
    s = tokens(ex).groupBy("lang", "tag", "sec").agg(F.count("*").alias("cnt"), F.min(place_in_corpus("i")).alias("first"))
    return top_per(s, ["lang", "tag"], [F.desc("cnt"), F.asc("first")], k).select("lang", "tag", "rank", "sec", "cnt")


def ngrams(ex: DataFrame, n: int) -> DataFrame:
    """Every run of n neighbouring tags: lang, ord, example_id, sec, translation, i, gram."""
    starts = F.when(F.size("tags") >= n, F.sequence(F.lit(0), F.size("tags") - n)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.struct(i.alias("i"), F.array_join(F.slice("tags", i + 1, n), " ").alias("gram")))
    return ex.select("lang", "ord", "example_id", "sec", "translation", F.explode(grams).alias("g")).select("lang", "ord", "example_id", "sec", "translation", "g.*")


def frequent_ngrams(ex: DataFrame, n: int, k: int, least: int = 5) -> DataFrame:
    g = ngrams(ex, n).groupBy("lang", "gram").agg(F.count("*").alias("cnt"), F.min(place_in_corpus("i")).alias("first"))
    return top_per(g.filter(F.col("cnt") >= least), ["lang"], [F.desc("cnt"), F.asc("first")], k).select("lang", "rank", "gram", "cnt")


def ngram_samples(ex: DataFrame, k: int = 40, ids: int = 5, translations: int = 3) -> DataFrame:
    """Frequent bigrams with the example ids of their first occurrences and the first translations that aren't empty."""
    occ = ngrams(ex, 2).join(frequent_ngrams(ex, 2, k), ["lang", "gram"])
    order = [F.asc("ord"), F.asc("i")]
    some = top_per(occ, ["lang", "gram"], order, ids, "r").select("lang", "gram", "rank", "cnt", "r", F.lit(1).alias("what"), F.col("example_id").alias("v"))
    told = top_per(occ.filter("translation <> ''"), ["lang", "gram"], order, translations, "r").select("lang", "gram", "rank", "cnt", "r", F.lit(2).alias("what"), F.substring("translation", 1, 80).alias("v"))
    listed = lambda what: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct("r", "v")))), lambda x: x["v"]), " | ")
    return some.unionByName(told).groupBy("lang", "gram", "rank", "cnt").agg(listed(1).alias("ids"), listed(2).alias("translations"))


def ngram_sections(ex: DataFrame, k: int = 40, most: int = 5) -> DataFrame:
    """The places of frequent bigrams, each once, in the order of their first example."""
    occ = ngrams(ex, 2).join(frequent_ngrams(ex, 2, k).select("lang", "gram"), ["lang", "gram"])
    first = occ.groupBy("lang", "gram", "sec").agg(F.min("ord").alias("first"))
    return top_per(first, ["lang", "gram"], [F.asc("first")], most).select("lang", "gram", "rank", "sec")


def _table(df: DataFrame, name: str, values: dict[str, list[str]]) -> DataFrame:
    """A constant table (name, name_ord, tag)."""
    rows = [(k, i, t) for i, (k, ts) in enumerate(values.items()) for t in ts]
    return df.sparkSession.createDataFrame(rows, f"{name} string, {name}_ord int, tag string")


def _hits(ex: DataFrame, name: str, values: dict[str, list[str]]) -> DataFrame:
    """Tokens per language and group of tags, zero included, with the tags present."""
    counts = tokens(ex).groupBy("lang", "tag").agg(F.count("*").alias("cnt"))
    groups = _table(ex, name, values)
    every = corpus_sizes(ex).select("lang", "n_examples", F.explode(F.array(*[F.struct(F.lit(k).alias(name), F.lit(i).alias("o")) for i, k in enumerate(values)])).alias("g"))
    found = counts.join(F.broadcast(groups), "tag").groupBy("lang", name).agg(
        F.sum("cnt").alias("hits"), F.array_join(F.array_sort(F.collect_list("tag")), " ").alias("present"), F.count("*").alias("forms")
    )
    return (
        every.select("lang", "n_examples", F.col(f"g.{name}").alias(name))
        .join(found, ["lang", name], "left")
        .select("lang", name, "n_examples", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("present", F.lit("")).alias("present"), F.coalesce("forms", F.lit(0)).alias("forms"))
    )


def absent_categories(ex: DataFrame) -> DataFrame:
    """Categories without any token (zero) or with less than one per 200 examples (marginal)."""
    h = _hits(ex, "category", TAG_CLUSTERS).withColumn("rate", F.col("hits") / F.col("n_examples"))
    kind = F.when(F.col("hits") == 0, "zero").when(F.col("rate") < 0.005, "marginal")
    return h.withColumn("kind", kind).filter("kind is not null").select("lang", "category", "kind", "hits", F.round("rate", 4).alias("rate"), "present")


def absence_verdicts(ex: DataFrame) -> DataFrame:
    """How strongly the corpus speaks for the absence of each category."""
    h = _hits(ex, "category", TAG_CLUSTERS).withColumn("rate", F.col("hits") / F.col("n_examples"))
    verdict = F.when(F.col("rate") == 0, "STRONG ABSENCE").when(F.col("rate") < 0.01, "WEAK PRESENCE").when(F.col("rate") < 0.05, "LIMITED").otherwise("PRESENT")
    return h.select("lang", "category", "hits", F.round("rate", 6).alias("rate"), verdict.alias("verdict"))


def resolve_category(query: str) -> str | None:
    """The exact name, else the first category that contains the query or is contained in it; the empty query contains nothing but is contained in all."""
    q = query.upper()
    return q if q in TAG_CLUSTERS else next((k for k in TAG_CLUSTERS if q in k or k in q), None)


def paradigm_slots(ex: DataFrame) -> DataFrame:
    return _hits(ex, "slot", PARADIGM_SLOTS).select("lang", "slot", "hits", "forms", "present", (F.col("hits") > 0).alias("attested"))


def section_richness(ex: DataFrame, k: int = 8) -> DataFrame:
    """Per place: examples (those without tags too), distinct tags, the k most frequent tags."""
    n = ex.groupBy("lang", "sec").agg(F.count("*").alias("n_examples"))
    t = tokens(ex).groupBy("lang", "sec", "tag").agg(F.count("*").alias("cnt"), F.min(place_in_corpus("i")).alias("first"))
    w = Window.partitionBy("lang", "sec").orderBy(F.desc("cnt"), F.asc("first"))
    r = t.withColumn("r", F.row_number().over(w))
    best = r.groupBy("lang", "sec").agg(
        F.count("*").alias("n_tags"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= k, F.struct("r", "tag")))), lambda x: x["tag"]), " ").alias("top_tags")
    )
    return n.join(best, ["lang", "sec"], "left").select("lang", "sec", "n_examples", F.coalesce("n_tags", F.lit(0)).alias("n_tags"), F.coalesce("top_tags", F.lit("")).alias("top_tags"))


def pmi(together: Column, a: Column, b: Column, n: Column) -> Column:
    """log2(together * n / (a * b)); minus infinity if they never meet."""
    return F.when(together == 0, F.lit(float("-inf"))).otherwise(F.log2(together * n / (a * b)))


def compare_tags(ex: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Attraction of pairs of tags: examples with both against what their token counts let expect."""
    wanted = [(a.upper(), b.upper()) for a, b in pairs]
    prof = tag_profiles(ex).filter(F.col("tag").isin(sorted(set(chain.from_iterable(wanted))))).select("lang", "tag", "cnt", "mean_pos", "n_examples")
    asked = ex.sparkSession.createDataFrame(wanted, "tag_a string, tag_b string")
    both = ex.select("lang", F.explode(F.array(*[F.struct(F.lit(a).alias("tag_a"), F.lit(b).alias("tag_b"), (F.array_contains("tags", a) & F.array_contains("tags", b)).alias("both")) for a, b in wanted])).alias("p"))
    cooc = both.filter("p.both").groupBy("lang", F.col("p.tag_a").alias("tag_a"), F.col("p.tag_b").alias("tag_b")).agg(F.count("*").alias("cooc"))
    x = prof.select("lang", F.col("tag").alias("tag_a"), F.col("cnt").alias("cnt_a"), F.col("mean_pos").alias("mean_a"), "n_examples")
    y = prof.select("lang", F.col("tag").alias("tag_b"), F.col("cnt").alias("cnt_b"), F.col("mean_pos").alias("mean_b"))
    r = F.broadcast(asked).join(x, "tag_a").join(y, ["lang", "tag_b"]).join(cooc, ["lang", "tag_a", "tag_b"], "left").withColumn("cooc", F.coalesce("cooc", F.lit(0)))
    r = r.withColumn("pmi", pmi(F.col("cooc"), F.col("cnt_a"), F.col("cnt_b"), F.col("n_examples")))
    relation = F.when(F.col("pmi") > 1.5, "ATTRACT").when(F.col("pmi") < -1.0, "REPEL").otherwise("INDEPENDENT")
    similar = F.abs(F.col("mean_a") - F.col("mean_b")) < 0.1
    return r.select("lang", "tag_a", "tag_b", "cnt_a", "cnt_b", "cooc", F.round("pmi", 6).alias("pmi"), relation.alias("relation"), similar.alias("similar_position"))


def tag_neighbours(ex: DataFrame, top_n: int = 12) -> DataFrame:
    """For every tag its co-occurrents (those of the profile) by PMI over token pairs; expected counts under 1 are left out."""
    prof = tag_profiles(ex).select("lang", "tag", "cnt", "n_examples")
    top = top_cooccurrents(ex).select("lang", F.col("tag").alias("seed"), "partner", "rank", F.col("cnt").alias("cooc"))
    r = top.join(prof.select("lang", F.col("tag").alias("seed"), F.col("cnt").alias("cnt_seed"), "n_examples"), ["lang", "seed"]).join(
        prof.select("lang", F.col("tag").alias("partner"), F.col("cnt").alias("cnt_partner")), ["lang", "partner"]
    )
    r = r.withColumn("expected", F.col("cnt_seed") * F.col("cnt_partner") / F.col("n_examples")).filter("expected >= 1")
    r = r.withColumn("pmi", F.round(F.log2(F.col("cooc") / F.col("expected")), 6))
    return top_per(r.drop("rank").withColumn("prank", F.col("cooc")), ["lang", "seed"], [F.desc("pmi"), F.desc("cooc"), F.asc("partner")], top_n).select("lang", "seed", "rank", "partner", "cooc", "pmi")


def gloss_statistics(ex: DataFrame, tags: int = 50, places: int = 20) -> DataFrame:
    """Overview in long form (part, rank, name, n): size, the most frequent tags and places, examples with a tone line."""
    t = tokens(ex).groupBy("lang", "tag").agg(F.count("*").alias("n"), F.min(place_in_corpus("i")).alias("first"))
    s = ex.filter("source_section <> ''").groupBy("lang", F.col("source_section").alias("tag")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    order = [F.desc("n"), F.asc("first")]
    part = lambda df, name: df.select("lang", F.lit(name).alias("part"), "rank", F.col("tag").alias("name"), "n")
    one = lambda df, name: df.select("lang", F.lit(name).alias("part"), F.lit(1).alias("rank"), F.lit("").alias("name"), "n")
    sizes = ex.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("tones") != "").alias("tones"))
    return (
        part(top_per(t, ["lang"], order, tags), "tag")
        .unionByName(part(top_per(s, ["lang"], order, places), "place"))
        .unionByName(one(sizes, "examples"))
        .unionByName(one(sizes.select("lang", F.col("tones").alias("n")).filter("n > 0"), "tones"))
        .unionByName(one(t.groupBy("lang").agg(F.count("*").alias("n")), "tags"))
    )


def tag_inventory(ex: DataFrame, top_n: int = 60) -> DataFrame:
    """The most frequent tags with their category; a tag of two categories has the last."""
    last = {t: k for k, ts in TAG_CLUSTERS.items() for t in ts}
    names = F.create_map(*chain.from_iterable((F.lit(t), F.lit(k)) for t, k in last.items()))
    top = top_per(tag_profiles(ex), ["lang"], [F.desc("cnt"), F.asc("first")], top_n)
    return top.select("lang", "rank", "tag", "cnt", F.coalesce(F.element_at(names, F.col("tag")), F.lit("OTHER")).alias("category"))
