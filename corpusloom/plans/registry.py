"""Tools by name: functions of a corpus and arguments that give a DataFrame. Rendering comes after, and last."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import retrieval, sections, stats, tools


@dataclass
class Corpus:
    """One language's examples, chunks and dictionary; views are built once."""

    igt: DataFrame
    chunk: DataFrame
    abbrev: DataFrame
    #: ord and vec of chunks, where an encoder made them.
    vectors: DataFrame | None = None

    def __post_init__(self):
        self.ex = stats.examples(self.igt)
        self.view = sections.chunk_view(self.chunk)
        self.sections = sections.with_key_terms(sections.assemble(self.view))

    def for_language(self, lang: str) -> "Corpus":
        return Corpus(self.igt.filter(F.col("lang") == lang), self.chunk.filter(F.col("lang") == lang), self.abbrev, self.vectors)


TOOLS: dict[str, Callable[..., DataFrame]] = {}


def tool(name: str):
    def add(f):
        TOOLS[name] = f
        return f

    return add


def call(corpus: Corpus, name: str, **args) -> DataFrame:
    if name not in TOOLS:
        raise KeyError(f"no tool {name!r}; there are {', '.join(sorted(TOOLS))}")
    return TOOLS[name](corpus, **args)


@tool("read_full_section")
def read_full_section(c: Corpus, query: str, max_chars: int = 8000) -> DataFrame:
    """A section by the id of one of its chunks, its label, its own id or the id without a part; else the best match of
    a search."""
    found = sections.find(c.sections, [query]).select("lang", "section_id", "full_text", "char_count", "how", "first")
    searched = sections.search_sections(c.sections, query, 1).select("lang", "section_id", "full_text", "char_count", F.lit(5).alias("how"), "first")
    best = stats.top_per(found.unionByName(searched), ["lang"], [F.asc("how"), F.asc("first")], 1)
    return best.select("lang", "section_id", F.substring("full_text", 1, max_chars).alias("text"), "char_count")


@tool("follow_cross_references")
def follow_cross_references(c: Corpus, query: str, max_hops: int = 2) -> DataFrame:
    return sections.follow_refs(c.sections, query, max_hops)


@tool("extract_author_claims")
def extract_author_claims(c: Corpus, query: str) -> DataFrame:
    return sections.author_claims(sections.search_sections(c.sections, query))


@tool("search_text")
def search_text(c: Corpus, query: str, top_k: int = 5, confidence: float = 1.0, query_vector: list[float] | None = None) -> DataFrame:
    """BM25; with a vector of the query and vectors of the chunks, fused with dense search and re-ranked for diversity."""
    docs = c.view.select("ord", F.concat_ws(" ", "chapter", "section", "subsection", "text").alias("text"))
    k = 2 * top_k if confidence < 0.5 else top_k
    if query_vector is not None and c.vectors is not None:
        return retrieval.hybrid(docs, "ord", "text", c.vectors, "ord", "vec", query, query_vector, k)
    return retrieval.bm25(docs, "ord", "text", query, k)


@tool("analyse_tag")
def analyse_tag(c: Corpus, tag: str, preferred_sections: list[str] | None = None) -> DataFrame:
    """All that is known of the tags a name stands for: profile, and as lists partners, places, surface forms and examples,
    those of preferred sections first."""
    prof = stats.tag_profiles(c.ex)
    hit = tools.resolve_tag(prof, [tag]).select("lang", "tag", "rank")
    some = hit.select("lang", "tag")

    def listed(df: DataFrame, out: str, *columns: str) -> DataFrame:
        return df.groupBy("lang", "tag").agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias(out))

    forms = tools.surface_forms(c.ex, tag).withColumn("tag", F.lit(tag.upper()))
    first = hit.filter("rank = 1").select("lang", "tag")
    holding = c.ex.join(first, "lang").filter(F.expr("array_contains(tags, tag)"))
    shown = tools.section_aware(holding, preferred_sections or []).join(first, "lang")
    out = prof.join(hit, ["lang", "tag"])
    for x in (
        listed(stats.top_cooccurrents(c.ex).join(some, ["lang", "tag"]), "partners", "partner", "cnt"),
        listed(stats.top_sections(c.ex).join(some, ["lang", "tag"]), "places", "sec", "cnt"),
        listed(forms, "forms", "form", "cnt"),
        listed(shown, "examples", "example_id", "ord"),
    ):
        out = out.join(x, ["lang", "tag"], "left")
    return out


@tool("analyse_construction")
def analyse_construction(c: Corpus, tags: list[str], preferred_sections: list[str] | None = None) -> DataFrame:
    if preferred_sections:
        return tools.section_aware(c.ex.filter(tools.has_run(tags)), preferred_sections)
    return tools.construction(c.ex, tags)


@tool("analyse_absence")
def analyse_absence(c: Corpus, category: str, preferred_sections: list[str] | None = None) -> DataFrame:
    """With preferred sections, also what these alone hold (hits_preferred)."""
    asked = F.col("category") == stats.resolve_category(category)
    out = stats.absence_verdicts(c.ex).filter(asked)
    if preferred_sections:
        own = stats.absence_verdicts(c.ex.filter(tools.in_any_section(preferred_sections))).filter(asked)
        out = out.join(own.select("lang", F.col("hits").alias("hits_preferred")), "lang", "left").fillna(0, ["hits_preferred"])
    return out


@tool("compare_tags")
def compare_tags(c: Corpus, tag_a: str, tag_b: str, preferred_sections: list[str] | None = None) -> DataFrame:
    """With preferred sections, also examples of both tags, those of these sections first."""
    out = stats.compare_tags(c.ex, [(tag_a, tag_b)])
    if preferred_sections:
        both = c.ex.filter(F.array_contains("tags", tag_a.upper()) & F.array_contains("tags", tag_b.upper()))
        shown = tools.section_aware(both, preferred_sections).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "example_id"))).alias("examples"))
        out = out.join(shown, "lang", "left")
    return out


@tool("get_section_igt")
def get_section_igt(c: Corpus, section_query: str, max_examples: int = 15) -> DataFrame:
    return tools.section_examples(c.ex, section_query, max_examples)


@tool("search_translations")
def search_translations(c: Corpus, query: str, max_results: int = 15) -> DataFrame:
    return tools.search_translations(c.ex, query, max_results)


@tool("get_triline_examples")
def get_triline_examples(c: Corpus, query: str, max_examples: int = 8) -> DataFrame:
    return tools.trilines(c.ex, query, max_examples)


@tool("get_igt_candidates")
def get_igt_candidates(c: Corpus, query_tags: list[str], query_text: str, max_examples: int = 10) -> DataFrame:
    return tools.candidates(c.ex, query_tags, query_text, max_examples)


@tool("get_tag_inventory")
def get_tag_inventory(c: Corpus, top_n: int = 60) -> DataFrame:
    return stats.tag_inventory(c.ex, top_n)


@tool("get_construction_inventory")
def get_construction_inventory(c: Corpus, top_n: int = 30) -> DataFrame:
    two, three = stats.frequent_ngrams(c.ex, 2, min(top_n, 30)), stats.frequent_ngrams(c.ex, 3, min(top_n, 15))
    return two.withColumn("size", F.lit(2)).unionByName(three.withColumn("size", F.lit(3)))


@tool("find_tag_cluster")
def find_tag_cluster(c: Corpus, seed_tag: str, top_n: int = 12) -> DataFrame:
    seeds = tools.resolve_tag(stats.tag_profiles(c.ex), [seed_tag], "strict").select("lang", F.col("tag").alias("seed"))
    return stats.tag_neighbours(c.ex, top_n).join(seeds, ["lang", "seed"])


@tool("analyse_semantic_context")
def analyse_semantic_context(c: Corpus, tag: str) -> DataFrame:
    return tools.semantic_domains(c.ex, tag)


@tool("analyse_morpheme_position")
def analyse_morpheme_position(c: Corpus, tag: str) -> DataFrame:
    return tools.morpheme_positions(c.ex, tag)


@tool("get_morpheme_forms")
def get_morpheme_forms(c: Corpus, tag: str) -> DataFrame:
    return tools.surface_forms(c.ex, tag)


@tool("get_toc_with_summaries")
def get_toc_with_summaries(c: Corpus, max_entries: int = 300, max_summary_chars: int = 120, skip_subsections: bool = False) -> DataFrame:
    toc = sections.contents(c.view, skip_subsections, max_entries).drop("ord")
    s = c.view.select("lang", F.col("ord").alias("_o"), "chunk_id", F.regexp_replace(F.substring("summary", 1, max_summary_chars), "\n", " ").alias("summary"))
    first = stats.top_per(s, ["lang", "chunk_id"], [F.asc("_o")], 1, "_r").drop("_o", "_r")
    return toc.join(first, ["lang", "chunk_id"], "left")


@tool("get_toc")
def get_toc(c: Corpus) -> DataFrame:
    """Sections with their lengths, by section id."""
    s = c.sections.select("lang", "section_id", *sections.NAMES, "label", "level", "char_count")
    return stats.top_per(s, ["lang"], [F.asc("section_id")], 300)


@tool("get_chunk_summaries")
def get_chunk_summaries(c: Corpus, ids: DataFrame, max_ids: int = 12) -> DataFrame:
    return tools.summaries(ids, c.view, max_ids)


@tool("lookup_igt_examples")
def lookup_igt_examples(c: Corpus, ids: DataFrame) -> DataFrame:
    return tools.lookup(ids, c.ex, "example_id")


@tool("get_context")
def get_context(c: Corpus, targets: DataFrame, window: int = 2) -> DataFrame:
    return tools.context_window(c.view, targets, window)


@tool("get_igt_summary")
def get_igt_summary(c: Corpus) -> DataFrame:
    """Long form of the corpus summary: part, rank, name, value."""
    tags = stats.top_per(stats.tag_profiles(c.ex), ["lang"], [F.desc("cnt"), F.asc("first")], 30).select("lang", F.lit("tag").alias("part"), "rank", F.col("tag").alias("name"), F.col("cnt").cast("string").alias("value"))
    grams = stats.frequent_ngrams(c.ex, 2, 20).select("lang", F.lit("pattern").alias("part"), "rank", F.col("gram").alias("name"), F.col("cnt").cast("string").alias("value"))
    absent = stats.absent_categories(c.ex).select("lang", F.lit("absent").alias("part"), F.lit(0).alias("rank"), F.col("category").alias("name"), F.col("kind").alias("value"))
    slots = stats.paradigm_slots(c.ex).select("lang", F.lit("paradigm").alias("part"), F.lit(0).alias("rank"), F.col("slot").alias("name"), F.col("hits").cast("string").alias("value"))
    secs = stats.top_per(stats.section_richness(c.ex), ["lang"], [F.desc("n_tags"), F.asc("sec")], 15).select("lang", F.lit("section").alias("part"), "rank", F.col("sec").alias("name"), F.col("n_tags").cast("string").alias("value"))
    out = tags
    for x in (grams, absent, slots, secs):
        out = out.unionByName(x)
    return out
