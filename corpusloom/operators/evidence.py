"""Evidence graphs: claims for and against a hypothesis, contradictions, one confidence per graph.

claims: graph_id, seq (order within the graph), claim_type, text, source, confidence, supports (true, false or null for
neutral), igt_examples. Aggregates are per graph and combine before the shuffle; a graph's pairs of contradicting
claims are inherent in the result, joined on graph and side so that only opposite sides meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.constants import CLAIM_WEIGHTS, CONTRADICTION_FROM, OTHER_WEIGHT
from corpusloom.operators.stats import ordinal, top_per


def claim_ids(claims: DataFrame) -> DataFrame:
    """Adds claim_id: C and the number of the claim in its graph, by ranges and not in one task."""
    return ordinal(claims, "graph_id", "seq", "r").withColumn("claim_id", F.format_string("C%03d", "r")).drop("r")


def contradictions(claims: DataFrame, least: float = CONTRADICTION_FROM) -> DataFrame:
    """graph_id, seq_a < seq_b, confidences: claims of opposite sides, both at least so confident."""
    c = claims.filter(F.col("supports").isNotNull() & (F.col("confidence") >= least)).select("graph_id", "seq", "confidence", "supports")
    yes = c.filter("supports").select("graph_id", F.col("seq").alias("s"), F.col("confidence").alias("cs"))
    no = c.filter("not supports").select("graph_id", F.col("seq").alias("n"), F.col("confidence").alias("cn"))
    first = F.col("s") < F.col("n")
    return yes.join(no, "graph_id").select(
        "graph_id", F.least("s", "n").alias("seq_a"), F.greatest("s", "n").alias("seq_b"),
        F.when(first, F.col("cs")).otherwise(F.col("cn")).alias("conf_a"), F.when(first, F.col("cn")).otherwise(F.col("cs")).alias("conf_b"),
    )


def contradicted(claims: DataFrame, least: float = CONTRADICTION_FROM) -> DataFrame:
    """graph_id, n_contradictions, without forming the pairs: confident claims for times those against."""
    sure = F.col("confidence") >= least
    return claims.groupBy("graph_id").agg((F.count_if(sure & F.col("supports")) * F.count_if(sure & ~F.col("supports"))).alias("n_contradictions"))


def resolve_by_strength(claims: DataFrame, gap: float = 0.25) -> DataFrame:
    """Rule resolution: of a contradicting pair more than gap apart, the weaker claim becomes neutral.

    A claim is weaker than some opposite one exactly if it is weaker than the strongest opposite one."""
    w = Window.partitionBy("graph_id")
    sure = F.col("confidence") >= CONTRADICTION_FROM
    best = lambda side: F.max(F.when(sure & (F.col("supports") == side), F.col("confidence"))).over(w)
    other = F.when(F.col("supports"), F.col("best_no")).when(~F.col("supports"), F.col("best_yes"))
    c = claims.withColumn("best_yes", best(True)).withColumn("best_no", best(False))
    beaten = sure & (other - F.col("confidence") > gap)
    return c.withColumn("supports", F.when(beaten, F.lit(None).cast("boolean")).otherwise(F.col("supports"))).drop("best_yes", "best_no")


def revised(claims: DataFrame, resolutions: DataFrame) -> DataFrame:
    """claims with the confidences that resolutions of contradictions (graph_id, seq_a, seq_b, resolved, confidence_a,
    confidence_b) give them; of several for one claim the last, by the pair's places, counts."""
    r = resolutions.filter("resolved")
    side = lambda s: r.select("graph_id", F.col(f"seq_{s}").alias("seq"), F.struct("seq_a", "seq_b").alias("at"), F.col(f"confidence_{s}").alias("new")).filter("new is not null")
    last = side("a").unionByName(side("b")).groupBy("graph_id", "seq").agg(F.max_by("new", "at").alias("new"))
    return claims.join(last, ["graph_id", "seq"], "left").withColumn("confidence", F.coalesce("new", "confidence")).drop("new")


def weight(kind: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for k, w in CLAIM_WEIGHTS.items():
        out = F.when(kind == k, w).otherwise(out)
    return out


def confidence(claims: DataFrame) -> DataFrame:
    """graph_id, verdict, confidence: weighted log-odds of the claims for minus those against, damped if both exist."""
    p = F.least(F.greatest(F.col("confidence"), F.lit(0.01)), F.lit(0.99))
    term = weight(F.col("claim_type")) * F.log(p / (1 - p))
    g = claims.withColumn("term", term).groupBy("graph_id").agg(
        F.count_if(F.col("supports")).alias("ns"), F.count_if(~F.col("supports")).alias("nc"),
        F.coalesce(F.sum(F.when(F.col("supports"), F.col("term")).when(~F.col("supports"), -F.col("term"))), F.lit(0.0)).alias("lo"),
        F.max(F.when(~F.col("supports"), F.col("confidence"))).alias("top_against"),
    )
    g = g.join(contradicted(claims), "graph_id")
    lo = F.when((F.col("ns") > 0) & (F.col("nc") > 0), F.col("lo") / F.sqrt(F.col("ns") + F.col("nc"))).otherwise(F.col("lo"))
    g = g.withColumn("raw", F.round(1 / (1 + F.exp(-lo)), 9))
    raw, none = F.col("raw"), (F.col("ns") == 0) & (F.col("nc") == 0)
    contested = (F.col("n_contradictions") > 0) & (F.col("top_against") > 0.7)
    middle = raw.between(0.45, 0.60)
    verdict = F.when(none, "Unclear").when(contested, "Partial").when(raw >= 0.75, "Yes").when(raw <= 0.30, "No").when(middle, "Unclear").otherwise("Partial")
    conf = F.when(none, 0.0).when(contested, F.least(F.lit(0.6), raw)).when(raw >= 0.75, raw).when(raw <= 0.30, 1 - raw).when(middle, 0.4).otherwise(raw)
    return g.select("graph_id", verdict.alias("verdict"), F.round(conf, 4).alias("confidence"), "ns", "nc", "n_contradictions")


def gaps(claims: DataFrame, has_igt: bool = True) -> DataFrame:
    """graph_id, gaps (names of missing evidence, in order), coverage (none, limited or empty)."""
    kind = lambda k: F.coalesce(F.bool_or(F.col("claim_type") == k), F.lit(False))
    igt = F.col("claim_type").isin("igt_pattern", "absence_evidence")
    g = claims.groupBy("graph_id").agg(
        kind("grammar_statement").alias("grammar"), kind("igt_pattern").alias("pattern"), kind("absence_evidence").alias("absence"),
        (F.count_if(~F.col("supports")) > 0).alias("counter"), F.count_if(igt).alias("n_igt"), F.count_if(igt & (F.col("confidence") >= 0.6)).alias("n_sure"),
    ).join(contradicted(claims), "graph_id")
    missing = [("grammar prose", ~F.col("grammar")), ("igt pattern", ~F.col("pattern") & has_igt), ("absence check", ~F.col("absence") & has_igt), ("counter-evidence", ~F.col("counter")), ("contradictions", F.col("n_contradictions") > 0)]
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in missing]))
    cover = F.when(F.col("n_igt") == 0, "none").when((F.col("n_sure") == 0) | (F.col("n_igt") == 1), "limited").otherwise("")
    return g.select("graph_id", F.array_join(names, "; ").alias("gaps"), cover.alias("coverage"), "n_igt", "n_sure")


def gates(claims: DataFrame, has_igt: bool = True, least: int = 4) -> DataFrame:
    """graph_id, ready, ready_igt: whether a conclusion is allowed, with prose (prose, pattern if there are examples,
    counter-evidence, no open contradiction) and from examples alone (pattern, absence check, counter-evidence, so many
    claims)."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = claims.groupBy("graph_id").agg(
        some(F.col("claim_type") == "grammar_statement").alias("p"), some(F.col("claim_type") == "igt_pattern").alias("i"), some(F.col("claim_type") == "absence_evidence").alias("a"),
        some(~F.col("supports")).alias("c"), F.count("*").alias("n"),
    ).join(contradicted(claims), "graph_id")
    ready = F.col("p") & (F.col("i") | F.lit(not has_igt)) & F.col("c") & (F.col("n_contradictions") == 0)
    return g.select("graph_id", ready.alias("ready"), (F.col("i") & F.col("a") & F.col("c") & (F.col("n") >= least)).alias("ready_igt"))


def figures(claims: DataFrame) -> DataFrame:
    """graph_id, verdict, confidence, claims by side and n, all over every claim."""
    n = claims.groupBy("graph_id").agg(F.count("*").alias("n"), F.count_if(F.col("supports").isNull()).alias("neutral"))
    return confidence(claims).join(n, "graph_id")


def listed(claims: DataFrame) -> DataFrame:
    """graph_id, seq, claim_id, claim: one row for every claim, so that no row grows with its graph; claim is JSON with
    the whole text. claim_id numbers the claims of a graph in the order of seq (an integer)."""
    c = ordinal(claims, "graph_id", "seq", "r").withColumn("claim_id", F.format_string("C%03d", "r"))
    one = F.struct(
        F.col("claim_id").alias("id"), F.col("claim_type").alias("type"), "text", "source", F.round("confidence", 3).alias("confidence"), "supports", "igt_examples",
    )
    return c.select("graph_id", "seq", "claim_id", F.to_json(one, {"ignoreNullFields": "false"}).alias("claim"))


def summary(claims: DataFrame, shown: int) -> DataFrame:
    """figures and, as the text a reader gets, a JSON list of the first so many claims in order, texts cut to 200
    characters; listed has every claim."""
    one = F.struct("seq", "claim_id", "claim_type", "confidence", "supports", F.substring("text", 1, 200).alias("text"), "source")
    first = top_per(claims, ["graph_id"], [F.asc("seq")], shown, "r").withColumn("claim_id", F.format_string("C%03d", "r"))
    told = first.groupBy("graph_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("claims"))
    return figures(claims).join(told, "graph_id")


def example_notes(claims: DataFrame) -> DataFrame:
    """graph_id, example_id, note, source, claim_type of the most confident claim that cites it (the first of equals);
    ids of chunks are no examples."""
    e = claims.select("graph_id", "seq", "confidence", "text", "source", "claim_type", F.explode("igt_examples").alias("example_id"))
    e = e.filter(F.col("example_id").isNotNull() & ~F.startswith("example_id", F.lit("chunk_")))
    best = e.groupBy("graph_id", "example_id").agg(F.max_by(F.struct("text", "source", "claim_type", "confidence", "seq"), F.struct("confidence", -F.col("seq"))).alias("c"))
    return best.select("graph_id", "example_id", F.substring("c.text", 1, 120).alias("note"), "c.source", "c.claim_type", F.col("c.seq").alias("seq"))


def example_ids(claims: DataFrame) -> DataFrame:
    """graph_id, rank, example_id: cited examples, each once, in the order of their first citation."""
    e = claims.select("graph_id", "seq", F.posexplode("igt_examples").alias("i", "example_id")).filter(F.col("example_id").isNotNull() & ~F.startswith("example_id", F.lit("chunk_")))
    first = e.groupBy("graph_id", "example_id").agg(F.min(F.struct("seq", "i")).alias("f"))
    return first.select("graph_id", F.row_number().over(Window.partitionBy("graph_id").orderBy("f")).alias("rank"), "example_id")
