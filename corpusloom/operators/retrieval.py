"""Retrieval: BM25 over postings, dense search, fusion and diversity re-ranking.

Postings are a plain table (term, doc, tf) with document lengths; a query touches the postings of its terms only. The
dense side is brute force over all vectors, distributed. MMR is sequential by nature and runs on the pool of a query,
which has a fixed size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def terms(text):
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, doc, tf, dl (terms of the document)."""
    t = docs.select(F.col(key).alias("doc"), terms(F.coalesce(F.col(text), F.lit(""))).alias("ts")).withColumn("dl", F.size("ts"))
    return t.select("doc", "dl", F.explode("ts").alias("term")).groupBy("term", "doc", "dl").agg(F.count("*").alias("tf"))


def term_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, df, tf (over all documents), idf."""
    n = docs.agg(F.count("*").alias("n"))
    t = postings(docs, key, text).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).crossJoin(F.broadcast(n))
    return t.select("term", "df", "tf", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))


def bm25(docs: DataFrame, key: str, text: str, query: str, k: int = 5) -> DataFrame:
    """rank, doc, score of the k best documents; a term that the query repeats counts again. Scores of zero are dropped
    after the cut at k, ties go to the smaller key."""
    import re

    q = re.findall(r"[a-z0-9]+", query.lower())
    weight = {t: q.count(t) for t in q}
    lengths = docs.select(F.size(terms(F.coalesce(F.col(text), F.lit("")))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    # only the query's terms leave the scan
    p = (
        docs.select(F.col(key).alias("doc"), terms(F.coalesce(F.col(text), F.lit(""))).alias("ts"))
        .select("doc", F.size("ts").alias("dl"), F.explode(F.filter("ts", lambda t: t.isin(list(weight)))).alias("term"))
        .groupBy("term", "doc", "dl")
        .agg(F.count("*").alias("tf"))
    )
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    qw = docs.sparkSession.createDataFrame(list(weight.items()) or [("", 0)], "term string, qtf int")
    # one row and at most as many rows as the query has words are broadcast
    scored = p.join(F.broadcast(df), "term").join(F.broadcast(qw), "term").crossJoin(F.broadcast(lengths))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    s = F.col("qtf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    best = scored.groupBy("doc").agg(F.round(F.sum(s), 6).alias("score")).filter("score > 0").orderBy(F.desc("score"), F.asc("doc")).limit(k)
    return best.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.asc("doc"))).alias("rank"), "doc", "score")


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def dense(vectors: DataFrame, key: str, vec: str, query: list[float], k: int = 5) -> DataFrame:
    """rank, doc, score by cosine; ties go to the smaller key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.select(F.col(key).alias("doc"), F.round(cosine(F.col(vec), q), 6).alias("score")).filter("score is not null").orderBy(F.desc("score"), F.asc("doc")).limit(k)
    return best.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.asc("doc"))).alias("rank"), "doc", "score")


def fuse(lexical: DataFrame, semantic: DataFrame, k: int = 5, alpha: float = 0.5) -> DataFrame:
    """alpha * dense + (1 - alpha) * bm25 / max(bm25) over the union of both pools; a missing side counts as zero."""
    top = lexical.agg(F.max("score").alias("top"))
    both = lexical.select("doc", F.col("score").alias("lex")).join(semantic.select("doc", F.col("score").alias("sem")), "doc", "full_outer").crossJoin(F.broadcast(top))
    s = F.round(alpha * F.coalesce("sem", F.lit(0.0)) + (1 - alpha) * F.coalesce(F.col("lex") / F.col("top"), F.lit(0.0)), 6)
    best = both.select("doc", s.alias("score")).orderBy(F.desc("score"), F.asc("doc")).limit(k)
    return best.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.asc("doc"))).alias("rank"), "doc", "score")


def mmr(pool: DataFrame, k: int = 5, lam: float = 0.6) -> DataFrame:
    """Selection order by maximal marginal relevance. pool: query, doc, score, vec (a pool of fixed size per query)."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(["score", "doc"], ascending=[False, True]).reset_index(drop=True)
        v = np.array(pdf["vec"].tolist(), float)
        v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-9
        sim, rel = v @ v.T, pdf["score"].to_numpy(float)
        chosen, left = [], list(range(len(pdf)))
        while left and len(chosen) < k:
            gain = [rel[i] if not chosen else lam * rel[i] - (1 - lam) * max(sim[i, j] for j in chosen) for i in left]
            chosen.append(left.pop(int(np.argmax(gain))))
        return pd.DataFrame({"query": pdf["query"].iat[0], "rank": range(1, len(chosen) + 1), "doc": pdf["doc"].iloc[chosen].tolist(), "score": rel[chosen]})

    kind = dict(pool.dtypes)
    return pool.groupBy("query").applyInPandas(pick, f"query {kind['query']}, rank int, doc {kind['doc']}, score double")


def hybrid(docs: DataFrame, key: str, text: str, vectors: DataFrame, vkey: str, vec: str, query: str, query_vector: list[float], k: int = 5) -> DataFrame:
    """rank, doc, score: pools of five times k from BM25 and dense search are fused, the best three times k that have a
    vector re-ranked for diversity."""
    lex, sem = bm25(docs, key, text, query, 5 * k), dense(vectors, vkey, vec, query_vector, 5 * k)
    with_vec = vectors.select(F.col(vkey).alias("doc"), F.col(vec).alias("vec"))
    pool = fuse(lex, sem, 10 * k).join(with_vec, "doc").orderBy(F.desc("score"), F.asc("doc")).limit(3 * k)
    return mmr(pool.select(F.lit("").alias("query"), "doc", "score", "vec"), k).select("rank", "doc", "score")
