"""Frequency of every distinct term, kept up to date by signed deltas.

A store holds one row per term with its occurrences and the number of records that hold it. A change of the
collection is given as the records that were added (or the new version of changed ones) and those that were removed
(or the old version). Only these are aggregated, into signed changes; the changes are merged into the store, which
lies in the shared folder as Parquet, partitioned by a hash of the term. Only the buckets that a change touches are
written again; a small list of each version says where every bucket's newest rows lie. The number of records with at
least one term is carried in the same pass as the row whose term is null.

Defined results: null and empty elements are no terms; a null or empty array is a record without terms and counts
nowhere; a term twice in a record is two occurrences and one record; an empty collection gives an empty store with
zero records. Terms are compared exactly as stored. Other columns of the input are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import cut, fresh_path

SCHEMA = "term string, occurrences long, records long"
#: Terms that a bucket of a new store holds on average, fewest and most buckets.
PER_BUCKET, FEWEST, MOST = 100_000, 16, 4096


def signed_delta(records: DataFrame, terms: str, sign: int) -> DataFrame:
    """The change per term that adding (sign 1) or removing (sign -1) the records makes.

    Terms are sorted within the record, so that the first of equal ones is found without comparing all with all; the
    aggregation is combined before the shuffle, so a term held by a third of the records costs one row per task.
    """
    valid = F.filter(F.col(terms), lambda t: t.isNotNull() & (t != ""))
    rows = records.select(F.array_sort(valid).alias("t")).filter(F.size("t") > 0)
    marked = F.transform(
        "t",
        lambda x, i: F.struct(
            x.alias("term"),
            F.when((i == 0) | (x != F.element_at("t", F.greatest(i, F.lit(1)))), 1).otherwise(0).alias("new"),
        ),
    )
    total = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("new")))
    return (
        rows.select(F.explode(F.concat(total, marked)).alias("e"))
        .groupBy("e.term")
        .agg(F.count("*").alias("n"), F.sum("e.new").alias("r"))
        .select(
            "term",
            (F.col("n") * sign).alias("occurrences"),
            (F.col("r") * sign).alias("records"),
        )
    )


def bucket_of(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _summed(deltas: DataFrame, keys: list[str]) -> DataFrame:
    sums = deltas.groupBy(*keys).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return sums.filter((F.col("occurrences") != 0) | (F.col("records") != 0))


class TermCounts:
    """Persistent counts, in versions; each merge writes the next version and leaves the one before it readable."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        """buckets: of a new store; by default as many as its first change asks for."""
        self.spark, self.path, self.buckets = spark, path or fresh_path(spark, "term-counts"), buckets
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        lists = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))] if self._fs.exists(self._at("")) else []
        self.version = max([int(n[1:-5]) for n in lists if n[:1] == "v" and n.endswith(".json")], default=0)
        #: Version in which each bucket was last written.
        self._written: dict[int, int] = {}
        if self.version:
            text = self.spark.sparkContext.wholeTextFiles(f"{self.path}/v{self.version}.json").first()[1]
            got = json.loads(text)
            self.buckets, self._written = got["buckets"], {int(k): v for k, v in got["written"].items()}

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _table(self, buckets=None) -> DataFrame:
        """The rows of some buckets, or of all."""
        paths = [f"{self.path}/v{v}/bucket={b}" for b, v in sorted(self._written.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def apply(self, added: DataFrame | None = None, removed: DataFrame | None = None, terms: str = "terms") -> "TermCounts":
        """Merges added and removed records; both versions of a changed record belong in one call. Terms whose change is
        nil touch nothing."""
        deltas = [signed_delta(d, terms, s) for d, s in ((added, 1), (removed, -1)) if d is not None]
        if not deltas:
            return self
        delta = deltas[0]
        if len(deltas) > 1:
            delta = _summed(deltas[0].unionByName(deltas[1]), ["term"])
        delta = cut(delta)
        if self.buckets is None:
            self.buckets = min(MOST, max(FEWEST, 1 << (-(-delta.count() // PER_BUCKET) - 1).bit_length()))
        of = bucket_of(F.col("term"), self.buckets).alias("bucket")
        delta = delta.select(of, "*")
        touched = {r[0] for r in delta.select("bucket").distinct().collect()}
        known = touched & set(self._written)
        merged = _summed(self._table(known).select(of, "*").unionByName(delta), ["bucket", "term"]) if known else delta
        new = f"v{self.version + 1}"
        merged.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{new}")
        left = {int(s.getPath().getName()[7:]) for s in self._fs.listStatus(self._at(new)) if s.getPath().getName().startswith("bucket=")}
        self._written = {b: v for b, v in self._written.items() if b not in touched} | {b: self.version + 1 for b in left}
        # the list is what makes a version count
        out = self._fs.create(self._at(f"{new}.json"))
        out.write(json.dumps({"buckets": self.buckets, "written": self._written}).encode())
        out.close()
        self.version += 1
        return self

    def counts(self) -> DataFrame:
        """term, occurrences, records."""
        return self._table().filter(F.col("term").isNotNull()).select("term", "occurrences", "records")

    def total(self) -> int:
        """Number of records with at least one term: one row of one bucket is read."""
        if not self.version:
            return 0
        b = self.spark.range(1).select(bucket_of(F.lit(None).cast("string"), self.buckets)).first()[0]
        row = self._table({b}).filter(F.col("term").isNull()).select("records").first()
        return row[0] if row else 0

    def marked(self, rare_below: int = 3, common_over: tuple[int, int] = (1, 5)) -> DataFrame:
        """counts with mark: rare under rare_below records, common in more than the share common_over, else null."""
        num, den = common_over
        common = F.col("records") * den > F.lit(self.total()) * num
        mark = F.when(F.col("records") < rare_below, "rare").when(common, "common")
        return self.counts().withColumn("mark", mark)
