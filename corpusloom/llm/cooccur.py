"""Items that appear together: stripes, merged by item, with lift and log-likelihood ratio.

Each task keeps, for the items it met, the associative array of their neighbours with counts (a stripe) and gives it
out when the arrays reach a fixed size, so what is shuffled has been combined already. Stripes of an item are merged
neighbour by neighbour: the merge key is the item with the neighbour, so that an item which stands in a third of all
records is merged by many tasks. Item counts travel as the stripe entry of the item with itself, the number of
records as the entry of null with null.

Defined results: null and empty items are no items; an item twice in a record counts once; records with fewer than two
items give no pair but count in N; an empty table gives no rows. A pair has its smaller item (by code point) first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut

#: Entries that a task holds before it gives its stripes out.
STRIPE_ENTRIES = 2_000_000
_STRIPES = "item string, nbs array<string>, cnts array<long>"


def _stripes(batches):
    """Partial stripes from batches with a column of arrays of distinct, sorted, valid items."""
    ids: dict[str, int] = {}
    names: list[str] = []
    acc_k = np.zeros(0, np.int64)
    acc_n = np.zeros(0, np.int64)
    total = 0

    def give():
        k, n = acc_k, acc_n
        if len(k) == 0 and not total:
            return
        a, b = k >> 31, k & 0x7FFFFFFF
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
        vocab = pa.array(names, pa.string())
        offs = pa.array(np.r_[starts, len(a)].astype(np.int32))
        item = vocab.take(pa.array(a[starts]))
        nbs = pa.ListArray.from_arrays(offs, vocab.take(pa.array(b)))
        cnts = pa.ListArray.from_arrays(offs, pa.array(n))
        yield pa.RecordBatch.from_arrays([item, nbs, cnts], ["item", "nbs", "cnts"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([[None]], pa.list_(pa.string())), pa.array([[total]], pa.list_(pa.int64()))], ["item", "nbs", "cnts"])

    for batch in batches:
        col = batch.column(0)
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        flat = col.flatten().dictionary_encode()
        local = np.empty(len(flat.dictionary), np.int64)
        for i, s in enumerate(flat.dictionary.to_pylist()):
            j = ids.get(s)
            if j is None:
                j = ids[s] = len(names)
                names.append(s)
            local[i] = j
        off = np.asarray(col.offsets) - np.asarray(col.offsets)[0]
        size = np.diff(off)
        total += int((size > 0).sum())
        if not len(flat):
            continue
        x = local[np.asarray(flat.indices)]
        rec = np.repeat(np.arange(len(size)), size)
        end = off[1:][rec]
        here = np.arange(len(x))
        keys = [x << 31 | x]
        # the d-th next item of the same record, for all items at once
        for d in range(1, int(size.max())):
            i = here[here + d < end]
            if not len(i):
                break
            keys.append(x[i] << 31 | x[i + d])
            if sum(map(len, keys)) > STRIPE_ENTRIES:
                keys = [np.concatenate(keys)]
                u, c = np.unique(keys[0], return_counts=True)
                acc_k, acc_n = _add(acc_k, acc_n, u, c)
                keys = []
        if keys:
            u, c = np.unique(np.concatenate(keys), return_counts=True)
            acc_k, acc_n = _add(acc_k, acc_n, u, c)
        if len(acc_k) > STRIPE_ENTRIES:
            yield from give()
            ids, names, acc_k, acc_n, total = {}, [], np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    yield from give()


def _add(k1, n1, k2, n2):
    k = np.concatenate([k1, k2])
    n = np.concatenate([n1, n2])
    u, inv = np.unique(k, return_inverse=True)
    return u, np.bincount(inv, n, len(u)).astype(np.int64)


def stripes(records: DataFrame, items: str) -> DataFrame:
    """Partial stripes (item, nbs, cnts) of records with an array column, one per item and task."""
    valid = F.array_sort(F.array_distinct(F.filter(F.col(items), lambda t: t.isNotNull() & (t != ""))))
    return records.select(F.coalesce(valid, F.array().cast("array<string>")).alias("v")).mapInArrow(_stripes, _STRIPES)


def merged(partial: DataFrame) -> DataFrame:
    """Stripe entries merged over all tasks: item, nb, n."""
    return (
        partial.select("item", F.explode(F.arrays_zip("nbs", "cnts")).alias("e"))
        .groupBy("item", F.col("e.nbs").alias("nb"))
        .agg(F.sum("e.cnts").alias("n"))
    )


def pair_statistics(records: DataFrame, items: str) -> DataFrame:
    """item_a, item_b, n_ab, n_a, n_b, n_records, lift (n_ab * N / (n_a * n_b)) and llr (log-likelihood ratio)."""
    m = cut(merged(stripes(records, items)))
    single = m.filter(F.col("item") == F.col("nb")).select(F.col("item").alias("i"), F.col("n").alias("ni"))
    n = (m.filter(F.col("item").isNull()).agg(F.sum("n")).first() or [0])[0] or 0
    pairs = (
        m.filter(F.col("item") != F.col("nb"))
        .select(F.least("item", "nb").alias("item_a"), F.greatest("item", "nb").alias("item_b"), F.col("n").alias("n_ab"))
    )
    return (
        pairs.join(single.select(F.col("i").alias("item_a"), F.col("ni").alias("n_a")), "item_a")
        .join(single.select(F.col("i").alias("item_b"), F.col("ni").alias("n_b")), "item_b")
        .withColumn("n_records", F.lit(n))
        .withColumn("lift", F.col("n_ab") * F.col("n_records") / (F.col("n_a") * F.col("n_b")))
        .withColumn("llr", _llr("n_ab", "n_a", "n_b", "n_records"))
    )


def _llr(ab: str, a: str, b: str, n: str):
    """2 * sum of k * ln(k / expected) over the four cells of the table of a and b."""
    k11, ka, kb, kn = (F.col(c).cast("double") for c in (ab, a, b, n))
    cells = ((k11, ka, kb), (ka - k11, ka, kn - kb), (kb - k11, kn - ka, kb), (kn - ka - kb + k11, kn - ka, kn - kb))
    terms = [F.when(k > 0, k * F.log(k * kn / (r * c))).otherwise(0.0) for k, r, c in cells]
    return 2 * (terms[0] + terms[1] + terms[2] + terms[3])


def top_partners(pairs: DataFrame, k: int = 8) -> DataFrame:
    """The k most significant partners of each item: item, rank, partner, n_ab, llr. Ties go to the smaller partner."""
    both = pairs.select(F.col("item_a").alias("item"), F.col("item_b").alias("partner"), "n_ab", "llr").unionByName(
        pairs.select(F.col("item_b").alias("item"), F.col("item_a").alias("partner"), "n_ab", "llr")
    )
    # rounded, so that equal ratios are ties whatever the order of their terms
    w = Window.partitionBy("item").orderBy(F.desc(F.round("llr", 6)), F.desc("n_ab"), "partner")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
