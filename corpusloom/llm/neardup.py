"""Records that repeat another record with small edits: an exact set-similarity self-join.

Every record is the set of its distinct words. The join runs in four steps.

1. Records with equal text form one class; one representative goes on.
2. Each representative gets a 128-bit fingerprint, the parity sketch of its words: a word flips one bit. The Hamming
   distance of two sketches never exceeds the number of words that only one of the two sets has, so a bound on the
   similarity gives a bound on the distance, and pruning by distance loses no pair.
3. Representatives meet in blocks. With words in a global order (rare first), two sets over the threshold share a word
   among their first |A| - ceil(t|A|) + 1; blocks of frequent words are divided by the next shared words (the first d
   shared words lie among the first |A| - ceil(t|A|) + d), as often as their frequency asks for. Within a block a
   hierarchical index over the Gray order is searched against itself. Sketches are sorted by Gray rank; neighbours that
   lie within the bound of each other form a leaf, neighbouring leaves that agree well enough an upper node, others
   stay nodes by themselves. A node keeps the bits all members agree on and the range of their sizes. Pairs of nodes
   are dropped as soon as the differences on the bits that both agree on, or those of their sizes, pass the bound; only
   the rest is refined down to single sketches. A block of more than PART members is given back by its task and
   searched part by part in others.
4. Surviving pairs are verified on the word sets themselves and, where asked, expanded to all members of the classes.

The word order comes from a count table with a fixed number of cells of one byte, on a logarithmic scale; it may be
coarse, since any common order is exact. Words are compared as 64-bit hashes.

Defined results: null is the empty text; records without words are in no pair; records with the same words but
different text are a pair; records with equal text (null and empty counting as equal) are copies, no pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

#: Cells of the count table (a byte each when broadcast), steps of its scale for every doubling.
CELLS, STEPS = 1 << 20, 8
#: A word in more sets than this is not a block of its own; every factor of ten beyond asks for one more shared word.
HOT = 2000
#: Sets under this size may share fewer words than a deep key has.
SHORT = 8
#: Members of a leaf and children of an upper node of the index, at most.
FAN = 16
#: Pairs of nodes or sketches compared at a time, members of a block that are searched in one task.
CHUNK, PART = 2_000_000, 50_000


def words(cols: list[str], sep: str = " "):
    """Distinct non-empty words of the joined columns, as hashes."""
    text = F.concat_ws(sep, *[F.coalesce(F.col(c), F.lit("")) for c in cols])
    parts = F.array_distinct(F.filter(F.split(text, sep), lambda x: x != ""))
    return F.transform(parts, lambda x: F.xxhash64(x))


def class_key(cols: list[str]):
    """Digest of the texts; their lengths keep the boundaries apart."""
    texts = [F.coalesce(F.col(c), F.lit("")) for c in cols]
    return F.unhex(F.md5(F.concat_ws(" ", *[F.char_length(t).cast("string") for t in texts], *texts)))


def classes(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """ck (key of the text), id (a row's key)."""
    return df.select(class_key(cols).alias("ck"), F.col(key).alias("id"))


def _count_table(reps: DataFrame) -> np.ndarray:
    """Per cell the count of its words, in steps of a doubling; 0 is a count of one."""
    rows = (
        reps.select(F.explode("w").alias("h"))
        .groupBy(F.col("h").bitwiseAND(CELLS - 1).cast("int").alias("cell"))
        .agg(F.least(F.round(F.log2(F.count("*")) * STEPS), F.lit(255)).cast("short").alias("n"))
        .toArrow()
    )
    out = np.zeros(CELLS, np.uint8)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _need(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least number of shared words: ceil(t * size)."""
    return -(-size * num // den)


def sketch(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low half of the parity sketch of each run of hashes; no run is empty."""
    bit = _mix(h) >> np.uint64(57)
    one = np.uint64(1) << (bit & np.uint64(63))
    zero = np.uint64(0)
    return np.bitwise_xor.reduceat(np.where(bit >= 64, one, zero), starts), np.bitwise_xor.reduceat(np.where(bit < 64, one, zero), starts)


def block_keys(h, rec, pos, size, cnt, num, den):
    """(index of the word that brings the record to the block, key), vectorised over the words of many records.

    h, rec, pos, size, cnt: of each word its hash, record, place in the record's order, the record's size, the count.
    The first shared word decides by its count how many shared words make a key, so both records agree on it. Sets of
    SHORT words or more make keys of any depth among themselves. A pair with a smaller set may share fewer words; it
    meets on keys of its own, of two words at most (one, if a set has one word and the other thus has no more).
    """
    n = len(h)
    idx = np.arange(n)
    prefix = size - _need(size, num, den) + 1
    with np.errstate(divide="ignore"):
        depth = 1 + np.clip(np.ceil(np.log10(np.maximum(cnt, 1) / HOT)), 0, 4).astype(np.int64)
    begin = (pos < prefix) & (cnt > 1)
    kinds = (
        (begin & (size >= SHORT), depth, 0x9E3779B97F4A7C15),
        (begin & (size > 1) & (size * num < SHORT * den), np.minimum(depth, 2), 0xD1B54A32D192ED03),
        (begin & (size == 1), np.ones_like(depth), 0x94D049BB133111EB),
    )
    out_i, out_k = [], []
    for here, deep, salt in kinds:
        first = idx[here]
        last, key, left, lim = first, _mix(h[first] ^ np.uint64(salt)), deep[first] - 1, prefix[first] + deep[first] - 1
        while len(last):
            done = left == 0
            out_i.append(last[done])
            out_k.append(key[done])
            last, key, left, lim = (x[~done] for x in (last, key, left, lim))
            # of the first `deep` shared words, the one with `left` to come, itself included, lies before lim - left + 1
            stop = np.minimum(lim - left + 1, size[last])
            steps = []
            for d in range(1, int((stop - pos[last]).max(initial=0))):
                ok = pos[last] + d < stop
                j = last[ok] + d
                steps.append((j, _mix(key[ok] ^ (h[j] + left[ok].astype(np.uint64))), left[ok] - 1, lim[ok]))
            if not steps:
                break
            last, key, left, lim = map(np.concatenate, zip(*steps))
    return np.concatenate(out_i), np.concatenate(out_k)


_ENTRY = "k long, id long, hi long, lo long, n int"


def _entries(table, num: int, den: int):
    def run(batches):
        counts = table.value
        for batch in batches:
            col = batch.column("w")
            col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
            off = np.asarray(col.offsets).astype(np.int64)
            h = np.asarray(col.flatten()).view(np.uint64)
            size = np.diff(off)
            off = off - off[0]
            if not len(h):
                continue
            rec = np.repeat(np.arange(len(size)), size)
            cnt = counts[(h & np.uint64(CELLS - 1)).astype(np.int64)]
            order = np.lexsort((h, cnt, rec))
            h, cnt = h[order], np.exp2(cnt[order] / STEPS)
            pos = np.arange(len(h)) - off[:-1][rec]
            hi, lo = sketch(h, off[:-1])
            i, k = block_keys(h, rec, pos, size[rec], cnt, num, den)
            r = rec[i]
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k.view(np.int64)), pa.array(ids[r]), pa.array(hi[r].view(np.int64)), pa.array(lo[r].view(np.int64)), pa.array(size[r].astype(np.int32))],
                ["k", "id", "hi", "lo", "n"],
            )

    return run


def gray_rank(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of a sketch in the Gray order: the prefix parities of its bits."""
    a, b = hi.copy(), lo.copy()
    for s in (1, 2, 4, 8, 16, 32):
        a ^= a >> np.uint64(s)
        b ^= b >> np.uint64(s)
    return a, np.where(a & np.uint64(1), ~b, b)


def _starts(group: np.ndarray, joined: np.ndarray, fan: int) -> np.ndarray:
    """Begins of runs of at most fan members that lie in one group; joined: whether a member goes with the one before."""
    n = len(group)
    new = np.ones(n, bool)
    new[1:] = (group[1:] != group[:-1]) | ~joined[1:]
    first = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    return np.flatnonzero(place % fan == 0)


class _Level:
    """Nodes over the level below: begins and ends of their children, agreed bits and their values, range of sizes."""

    def __init__(self, begin, hi, lo, ahi, alo, least, most, group):
        total = len(group)
        self.begin, self.end, self.group = begin, np.r_[begin[1:], total], group[begin]
        self.hi = np.bitwise_and.reduceat(hi & ahi, begin)
        self.lo = np.bitwise_and.reduceat(lo & alo, begin)
        one_hi, one_lo = np.bitwise_or.reduceat(hi & ahi, begin), np.bitwise_or.reduceat(lo & alo, begin)
        self.ahi = np.bitwise_and.reduceat(ahi, begin) & ~(self.hi ^ one_hi)
        self.alo = np.bitwise_and.reduceat(alo, begin) & ~(self.lo ^ one_lo)
        self.least, self.most = np.minimum.reduceat(least, begin), np.maximum.reduceat(most, begin)

    def apart(self, a, b) -> np.ndarray:
        """Differences on the bits that both nodes agree on."""
        return (np.bitwise_count((self.hi[a] ^ self.hi[b]) & self.ahi[a] & self.ahi[b]) + np.bitwise_count((self.lo[a] ^ self.lo[b]) & self.alo[a] & self.alo[b])).astype(np.int64)


def _triangle(begin_i: np.ndarray, end_i: np.ndarray, i: np.ndarray):
    """Pairs (i, j) with begin <= j < end for each i."""
    c = end_i - begin_i
    left = np.repeat(i, c)
    right = np.arange(int(c.sum())) - np.repeat(np.r_[0, np.cumsum(c)[:-1]], c) + np.repeat(begin_i, c)
    return left, right


def _slices(cost: np.ndarray):
    """Cuts of a list so that the costs of each part stay near CHUNK."""
    cum = np.cumsum(cost)
    at = 0
    while at < len(cost):
        to = max(at + 1, int(np.searchsorted(cum, (cum[at - 1] if at else 0) + CHUNK, "right")))
        yield at, to
        at = to


def gray_search(key, hi, lo, n, num: int, den: int, tally: dict | None = None, by_size: bool = False):
    """Index pairs (i, j) within equal keys whose distance allows the similarity num/den; arrays are sorted by key and
    Gray rank. |A xor B| <= (1-t)/(1+t) * (|A|+|B|) when the similarity is t or more. With
    by_size, differences of the sizes n count like those of the sketches. tally counts the pairs of nodes and of sketches
    that were looked at, and those dropped."""
    n = n.astype(np.int64)
    more, less = den + num, den - num
    tally = {} if tally is None else tally

    def count(what: str, keep: np.ndarray) -> None:
        tally[what] = tally.get(what, 0) + len(keep)
        tally[what + " dropped"] = tally.get(what + " dropped", 0) + int((~keep).sum())

    d = np.r_[0, np.bitwise_count(hi[1:] ^ hi[:-1]) + np.bitwise_count(lo[1:] ^ lo[:-1])].astype(np.int64)
    full = np.full(len(key), ~np.uint64(0))
    leaf = _Level(_starts(key, d * more <= less * (n + np.r_[0, n[:-1]]), FAN), hi, lo, full, full, n, n, key)
    at = np.arange(1, len(leaf.begin))
    # leaves within twice the bound go together
    close = np.r_[False, leaf.apart(at, at - 1) * more <= 2 * less * (leaf.least[at] + leaf.least[at - 1])]
    top = _Level(_starts(leaf.group, close, FAN), leaf.hi, leaf.lo, leaf.ahi, leaf.alo, leaf.least, leaf.most, leaf.group)

    def near(x, a, b):
        apart = x.apart(a, b)
        if by_size:
            # the sizes themselves may differ by as much as the sets do
            apart = np.maximum(apart, np.maximum(x.least[a] - x.most[b], x.least[b] - x.most[a]))
        return apart * more <= less * (x.most[a] + x.most[b])

    def children(x, a, b):
        """Pairs of children of node pairs; of a node with itself, each pair once."""
        ca = x.end[a] - x.begin[a]
        left, pick = _triangle(np.zeros(len(a), np.int64), ca, np.arange(len(a)))
        i = x.begin[a][left] + pick
        lo_j = np.where(a[left] == b[left], i, x.begin[b][left])
        k, j = _triangle(lo_j, x.end[b][left], np.arange(len(i)))
        return i[k], j

    m = len(top.begin)
    first = np.flatnonzero(np.r_[True, top.group[1:] != top.group[:-1]])
    group_end = np.repeat(np.r_[first[1:], m], np.diff(np.r_[first, m]))
    at = np.arange(m)
    for s, e in _slices(group_end - at):
        a, b = _triangle(at[s:e], group_end[s:e], at[s:e])
        other = a != b
        keep = ~other | near(top, a, b)
        count("upper nodes", keep[other])
        a, b = a[keep], b[keep]
        for s1, e1 in _slices((top.end[a] - top.begin[a]) * (top.end[b] - top.begin[b])):
            la, lb = children(top, a[s1:e1], b[s1:e1])
            other = la != lb
            keep = ~other | near(leaf, la, lb)
            count("leaves", keep[other])
            la, lb = la[keep], lb[keep]
            for s2, e2 in _slices((leaf.end[la] - leaf.begin[la]) * (leaf.end[lb] - leaf.begin[lb])):
                i, j = children(leaf, la[s2:e2], lb[s2:e2])
                keep = i != j
                i, j = i[keep], j[keep]
                d = np.bitwise_count(hi[i] ^ hi[j]).astype(np.int64) + np.bitwise_count(lo[i] ^ lo[j])
                if by_size:
                    d = np.maximum(d, np.abs(n[i] - n[j]))
                keep = d * more <= less * (n[i] + n[j])
                count("sketches", keep)
                yield i[keep], j[keep]


#: A pair (a, b), or, with its part, a member (a: block, b: id) of a block that is given back.
_FIELDS = ["a", "b", "hi", "lo", "n", "part"]
_FOUND = "a long, b long, hi long, lo long, n int, part int"
_COLUMNS = ("k", "id", "hi", "lo", "n", "side")


def _found_pairs(cols, num: int, den: int, tally: dict | None = None):
    """a, b of the pairs found in blocks (k, id, hi, lo, n, side), each pair once; a side other than -1 pairs only with
    another one, unless the block has one side alone."""
    k, ids, hi, lo, n, side = cols
    same = k[1:] == k[:-1]
    once = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    if not len(once):
        return None
    k, ids, hi, lo, n, side = (x[once] for x in (k, ids, hi, lo, n, side))
    ga, gb = gray_rank(hi, lo)
    order = np.lexsort((gb, ga, k))
    k, ids, hi, lo, n, side = (x[order] for x in (k, ids, hi, lo, n, side))
    got = []
    for i, j in gray_search(k, hi, lo, n, num, den, tally, by_size=True):
        keep = (side[i] == -1) | (side[i] != side[j])
        i, j = i[keep], j[keep]
        got.append((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])))
    if not got:
        return None
    a, b = (np.concatenate([x[c] for x in got]) for c in (0, 1))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)] & (a != b)
    return a[keep], b[keep]


def _batch(a=None, rows=None, part: int = 0) -> pa.RecordBatch:
    """Pairs, or members of a block that is given back."""
    size = len(a[0]) if a is not None else len(rows[0])
    no = pa.nulls(size, pa.int64())
    if a is not None:
        return pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(a[1]), no, no, pa.nulls(size, pa.int32()), pa.nulls(size, pa.int32())], _FIELDS)
    k, ids, hi, lo, n, _ = rows
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(ids), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(n), pa.array(np.full(size, part, np.int32))], _FIELDS)


def _search(num: int, den: int, part_rows: int):
    """Batches come sorted by block; a block that a batch ends in waits for the next one. A block that grows over
    part_rows is given back in parts, without being held. part_rows 0: all blocks are searched."""

    def run(batches):
        held, rows, hot, given = [], 0, None, 0
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in _COLUMNS]
            cols[2], cols[3] = cols[2].view(np.uint64), cols[3].view(np.uint64)
            if hot is not None:
                to = int(np.searchsorted(cols[0], hot, "right"))
                if to:
                    yield _batch(rows=[x[:to] for x in cols], part=given // part_rows)
                    given += to
                if to == len(cols[0]):
                    continue
                cols, hot = [x[to:] for x in cols], None
            held.append(cols)
            rows += len(cols[0])
            if rows < 200_000 and (held[0][0][0] != cols[0][-1] or not part_rows or rows <= part_rows):
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            to = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            rest = [x[to:] for x in cols]
            if to and (got := _found_pairs([x[:to] for x in cols], num, den)):
                yield _batch(got)
            held, rows = [rest], len(rest[0])
            if part_rows and rows > part_rows:
                hot, given, held, rows = rest[0][-1], len(rest[0]), [], 0
                yield _batch(rows=rest)
        if held:
            if got := _found_pairs([np.concatenate(x) for x in zip(*held)], num, den):
                yield _batch(got)

    return run


def _blocks(entries: DataFrame) -> DataFrame:
    return entries.repartition("k").sortWithinPartitions("k")


def _pairs_of(entries: DataFrame, num: int, den: int, part_rows: int) -> DataFrame:
    """a, b: candidate pairs. Blocks given back are spread over tasks by pairs of their parts."""
    out = cut(_blocks(entries).withColumn("side", F.lit(-1)).mapInArrow(_search(num, den, part_rows), _FOUND))
    found = out.filter("part is null").select("a", "b")
    back = out.filter("part is not null").select(F.col("a").alias("k"), F.col("b").alias("id"), "hi", "lo", "n", "part")
    if not back.isEmpty():
        parts = back.groupBy("k").agg((F.max("part") + 1).alias("parts"))
        with_other = back.join(parts, "k").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        low, high = F.least("part", "other"), F.greatest("part", "other")
        side = F.when(low == high, -1).otherwise(F.col("part"))
        again = with_other.select(F.xxhash64("k", low, high).alias("k"), "id", "hi", "lo", "n", side.alias("side"))
        found = found.unionByName(_blocks(again).mapInArrow(_search(num, den, 0), _FOUND).select("a", "b"))
    return found.groupBy("a", "b").agg(F.count("*").alias("blocks")).select("a", "b")


def _representatives(df: DataFrame, key: str, cols: list[str], sep: str) -> DataFrame:
    """id, w: a row with words of each class of equal texts."""
    rows = df.select(class_key(cols).alias("ck"), F.col(key).cast("long").alias("id"), words(cols, sep).alias("w"))
    return rows.filter(F.size("w") > 0).groupBy("ck").agg(F.min("id").alias("id"), F.first("w").alias("w")).select("id", "w")


def index_report(df: DataFrame, key: str, cols: list[str], num: int = 4, den: int = 5, sep: str = " ") -> dict[str, int]:
    """What the index does for these rows: representatives, their entries in blocks, pairs of nodes and sketches looked
    at and dropped. Sums of the tasks' counts reach the driver."""
    reps = _representatives(df, key, cols, sep)
    table = df.sparkSession.sparkContext.broadcast(_count_table(df.select(words(cols, sep).alias("w"))))

    def run(batches):
        tally: dict[str, int] = {}
        for b in batches:
            held = [b.column(c).to_numpy(zero_copy_only=False) for c in _COLUMNS]
            held[2], held[3] = held[2].view(np.uint64), held[3].view(np.uint64)
            tally["entries"] = tally.get("entries", 0) + b.num_rows
            _found_pairs(held, num, den, tally)
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["what", "n"])

    # whole tasks as single batches, for the report only
    entries = _blocks(reps.mapInArrow(_entries(table, num, den), _ENTRY)).withColumn("side", F.lit(-1))
    rows = entries.mapInArrow(lambda it: run(_one(it)), "what string, n long").groupBy("what").agg(F.sum("n")).collect()
    return {"representatives": reps.count(), **{r[0]: r[1] for r in rows}}


def _one(batches):
    got = [b for b in batches if b.num_rows]
    if got:
        yield pa.Table.from_batches(got).combine_chunks().to_batches()[0]


def near_duplicates(df: DataFrame, key: str, cols: list[str], num: int = 4, den: int = 5, sep: str = " ") -> DataFrame:
    """Pairs of class representatives: a, b (a < b), shared, united. The threshold num/den is over one half."""
    if not den < 2 * num <= 2 * den:
        raise ValueError("the similarity must be over one half, and one at most")
    reps = _representatives(df, key, cols, sep)
    table = df.sparkSession.sparkContext.broadcast(_count_table(df.select(words(cols, sep).alias("w"))))
    found = _pairs_of(reps.mapInArrow(_entries(table, num, den), _ENTRY), num, den, PART)
    both = found.join(reps.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(
        reps.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b"
    )
    shared = F.size(F.array_intersect("wa", "wb"))
    return (
        both.select("a", "b", shared.alias("shared"), (F.size("wa") + F.size("wb")).alias("s"))
        .select("a", "b", "shared", (F.col("s") - F.col("shared")).alias("united"))
        .filter(F.col("shared") * den >= F.col("united") * num)
    )


def members(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Rows of classes with several rows: rep (the class's representative), id. The hot class is spread by AQE."""
    rows = classes(df, key, cols)
    many = rows.groupBy("ck").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter(F.col("n") > 1).select("ck", "rep")
    return rows.join(many, "ck").select("rep", "id")


def expanded(pairs: DataFrame, df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Pairs of rows (a < b): each pair of classes with all members of both."""
    m = members(df, key, cols)
    ma, mb = m.select(F.col("rep").alias("a"), F.col("id").alias("ia")), m.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    both = pairs.select("a", "b").join(ma, "a", "left").join(mb, "b", "left")
    x, y = F.coalesce("ia", "a"), F.coalesce("ib", "b")
    return both.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def components(pairs: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable): connected components by alternating large and small stars.

    Each round joins every node to the smallest node around it, in shuffles over the edges only; the number of rounds
    grows with the logarithm of the longest chain. Lineage is cut each round; only a count reaches the driver."""
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Large: larger neighbours go to the smallest node around u. Small: u and its smaller neighbours do."""
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        j = both.join(low, "u")
        if large:
            out = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    state = None
    while True:
        edges = cut(star(star(edges, True), False))
        # stable once every node hangs on its smallest one: stars over stars change nothing
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    low = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return low.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def grouped(pairs: DataFrame, df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One row per row of df: id, rep (smallest key among rows of equal text), grp (smallest rep of its group; rep itself
    if it is similar to none), links (number of different texts that are similar to its own)."""
    pairs = cut(pairs.select("a", "b"))
    rows = classes(df, key, cols)
    reps = rows.groupBy("ck").agg(F.min("id").alias("rep"))
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))
    links = ends.groupBy("rep").agg(F.count("*").alias("links"))
    comp = components(pairs).select(F.col("node").alias("rep"), F.col("comp").alias("grp"))
    known = reps.join(links, "rep", "left").join(comp, "rep", "left")
    return rows.join(known, "ck").select("id", "rep", F.coalesce("grp", "rep").alias("grp"), F.coalesce("links", F.lit(0)).alias("links"))
