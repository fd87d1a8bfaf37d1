"""Oversized texts cut into overlapping pieces at natural boundaries.

Workers look at byte ranges of a text, each with a halo of the bytes beside it, and list the natural boundaries of
their range. The boundary tables are stitched: a running sum over the lengths of the ranges in characters turns places
in a range into places in the text, and the cuts are chosen on the table alone. A giant text is stitched in segments,
each of which begins at a cut that depends on its own neighbourhood only, so no task holds more than a segment's table.
Pieces are given as offsets; their texts are taken by offset, from the column or from the file, of which no task reads
more than its ranges and pieces.

Defined results: null texts give nothing; texts within the limit give one piece, or none if only oversized ones are
asked for; without any boundary in reach a cut falls at the limit exactly, be it between a letter and its combining mark;
pieces cover the whole text, in order; repeated rows give their pieces under their own key.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a column's text and of a file that a worker looks at in one go, and bytes around them.
RANGE, FILE_RANGE, HALO = 1 << 13, 1 << 18, 256
#: Ranges of a file whose lengths are summed together.
BLOCK = 1024
#: Ranges that are stitched as one segment.
SEGMENT = 16
#: Ranks of boundaries: new paragraph, end of line or sentence, end of clause, white space.
PARAGRAPH, SENTENCE, CLAUSE, WORD = 4, 3, 2, 1
#: Code points that end a sentence or a clause, that may close a quotation behind it, that end a sentence
#: without a space behind them.
_ENDS, _COMMAS, _CLOSERS, _WIDE_ENDS = (np.array([ord(c) for c in x], np.uint32) for x in (".!?…。！？", ",;:", "\"'”’)]»", "。！？"))


def _is_space(c: np.ndarray) -> np.ndarray:
    low = (c == 32) | ((c >= 9) & (c <= 13)) | ((c >= 0x1C) & (c <= 0x1F)) | (c == 0x85) | (c == 0xA0)
    return low | (c == 0x1680) | ((c >= 0x2000) & (c <= 0x200A)) | (c == 0x2028) | (c == 0x2029) | (c == 0x202F) | (c == 0x205F) | (c == 0x3000)


def boundaries(text: str, begin: int, end: int) -> tuple[list[int], list[int]]:
    """Places within text[begin:end] before which a piece may begin, with their ranks, counted from begin; text holds
    the halo too. A piece may begin behind a run of white space; the run's line breaks and the character before it give
    the rank."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(c):
        return [], []
    space = _is_space(c)
    edge = np.flatnonzero(np.diff(np.r_[False, space, False].astype(np.int8)))
    start, at = edge[0::2], edge[1::2]
    lines = np.r_[0, np.cumsum(c == 10)]
    breaks = lines[at] - lines[start]
    before = np.where(start > 0, c[np.maximum(start - 1, 0)], 0)
    inner = np.where(start > 1, c[np.maximum(start - 2, 0)], 0)
    ends = np.isin(before, _ENDS) | (np.isin(before, _CLOSERS) & np.isin(inner, _ENDS))
    rank = np.where(breaks > 1, PARAGRAPH, np.where((breaks == 1) | ends, SENTENCE, np.where(np.isin(before, _COMMAS), CLAUSE, WORD)))
    wide = np.flatnonzero(np.isin(c[:-1], _WIDE_ENDS) & ~space[1:]) + 1
    if len(wide):
        at, rank = np.r_[at, wide], np.r_[rank, np.full(len(wide), SENTENCE)]
        order = np.argsort(at, kind="stable")
        at, rank = at[order], rank[order]
    here = (at >= max(begin, 1)) & (at < min(end, len(c)))
    at, rank = at[here] - begin, rank[here]
    return at.tolist(), rank.tolist()


def _begin(raw: bytes, at: int) -> int:
    """The first place from at on where a character begins."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def look(raw: bytes, begin: int, end: int) -> tuple[str, list[int], list[int]]:
    """The characters of a byte range of UTF-8 (raw holds the halo too), their boundaries and ranks. Bytes that are no
    UTF-8 count as one replacement character each."""
    before, own, after = (raw[x:y].decode("utf-8", "replace") for x, y in ((0, begin), (begin, end), (end, len(raw))))
    at, rank = boundaries(before + own + after, len(before), len(before) + len(own))
    return own, at, rank


def ranges(text: str, size: int = RANGE) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """number, length in characters, boundaries and ranks of each byte range of a text."""
    raw = text.encode("utf-8", "replace")
    for no, s in enumerate(range(0, len(raw), size)):
        b, e = _begin(raw, s), _begin(raw, min(len(raw), s + size))
        lead = _begin(raw, max(0, b - HALO))
        own, at, rank = look(raw[lead : _begin(raw, min(len(raw), e + HALO))], b - lead, e - lead)
        yield no, len(own), at, rank


def choose_cut(places: list[tuple[int, int]], begin: int, limit: int) -> int:
    """The place at which the piece from begin ends: the best boundary of its last part, else the limit."""
    hi = bisect_right(places, (begin + limit, 9))
    for share, least in ((0.5, PARAGRAPH), (0.6, SENTENCE), (0.75, CLAUSE), (0.5, WORD)):
        lo = bisect_left(places, (begin + int(limit * share), 0))
        for p, r in reversed(places[lo:hi]):
            if r >= least and p > begin:
                return p
    return begin + limit


def choose_start(places: list[tuple[int, int]], begin: int, cut: int, overlap: int) -> int:
    """The boundary nearest to cut - overlap from which the next piece begins; it lies after begin."""
    if not overlap:
        return cut
    want = cut - overlap
    i = bisect_left(places, (want, 0))
    near = [p for p, _ in places[max(0, i - 2) : i + 2] if begin < p < cut and abs(p - want) <= overlap]
    return min(near, key=lambda p: (abs(p - want), p)) if near else max(want, begin + 1)


def stitch(parts: list[tuple[int, int, list[int], list[int]]], first: int, whole_end: bool, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (begin, end) of a segment. parts: offset, length, boundaries and ranks of its ranges in order, with that
    of the range before the segment in front, if there is one; first: offset of the segment."""
    places = [(off + a, r) for off, _, at, rank in parts for a, r in zip(at, rank)]
    end = parts[-1][0] + parts[-1][1]

    def anchor(at: int) -> int:
        return choose_cut(places, at - limit, limit) if at else 0

    stop = end if whole_end else anchor(end)
    start = anchor(first)
    begin = choose_start(places, max(-1, start - limit), start, overlap) if start else 0
    out = []
    while begin < stop:
        cut = stop if stop - begin <= limit else choose_cut(places, begin, limit)
        out.append((begin, cut))
        if cut >= stop:
            break
        begin = choose_start(places, begin, cut, overlap)
    return out


def _detect(keys: list[str]):
    def run(batches):
        for b in batches:
            rows, no, off, ln, at, rk, last = [], [], [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                got = list(ranges(text))
                rows += [i] * len(got)
                last += [len(got) - 1] * len(got)
                off += [0, *accumulate(r[1] for r in got)][:-1]
                for x, v in zip((no, ln, at, rk), zip(*got)):
                    x += v
            i32 = pa.list_(pa.int32())
            cols = [*(b.column(k).take(pa.array(rows, pa.int64())) for k in keys), pa.array(no, pa.int32()), pa.array(off, pa.int64()), pa.array(ln, pa.int32()), pa.array(last, pa.int32())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at, i32), pa.array(rk, i32)], [*keys, "no", "off", "len", "last", "at", "rank"])

    return run


def placed_ranges(table: DataFrame, keys: list[str]) -> DataFrame:
    """Adds off (length of the ranges before). Lengths are summed by blocks, blocks by text: no window holds more than
    BLOCK ranges or the blocks of one text. table is read twice."""
    from pyspark.sql import Window

    lengths = table.select(*keys, "no", "len").withColumn("block", (F.col("no") / BLOCK).cast("int"))
    sums = lengths.groupBy(*keys, "block").agg(F.sum("len").alias("sum"))
    before = sums.select(*keys, "block", (F.sum("sum").over(Window.partitionBy(*keys).orderBy("block")) - F.col("sum")).alias("before"))
    inner = F.sum("len").over(Window.partitionBy(*keys, "block").orderBy("no")) - F.col("len")
    offs = lengths.select(*keys, "no", "block", inner.alias("inner")).join(before, [*keys, "block"]).select(*keys, "no", (F.col("before") + F.col("inner")).alias("off"))
    return table.join(offs, [*keys, "no"])


def cut_table(placed: DataFrame, keys: list[str], limit: int, overlap: int) -> DataFrame:
    """keys, seg, k, begin, end of each piece and no, the range that it begins in, from the ranges' boundary tables (keys,
    no, off, len, last, at, rank)."""
    own = (F.col("no") / SEGMENT).cast("int")
    segs = F.when((F.col("no") % SEGMENT == SEGMENT - 1) & (F.col("no") < F.col("last")), F.array(own, own + 1)).otherwise(F.array(own))
    grouped = (
        placed.select(*keys, F.explode(segs).alias("seg"), "last", F.struct("no", "off", "len", "at", "rank").alias("r"))
        .groupBy(*keys, "seg")
        .agg(F.max("last").alias("last"), F.array_sort(F.collect_list("r")).alias("rs"))
    )

    def run(batches):
        for b in batches:
            rows, no, be, en, of = [], [], [], [], []
            segs, last, rs = (b.column(c).to_pylist() for c in ("seg", "last", "rs"))
            for i in range(len(segs)):
                parts = [(r["off"], r["len"], r["at"], r["rank"]) for r in rs[i]]
                first = next(r["off"] for r in rs[i] if r["no"] >= segs[i] * SEGMENT)
                offs = [r["off"] for r in rs[i]]
                for k, (x, y) in enumerate(stitch(parts, first, rs[i][-1]["no"] == last[i], limit, overlap)):
                    rows.append(i)
                    of.append(rs[i][bisect_right(offs, x) - 1]["no"])
                    no.append(k)
                    be.append(x)
                    en.append(y)
            cols = [*(b.column(k).take(pa.array(rows, pa.int64())) for k in [*keys, "seg"]), pa.array(no, pa.int32()), pa.array(be, pa.int64()), pa.array(en, pa.int64()), pa.array(of, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, [*keys, "seg", "k", "begin", "end", "no"])

    types = dict(placed.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", seg int, k int, begin long, end long, no int"
    return grouped.mapInArrow(run, schema)


def split_offsets(df: DataFrame, keys: list[str], text: str, limit: int = 2000, overlap: int = 200, oversized_only: bool = True) -> DataFrame:
    """keys, seg, k, begin, end: pieces by offset, ordered by seg and k."""
    rows = df.select(*keys, F.col(text).alias("text")).filter(F.char_length("text") > (limit if oversized_only else 0))
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", no int, off long, len int, last int, at array<int>, rank array<int>"
    return cut_table(rows.mapInArrow(_detect(keys), schema), keys, limit, overlap)


def split_texts(df: DataFrame, keys: list[str], text: str, limit: int = 2000, overlap: int = 200, oversized_only: bool = True) -> DataFrame:
    """keys, piece (number from 0), begin, end, text of each piece. keys identify a row."""
    cuts = split_offsets(df, keys, text, limit, overlap, oversized_only)
    per_text = cuts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seg", "k", "begin", "end"))).alias("ps"))
    both = df.select(*keys, F.col(text).alias("text")).join(per_text, keys)
    return both.select(*keys, "text", F.posexplode("ps").alias("piece", "p")).select(
        *keys, "piece", F.col("p.begin").alias("begin"), F.col("p.end").alias("end"), F.substring("text", F.col("p.begin").cast("int") + 1, (F.col("p.end") - F.col("p.begin")).cast("int")).alias("text")
    )


# ---- files ----------------------------------------------------------------------------------------------------------


def _open(path: str):
    """A file of any file system that Arrow knows, for reading at places."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def file_range(f, begin: int, end: int, size: int) -> tuple[int, int, list[int], list[int], list[int]]:
    """First byte, characters, boundaries, their ranks and their bytes of the byte range [begin, end) of a UTF-8 file."""
    lead = max(0, begin - HALO - 3)
    raw = f.read_at(min(size, end + HALO + 7) - lead, lead)
    b, e = _begin(raw, begin - lead), _begin(raw, end - lead)
    skip = _begin(raw, 0)
    tail = _begin(raw, min(len(raw), e + HALO)) if lead + len(raw) < size else len(raw)
    own, at, rank = look(raw[skip:tail], b - skip, e - skip)
    edge, last, bytes_at = lead + b, 0, []
    for a in at:
        edge += len(own[last:a].encode())
        bytes_at.append(edge)
        last = a
    return lead + b, len(own), at, rank, bytes_at


def split_files(spark: SparkSession, paths: list[str], limit: int = 2000, overlap: int = 200, range_bytes: int = FILE_RANGE) -> DataFrame:
    """path, piece, begin, end (characters), text of the pieces of UTF-8 files, or of those in folders. Sizes come from the file
    system; ranges, cuts and pieces are rows, and a piece is read from the last boundary at or before its begin."""
    from pyspark.sql import Window

    from corpusloom.session import cut

    files = spark.read.format("binaryFile").load(paths).select("path", "length").filter("length > 0")
    last = F.floor((F.col("length") - 1) / range_bytes).cast("int")
    todo = files.select("path", "length", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("no")).repartition("path", "no")

    def detect(it):
        for pdf in it:
            got = []
            for path, rows in pdf.groupby("path", sort=False):
                with _open(path) as f:
                    for r in rows.itertuples():
                        got.append((path, r.no, r.last, *file_range(f, r.no * range_bytes, min((r.no + 1) * range_bytes, r.length), r.length)))
            yield pd.DataFrame(got, columns=["path", "no", "last", "first", "len", "at", "rank", "bytes"])

    table = cut(todo.mapInPandas(detect, "path string, no int, last int, first long, len int, at array<int>, rank array<int>, bytes array<long>"))
    placed = placed_ranges(table, ["path"])
    cuts = cut(cut_table(placed.drop("bytes", "first"), ["path"], limit, overlap))
    per = cuts.groupBy("path", "seg").agg((F.max("k") + 1).alias("pieces"))
    before = per.select("path", "seg", (F.sum("pieces").over(Window.partitionBy("path").orderBy("seg")) - F.col("pieces")).alias("before"))
    of_range = cuts.join(before, ["path", "seg"]).groupBy("path", "no").agg(F.collect_list(F.struct((F.col("before") + F.col("k")).alias("piece"), "begin", "end")).alias("ps"))

    def emit(it):
        for pdf in it:
            out = []
            for path, rows in pdf.groupby("path", sort=False):
                with _open(path) as f:
                    for r in rows.itertuples():
                        for p in r.ps:
                            k = bisect_right(r.at, p["begin"] - r.off) - 1
                            byte, skip = (int(r.bytes[k]), p["begin"] - r.off - r.at[k]) if k >= 0 else (r.first, p["begin"] - r.off)
                            n = int(skip + p["end"] - p["begin"])
                            out.append((path, p["piece"], p["begin"], p["end"], f.read_at(4 * n, byte).decode("utf-8", "replace")[int(skip) : n]))
            yield pd.DataFrame(out, columns=["path", "piece", "begin", "end", "text"])

    jobs = of_range.join(placed.select("path", "no", "off", "first", "at", "bytes"), ["path", "no"])
    return jobs.mapInPandas(emit, "path string, piece long, begin long, end long, text string")
