"""Items of varying size packed into containers of fixed capacity, by hierarchical residual packing.

Items are spread over groups of bounded size. Each group packs its items best-fit, largest first. Containers that are
nearly full are given out; the others move up a tree as items of the next round, several groups becoming one, and are
packed again best-fit, until one group is left. An item larger than the capacity is split: full containers of its own
and a rest that is packed like any item.

Defined results: items of size zero (null and empty texts) stand in some container and take no room; null sizes count
as zero; an empty table gives no rows; items of equal size are taken in the order of their key. The result depends on
keys and sizes only, not on the partitioning of the input.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

#: Items that a group of the first round has on average, groups that become one, room that counts as nearly full.
GROUP_ITEMS, FAN_IN, NEARLY = 20_000, 8, 0.005


def best_fit(sizes, capacity: int) -> tuple[list[int], list[int]]:
    """Container of each item, in the given order, and the room left in each container.

    Containers with r left are kept per r; a bit set of the r that occur gives the least r that suffices."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, place, room = 0, [], []
    for s in sizes:
        above = bits >> s
        if above:
            r = s + (above & -above).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                bits &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        r -= s
        room[b] = r
        by_room[r].append(b)
        bits |= 1 << r
        place.append(b)
    return place, room


def _rising(bins: list[tuple[int, int]], capacity: int, groups: int) -> set[int]:
    """The bins that go up: those up to half full, of which best fit leaves one to a group, and of the others, which
    can't be joined with each other, as many of the roomiest as there are groups that may send one to join."""
    bins = [x for x in bins if x[1] < int(capacity * (1 - NEARLY))]
    half = [b for b, f in bins if 2 * f <= capacity]
    rest = sorted((f, b) for b, f in bins if 2 * f > capacity)
    return {*half, *(b for _, b in rest[: groups + len(half)])}


def _pack_group(capacity: int, groups: int):
    """Items (g, key, part, n) of a group -> with bin, fill and whether the bin goes up; a bin is named by the group
    and its number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "key", "part"], ascending=[False, True, True], kind="stable")
        place, room = best_fit(pdf["n"].tolist(), capacity)
        out = pdf.copy()
        out["bin"] = [(int(pdf["g"].iat[0]) << 32) + b for b in place]
        out["fill"] = [capacity - room[b] for b in place]
        return out.assign(up=out["bin"].isin(_rising([(int(b) + (int(pdf["g"].iat[0]) << 32), capacity - r) for b, r in enumerate(room)], capacity, groups)))

    return run


def _merge_group(capacity: int, groups: int):
    """Open bins (g, bin, fill) -> bin, into (the name of its first member), fill, whether that goes up."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        place, room = best_fit(pdf["fill"].tolist(), capacity)
        bins = pdf["bin"].tolist()
        first: dict[int, int] = {}
        for b, p in zip(bins, place):
            first.setdefault(p, b)
        into, fill = [first[p] for p in place], [capacity - room[p] for p in place]
        up = _rising(list(dict(zip(into, fill)).items()), capacity, groups)
        return pd.DataFrame({"g": pdf["g"].tolist(), "bin": bins, "into": into, "fill": fill, "up": [b in up for b in into]})

    return run


def pack(items: DataFrame, key: str, size: str, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """key, part, n, container: parts of split items count from 0."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    s = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    rest = F.pmod(F.col("s"), F.lit(capacity)).cast("int")
    full = F.floor(F.col("s") / capacity).cast("int")
    parts = F.concat(
        F.array_repeat(F.lit(capacity), full),
        F.when((rest > 0) | (full == 0), F.array(rest)).otherwise(F.array().cast("array<int>")),
    )
    rows = cut(items.select(F.col(key).alias("key"), s.alias("s")).select("key", F.posexplode(parts).alias("part", "n")))
    kind = dict(rows.dtypes)["key"]
    closed = rows.filter(F.col("n") == capacity)
    todo = rows.filter(F.col("n") < capacity)
    groups = max(1, -(-todo.count() // group_items))
    # full parts need no packing
    whole = closed.select("key", "part", "n", F.concat_ws(":", F.lit("full"), "key", "part").alias("container"))
    first = cut(
        todo.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))
        .groupBy("g")
        .applyInPandas(_pack_group(capacity, groups), f"key {kind}, part int, n int, g int, bin long, fill int, up boolean")
    )
    placed = first.select("key", "part", "n", "bin")
    open_bins = first.filter("up").groupBy("g", "bin").agg(F.first("fill").alias("fill"))
    moves = None
    while groups > 1:
        groups = -(-groups // FAN_IN)
        merged = cut(
            open_bins.withColumn("g", F.floor(F.col("g") / FAN_IN).cast("int")).groupBy("g").applyInPandas(_merge_group(capacity, groups), "g int, bin long, into long, fill int, up boolean")
        )
        moved = merged.filter(F.col("bin") != F.col("into")).select("bin", "into")
        open_bins = merged.filter(F.col("up") & (F.col("bin") == F.col("into"))).select("g", "bin", "fill")
        if moves is None:
            moves = moved
        else:
            # where a bin went that has moved on
            onward = moved.select(F.col("bin").alias("into"), F.col("into").alias("onward"))
            moves = moves.join(onward, "into", "left").select("bin", F.coalesce("onward", "into").alias("into")).unionByName(moved)
    if moves is not None:
        placed = placed.join(moves, "bin", "left").select("key", "part", "n", F.coalesce("into", "bin").alias("bin"))
    packed = placed.select("key", "part", "n", F.concat_ws(":", F.lit("bin"), "bin").alias("container"))
    return packed.unionByName(whole).select(F.col("key").alias(key), "part", "n", "container")
