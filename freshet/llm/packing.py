"""Variable-capacity best-fit packing.

Sequences of several permitted lengths are filled with pieces of documents. The plan depends only
on how many pieces there are of each length, and lengths are bounded by the largest capacity, so
the whole input is planned exactly from a histogram of at most that many rows:

* lengths are placed from the longest down; a piece goes to the open bin with the least room that
  holds it (best fit);
* if none does, a bin is opened at the capacity whose cost per filled token, given the lengths
  still to come, is least;
* in the end every bin shrinks to the smallest permitted capacity that holds its contents.

Bins alike are planned together, so the plan is a short list of runs: so many pieces of one
length, at one offset, in so many consecutive bins. Pieces find their run by their rank among
those of equal length; ranks are counted by many tasks even if one length holds most pieces.

Defined cases: a null or empty text has length 0 plus `extra`; a document longer than the largest
capacity is cut into full pieces and a rest; a document of length 0 takes no bin and has no row;
repeated rows are packed one by one; an empty table gives no rows; further columns are kept by
`pack`, which only needs a length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.ranks import rank_in_groups
from freshet.session import cut_lineage

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of opening a bin on top of its tokens, in tokens.
OVERHEAD = 16


@dataclass
class Bins:
    """Consecutive bins with equal contents."""

    first: int
    count: int
    capacity: int
    used: int


@dataclass(frozen=True)
class Run:
    """`count` pieces of `length` from rank `rank` on, one in each bin from `bin` on, at `offset`."""

    length: int
    rank: int
    count: int
    bin: int
    offset: int


def _fill(start: int, capacity: int, lengths: list[int], left: dict[int, int]) -> int:
    """Tokens in a bin that starts with `start` and takes the longest remaining pieces that fit."""
    used, top = start, len(lengths)
    while used < capacity:
        top = min(top, bisect_left(lengths, capacity - used + 1))
        if not top:
            break
        length = lengths[top - 1]
        used += length * min(left[length], (capacity - used) // length)
        top -= 1
    return used


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[Run], list[Bins]]:
    """Runs and downsized bins for `histogram` (length -> pieces); lengths are 1 to the largest capacity."""
    sizes = sorted(capacities)
    left = {n: c for n, c in histogram.items() if c}
    lengths = sorted(left)
    runs: list[Run] = []
    bins: list[Bins] = []
    open_bins: list[tuple[int, int]] = []  # (room, index into bins), sorted
    total = 0
    while lengths:
        length = lengths[-1]
        rank = 0
        while left[length]:
            at = bisect_left(open_bins, (length, -1))
            if at < len(open_bins):
                room, k = open_bins.pop(at)
                b = bins[k]
                # A bin that has taken a piece is the best fit for the next as long as it holds it.
                per_bin = min(room // length, left[length])
                n = min(b.count, left[length] // per_bin)
                if n < b.count:  # the rest of these bins stays as it is
                    bins.append(Bins(b.first + n, b.count - n, b.capacity, b.used))
                    insort(open_bins, (room, len(bins) - 1))
                    b.count = n
            else:
                rest = left[length]
                left[length] = rest - 1
                able = lengths if left[length] else lengths[:-1]
                capacity = min(
                    (c for c in sizes if c >= length),
                    key=lambda c: ((c + overhead) / _fill(length, c, able, left), c),
                )
                left[length] = rest
                per_bin = min(rest, capacity // length)
                n = rest // per_bin
                b = Bins(total, n, capacity, 0)
                total += n
                bins.append(b)
                k = len(bins) - 1
            for _ in range(per_bin):
                runs.append(Run(length, rank, n, b.first, b.used))
                b.used += length
                rank += n
                left[length] -= n
            if b.capacity > b.used:
                insort(open_bins, (b.capacity - b.used, k))
        lengths.pop()
    for b in bins:
        b.capacity = next(c for c in sizes if c >= b.used)
    return runs, bins


def pieces(docs: DataFrame, length: Column, most: int, columns: list[str]) -> DataFrame:
    """`columns` with `piece` (0, 1, ...), `start` and `length` of each piece of at most `most` tokens."""
    sized = docs.select(*columns, length.cast("long").alias("_length")).where("_length > 0")
    split = sized.select(*columns, "_length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_length") - 1) / most))).alias("piece"))
    start = F.col("piece") * most
    return split.select(*columns, "piece", start.alias("start"), F.least(F.lit(most), F.col("_length") - start).cast("int").alias("length"))


def pack(
    docs: DataFrame, length: Column, columns: list[str], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD
) -> DataFrame:
    """One row per piece: `columns`, piece, start, length, bin_id, capacity, position (in the bin), bin_used.

    `columns` also break ties between pieces of one length.
    """
    # The pieces are read three times: once written without their texts, they are small.
    cut = cut_lineage(pieces(docs, length, max(capacities), columns))
    # At most one row per length up to the largest capacity.
    counts = cut.groupBy("length").agg(F.count(F.lit(1)).alias("rows"))
    histogram = {r["length"]: r["rows"] for r in counts.collect()}
    runs, bins = plan(histogram, capacities, overhead)
    spark = docs.sparkSession
    ranked = rank_in_groups(cut, "length", counts, sum(histogram.values()), [*(F.col(c) for c in columns), F.col("piece")], "_rank")
    firsts = [b.first for b in sorted(bins, key=lambda b: b.first)]
    by_first = {b.first: b for b in bins}
    # Split runs where the bins differ, so each run has one capacity; still a plan of bounded size.
    steps = []
    for r in runs:
        at, rank = r.bin, r.rank
        while at < r.bin + r.count:
            b = by_first[firsts[bisect_left(firsts, at + 1) - 1]]
            n = min(r.bin + r.count, b.first + b.count) - at
            steps.append((r.length, rank, rank + n, at, r.offset, b.capacity, b.used))
            at, rank = at + n, rank + n
    schema = "length int, steps array<struct<low:long,high:long,bin:long,position:int,capacity:int,used:int>>"
    by_length: dict[int, list] = {}
    for n, *rest in sorted(steps):
        by_length.setdefault(n, []).append(tuple(rest))
    table = spark.createDataFrame(sorted(by_length.items()), schema)
    placed = ranked.join(F.broadcast(table), "length").withColumn(
        "_step", F.get(F.filter("steps", lambda s: (s.low <= F.col("_rank")) & (s.high > F.col("_rank"))), F.lit(0))
    )
    step = F.col("_step")
    return placed.select(
        *columns, "piece", "start", "length", (step.bin + F.col("_rank") - step.low).alias("bin_id"), step.capacity.alias("capacity"),
        step.position.alias("position"), step.used.alias("bin_used"),
    )


def words_and_end(text: Column) -> Column:
    """Tokens of a text: its words between ASCII white space, and one end."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1
