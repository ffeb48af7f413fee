"""Best-fit packing into sequences of several permitted lengths.

A document of more than the longest length is cut into full pieces and a rest. Pieces are
dealt by hash to groups of about ``group_items``; every group is packed alone, so the work is
spread and each task sees a bounded list of lengths, never texts. A sequence of capacity c
costs ``overhead`` + c + c^2 / ``attention``: long sequences cost more by attention, short ones
by their fixed part and the room that stays empty. Inside a group, longest piece first:

* a piece goes to the open bin that it fills best (least room left over);
* if none fits, each permitted size bids its cost for every token that a bin of it could take
  up from the pieces still left, longest first, and the least bid opens the bin;
* every bin shrinks to the smallest permitted length that holds its contents;
* then the sizes of many bins are chosen anew together: the bins that cost most beyond the best rate are opened
  again, a share of them at a time, and their pieces packed by the same rules, by least bids or with bins of some size
  at least; the cheapest way is kept, until none is cheaper. Plans that keep to one size where they can
  are only a check: one is taken if it costs less, which on ``documents`` none does.

Where short pieces are many, every plan fills its bins, and then no choice of sizes costs much less than another.

Texts of any length are packed whole, in pieces. Texts that are null or have no word have length 0 and take no bin: their row has a null
bin_id. Repeated rows are told apart by ``copy`` and each is packed. Null ids are ids like
any other. An empty table gives no rows; extra columns are not read. The result depends on
the data only, not on the partitions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD, ATTENTION, GROUP_ITEMS = 32, 16_384, 20_000
COPIES = 10_000
ROUNDS, SHARES = 6, (0.05, 0.15, 0.4)  # how often, and for which shares of the bins, sizes are chosen anew
SPACE = r"[\x20\x09-\x0D]+"
PACKED = "bin_id long, capacity int, copy int, piece int, start long, length long, offset long"


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def cost(capacity: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    """What a sequence of ``capacity`` costs: a fixed part, its length, and attention, which grows with the square."""
    return overhead + capacity + capacity * capacity / attention


def total_cost(placed: list[tuple[int, int, int]], overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return sum(cost(c, overhead, attention) for _, c in {(b, c) for b, c, _ in placed})


def _plan(lengths: list[int], sizes: list[int], prices: dict[int, float], single: int | None = None) -> list[tuple[int, int, int]]:
    """Best fit of ``lengths``, longest first.

    A bin is opened at the size of least cost for each token it can take up, or, with ``single``,
    at that size or the next that holds the piece.
    """
    fitting = [-n for n in lengths]  # ascending, for searches
    sums = [0, *accumulate(lengths)]
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    used: list[int] = []
    place: list[tuple[int, int]] = []

    def filled(capacity: int, i: int) -> int:
        """Tokens that a bin opened for piece ``i`` can take up from the pieces still left, longest first."""
        free, at = capacity - lengths[i], i + 1
        while free and (at := bisect_left(fitting, -free, at)) < len(lengths):
            to = bisect_right(sums, sums[at] + free, at) - 1  # as many in a row as fit
            free -= sums[to] - sums[at]
            at = to
        return capacity - free

    for i, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            best = None
            for c in sizes[bisect_left(sizes, max(n, single or 0)) :][: 1 if single else None]:
                holds = filled(c, i)
                bid = (prices[sizes[bisect_left(sizes, holds)]] / holds, c)
                best = min(best or bid, bid)
            free, b = best[1], len(used)
            used.append(0)
        place.append((b, used[b]))
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    final = [sizes[bisect_left(sizes, u)] for u in used]
    return [(b, final[b], offset) for b, offset in place]


def _joint(lengths: list[int], sizes: list[int], prices: dict[int, float]) -> list[tuple[int, int, int]]:
    """A plan of ``lengths``, longest first, in bins of all sizes: least bids, then costly bins planned anew together."""
    fit = lambda n: sizes[bisect_left(sizes, n)]
    rate = min(prices[c] / c for c in sizes)
    held: dict[int, list[int]] = {}
    for i, (b, _, _) in enumerate(_plan(lengths, sizes, prices)):
        held.setdefault(b, []).append(i)
    bins = [(sum(lengths[i] for i in own), own) for own in held.values()]
    for _ in range(ROUNDS):
        bins.sort(key=lambda b: (rate * b[0] - prices[fit(b[0])], b[1]))
        best = None
        for share in SHARES:
            few = bins[: max(2, int(len(bins) * share))]
            freed = sorted(i for _, own in few for i in own)
            pieces = [lengths[i] for i in freed]
            before = sum(prices[fit(n)] for n, _ in few)
            for least in (None, *sizes):
                plan = _plan(pieces, sizes, prices, least)
                saved = before - sum(prices[c] for _, c in {(b, c) for b, c, _ in plan})
                if saved > 1e-6 and (best is None or saved > best[0]):
                    best = saved, len(few), freed, plan
        if best is None:
            break
        _, n, freed, plan = best
        anew: dict[int, list[int]] = {}
        for i, (b, _, _) in zip(freed, plan, strict=True):
            anew.setdefault(b, []).append(i)
        bins = [(sum(lengths[i] for i in own), own) for own in anew.values()] + bins[n:]
    bins.sort(key=lambda b: b[1])  # bins are numbered by their first piece
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(lengths)
    for b, (total, own) in enumerate(bins):
        at = 0
        for i in own:
            out[i] = b, fit(total), at
            at += lengths[i]
    return out


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> list[tuple[int, int, int]]:
    """For each length, in the order given, its bin, the bin's final capacity and its offset in the bin.

    No length may exceed the largest capacity. Sizes are planned jointly; a plan that keeps to one size where it
    can is taken only if it costs less.
    """
    sizes = sorted(capacities)
    prices = {c: cost(c, overhead, attention) for c in sizes}
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    ranked = [lengths[i] for i in order]
    best = min((_joint(ranked, sizes, prices), *(_plan(ranked, sizes, prices, single) for single in sizes)), key=lambda p: total_cost(p, overhead, attention))
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(lengths)
    for i, x in zip(order, best, strict=True):
        out[i] = x
    return out


def pack(df: DataFrame, *, id: str = "doc_id", text: str = "text", length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION, group_items: int = GROUP_ITEMS) -> DataFrame:
    """One row per piece: ``(id, copy, piece, start, length, bin_id, capacity, offset)``."""
    most = max(capacities)
    total = (word_count(F.col(text)) if length is None else F.coalesce(length, F.lit(0))).cast("long")
    # texts are read once, for their lengths
    sized = materialize(df.select(F.col(id).cast("long").alias("row_id"), total.alias("total")).groupBy("row_id", "total").agg(F.count("*").alias("n")), "lengths")
    groups = max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // group_items))
    # copies are numbered in two steps, so that no array is longer than COPIES where there are COPIES squared of them
    some = sized.select("row_id", "total", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(COPIES)), F.lit(1).cast("long"))).alias("k"))
    last = F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("k") * COPIES)
    rows = some.select("row_id", "total", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), last), lambda j: (F.col("k") * COPIES + j).cast("int"))).alias("copy"))
    pieces = rows.where("total > 0").select("row_id", "copy", "total", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(most).cast("long"))).alias("piece", "start"))
    pieces = pieces.select("row_id", "copy", "piece", "start", F.least(F.lit(most).cast("long"), F.col("total") - F.col("start")).alias("length"))
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("row_id", "copy", "piece"), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row_id", "copy", "piece"], ascending=[False, True, True, True]).reset_index(drop=True)
        placed = best_fit(pdf["length"].tolist(), capacities, overhead, attention)
        bins, caps, offsets = zip(*placed, strict=True)
        first = int(pdf["g"].iloc[0]) << 32
        return pdf.drop(columns="g").assign(bin_id=[first + b for b in bins], capacity=list(caps), offset=list(offsets))

    fields = "row_id long, copy int, piece int, start long, length long, bin_id long, capacity int, offset long"
    packed = dealt.groupBy("g").applyInPandas(run, fields)
    none = rows.where("total = 0").select("row_id", "copy", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("long").alias("offset"))
    return packed.unionByName(none).withColumnRenamed("row_id", id)
