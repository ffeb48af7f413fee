"""Rows of two versions of a sheet, matched by what they hold.

Patience alignment, for each pair of versions and sheet:

1. every row gets a 128-bit digest of its cells (constants by value, formulas in relative form), added up
   without an order. Sheets whose rows agree place by place need nothing more;
2. rows whose digest occurs once in either version are anchors;
3. of the rows left, cells that occur once in either version vote for the rows that hold them; rows that
   choose each other are anchors too, so a changed row is known by what is left of it;
4. a longest increasing subsequence of the anchors keeps its order, the others have moved; in the gaps between
   two anchors rows that are unique there become anchors in turn, then equal rows at both ends of a gap
   are matched, and what is left on both sides in equal number is matched in order.

Steps 1 to 3 are aggregates; step 4 sees one sheet at a time, as numbers alone. The file format bounds a
sheet at 1,048,576 rows; rows beyond it (in tables of other origin) and cells without row keep
their place. Repeated cells count as often as they come; null values are values. Versions that
lack a sheet give nothing for it, and empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import MOST_ROWS

KEY = ["pair_id", "sheet"]
ALIGNED = "pair_id string, sheet string, old_row int, new_row int, moved boolean"


def content() -> Column:
    """What a cell says, wherever it stands; ``form`` is its formula in relative form."""
    return F.when(F.col("formula").isNotNull(), F.struct(F.lit("f").alias("kind"), F.col("form").alias("text"))).otherwise(F.struct(F.lit("v").alias("kind"), F.col("value").alias("text")))


# ---------------------------------------------------------------- one sheet


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of ``pairs``, ascending by their first, whose second ascends too."""
    tails, at, back = [], [], [-1] * len(pairs)
    for i, (_, n) in enumerate(pairs):
        k = bisect_left(tails, n)
        if k == len(tails):
            tails.append(n)
            at.append(i)
        else:
            tails[k], at[k] = n, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _unique(rows: list[tuple[int, object]]) -> dict:
    seen: dict = {}
    for place, digest in rows:
        seen[digest] = None if digest in seen else place
    return {d: p for d, p in seen.items() if p is not None}


def align(old: list[tuple[int, object]], new: list[tuple[int, object]], anchors: list[tuple[int, int]]) -> list[tuple[int | None, int | None, bool]]:
    """``(old row, new row, moved)`` for rows given as (row, digest) in order; a row without a match has none on the other side."""
    chain = increasing(sorted(anchors))
    kept = set(chain)
    out: list[tuple[int | None, int | None, bool]] = [(a, b, (a, b) not in kept) for a, b in anchors]
    gone, came = {a for a, _ in anchors}, {b for _, b in anchors}
    old, new = [r for r in old if r[0] not in gone], [r for r in new if r[0] not in came]
    edges = [*chain, (None, None)]
    work, i, j = [], 0, 0
    for a, b in edges:
        i2 = len(old) if a is None else bisect_left(old, a, i, key=lambda r: r[0])
        j2 = len(new) if b is None else bisect_left(new, b, j, key=lambda r: r[0])
        if i2 > i or j2 > j:
            work.append((old[i:i2], new[j:j2]))
        i, j = i2, j2
    while work:
        left, right = work.pop()
        if not left or not right:
            out += [(a, None, False) for a, _ in left] + [(None, b, False) for b, _ in right]
            continue
        mine, theirs = _unique(left), _unique(right)
        inner = increasing(sorted((mine[d], theirs[d]) for d in mine.keys() & theirs.keys()))
        if inner:
            i = j = 0
            for a, b in [*inner, (None, None)]:
                i2 = len(left) if a is None else bisect_left(left, a, i, key=lambda r: r[0])
                j2 = len(right) if b is None else bisect_left(right, b, j, key=lambda r: r[0])
                work.append((left[i:i2], right[j:j2]))
                if a is not None:
                    out.append((a, b, False))
                    i2, j2 = i2 + 1, j2 + 1
                i, j = i2, j2
            continue
        head = 0
        while head < min(len(left), len(right)) and left[head][1] == right[head][1]:
            head += 1
        tail = 0
        while tail < min(len(left), len(right)) - head and left[-1 - tail][1] == right[-1 - tail][1]:
            tail += 1
        out += [(a[0], b[0], False) for a, b in zip(left[:head], right[:head], strict=True)]
        out += [(a[0], b[0], False) for a, b in zip(left[len(left) - tail :], right[len(right) - tail :], strict=True)]
        left, right = left[head : len(left) - tail], right[head : len(right) - tail]
        if len(left) == len(right):
            out += [(a[0], b[0], False) for a, b in zip(left, right, strict=True)]
        else:
            out += [(a, None, False) for a, _ in left] + [(None, b, False) for b, _ in right]
    return out


# ---------------------------------------------------------------- all sheets


def aligned_rows(cells: DataFrame) -> DataFrame:
    """``(pair_id, sheet, old_row, new_row, moved)`` of all sheets in which some row differs.

    ``cells`` hold pair_id, side (old or new), sheet, row, col, value, formula and its relative form. In sheets that are not
    listed every row keeps its number.
    """
    each = cells.where(F.col("row").between(1, MOST_ROWS)).select(*KEY, "side", "row", "col", content().alias("content"))
    lane = lambda i: F.bit_xor(F.xxhash64(F.lit(i), "col", "content"))
    digests = each.groupBy(*KEY, "side", "row").agg(F.struct(lane(0).alias("a"), lane(1).alias("b"), F.count("*").alias("n")).alias("d"))
    side = lambda s, c="d": F.max(F.when(F.col("side") == s, F.col(c)))
    flat = digests.select(*KEY, "side", "row", F.concat_ws(":", "d.a", "d.b", "d.n").alias("d"))
    places = flat.groupBy(*KEY, "row").agg(side("old").alias("old"), side("new").alias("new"))
    changed = places.groupBy(*KEY).agg(F.bool_or(~F.col("old").eqNullSafe(F.col("new"))).alias("differs"), F.count("old").alias("n_old"), F.count("new").alias("n_new"))
    changed = changed.where("differs AND n_old > 0 AND n_new > 0").select(*KEY)
    rows = flat.join(changed, KEY, "left_semi")

    def alone(table: DataFrame, what: str) -> DataFrame:
        """Where ``what`` occurs once on either side."""
        met = table.groupBy(*KEY, what).agg(*(F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("old", "new")), *(F.max(F.when(F.col("side") == s, F.col("row"))).alias(f"{s}_row") for s in ("old", "new")))
        return met.where("n_old = 1 AND n_new = 1").select(*KEY, "old_row", "new_row")

    whole = alone(rows, "d")
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_row").alias("row")) for s in ("old", "new")))
    taken = whole.select(*KEY, F.explode(sides).alias("t")).select(*KEY, "t.side", "t.row")
    rest = each.join(changed, KEY, "left_semi").join(taken, [*KEY, "side", "row"], "left_anti")
    votes = alone(rest.select(*KEY, "side", "row", F.struct("col", "content").alias("c")), "c").groupBy(*KEY, "old_row", "new_row").agg(F.count("*").alias("n"))
    choice = lambda own, other: votes.groupBy(*KEY, own).agg(F.max(F.struct("n", (-F.col(other)).alias("other"))).alias("m")).select(*KEY, own, (-F.col("m.other")).alias(other))
    mutual = choice("old_row", "new_row").join(choice("new_row", "old_row"), [*KEY, "old_row", "new_row"])
    anchors = whole.unionByName(mutual)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    told = rows.select(*KEY, "side", "row", "d", none("mate", "int")).unionByName(anchors.select(*KEY, F.lit("pair").alias("side"), F.col("old_row").alias("row"), none("d", "string"), F.col("new_row").alias("mate")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = {s: g.sort_values("row") for s, g in pdf.groupby("side")}
        lines = lambda s: list(zip(part[s]["row"].tolist(), part[s]["d"].tolist(), strict=True)) if s in part else []
        pairs = list(zip(part["pair"]["row"].tolist(), part["pair"]["mate"].astype("int64").tolist(), strict=True)) if "pair" in part else []
        found = align(lines("old"), lines("new"), pairs)
        frame = pd.DataFrame(found, columns=["old_row", "new_row", "moved"]).astype({"old_row": "Int32", "new_row": "Int32"})
        frame.insert(0, "sheet", pdf["sheet"].iloc[0])
        frame.insert(0, "pair_id", pdf["pair_id"].iloc[0])
        return frame

    return told.groupBy(*KEY).applyInPandas(run, ALIGNED)
