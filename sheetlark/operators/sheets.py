"""Sheets that were renamed: the best one-to-one match of sheets by what their cells hold.

Only sheets whose name the other version lacks are looked at. Each cell that is rare (a fingerprint of column and
content that at most ``RARE`` of these sheets of a side hold) counts once for every pair of sheets that
share it; the matches are counted in aggregates, and a maximum-weight assignment picks the pairs. A pair
needs a share of ``SHARE`` of the larger sheet's fingerprints. The assignment sees the names and counts of one pair
of versions, never cells.

Fingerprints leave the row out, so a renamed sheet may have new rows as well. Repeated cells count
once; sheets without cells match nothing; of equal counts the names decide, in order. Empty tables
give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import content

RARE, SHARE = 8, 0.5
RENAMED = "pair_id string, old_sheet string, new_sheet string"


def assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total weight, each row and column once at most; pairs of weight 0 are left out.

    Shortest augmenting paths with potentials, a row at a time.
    """
    n, m = weights.shape
    if n > m:
        return sorted((i, j) for j, i in assignment(weights.T))
    cost = weights.max(initial=0) - weights.astype(np.float64)
    rows, columns, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        least, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, last = start, -1
        reached = 0.0
        while True:
            slack = reached + cost[i] - rows[i] - columns
            better = ~done & (slack < least)
            least[better], back[better] = slack[better], last
            last = int(np.where(done, np.inf, least).argmin())
            reached = least[last]
            done[last] = True
            if owner[last] < 0:
                break
            i = int(owner[last])
        for j in np.flatnonzero(done):
            if j != last and owner[j] >= 0:
                rows[owner[j]] += reached - least[j]
            columns[j] -= reached - least[j]
        rows[start] += reached
        while last >= 0:
            before = int(back[last])
            owner[last] = owner[before] if before >= 0 else start
            last = before
    return sorted((int(i), j) for j, i in enumerate(owner) if i >= 0 and weights[i, j] > 0)


def matched_sheets(facts: DataFrame) -> DataFrame:
    """``(pair_id, old_sheet, new_sheet)`` of sheets that were renamed; ``facts`` have a side, old or new, and formulas in relative form."""
    listed = facts.where("kind = 'sheet' AND sheet IS NOT NULL").groupBy("pair_id", "sheet").agg(F.bool_or(F.col("side") == "old").alias("was"), F.bool_or(F.col("side") == "new").alias("now"))
    alone = listed.where("was <> now").select("pair_id", "sheet")
    cells = facts.where("kind = 'cell'").join(alone, ["pair_id", "sheet"], "left_semi")
    marks = cells.select("pair_id", "side", "sheet", F.xxhash64("col", content()).alias("mark")).distinct()
    sizes = marks.groupBy("pair_id", "side", "sheet").agg(F.count("*").alias("size"))
    held = lambda s: F.collect_list(F.when(F.col("side") == s, F.col("sheet")))
    # a mark that many sheets hold says nothing, and is not gathered
    number = marks.groupBy("pair_id", "mark").agg(F.count_if(F.col("side") == "old").alias("n_old"), F.count_if(F.col("side") == "new").alias("n_new")).where(f"n_old BETWEEN 1 AND {RARE} AND n_new BETWEEN 1 AND {RARE}")
    rare = marks.join(number.select("pair_id", "mark"), ["pair_id", "mark"], "left_semi").groupBy("pair_id", "mark").agg(held("old").alias("olds"), held("new").alias("news"))
    shared = rare.select("pair_id", F.explode("olds").alias("old_sheet"), "news").select("pair_id", "old_sheet", F.explode("news").alias("new_sheet")).groupBy("pair_id", "old_sheet", "new_sheet").agg(F.count("*").alias("n"))
    of = lambda s: sizes.where(F.col("side") == s).select("pair_id", F.col("sheet").alias(f"{s}_sheet"), F.col("size").alias(f"{s}_size"))
    near = shared.join(of("old"), ["pair_id", "old_sheet"]).join(of("new"), ["pair_id", "new_sheet"]).where(F.col("n") >= SHARE * F.greatest("old_size", "new_size"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        olds, news = sorted(pdf["old_sheet"].unique()), sorted(pdf["new_sheet"].unique())
        weights = np.zeros((len(olds), len(news)))
        for a, b, n in zip(pdf["old_sheet"], pdf["new_sheet"], pdf["n"], strict=True):
            weights[olds.index(a), news.index(b)] = n
        return pd.DataFrame([(pdf["pair_id"].iloc[0], olds[i], news[j]) for i, j in assignment(weights)], columns=["pair_id", "old_sheet", "new_sheet"])

    return near.select("pair_id", "old_sheet", "new_sheet", "n").groupBy("pair_id").applyInPandas(run, RENAMED)


def with_new_names(facts: DataFrame, renamed: DataFrame) -> DataFrame:
    """Facts of the old side under the names that their sheets have now."""
    names = renamed.select("pair_id", F.col("old_sheet").alias("sheet"), F.lit("old").alias("side"), "new_sheet")
    return facts.join(names, ["pair_id", "sheet", "side"], "left").withColumn("sheet", F.coalesce("new_sheet", "sheet")).select(*facts.columns)
