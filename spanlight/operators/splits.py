"""Leakage-safe groups, folds and partitions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def embargo_groups(cases: DataFrame, keys: list[str], embargo: float, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """``cases`` with ``group_n``; intervals padded by ``embargo`` that overlap or touch share a group. Stored bounds stay unpadded."""
    order = Window.partitionBy(*keys).orderBy(start, end, "case_id")
    reach = F.max(F.col(end) + embargo).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.coalesce(F.col(start) - embargo > reach, F.lit(True)).cast("int")
    marked = cases.withColumn("_open", opened)
    return marked.withColumn("group_n", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_open")


def stratified_folds(groups: DataFrame, campaign: str, folds: int = 3) -> DataFrame:
    """Greedy fold of each group (``group_n, tactic, n``), rarest tactic first.

    A group goes where the cost grows least: over all folds and tactics the squared error against
    an equal share, divided by that share, plus 0.05 times the squared error of the folds' sizes.
    Equal costs go to the smaller fold.

    Sequential by nature, so it runs once per campaign on one row for each group and tactic.
    """

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index="group_n", columns="tactic", values="n", aggfunc="sum", fill_value=0)
        total = wide.sum()
        target, size = total / folds, total.sum() / folds
        have = [total * 0.0 for _ in range(folds)]
        rarity = {g: min(total[t] for t in wide.columns if row[t]) for g, row in wide.iterrows()}
        out = []
        for g in sorted(wide.index, key=lambda g: (rarity[g], -wide.loc[g].sum(), g)):
            cost = []
            for f in range(folds):
                after = have[f] + wide.loc[g]
                # The other folds stay as they are, so only this one's part of the sum over all folds changes.
                off = lambda x: ((x - target) ** 2 / target.clip(lower=1)).sum() + 0.05 * (x.sum() - size) ** 2
                cost.append((round(off(after) - off(have[f]), 9), after.sum(), f))
            f = min(cost)[2]
            have[f] = have[f] + wide.loc[g]
            out.append((g, f + 1))
        return pd.DataFrame(out, columns=["group_n", "fold"]).assign(campaign=rows[campaign].iloc[0])[["campaign", "group_n", "fold"]]

    return groups.groupBy(campaign).applyInPandas(assign, "campaign string, group_n bigint, fold int")


def calibration_groups(groups: DataFrame, keys: list[str], share: float = 0.25) -> DataFrame:
    """The groups that cover ``share`` of every tactic at the least cost, best gain per row first; ``fold, group_n``."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index="group_n", columns="tactic", values="n", aggfunc="sum", fill_value=0)
        need = (wide.sum() * share).apply(lambda x: max(1, round(x)))
        chosen: list[int] = []
        while (need > 0).any() and len(chosen) < len(wide):
            rest = wide.drop(index=chosen)
            gain = rest.clip(upper=need.clip(lower=0), axis=1).sum(axis=1)
            if gain.max() <= 0:
                break
            best = min(rest.index, key=lambda g: (-gain[g] / rest.loc[g].sum(), rest.loc[g].sum(), g))
            chosen.append(best)
            need = need - wide.loc[best]
        return pd.DataFrame({"fold": rows[keys[0]].iloc[0], "group_n": chosen})

    return groups.groupBy(*keys).applyInPandas(choose, "fold int, group_n bigint")


def family_folds(families: DataFrame, campaign: str, folds: int = 3) -> DataFrame:
    """Families (``family, n``) dealt largest first to the smallest fold."""

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        have, out = [0] * folds, []
        for r in rows.sort_values(["n", "family"], ascending=[False, True]).itertuples():
            f = have.index(min(have))
            have[f] += r.n
            out.append((r.family, f + 1))
        return pd.DataFrame(out, columns=["family", "fold"])

    return families.groupBy(campaign).applyInPandas(deal, "family string, fold int")


def background_partition(bucket: Column) -> Column:
    """A third of the blocks are test, a fifth of the rest calibration, by hash."""
    return F.when(bucket % 3 == 0, "test").when(F.floor(bucket / 3) % 5 == 0, "calibration").otherwise("train")
