"""Barycentres of a position's six outcomes in score space, cells, and match winning chances.

A match equity table gives the chance to win from (own away, other away). It is a parameter: `linear_table` builds one by
rule, and a published table can be passed as rows of chances for aways 1..n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import table_lookup


def linear_table(n: int = 15, slope: float = 0.85) -> list[list[float]]:
    """Chances 0.5 + slope / 2 * (other - own) / (other + own) for aways 1..n."""
    return [[0.5 + slope / 2 * (b - a) / (b + a) for b in range(1, n + 1)] for a in range(1, n + 1)]


def bordered(table: Sequence[Sequence[float]]) -> list[list[float]]:
    """The table from away 0 on: who has no points to go has won."""
    n = len(table)
    return [[1.0] * (n + 1)] + [[0.0, *row] for row in table]


def barycentres(df: DataFrame, table: Sequence[Sequence[float]], compat: bool = False) -> DataFrame:
    """Adds bary_onroll_a/_b, cubeless_mwc_onroll, the player-1 view bary_p1_*, disp_p1_*, disp_magnitude_p1,
    cubeless_mwc_p1, cubeless_equity_p1, cubeful_equity_p1 and cube_gap_p1.

    Needs player_on_roll, score_away_p1/_p2, cube_value, eval_win/_win_g/_win_bg/_lose_g/_lose_bg (gammons counted as wins
    of at least a gammon), eval_equity. A win of k points lowers the winner's own away score by k cubes; with compat=True it
    lowers the opponent's instead, as a published variant has it. All is arithmetic in one projection: the table is a
    literal, not six joins."""
    grid = bordered(table)
    c = F.greatest(F.col("cube_value"), F.lit(1)).cast("int")
    first = F.col("player_on_roll") == 1
    our = F.when(first, F.col("score_away_p1")).otherwise(F.col("score_away_p2")).cast("int")
    opp = F.when(first, F.col("score_away_p2")).otherwise(F.col("score_away_p1")).cast("int")
    win, win_g, win_bg, lose_g, lose_bg = (F.col(f"eval_{x}").cast("double") for x in ("win", "win_g", "win_bg", "lose_g", "lose_bg"))
    less = lambda away, k: F.greatest(away - k * c, F.lit(0))
    wins = [(win_bg, 3), (win_g - win_bg, 2), (win - win_g, 1)]
    losses = [(1 - win - lose_g, 1), (lose_g - lose_bg, 2), (lose_bg, 3)]
    outcomes = []
    for p, k in wins:
        outcomes.append((p, our, less(opp, k)) if compat else (p, less(our, k), opp))
    for p, k in losses:
        outcomes.append((p, less(our, k), opp) if compat else (p, our, less(opp, k)))
    total = lambda xs: sum(xs[1:], xs[0])
    a = total([p * x.cast("double") for p, x, _ in outcomes])
    b = total([p * y.cast("double") for p, _, y in outcomes])
    m = total([p * table_lookup(grid, x, y) for p, x, y in outcomes])
    out = df.withColumns({"bary_onroll_a": a, "bary_onroll_b": b, "cubeless_mwc_onroll": m})
    swap = lambda x, y: F.when(first, x).otherwise(y)
    out = out.withColumns({
        "bary_p1_a": swap(F.col("bary_onroll_a"), F.col("bary_onroll_b")), "bary_p1_b": swap(F.col("bary_onroll_b"), F.col("bary_onroll_a")),
        "cubeless_mwc_p1": swap(F.col("cubeless_mwc_onroll"), 1 - F.col("cubeless_mwc_onroll")), "cubeful_equity_p1": swap(F.col("eval_equity"), -F.col("eval_equity")),
    })
    out = out.withColumns({"disp_p1_a": F.col("bary_p1_a") - F.col("score_away_p1"), "disp_p1_b": F.col("bary_p1_b") - F.col("score_away_p2"), "cubeless_equity_p1": 2 * F.col("cubeless_mwc_p1") - 1})
    return out.withColumns({"disp_magnitude_p1": F.sqrt(F.col("disp_p1_a") ** 2 + F.col("disp_p1_b") ** 2), "cube_gap_p1": F.col("cubeful_equity_p1") - F.col("cubeless_equity_p1")})


def cell_statistics(df: DataFrame, cell: Sequence[str], x: str = "disp_p1_a", y: str = "disp_p1_b") -> DataFrame:
    return df.groupBy(*cell).agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.stddev_samp(x).alias("std_x"), F.stddev_samp(y).alias("std_y"), F.covar_pop(x, y).alias("covariance"))


def in_range(a: Column, b: Column, n: int = 15) -> Column:
    """Scores that a table of n aways covers."""
    return a.between(1, n) & b.between(1, n)
