"""Scores, cube decisions and gammon figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leader(away1: Column, away2: Column) -> Column:
    """1 or 2 for the side nearer to winning, 0 if level."""
    return F.when(away1 < away2, 1).when(away2 < away1, 2).otherwise(0)


def variant(away1: Column, away2: Column, crawford: Column) -> Column:
    """crawford, post_crawford (a side is 1-away in another game) or normal."""
    return F.when(crawford, "crawford").when((away1 == 1) | (away2 == 1), "post_crawford").otherwise("normal")


def cell_id(away1: Column, away2: Column, of: Column) -> Column:
    return F.format_string("a%d_b%d_%s", away1.cast("int"), away2.cast("int"), of)


def cell_label(away1: Column, away2: Column, of: Column) -> Column:
    mark = F.when(of == "crawford", " CRA").when(of == "post_crawford", " PCR").otherwise("")
    return F.concat(F.format_string("%da-%da", away1.cast("int"), away2.cast("int")), mark)


def take_point(away1: Column, away2: Column) -> Column:
    """Share of wins that a take needs, from a linear match equity 0.5 + 0.425 * (n2 - n1) / (n2 + n1), within 0..0.5;
    0.25 for money games (an away score of 0 or less)."""
    a, b = away1.cast("double"), away2.cast("double")
    one = F.lit(1.0)

    def equity(own: Column, other: Column, own_base: Column, other_base: Column) -> Column:
        return F.lit(0.5) + F.lit(0.425) * F.try_divide(other - own, other_base + own_base)

    now = equity(a, b, a, b)
    win = equity(a - 1, b, F.greatest(a - 1, one), b)
    loss = equity(a, b - 1, a, F.greatest(b - 1, one))
    point = (now - loss) / F.greatest(win - loss, F.lit(1e-6))
    return F.when((a <= 0) | (b <= 0), F.lit(0.25)).otherwise(F.least(F.greatest(point, F.lit(0.0)), F.lit(0.5)))


def gammon_threat(win_g: Column, win_bg: Column) -> Column:
    return win_g.cast("double") + win_bg.cast("double")


def cube_leverage(cube: Column, away1: Column, away2: Column) -> Column:
    return cube.cast("double") / F.greatest(away1, away2, F.lit(1)).cast("double")


def cube_log2(cube: Column) -> Column:
    """0 for 1 (and below), 1 for 2, 2 for 4, …"""
    return F.floor(F.log2(F.greatest(cube, F.lit(1)).cast("double"))).cast("int")


def cube_error(no_double: Column, double_take: Column, double_pass: Column, played: Column) -> Column:
    """Loss of the played action against max(no double, min(double/take, double/pass)), at least 0."""
    best = F.greatest(no_double, F.least(double_take, double_pass))
    return F.greatest(F.lit(0.0), best - played)


#: The four categories, by texts that an action holds in lower case, tried in order.
ACTIONS = (("no double", "no_double"), ("pass", "double_pass"), ("drop", "double_pass"), ("take", "double_take"), ("redouble", "double"), ("double", "double"))


def cube_category(action: Column) -> Column:
    low = F.lower(action)
    out = F.when(action.isNull(), F.lit(None).cast("string"))
    for text, kind in ACTIONS:
        out = out.when(low.contains(text), kind)
    return out


def missed_double(played: Column, optimal: Column) -> Column:
    return (cube_category(played) == "no_double") & cube_category(optimal).isin("double_take", "double_pass", "double")


def wrong_take(played: Column, optimal: Column) -> Column:
    return (cube_category(played) == "double_take") & (cube_category(optimal) == "double_pass")


def wrong_pass(played: Column, optimal: Column) -> Column:
    return (cube_category(played) == "double_pass") & (cube_category(optimal) == "double_take")


def zone(own_away: Column, other_away: Column, near: int = 3) -> Column:
    """dmp, both_near, ahead, behind or far."""
    return (
        F.when((own_away == 1) & (other_away == 1), "dmp")
        .when((own_away <= near) & (other_away <= near), "both_near")
        .when(own_away <= near, "ahead")
        .when(other_away <= near, "behind")
        .otherwise("far")
    )


def recommendation(equity: Column, take: Column, threat: Column, from_threat: float = 0.30, per_threat: float = 0.05) -> Column:
    """double if the equity reaches the threshold, which a gammon threat from 0.30 on lowers; else wait."""
    threshold = take - F.when(threat >= from_threat, threat * per_threat).otherwise(0.0)
    return F.when(equity >= threshold, "double").otherwise("wait")


def equity_scaled(equity: Column) -> Column:
    """Equity as an integer of ten-thousandths, halves away from zero."""
    return F.round(equity * 10_000).cast("int")


def equity_of(scaled: Column) -> Column:
    return scaled / 10_000.0
