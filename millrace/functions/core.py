"""Column helpers that other functions build on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body uses it, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def rate(flag: Column) -> Column:
    """Share of all rows where flag holds; a null flag counts as false."""
    return F.avg(F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0)))


def rate_known(flag: Column) -> Column:
    """Share among the rows where flag is not null."""
    return F.avg(F.when(flag, F.lit(1.0)).when(~flag, F.lit(0.0)))


def long_sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true in an array<boolean>; null counts as false."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, flag: Column) -> Column:
        run = F.when(flag, acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(flags, start, step, lambda acc: acc["best"])


def runs(flags: Column, first: int = 1) -> Column:
    """(best, best_start) of the first longest run of true, with positions from `first` on; 0 and 0 if there is none."""
    zero = F.lit(0)
    start = F.struct(F.lit(first).alias("i"), zero.alias("run"), zero.alias("best"), zero.alias("at"))

    def step(acc: Column, flag: Column) -> Column:
        run = F.when(flag, acc["run"] + 1).otherwise(0)
        more = run > acc["best"]
        return F.struct(
            (acc["i"] + 1).alias("i"),
            run.alias("run"),
            F.when(more, run).otherwise(acc["best"]).alias("best"),
            F.when(more, acc["i"] - run + 1).otherwise(acc["at"]).alias("at"),
        )

    return F.aggregate(flags, start, step, lambda acc: F.struct(acc["best"].alias("best"), acc["at"].alias("best_start")))


def bucket(value: Column, breaks: list[float], labels: list[str], right_closed: bool = True) -> Column:
    """Label of the bin that holds value: labels[i] up to breaks[i], the last beyond them. Null stays null."""
    if len(labels) != len(breaks) + 1:
        raise ValueError("there must be one label more than breaks")
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for b, label in zip(breaks, labels, strict=False):
        out = out.when(value <= b if right_closed else value < b, label)
    return out.otherwise(labels[-1])


def width_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """The bin 1..bins of an equi-width histogram, 0 below low and bins + 1 from high on."""
    inner = F.floor((value - low) / ((high - low) / bins)).cast("int") + 1
    return F.when(value < low, 0).when(value >= high, bins + 1).otherwise(F.least(inner, F.lit(bins)))


def year_of(date: Column) -> Column:
    """The year of an ISO-like date text, null where the first four characters are no number."""
    return F.substring(date, 1, 4).try_cast("int")
