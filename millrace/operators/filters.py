"""Filters, searches and pages. Conditions are Column expressions, so they reach the scan where the source can take them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def typed(spec: Mapping[str, Any]) -> Column:
    """A conjunction by the values' types: scalar equals, (low, high) is a closed range whose None ends are open, a list
    or set is membership; None skips the column."""
    out = []
    for name, v in spec.items():
        c = F.col(name)
        if v is None:
            continue
        if isinstance(v, tuple):
            low, high = v
            out += [c >= low] * (low is not None) + [c <= high] * (high is not None)
        elif isinstance(v, (list, set, frozenset)):
            out.append(c.isin(*sorted(v)))
        else:
            out.append(c == v)
    return all_of(out)


def wildcard(spec: Mapping[str, int], any_value: int = -1) -> Column:
    """Equality on every column whose value is not the wildcard."""
    return all_of(F.col(k) == v for k, v in spec.items() if v != any_value)


def contains_text(text: str, *columns: str) -> Column:
    """Whether any column holds the text, whatever its case; % and _ are ordinary characters."""
    return reduce(lambda a, b: a | b, (F.lower(F.col(c)).contains(text.lower()) for c in columns))


def any_flag(*flags: str) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(f), F.lit(False)) for f in flags))


def viewport(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point lies in the closed rectangle (x low, y low, x high, y high)."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def search(df: DataFrame, where: Column, order: list[Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the matching rows. `order` should end in a unique column, so that pages do not overlap."""
    return df.where(where).orderBy(*order).offset(offset).limit(limit)


def sort_key(name: str, allowed: Iterable[str], descending: bool = False) -> Column:
    """An order by a caller's column name, refused unless allowed; nulls last."""
    if name not in set(allowed):
        raise ValueError(f"cannot sort by {name}")
    return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()


def existing(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted columns that the frame has."""
    return [c for c in wanted if c in df.columns]


def split_id(column: Column, sep: str = "_", last: bool = True) -> tuple[Column, Column]:
    """A composite id's two halves, cut at its last separator (or first)."""
    if last:
        return F.regexp_extract(column, f"^(.*){sep}([^{sep}]*)$", 1), F.regexp_extract(column, f"^(.*){sep}([^{sep}]*)$", 2)
    return F.substring_index(column, sep, 1), F.regexp_extract(column, f"^[^{sep}]*{sep}(.*)$", 1)


#: Token kinds of the search language: name to (column, operator).
TOKEN = r"^(?P<name>\w+)(?P<op><=|>=|=|<|>|:|~)(?P<value>.*)$"


def parse_search(text: str, columns: Mapping[str, str]) -> Column:
    """A conjunction from tokens parted by spaces: `name>=3`, `name=x`, `name:1,2,3` (one of), `name:2..5` (closed range),
    `name~text` (holds the text), `name` (a true flag), `!name` (a false one). columns maps names to columns."""
    import re

    out = []
    for token in text.split():
        m = re.match(TOKEN, token)
        name = m["name"] if m else token.lstrip("!")
        if name not in columns:
            raise ValueError(f"unknown search term {name}")
        c = F.col(columns[name])
        if not m:
            out.append(~c if token.startswith("!") else c)
        elif m["op"] == "~":
            out.append(F.lower(c).contains(m["value"].lower()))
        elif m["op"] == ":" and ".." in m["value"]:
            low, high = m["value"].split("..", 1)
            out.append(c.between(low, high))
        elif m["op"] == ":":
            out.append(c.isin(*m["value"].split(",")))
        else:
            v = m["value"]
            out.append({"=": c == v, "<": c < v, ">": c > v, "<=": c <= v, ">=": c >= v}[m["op"]])
    return all_of(out)
