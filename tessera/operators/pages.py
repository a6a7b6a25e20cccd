"""Pages with their true totals.

A page is a top-k, and its totals are one aggregate of the key columns.  They are not observed
in the run of the page: where the input is sorted already that run ends before the last row, and
where it has to sort it reads rows twice, so that an observation is wrong either way.  Pages
are named by the key values of their last row, so that a later page costs no more than the
first and stays right while rows are added.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Page:
    """``rows`` of a page, the ``total`` of all rows and how many stand ``before`` the page.

    ``next`` and ``previous`` name the neighbouring pages, None where there is none.
    """

    rows: list[Row] = field(default_factory=list)
    total: int = 0
    before: int = 0
    next: str | int | None = None
    previous: str | int | None = None

    def frame(self, spark, schema) -> DataFrame:
        """The page's rows with total, has_previous and has_next; as many rows as the page has."""
        df = spark.createDataFrame(self.rows, schema)
        return df.withColumns({"total": F.lit(self.total).cast("long"), "has_previous": F.lit(self.previous is not None), "has_next": F.lit(self.next is not None)})


def numbered_page(df: DataFrame, order: list[str], number: int = 1, size: int = 50) -> Page:
    """Page ``number`` (from 1) by a total order; a page beyond the last is empty.  Pages are named by number."""
    if size < 1:
        raise ValueError("a page has one row at least")
    number, total = max(number, 1), df.count()
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size).collect()
    return Page(rows, total, min((number - 1) * size, total), number + 1 if number * size < total else None, number - 1 if number > 1 and total else None)


def _token(way: str, row: Row, keys: list[str]) -> str:
    return base64.urlsafe_b64encode(json.dumps([way, *(row[k] for k in keys)]).encode()).decode()


def _beyond(keys: list[str], values: list, below: bool) -> Column:
    """Whether a row's keys come after ``values`` (or before, if ``below``), compared from the first on."""
    out, same = F.lit(False), F.lit(True)
    for k, v in zip(keys, values):
        c, v = F.col(k), F.lit(v)
        out, same = out | (same & ((c < v) if below else (c > v))), same & (c == v)
    return out


def keyset_page(df: DataFrame, keys: list[str], size: int = 50, token: str | None = None) -> Page:
    """A page of ``df`` by ``keys``, which are unique together, not null, and texts or numbers.

    ``token`` is the ``next`` or ``previous`` of another page; None gives the first page.
    """
    if size < 1:
        raise ValueError("a page has one row at least")
    way, values = "after", None
    if token is not None:
        try:
            way, *values = json.loads(base64.urlsafe_b64decode(token))
        except ValueError as e:
            raise ValueError("no token of a page") from e
        if way not in ("after", "before") or len(values) != len(keys):
            raise ValueError("no token of such a page")
    back = way == "before"
    mine = _beyond(keys, values, back) if values is not None else F.lit(True)
    total, left = df.agg(F.count(F.lit(1)), F.count_if(mine)).first()
    rows = df.where(mine).orderBy(*[F.desc(k) if back else F.asc(k) for k in keys]).limit(size + 1).collect()
    more, rows = len(rows) > size, rows[:size]
    if back:
        rows.reverse()
        before, after = left - len(rows), total - left
    else:
        before, after = total - left, left - len(rows)
    if not rows:
        return Page([], total, before)
    return Page(rows, total, before, _token("after", rows[-1], keys) if (after if back else more) else None, _token("before", rows[0], keys) if (more if back else before) else None)
