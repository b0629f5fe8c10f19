"""Named queries: a function of the tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans.fixtures import CTE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_NEEDS = {"fx_regions": ["fx_annotations"], "fx_mask": ["fx_discs"], "fx_prob": ["fx_discs", "fx_mask"]}


def sql_with(names: str, body: str) -> str:
    """``body`` after the common table expressions that it names and those they need."""
    out: list[str] = []
    for n in names.split():
        for x in [*_NEEDS.get(n, []), n]:
            if x not in out:
                out.append(x)
    head = ", ".join(CTE[x] for x in out)
    recursive = "RECURSIVE " if body.startswith("RECURSIVE") else ""
    body = body.removeprefix("RECURSIVE").strip()
    if not head:
        return f"WITH {recursive}{body[1:].strip()}" if body.startswith(",") else body
    return f"WITH {recursive}{head} {body}"


def query(name: str, needs: str = "", sql: str | None = None) -> Callable:
    """Register ``f(tables)`` under ``name``. ``sql`` may begin with a comma, to add expressions of its own."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql_with(needs, sql.strip())
        return f

    return add


def met(a: str, abox: tuple[str, ...], b: str, bbox: tuple[str, ...]) -> tuple[str, str]:
    """SQL of rows of two tables that may meet: (common table expressions, join of a and b). Each row stands in the cells of its box (x0, y0, x1, y1), a pair in the cell of its intersection's lower corner."""
    cells = lambda t, box: f"(SELECT *, unnest(range(({box[0]}) // 512, ({box[2]}) // 512 + 1)) AS gx FROM (SELECT *, unnest(range(({box[1]}) // 512, ({box[3]}) // 512 + 1)) AS gy FROM {t}))"
    on = " AND ".join(f"a.g{c} = greatest({named('a', abox[k])}, {named('b', bbox[k])}) // 512" for k, c in enumerate("xy"))
    return f", ga AS {cells(a, abox)}, gb AS {cells(b, bbox)} ", f"ga a JOIN gb b ON a.slide_id = b.slide_id AND a.gx = b.gx AND a.gy = b.gy AND {on}"


def named(side: str, expression: str) -> str:
    """The expression with its column, which comes first, taken from one side of a join."""
    return f"({side}.{expression})"
