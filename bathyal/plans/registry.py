"""Where queries and their SQL oracles are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The oracle's form of the views in bathyal.sources.views.
VIEW_SQL = {
    "pts": """SELECT event_id AS point_id, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS x, user_id::DOUBLE AS y, value AS z,
        list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)::INT AS classification,
        regexp_extract(props, '"k": *([0-9]+)', 1)::INT AS intensity FROM events""",
    "soundings": """SELECT o_orderkey AS point_id, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS x,
        o_custkey::DOUBLE AS y, -o_totalprice / 1000 AS z, left(o_orderpriority, 1)::INT AS classification FROM orders""",
    "vec3": """SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
        label AS classification FROM embeddings""",
    "structures": "SELECT s_suppkey AS structure_id, s_name AS name, s_acctbal / 100 AS x, s_nationkey::DOUBLE AS y, 8.0::DOUBLE AS diameter FROM supplier",
    "profile": "SELECT y::BIGINT AS route_id, point_id, x AS ch, z FROM pts",
    "route_vertex": """SELECT route_id, seq, x, y, sum(step) OVER (PARTITION BY route_id ORDER BY seq) AS cum FROM (
        SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM (
        SELECT y::BIGINT AS route_id, row_number() OVER (PARTITION BY y ORDER BY x, point_id) AS seq, x, z AS y FROM pts)
        WINDOW w AS (PARTITION BY route_id ORDER BY seq))""",
    "epoch_cells": """SELECT (point_id % 2)::INT AS epoch, floor(x / 30)::BIGINT AS col, floor(y / 50)::BIGINT AS row, avg(z) AS z
        FROM soundings GROUP BY ALL""",
    "seabed": "SELECT floor(x / 30)::BIGINT AS col, floor(y / 50)::BIGINT AS row, avg(z) AS z FROM soundings GROUP BY ALL",
}
NEEDS = {"profile": ["pts"], "route_vertex": ["pts"], "epoch_cells": ["soundings"], "seabed": ["soundings"]}


def with_views(views: str, sql: str) -> str:
    """sql, which begins with SELECT or with `name AS (...)` clauses, after the named views."""
    names: list[str] = []
    for v in views.split():
        for n in [*NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    head = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    sql = sql.strip()
    return f"WITH RECURSIVE {head}{' ' if sql.upper().startswith('SELECT') else ', '}{sql}" if head else sql


def query(views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql is its oracle, over the named views."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(views, sql)
        return f

    return put
