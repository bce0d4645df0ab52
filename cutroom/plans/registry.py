"""A small register that keeps a query beside its SQL."""

from __future__ import annotations

from collections.abc import Callable


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        """Register a function (spark, sf_dir) -> DataFrame under its own name."""

        def add(function: Callable) -> Callable:
            self.queries[function.__name__] = function
            if sql:
                self.sql[function.__name__] = sql
            return function

        return add


def greedy_groups_sql(most: int) -> str:
    """A recursion g(event, groups) over o(event, pos, id, near): each id in order joins the first group with room that lies within its near ids."""
    fits = f"list_filter(range(1, len(t.groups) + 1), lambda k: len(t.groups[k]) < {most} AND len(list_filter(t.groups[k], lambda m: NOT list_contains(o.near, m))) = 0)"
    joined = "list_transform(groups, lambda g, k: CASE WHEN k = hit THEN list_append(g, id) ELSE g END)"
    return f"""t AS (SELECT event, CAST(1 AS BIGINT) AS pos, CAST([] AS BIGINT[][]) AS groups FROM o GROUP BY event UNION ALL
 SELECT event, pos + 1, CASE WHEN hit IS NULL THEN list_append(groups, [id]) ELSE {joined} END FROM (SELECT t.event, t.pos, t.groups, o.id, {fits}[1] AS hit FROM t JOIN o ON o.event = t.event AND o.pos = t.pos)),
g AS (SELECT event, arg_max(groups, pos) AS groups FROM t GROUP BY event)"""
