"""Registration of queries with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with its SQL if there is any."""

    def add(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_replaced(expression: str, pairs) -> str:
    for a, b in pairs:
        expression = f"replace({expression}, {quoted(a)}, {quoted(b)})"
    return expression


def sql_without(expression: str, characters: str) -> str:
    return f"translate({expression}, {quoted(characters)}, '')"


def in_steps(source: str, steps: list[str], keep: str, last: str = "x") -> str:
    """SQL that applies expressions of x one after another, each in its own table."""
    parts = [f"s0 AS ({source})"] + [f"s{i} AS (SELECT {keep}, {e} AS x FROM s{i - 1})" for i, e in enumerate(steps, 1)]
    return f"WITH {', '.join(parts)} SELECT {keep}, x AS {last} FROM s{len(steps)}"
