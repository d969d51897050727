"""Registry of queries and the SQL each must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.plans.oracle_views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# Added before rounding: an exact half is then rounded up by every engine,
# whichever way its sum was ordered.
NUDGE = 1e-9
# Costs of a few tokens are far below a millionth; they are rounded per million.
FINE = ("cost_per_token_usd", "cost_per_1k_tokens_usd", "min_cost")
MILLION = 1_000_000.0


def nudged(sql: str) -> str:
    """Add the nudge inside every two-argument round call, and round fine columns per million."""
    out, i = [], 0
    for start in (m.end() for m in re.finditer(r"\bround\(", sql)):
        depth, comma, end = 1, None, start
        while depth:
            c = sql[end]
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 1:
                comma = end
            end += 1
        fine = re.match(rf"\s+AS\s+({'|'.join(FINE)})\b", sql[end:]) is not None
        out.append((start, "("))
        out.append((comma, f") * {MILLION} + {NUDGE}" if fine else f") + {NUDGE}"))
        if fine:
            out.append((end, f" / {MILLION}"))
    text = []
    for start, comma in sorted(out):
        text.append(sql[i:start] + comma)
        i = start
    return "".join(text) + sql[i:]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where SQL can say the same."""

    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(nudged(oracle))
        return run

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed number of places, so summation order cannot show."""

    def places(c: str) -> Column:
        if c in FINE:
            return F.round(F.col(c) * MILLION + NUDGE, digits) / MILLION
        return F.round(F.col(c) + NUDGE, digits)

    return df.select(*[places(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
