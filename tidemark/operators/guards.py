"""Guards of a flow: measures taken by Spark while a stage is written, and checked before the next reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from tidemark.session import cut


def guarded(df: DataFrame, measures: dict[str, Column], check: Callable[[dict], None]) -> DataFrame:
    """``df``, materialised; ``check`` gets the measures (aggregates over its rows), which the same pass took, and raises to stop the flow.

    The measures are read from the query's own observed metrics. Spark's ``Observation`` class would leave in the session an
    object that cannot be serialized, on which models of its ML library fail later.
    """
    watched = df.observe("guard", *[c.alias(n) for n, c in measures.items()])
    out = cut(watched)
    row = watched._jdf.queryExecution().observedMetrics().apply("guard")
    check({n: row.get(i) for i, n in enumerate(measures)})
    return out
