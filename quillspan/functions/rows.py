"""Columns that are computed once, and rows that are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once: within a lambda an expression is computed for every element, a lambda's argument is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settle(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with further columns. They pass through a generator, which keeps Catalyst from copying their expressions into filters and into every column that reads them."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt out to four tasks for each core, if there are fewer: a table of few bytes is read by few tasks, however much work stands behind each row. To be called on narrow rows."""
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)
