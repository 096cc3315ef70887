"""Where a column comes from, kept in the column's own metadata, so that a test against its own sources can be refused.

Metadata stay with a column through projections, filters and joins. An aggregate or an expression makes
a new column; whoever makes one says what it is made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "derived_from"


class CircularTest(ValueError):
    """A state would be tested against what it is derived from."""


def roots(df: DataFrame, name: str) -> set[str]:
    """The columns that ``name`` was derived from in the first place; itself if nothing is told."""
    return set(df.schema[name].metadata.get(KEY, [name]))


def derived(df: DataFrame, name: str, column: Column, sources: list[str]) -> DataFrame:
    """``df`` with a column made of ``sources`` (columns of ``df``), whose roots are theirs."""
    found = sorted(set().union(*[roots(df, s) for s in sources])) if sources else [name]
    return df.withColumn(name, column.alias(name, metadata={KEY: found}))


def marked(df: DataFrame, told: dict[str, list[str]]) -> DataFrame:
    """``df`` with the roots of columns stated by name, for tables whose columns were made elsewhere."""
    return df.select(*[F.col(c).alias(c, metadata={KEY: sorted(told[c])}) if c in told else F.col(c) for c in df.columns])


def require_independent(df: DataFrame, states: list[str], metrics: list[str]) -> None:
    """An error that names every state and metric with a common root."""
    shared = [(s, m, roots(df, s) & roots(df, m)) for s in states for m in metrics]
    wrong = [f"{s} and {m} both come from {', '.join(sorted(r))}" for s, m, r in shared if r]
    if wrong:
        raise CircularTest("; ".join(wrong))
