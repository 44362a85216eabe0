"""Compute columns exactly once."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns) -> DataFrame:
    """Add (or replace) columns so that later filters use their values.

    A filter on a plain projected column is pushed below the projection by repeating the column's
    expression; with long chains of JSON expressions the repeats multiply. A one-row generator
    keeps the filter above and still runs inside generated code.
    """
    keep = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
