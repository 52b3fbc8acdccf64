"""Corpus counts shared by the text operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.runtime import materialise


def most_frequent(counts: DataFrame, bounds: dict[str, int], key: str = "key", *, written: bool = False) -> DataFrame:
    """The rows (kind, key, n) of the greatest n, for each kind up to its bound; ties go to the lower key.

    Each kind is cut by a limit, of which every task keeps only its own share, so no task sees all rows.
    The counts are read once for each kind and written before, unless they are ``written`` already.
    """
    c = counts if written else materialise(counts, "counts")
    parts = [c.where(F.col("kind") == kind).orderBy(F.desc("n"), key).limit(bound) for kind, bound in bounds.items()]
    return reduce(DataFrame.unionByName, parts)
