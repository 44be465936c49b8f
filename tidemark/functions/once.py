"""Computing costly columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, *columns: Column, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with further ``columns``, each evaluated once per row.

    A filter on a plain computed column is pushed below the projection with the expression
    copied into it, so a JSON document would be parsed again for every condition on its
    fields. Predicates do not move below a generator that makes their columns; hence the
    explode of a single struct.
    """
    kept = df.columns if keep is None else keep
    return df.select(*kept, F.explode(F.array(F.struct(*columns))).alias("_once")).select(*kept, "_once.*")
