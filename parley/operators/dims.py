"""Small dimension tables and the size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StructType

DEFAULT_MAX_BROADCAST_ROWS = 100_000
DEFAULT_MAX_BROADCAST_BYTES = 64 << 20


def fixed_row_bytes(schema: StructType) -> int | None:
    """Bytes of a row in memory (a header and one word a column), or None if a
    column has no fixed size."""
    if not all(isinstance(f.dataType, (NumericType, BooleanType)) for f in schema.fields):
        return None
    return 16 + 8 * len(schema.fields)


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when it has at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows; above the bound the
    DataFrame is returned unchanged and the planner picks a shuffle join.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Join a large table with a derived per-key table (one row per episode
    or segment, e.g. a length or a peak).

    The small side is written once to the shared checkpoint folder (so the
    aggregate over the large table is not computed twice), its size is
    checked, and within ``max_bytes`` it is broadcast: the large side is then
    joined where it lies, with no shuffle.  Above the bound, or when a column
    such as a string has no fixed size, the join is left to the planner (a
    shuffle with AQE skew handling, unless the table is tiny).
    """
    from parley.session import cut_lineage
    s = cut_lineage(small, "keyed")
    width = fixed_row_bytes(s.schema)
    if width is not None:
        max_rows = max_bytes // width
        if s.limit(max_rows + 1).count() <= max_rows:
            s = F.broadcast(s)
    return big.join(s, on, how)
