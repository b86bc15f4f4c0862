"""Ordered scans per group (running sums, previous non-null value, group
totals) that stay parallel when one group is huge.

A plain ``Window.partitionBy(key)`` puts a whole group into one task.  Here
rows are cut into blocks of ``block_rows`` consecutive positions.  A window
over (key, block) gives the local scans; block aggregates are computed from
the input with map-side partial aggregation; the block aggregates
(``rows / block_rows`` values per key) are scanned per key, and the carry
is joined back on (key, block), reusing the partitioning of the window
output.  The full rows are shuffled once, so a key holding a third of all
rows is spread over many tasks.  ``order`` should be a dense 0-based
integer index within the key (other integer orders are correct but may
give uneven blocks).  Rows without a key or order have no place in a scan:
they stay, with nulls in the added columns, and count in no other row.

A scan whose increments depend on the previous value (a crossfade that depends
on the previous speaker) needs no second scan: :func:`linked_scan` closes the
rows of a block but for its first value, whose increment is settled in the scan
of the block summaries (the boundary correction).
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DEFAULT_BLOCK_ROWS = 4096


def block_column(block_rows: int) -> str:
    return f"_scan_block_{block_rows}"


def _keys(part) -> list[str]:
    return [part] if isinstance(part, str) else list(part)


def _col(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def blocked_scan(df: DataFrame, part, order: str, *,
                 sums: dict[str, tuple[Column | str, bool]] | None = None,
                 prev_non_null: dict[str, Column | str] | None = None,
                 totals: dict[str, Column | str] | None = None,
                 block_rows: int = DEFAULT_BLOCK_ROWS, keep_block: bool = False) -> DataFrame:
    """Add scan columns to ``df``.

    * ``sums[out] = (value, inclusive)``: sum of ``value`` over earlier rows
      of the key (plus the current row when ``inclusive``); 0 when empty.
    * ``prev_non_null[out] = value``: last non-null ``value`` on an earlier row.
    * ``totals[out] = value``: sum of ``value`` over the whole key.

    With ``keep_block`` the block column stays in the output; a following
    scan with the same block size reuses it, and with it the (key, block)
    partitioning, so it needs no second shuffle of the rows.
    """
    sums, prev_non_null, totals = sums or {}, prev_non_null or {}, totals or {}
    keys = _keys(part)
    _B = block_column(block_rows)
    d = df if _B in df.columns else df.withColumn(_B, F.floor(F.col(order) / F.lit(block_rows)))
    vals: dict[str, Column] = {}
    for i, (out, (v, _)) in enumerate(sums.items()):
        vals[f"_sv{i}"] = _col(v)
    for i, (out, v) in enumerate(prev_non_null.items()):
        vals[f"_lv{i}"] = _col(v)
    for i, (out, v) in enumerate(totals.items()):
        vals[f"_tv{i}"] = _col(v)
    for name, c in vals.items():
        d = d.withColumn(name, c)

    w_incl = Window.partitionBy(*keys, _B).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    w_excl = Window.partitionBy(*keys, _B).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local, block_aggs = [], []
    for i, (out, (_, inclusive)) in enumerate(sums.items()):
        v = f"_sv{i}"
        zero = F.lit(0).cast(d.schema[v].dataType)
        local.append(F.coalesce(F.sum(v).over(w_incl if inclusive else w_excl), zero).alias(f"_sl{i}"))
        block_aggs.append(F.coalesce(F.sum(v), zero).alias(f"_sb{i}"))
    for i in range(len(prev_non_null)):
        v = f"_lv{i}"
        local.append(F.last(v, ignorenulls=True).over(w_excl).alias(f"_ll{i}"))
        # value of the last row that has one; max_by ignores null orderings
        block_aggs.append(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(f"_lb{i}"))
    for i in range(len(totals)):
        v = f"_tv{i}"
        block_aggs.append(F.coalesce(F.sum(v), F.lit(0).cast(d.schema[v].dataType)).alias(f"_tb{i}"))
    # The full rows are shuffled once, on (key, block), for the local window.
    win = d.select("*", *local)
    # Block aggregates come straight from the input with map-side partial
    # aggregation, so their shuffle carries about one row per block and task.
    blocks = d.where(F.col(_B).isNotNull()).groupBy(*keys, _B).agg(*block_aggs)
    w_prev = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    w_key = Window.partitionBy(*keys)
    carry = [*keys, _B]
    for i in range(len(sums)):
        carry.append(F.coalesce(F.sum(f"_sb{i}").over(w_prev),
                                F.lit(0).cast(blocks.schema[f"_sb{i}"].dataType)).alias(f"_sc{i}"))
    for i in range(len(prev_non_null)):
        carry.append(F.last(f"_lb{i}", ignorenulls=True).over(w_prev).alias(f"_lc{i}"))
    for i in range(len(totals)):
        carry.append(F.sum(f"_tb{i}").over(w_key).alias(f"_tc{i}"))
    carry_df = blocks.select(*carry)

    j = win.join(carry_df, [*keys, _B], "left")
    placed = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, _B]])
    outs = []
    for i, out in enumerate(sums):
        outs.append((F.col(f"_sl{i}") + F.col(f"_sc{i}")).alias(out))
    for i, out in enumerate(prev_non_null):
        outs.append(F.when(placed, F.coalesce(F.col(f"_ll{i}"), F.col(f"_lc{i}"))).alias(out))
    for i, out in enumerate(totals):
        outs.append(F.col(f"_tc{i}").alias(out))
    keep = [c for c in df.columns if c != _B] + ([_B] if keep_block or _B in df.columns else [])
    return j.select(*[F.col(f"`{c}`") for c in keep], *outs)


def running_sum(df: DataFrame, part, order: str, value: Column | str, out: str,
                inclusive: bool = True, block_rows: int = DEFAULT_BLOCK_ROWS,
                keep_block: bool = False) -> DataFrame:
    """Add ``out`` = sum of ``value`` over rows of the same key with a smaller
    ``order`` (plus the current row when ``inclusive``)."""
    return blocked_scan(df, part, order, sums={out: (value, inclusive)}, block_rows=block_rows,
                        keep_block=keep_block)


def previous_non_null(df: DataFrame, part, order: str, value: Column | str, out: str,
                      block_rows: int = DEFAULT_BLOCK_ROWS, keep_block: bool = False) -> DataFrame:
    """Add ``out`` = the last non-null ``value`` on an earlier row of the key."""
    return blocked_scan(df, part, order, prev_non_null={out: value}, block_rows=block_rows,
                        keep_block=keep_block)


def drop_block(df: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    return df.drop(block_column(block_rows))


# ------------------------------------------------------------ composite scans
NO_PLACE = -(1 << 40)  # blocks below hold the rows without a place
Stage = Callable[["Spans"], dict[str, Column]]


@dataclass
class Spans:
    """Windows over the ordered rows of a group."""
    before: WindowSpec
    upto: WindowSpec
    ordered: WindowSpec
    whole: WindowSpec


def _spans(keys: list[str], order: str) -> Spans:
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy(order)
    return Spans(ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(Window.unboundedPreceding, 0), ordered, whole)


def placed(block_rows: int = DEFAULT_BLOCK_ROWS) -> Column:
    """Whether a row has a key and an order, in the rows of a composite scan."""
    return F.coalesce(F.col(block_column(block_rows)) > NO_PLACE, F.lit(False))


def in_blocks(df: DataFrame, part, order: str, block_rows: int = DEFAULT_BLOCK_ROWS, uses: tuple[str, ...] = ()) -> DataFrame:
    """Adds the block column.  Rows without a key or order are dealt to blocks
    of their own by a hash of these and ``uses``, so that many of them do not
    meet in one task."""
    place = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*_keys(part), order]])
    apart = F.lit(NO_PLACE) - F.pmod(F.xxhash64(*_keys(part), order, *uses), F.lit(1024))
    return df.withColumn(block_column(block_rows), F.when(place, F.floor(F.col(order) / F.lit(block_rows))).otherwise(apart))


def local_rows(df: DataFrame, part, order: str, local: list[Stage], block_rows: int = DEFAULT_BLOCK_ROWS, uses: tuple[str, ...] = ()) -> DataFrame:
    """The rows in blocks with the columns of the ``local`` stages, over the
    rows of a block; a stage may use the columns of the ones before."""
    d = in_blocks(df, part, order, block_rows, uses)
    spans = _spans([*_keys(part), block_column(block_rows)], order)
    for stage in local:
        d = d.withColumns(stage(spans))
    return d


def block_carries(rows: DataFrame, part, summary: dict[str, Column], carry: list[Stage], block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """A row for each block: its ``summary`` (aggregates over its rows, which
    lie together already) and the columns of the ``carry`` stages, over the
    blocks of a key in order."""
    block = block_column(block_rows)
    d = rows.groupBy(*_keys(part), block).agg(*[c.alias(n) for n, c in summary.items()])
    spans = _spans(_keys(part), block)
    for stage in carry:
        d = d.withColumns(stage(spans))
    return d


def composite_scan(df: DataFrame, part, order: str, local: list[Stage], summary: dict[str, Column], carry: list[Stage], give: list[str],
                   block_rows: int = DEFAULT_BLOCK_ROWS, uses: tuple[str, ...] = ()) -> DataFrame:
    """The rows with the local columns and the columns ``give`` of their block.

    Two things are shuffled: the rows, on (key, block), and the block
    summaries, on the key and back.  The rows of the two branches (scan and
    summary) are the same shuffle if they use the same columns; columns that
    only travel along are left out of the summary's."""
    block = block_column(block_rows)
    rows = local_rows(df, part, order, local, block_rows, uses)
    # The join goes by copies of the grouping columns: a filter for nulls that Spark derives from a
    # join column would move below the shuffle, which the two branches then could not share.
    copies = {f"_same_{c}": F.max(c) for c in [*_keys(part), block]}
    carries = block_carries(rows, part, summary | copies, carry, block_rows)
    carries = carries.select(*[F.col(f"_same_{c}").alias(c) for c in [*_keys(part), block]], *give)
    return rows.join(carries, [*_keys(part), block], "left")


class Linked:
    """Running sums whose steps depend on the last value of an earlier row.

    ``value`` is null on rows that leave the last value as it is.  ``steps``:
    for each sum a function of that last value (null if there is none) and of a
    function that gives the row's columns named in ``uses``; on rows without a
    value the step must not depend on the last value."""

    def __init__(self, part, order: str, value: Column, steps: dict[str, Callable[[Column, Callable[[str], Column]], Column]], uses: list[str],
                 block_rows: int = DEFAULT_BLOCK_ROWS):
        self.part, self.order, self.value, self.steps, self.uses, self.block_rows = part, order, value, steps, uses, block_rows
        self.n = range(len(steps))

    def _local(self) -> list[Stage]:
        place = placed(self.block_rows)
        zero = F.lit(0).cast("long")
        known = F.col("_v").isNull() | F.col("_lp").isNotNull()   # all but the first value of a block
        step = [F.when(place & known, s(F.col("_lp"), F.col)).otherwise(zero) for s in self.steps.values()]
        return [lambda w: {"_v": F.when(place, self.value)},
                lambda w: {"_lp": F.last("_v", ignorenulls=True).over(w.before)},
                lambda w: {f"_li{i}": F.coalesce(step[i], zero) for i in self.n},
                lambda w: {f"_ls{i}": F.sum(f"_li{i}").over(w.upto) for i in self.n}]

    def _summary(self) -> dict[str, Column]:
        at = F.when(F.col("_v").isNotNull(), F.col(self.order))
        return {"_last": F.max_by("_v", at), "_first": F.min_by(F.struct(*self.uses), at)} | {f"_bs{i}": F.sum(f"_li{i}") for i in self.n}

    def _carry(self) -> list[Stage]:
        zero = F.lit(0).cast("long")
        first = [F.when(F.col("_first").isNotNull(), s(F.col("_cp"), lambda c: F.col("_first")[c])) for s in self.steps.values()]
        return [lambda w: {"_cp": F.last("_last", ignorenulls=True).over(w.before)},
                lambda w: {f"_fi{i}": F.coalesce(first[i], zero) for i in self.n},
                lambda w: {f"_cs{i}": F.coalesce(F.sum(F.col(f"_bs{i}") + F.col(f"_fi{i}")).over(w.before), zero) for i in self.n}]

    def scan(self, df: DataFrame, prev: str) -> DataFrame:
        """``df`` with ``prev``, the last value of an earlier row, and the running
        sums, the row's own step included (null on rows without a place)."""
        give = ["_cp", *[f"_fi{i}" for i in self.n], *[f"_cs{i}" for i in self.n]]
        rows = composite_scan(df, self.part, self.order, self._local(), self._summary(), self._carry(), give, self.block_rows, tuple(self.uses))
        place = placed(self.block_rows)
        behind = F.col("_v").isNotNull() | F.col("_lp").isNotNull()
        sums = [F.when(place, F.col(f"_ls{i}") + F.col(f"_cs{i}") + F.when(behind, F.col(f"_fi{i}")).otherwise(0)).alias(out) for i, out in enumerate(self.steps)]
        return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.when(place, F.coalesce("_lp", "_cp")).alias(prev), *sums)

    def totals(self, df: DataFrame, **more: Column) -> DataFrame:
        """A row for each key: the sums over all its rows, and the sums of the
        aggregates ``more`` over its blocks.  The carries are not taken back to
        the rows, so the rows are shuffled once and the summaries once."""
        rows = local_rows(df, self.part, self.order, self._local()[:3], self.block_rows, tuple(self.uses))
        blocks = block_carries(rows, self.part, self._summary() | {f"_more_{n}": c for n, c in more.items()}, self._carry()[:2], self.block_rows)
        return blocks.groupBy(*_keys(self.part)).agg(*[F.sum(F.col(f"_bs{i}") + F.col(f"_fi{i}")).alias(out) for i, out in enumerate(self.steps)],
                                                     *[F.sum(f"_more_{n}").alias(n) for n in more])
