"""Ordered running values per key that stay correct and bounded under skew.

``running`` computes prefix sums/maxima/firsts/lasts per key, optionally
restarted at reset rows.  A key of ordinary size is one window group.  The rows of
hot keys (say a third of all rows) are dealt into even ranges of key and order, whatever
the shape of a key's history: each range is scanned on its own, one small summary row
per key and range is carried forward, and the carry is added back to the rows.  Results
do not depend on the cut.

Which keys are hot is decided from exact counts.  A hot key has more rows than the limit,
so there are at most rows / limit of them; they stay in a table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import cut_lineage

BROADCAST_KEYS = 500_000
NULL_PARTS = 4096
ROWS_PER_GROUP_CONF = "spark.tidewatch.maxRowsPerGroup"
DEFAULT_ROWS_PER_GROUP = 2_000_000
ROWS_PER_TASK = 100_000  # counted rows of ordinary keys that one task sorts
SEGMENT = "__segment"


@dataclass(frozen=True)
class Scan:
    """One running value.

    ``before`` leaves the current row out; ``earlier`` leaves out every row that
    is not strictly earlier on the first order column (which must be numeric).
    """

    name: str
    op: str  # sum | max | min | first | last
    value: Column
    before: bool = False
    earlier: bool = False

    def over(self, window) -> Column:
        match self.op:
            case "sum":
                return F.coalesce(F.sum(self.value).over(window), F.lit(0))
            case "max":
                return F.max(self.value).over(window)
            case "min":
                return F.min(self.value).over(window)
            case "first":
                return F.first(self.value, ignorenulls=True).over(window)
            case "last":
                return F.last(self.value, ignorenulls=True).over(window)
        raise ValueError(self.op)

    def combine(self, carried: Column, local: Column) -> Column:
        match self.op:
            case "sum":
                return F.coalesce(carried, F.lit(0)) + local
            case "max":
                return F.greatest(carried, local)
            case "min":
                return F.least(carried, local)
            case "first":
                return F.coalesce(carried, local)
        return F.coalesce(local, carried)


def rows_per_group(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_PER_GROUP_CONF, str(DEFAULT_ROWS_PER_GROUP)))


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys with more rows than one task should hold, with their counts, or None.

    Reads only the key columns and combines map-side.
    """
    return counted_keys(df, keys)[1]


def counted_keys(df: DataFrame, keys: Sequence[str]) -> tuple[int, DataFrame | None]:
    """The number of rows, and the keys of ``hot_keys``."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__hot_n"))
    is_hot = F.col("__hot_n") > rows_per_group(df)
    rows, hot = counts.agg(F.sum("__hot_n"), F.count_if(is_hot)).first()
    return rows or 0, cut_lineage(counts.filter(is_hot)) if hot else None


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Deal keys to as many tasks as their counted rows need, so that what one task sorts does
    not grow with the table.  AQE joins small shuffle partitions by their compressed size,
    which says little about wide rows; a number asked for here is kept."""
    if rows <= ROWS_PER_TASK:
        return df
    tasks = max(-(-rows // ROWS_PER_TASK), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def _sized(table: DataFrame) -> DataFrame:
    """Broadcast while the counted rows allow; beyond, Spark joins by shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_KEYS else table


def _match(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    renamed = hot.select(*[F.col(k).alias(f"__key_{k}") for k in keys],
                         *[c for c in hot.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return renamed, condition


def even_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int) -> DataFrame:
    """Add the number of the row's range, one task each, and write the rows down.

    Bounds are sampled over the whole of ``keys`` and ``order``, so ranges are even for
    bursts and outliers too, and number along the order within each key.
    """
    cut = df.repartitionByRange(ranges, *keys, *order)
    return cut_lineage(cut.withColumn(SEGMENT, F.spark_partition_id().cast("long")))


def by_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    body: Callable[[DataFrame, str | None], DataFrame],
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Run ``body`` over all rows, the rows of hot keys cut into ranges of ``order``.

    Rows equal in ``order`` stay together.  ``sized_by`` may name a cheaper table whose
    per-key row counts bound those of ``df`` (the raw scan the rows were aggregated from).
    """
    total, hot = counted_keys(df if sized_by is None else sized_by, keys)
    if hot is None:
        return body(dealt(df, keys, total), None)
    rows = hot.agg(F.sum("__hot_n")).first()[0]
    ranges = 2 * -(-rows // rows_per_group(df))
    table, condition = _match(df, hot, keys)
    marked = df.join(_sized(table), condition, "left")
    is_hot = F.col("__hot_n").isNotNull()
    ordinary = body(dealt(marked.filter(~is_hot).drop(*table.columns), keys, total - rows), None)
    cut = even_segments(marked.filter(is_hot).drop(*table.columns), keys, order, ranges)
    return ordinary.unionByName(body(cut, SEGMENT).drop(SEGMENT))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scans: Sequence[Scan],
    reset: str | None = None,
    segment: str | None = None,
) -> DataFrame:
    """Add one column per scan.  ``order`` must be a total order within a key.

    ``reset`` names a boolean column; its true rows start a new group.
    """
    group = [*keys, segment] if segment else list(keys)
    island = f"__island_{reset}"
    if reset and island not in df.columns:
        whole = Window.partitionBy(*group).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, 0)
        df = df.withColumn(island, F.sum(F.col(reset).cast("int")).over(whole))
    parts = [*group, island] if reset else group
    by_row = Window.partitionBy(*parts).orderBy(*order)
    by_time = Window.partitionBy(*parts).orderBy(order[0])
    to_here = by_row.rowsBetween(Window.unboundedPreceding, 0)

    def frame(scan: Scan):
        if scan.earlier:
            return by_time.rangeBetween(Window.unboundedPreceding, -1)
        return by_row.rowsBetween(Window.unboundedPreceding, -1 if scan.before else 0)

    local = df.withColumns({s.name: s.over(frame(s)) for s in scans})
    if not segment:
        return local

    closing = {f"__end_{s.name}": s.over(to_here) for s in scans}
    local = cut_lineage(local.withColumns(closing))
    last_row = F.struct(*order)
    touched = F.max(F.col(island)) > 0 if reset else F.lit(False)
    summary = local.groupBy(*keys, segment).agg(
        touched.alias("__touched"),
        *[F.max_by(F.col(f"__end_{s.name}"), last_row).alias(f"__end_{s.name}") for s in scans],
    )
    along = Window.partitionBy(*keys).orderBy(segment)
    summary = summary.withColumn("__run", F.sum(F.col("__touched").cast("int")).over(
        along.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*keys, "__run").orderBy(segment).rowsBetween(
        Window.unboundedPreceding, 0)
    carry = summary.withColumns({
        f"__incl_{s.name}": Scan(s.name, s.op, F.col(f"__end_{s.name}")).over(within)
        for s in scans
    }).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col(segment).alias("__k_segment"),
        *[F.lag(F.col(f"__incl_{s.name}")).over(along).alias(f"__in_{s.name}") for s in scans],
    )
    condition = F.col(segment) == F.col("__k_segment")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    # One row per key and segment, both already keyed by them; AQE decides how to join.
    joined = local.join(carry, condition, "left")
    untouched = F.col(island) == 0 if reset else F.lit(True)
    joined = joined.withColumns({
        s.name: F.when(untouched, s.combine(F.col(f"__in_{s.name}"), F.col(s.name)))
        .otherwise(F.col(s.name))
        for s in scans
    })
    helper = [c for c in joined.columns
              if c.startswith(("__k_", "__in_", "__end_"))]
    return joined.drop(*helper)


def _spread_nulls(df: DataFrame, keys: Sequence[str]) -> Column:
    """0 for rows that can match; rows with a NULL key are spread over other values."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "struct", "array"))]
    return F.when(known, 0).otherwise(F.pmod(F.xxhash64(*plain), F.lit(NULL_PARTS)) + 1)


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a fact table with a table that has at most one row per key.

    Rows with a NULL key match nothing and are spread over many tasks.  Rows of hot keys
    meet their partner rows, at most rows / limit of them, by broadcast while its counted
    size allows; the rest joins normally, so no task receives a whole hot key.
    """
    on = [*keys, "__spread"]
    hot = hot_keys(left.dropna(subset=list(keys)), keys)
    left = left.withColumn("__spread", _spread_nulls(left, keys).cast("long"))
    right = right.withColumn("__spread", F.lit(0).cast("long"))
    if hot is None:
        return left.join(right, on, how).drop("__spread")
    hot = _sized(hot.select(*keys))
    warm_right = _sized(right.join(hot, list(keys), "left_semi"))
    warm = left.join(hot, list(keys), "left_semi").join(warm_right, on, how)
    cold = left.join(hot, list(keys), "left_anti").join(right, on, how)
    return cold.unionByName(warm).drop("__spread")


def micros(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast(T.TimestampType()))
