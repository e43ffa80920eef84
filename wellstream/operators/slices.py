"""Running aggregates that do not depend on how large one key is.

A window over a whole stream puts that stream into one task. Here every key is cut into consecutive
slices of its order. Each slice is summarised by a map-side-combined aggregate, the few summaries of a
key are accumulated, and each slice receives what has accumulated in the slices before it. The window
over rows then spans only one slice of one key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"

# Arrival numbers are unique, so a slice of this many numbers holds at most this many rows of any key.
# Sparse numbering (one row per thousand numbers, say) wants a slice wider by that factor.
ARRIVALS_PER_SLICE = 1 << 20


def slice_start(position: Column, width: int) -> Column:
    """First position of the slice that an integer position falls into; monotone and exact."""
    if width <= 0:
        raise ValueError("slice width must be positive")
    return position - F.pmod(position, F.lit(width))


def carried(
    rows: DataFrame,
    keys: Sequence[str],
    summaries: Mapping[str, tuple[Column, str]],
) -> DataFrame:
    """One row per key and slice with the running summary of all *earlier* slices of that key.

    ``summaries`` maps an output column to (aggregate within a slice, SQL function that accumulates it).
    The value is null in the first slice of a key.
    """
    per_slice = rows.groupBy(*keys, SLICE).agg(*[agg.alias(name) for name, (agg, _) in summaries.items()])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(
        *keys, SLICE, *[F.call_function(fn, F.col(name)).over(before).alias(name) for name, (_, fn) in summaries.items()]
    )


def with_carried(rows: DataFrame, keys: Sequence[str], summaries: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """``rows`` plus the columns of :func:`carried`. The join shares its exchange with slice windows."""
    return rows.join(carried(rows, keys, summaries), [*keys, SLICE])


def slice_window(keys: Sequence[str], *order: str) -> Window:
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


# Borders that are sought for a large key. A key of more than BORDERS times the wanted rows gets larger slices.
BORDERS = 1 << 10


def balanced(rows: DataFrame, keys: Sequence[str], position: str, tie: str, rows_per_slice: int) -> DataFrame:
    """``rows`` with slices of about so many rows of a key, in the order of (position, tie), however rows are spread in it.

    Keys with fewer rows are one slice. The borders of larger ones are quantiles of position, which combine on the map side;
    rows of one position that fill a whole slice are cut by ``tie``, a number that is unique in the key. A large key has at
    least ``rows_per_slice`` rows and a border for about as many, so what is broadcast is one number for so many input rows.
    """
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows_per_slice)
    quantiles = F.percentile_approx(position, [i / BORDERS for i in range(1, BORDERS)], 10 * BORDERS)
    found = rows.select(*keys, position).join(F.broadcast(large), [*keys]).groupBy(*keys).agg(F.first("_rows").alias("_rows"), quantiles.alias("_all"))
    # every n-th of the quantiles, so that a slice has the wanted rows
    step = F.greatest(F.lit(1), F.floor(F.lit(BORDERS * rows_per_slice) / F.col("_rows"))).cast("int")
    borders = found.select(*keys, F.filter("_all", lambda _, i: (i + 1) % step == 0).alias("_borders"))
    at, found = F.col(position), rows.join(F.broadcast(borders), [*keys], "left")

    def below(reached: Column, stride: Column) -> Column:
        passed = F.coalesce(F.get("_borders", reached + stride - 1) <= at, F.lit(False))
        return F.when(passed, reached + stride).otherwise(reached)

    strides = F.lit([BORDERS >> i for i in range(1, BORDERS.bit_length())])
    count = F.when(F.col("_borders").isNull(), F.lit(0)).otherwise(F.aggregate(strides, F.lit(0), below))
    numbered = found.withColumn("_at", count)
    crowded = F.coalesce((F.get("_borders", F.col("_at") - 1) == at) & (F.get("_borders", F.col("_at") - 2) == at), F.lit(False))
    part = F.when(crowded, slice_start(F.col(tie), rows_per_slice)).otherwise(F.lit(-1).cast("bigint"))
    # crowded rows come before the others behind their border
    return numbered.withColumn(SLICE, F.struct(F.col("_at").alias("at"), (~crowded).alias("rest"), part.alias("part"))).drop("_borders", "_at")


BINS = 1 << 12


def at_shares(rows: DataFrame, position: str, shares: Sequence[float]) -> list[int]:
    """The value of an integer position at each share of its order: exact, of every row, nulls left out.

    An exact percentile holds all different values in one task. Here a histogram of BINS bins combines on the map side and
    the bins that hold the wanted ranks are cut again, until a bin is one value: a few passes over one column.
    """
    at = F.col(position)
    ends = rows.agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count(at).alias("n")).first()
    if ends.n == 0:
        raise ValueError(f"no row has a {position}")
    # (first value of the range, its number of values, rank within it) of each share
    found = [(ends.low, ends.high - ends.low + 1, int((ends.n - 1) * share)) for share in shares]
    while any(size > 1 for _, size, _ in found):
        counted = {}
        for low, size in {(low, size) for low, size, _ in found if size > 1}:
            width = -(-size // BINS)
            inside = rows.where(at.between(F.lit(low), F.lit(low + size - 1)))
            bins = inside.groupBy(F.expr(f"(`{position}` - {low}L) div {width}L").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            counted[low, size] = width, sorted((r["bin"], r["n"]) for r in bins.collect())
        found = [_bin_of_rank(low, rank, *counted[low, size]) if size > 1 else (low, size, rank) for low, size, rank in found]
    return [low for low, _, _ in found]


def _bin_of_rank(low: int, rank: int, width: int, bins: list[tuple[int, int]]) -> tuple[int, int, int]:
    for number, n in bins:
        if rank < n:
            return low + number * width, width, rank
        rank -= n
    raise ValueError("the rows changed between two passes")
