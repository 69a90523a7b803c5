"""Ordered computations per key that do not need a whole key in one task.

A plain ``Window.partitionBy(key).orderBy(frame)`` sorts every row of a key in a single
task, so one camera with a third of all rows becomes the slowest task of the job.  Here
the frame axis is cut into chunks: rows are only ever sorted inside ``(key, chunk)``, and
what a chunk must know about earlier ones (a run that started before it, how many rows
or gaps came first) is computed on one summary row per chunk and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = 4096
_CHUNK = "_chunk"


def _chunked(df: DataFrame, order: str, chunk: int) -> DataFrame:
    return df.withColumn(_CHUNK, F.floor(F.col(order) / chunk))


def _same(keys: list[str], a: str, b: str) -> Column:
    cond = F.col(f"{a}.{_CHUNK}") == F.col(f"{b}.{_CHUNK}")
    for key in keys:
        cond = cond & F.col(f"{a}.{key}").eqNullSafe(F.col(f"{b}.{key}"))
    return cond


def with_runs(
    df: DataFrame,
    keys: list[str],
    order: str = "frame_index",
    limits: dict[str, int] | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``run_start`` and ``run_no``.

    A run goes on while every column in ``limits`` (default: ``{order: 1}``) grows by at
    most its limit from one row to the next.  ``run_start`` is the order value of the
    first row of the run, ``run_no`` counts the runs of the key from one.  ``order`` is a
    whole number, and the limited columns never decrease along it.
    """
    limits = limits or {order: 1}
    rows = _chunked(df, order, chunk)
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(order)
    broken = F.lit(False)
    for name, limit in limits.items():
        broken = broken | (F.col(name) - F.lag(name).over(inside) > limit)
    marked = rows.withColumn("_inner", F.when(broken, F.col(order)))

    summary = marked.groupBy(*keys, _CHUNK).agg(
        F.min(order).alias("_first"),
        F.max("_inner").alias("_last_inner"),
        F.count("_inner").alias("_breaks"),
        *[F.min(n).alias(f"_lo_{n}") for n in limits],
        *[F.max(n).alias(f"_hi_{n}") for n in limits],
    )
    along = Window.partitionBy(*keys).orderBy(_CHUNK)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.lag("_first").over(along).isNull()
    for name, limit in limits.items():
        step = F.col(f"_lo_{name}") - F.lag(f"_hi_{name}").over(along)
        opens = opens | F.coalesce(step > limit, F.lit(False))
    summary = summary.withColumn("_opens", opens).withColumn(
        "_own", F.coalesce("_last_inner", F.when(F.col("_opens"), F.col("_first")))
    )
    carried = F.max("_own").over(before)
    earlier = F.coalesce(
        F.sum(F.col("_breaks") + F.col("_opens").cast("long")).over(before), F.lit(0)
    )
    summary = summary.select(
        *keys,
        _CHUNK,
        F.when(F.col("_opens"), F.col("_first")).otherwise(carried).alias("_entry_start"),
        (earlier + F.col("_opens").cast("long")).alias("_entry_no"),
    )

    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marked.withColumn("_start", F.max("_inner").over(upto)).withColumn(
        "_count", F.count("_inner").over(upto)
    )
    joined = placed.alias("r").join(summary.alias("s"), _same(keys, "r", "s"))
    return joined.select(
        *[F.col(f"r.{c}") for c in df.columns],
        F.coalesce(F.col("r._start"), F.col("s._entry_start")).alias("run_start"),
        (F.col("s._entry_no") + F.col("r._count")).alias("run_no"),
    )


def with_position(
    df: DataFrame,
    keys: list[str],
    order: str,
    ties: list[str] | None = None,
    chunk: int = CHUNK,
    name: str = "position",
) -> DataFrame:
    """Add the one-based position of a row in its key."""
    rows = _chunked(df, order, chunk)
    counts = rows.groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = counts.select(
        *keys, _CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(order, *(ties or []))
    placed = rows.withColumn("_here", F.row_number().over(inside))
    joined = placed.alias("r").join(counts.alias("s"), _same(keys, "r", "s"))
    return joined.select(
        *[F.col(f"r.{c}") for c in df.columns],
        (F.col("s._before") + F.col("r._here")).alias(name),
    )


def over_last_rows(
    df: DataFrame,
    keys: list[str],
    n: int,
    columns,
    position: str = "position",
    block: int = CHUNK,
) -> DataFrame:
    """Evaluate window columns that look back at most ``n`` rows.

    ``columns`` maps an output name to a function of an ordered window (without a frame).
    The key is cut into blocks of ``block`` rows and the last ``n`` rows of each block are
    copied in front of the next one, so a block has everything its rows look at.
    """
    where = F.floor((F.col(position) - 1) / block)
    at_end = (F.col(position) - 1) % block >= block - n
    homes = F.when(at_end, F.array(where, where + 1)).otherwise(F.array(where))
    spread = df.withColumn("_home", where).withColumn("_block", F.explode(homes))
    window = Window.partitionBy(*keys, "_block").orderBy(position)
    for name, build in columns.items():
        spread = spread.withColumn(name, build(window))
    return spread.where(F.col("_block") == F.col("_home")).drop("_home", "_block")


def running_totals(
    df: DataFrame, keys: list[str], order: str, columns: list[str], chunk: int = CHUNK
) -> DataFrame:
    """Replace ``columns`` by their running sums along ``order`` (unique per key)."""
    rows = _chunked(df, order, chunk)
    sums = rows.groupBy(*keys, _CHUNK).agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    before = (
        Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = sums.select(
        *keys, _CHUNK, *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in columns]
    )
    upto = (
        Window.partitionBy(*keys, _CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    for c in columns:
        rows = rows.withColumn(f"_h_{c}", F.sum(c).over(upto))
    joined = rows.alias("r").join(sums.alias("s"), _same(keys, "r", "s"))
    return joined.select(
        *[F.col(f"r.{c}") for c in df.columns if c not in columns],
        *[(F.col(f"s._s_{c}") + F.col(f"r._h_{c}")).alias(c) for c in columns],
    )


def running(
    df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], maxima: dict[str, Column] | None = None, chunk: int = CHUNK
) -> DataFrame:
    """Add sums and maxima of all rows of the key up to each one along ``order`` (unique per key)."""
    how = {n: (F.sum, c) for n, c in sums.items()} | {n: (F.max, c) for n, c in (maxima or {}).items()}
    rows = _chunked(df, order, chunk)
    upto = Window.partitionBy(*keys, _CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(*keys, _CHUNK).agg(*[f(c).alias(f"_s_{n}") for n, (f, c) in how.items()])
    chunks = chunks.select(*keys, _CHUNK, *[f(f"_s_{n}").over(before).alias(f"_s_{n}") for n, (f, _) in how.items()])
    for n, (f, c) in how.items():
        rows = rows.withColumn(f"_h_{n}", f(c).over(upto))
    joined = rows.alias("r").join(chunks.alias("s"), _same(keys, "r", "s"))
    total = {n: F.coalesce(F.col(f"s._s_{n}"), F.lit(0)) + F.col(f"r._h_{n}") for n in sums}
    largest = {n: F.greatest(f"s._s_{n}", f"r._h_{n}") for n in maxima or {}}
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], *[c.alias(n) for n, c in (total | largest).items()])


def next_minimum(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, chunk: int = CHUNK
) -> DataFrame:
    """Add the smallest ``value`` among the rows of the key that come strictly later.

    ``order`` is a whole number.  Later rows of the chunk are a growing frame of the
    reversed order; later chunks contribute one minimum each.
    """
    rows = _chunked(df, order, chunk).withColumn("_v", value)
    lows = rows.groupBy(*keys, _CHUNK).agg(F.min("_v").alias("_low"))
    later = Window.partitionBy(*keys).orderBy(F.desc(_CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    lows = lows.select(*keys, _CHUNK, F.min("_low").over(later).alias("_low"))
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_here", F.min("_v").over(inside))
    joined = placed.alias("r").join(lows.alias("s"), _same(keys, "r", "s"))
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], F.least("r._here", "s._low").alias(name))
