"""Series primitives and panel features.

A panel has few series and each may be long, so ``partitionBy(series)`` would put a whole series in one task.
The primitives below cut a series into chunks of rows. Work inside a chunk is an ordinary window; what crosses
a chunk border is either a bounded overlap (lags, leads, rolling frames) or a small per-chunk summary that is
scanned and joined back (row numbers, running totals, fill-forward). Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wattframe.joins import on_keys

CHUNK = 8192
FEATURE_LAGS = (1, 2, 3, 6, 12, 24, 48, 168)  # fixed values: the lags of the panel feature set
FEATURE_ROLLS = (24, 168)  # fixed values: the rolling windows of the panel feature set


def hour_number(ts: Column | str) -> Column:
    """Hours since 1970-01-01 00:00 as a BIGINT: the row position inside a gap-free hourly series."""
    return F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            F.col(ts) if isinstance(ts, str) else ts)


def with_hour_position(df: DataFrame, ts: str, name: str = "pos") -> DataFrame:
    return df.withColumn(name, hour_number(ts))


def over_chunks(df: DataFrame, keys: Sequence[str], pos: str, build: Callable[[W], list[Column]],
                back: int, ahead: int = 0, chunk: int = CHUNK, dense: bool = False) -> DataFrame:
    """Add row-frame window columns to series cut into chunks with an overlap.

    ``pos`` is a number that orders the rows of a series; ``build`` gets the window and returns columns that look at most
    ``back`` rows behind and ``ahead`` rows in front. ``dense`` says that ``pos`` counts rows without gaps, as hours of a gap-free
    panel do; otherwise rows are numbered first, so the result doesn't depend on where chunks end. One shuffle on (keys, chunk),
    asked for, as a table that is dealt by series already would be left so; one sort.
    """
    chunk = max(chunk, back + ahead, 1)
    rows = df.withColumn("_row", F.col(pos)) if dense else with_row_index(df, keys, [pos], F.floor(F.col(pos) / chunk), index="_row")
    p = F.col("_row")
    first, last = F.floor((p - ahead) / chunk), F.floor((p + back) / chunk)
    pieces = rows.withColumn("_chunk", F.explode(F.sequence(first, last))).repartition(*keys, "_chunk")
    w = W.partitionBy(*keys, "_chunk").orderBy("_row")
    return (pieces.select(*df.columns, "_row", "_chunk", *build(w))
            .filter(F.col("_chunk") == F.floor(p / chunk)).drop("_chunk", "_row"))


def _bucket_offsets(sizes: DataFrame, keys: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """Exclusive running sums over the per-bucket totals of each series."""
    w = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(*keys, "_b", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(o) for c, o in cols.items()])


def with_row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                   index: str = "idx", total: str | None = None) -> DataFrame:
    """0-based row number per series (and the series length as ``total``).

    ``bucket`` is a coarsening of the first order column, such as the month of a timestamp. Rows are sorted only
    inside (series, bucket); the sizes of the buckets before give the offset. NULL keys are a series of their own, and NULLs
    in the order come first.
    """
    b = df.withColumn("_b", bucket)
    sizes = b.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    offsets = _bucket_offsets(sizes, keys, {"_n": "_off"})
    if total:
        offsets = on_keys(offsets, sizes.groupBy(*keys).agg(F.sum("_n").alias(total)), keys) if keys else \
            offsets.withColumn(total, sizes.agg(F.sum("_n")).scalar())
    w = W.partitionBy(*keys, "_b").orderBy(*order)
    out = on_keys(b.repartition(*keys, "_b"), offsets, [*keys, "_b"]).withColumn(index, F.col("_off") + F.row_number().over(w) - 1)
    return out.select(*df.columns, index, *([total] if total else []))


def with_running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                      sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums per series in two levels: inside buckets, then over bucket totals."""
    b = df.withColumn("_b", bucket).select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()])
    totals = b.groupBy(*keys, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    offsets = _bucket_offsets(totals, keys, {f"_t_{n}": f"_o_{n}" for n in sums})
    w = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (on_keys(b.repartition(*keys, "_b"), offsets, [*keys, "_b"])
            .select(*df.columns, *[(F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(w)).alias(n) for n in sums]))


def with_fill_forward(df: DataFrame, keys: Sequence[str], order: str, bucket: Column, col: str,
                      name: str) -> DataFrame:
    """Last non-NULL value of ``col`` up to the row, per series, in two levels."""
    b = df.withColumn("_b", bucket)
    tails = (b.filter(F.col(col).isNotNull()).groupBy(*keys, "_b")
             .agg(F.max_by(col, order).alias("_tail")))
    buckets = on_keys(b.select(*keys, "_b").distinct(), tails, [*keys, "_b"], "left")
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = buckets.select(*keys, "_b", F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    w = W.partitionBy(*keys, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (on_keys(b.repartition(*keys, "_b"), carried, [*keys, "_b"])
            .withColumn(name, F.coalesce(F.last(col, ignorenulls=True).over(w), F.col("_carry")))
            .select(*df.columns, name))


# --- time grids -------------------------------------------------------------------------------------------

def series_grid(df: DataFrame, keys: Sequence[str], ts: str, unit: str, per_series: bool = False) -> DataFrame:
    """Every (series, time step) between the first and last time, of the table or of each series."""
    if per_series:
        span = df.groupBy(*keys).agg(F.struct(F.min(ts).alias("a"), F.max(ts).alias("z")).alias("_e"))
    else:
        ends = df.agg(F.struct(F.min(ts).alias("a"), F.max(ts).alias("z")))
        # the grid is built per series inside the row, so no cross join is needed
        span = df.select(*keys).distinct().withColumn("_e", ends.scalar())
    step, first, last = F.expr(f"interval 1 {unit}"), F.col("_e.a"), F.col("_e.z")
    if unit != "hour":
        return span.select(*keys, F.explode(F.sequence(first, last, step)).alias(ts))
    # days first, so that a long span never becomes one array of hours
    days = span.select(*keys, last.alias("_z"), F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("_d")).repartition(*keys, "_d")
    end = F.least(F.timestamp_add("HOUR", F.lit(23), F.col("_d")).cast("timestamp_ntz"), F.col("_z"))
    return days.select(*keys, F.explode(F.sequence(F.col("_d"), end, step)).alias(ts))


def dense_panel(df: DataFrame, keys: Sequence[str], ts: str, unit: str, per_series: bool = False) -> DataFrame:
    """Gap-free panel: missing steps appear with NULL values."""
    return on_keys(series_grid(df, keys, ts, unit, per_series), df, [*keys, ts], "left")


def missing_steps(df: DataFrame, keys: Sequence[str], ts: str, unit: str, per_series: bool = False) -> DataFrame:
    """Time steps that should exist and do not. ``ts`` holds whole steps."""
    return expand_gaps(gap_intervals(df, keys, ts, unit, per_series), keys, ts, unit)


def step_number(ts: Column | str, unit: str) -> Column:
    """Whole ``unit`` steps (second, minute, hour, day ..) since 1970-01-01 00:00."""
    return F.timestamp_diff(unit.upper(), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def gap_intervals(df: DataFrame, keys: Sequence[str], ts: str, unit: str, per_series: bool = False) -> DataFrame:
    """keys, gap_start, gap_end, n_missing: each run of missing steps as one row, whatever its length.

    A gap lies between a row and the next of its series; unless ``per_series``, also before the first and after the last row up to the ends of the
    whole table. No grid is made, so it works for minutes over decades. A NULL key is a series of its own; rows without a time don't count.
    """
    steps = df.filter(F.col(ts).isNotNull()).select(*keys, step_number(ts, unit).alias("_p")).distinct()
    after = over_chunks(steps, keys, "_p", lambda w: [F.lead("_p").over(w).alias("_next")], back=0, ahead=1)
    gaps = after.filter(F.col("_next") > F.col("_p") + 1).select(*keys, (F.col("_p") + 1).alias("_a"), (F.col("_next") - 1).alias("_z"))
    if not per_series:
        ends = steps.agg(F.struct(F.min("_p").alias("a"), F.max("_p").alias("z")))
        own = steps.groupBy(*keys).agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi")).withColumn("_e", ends.scalar())
        sides = F.array(F.struct(F.col("_e.a").alias("_a"), (F.col("_lo") - 1).alias("_z")), F.struct((F.col("_hi") + 1).alias("_a"), F.col("_e.z").alias("_z")))
        gaps = gaps.unionByName(own.select(*keys, F.inline(sides)).filter("_a <= _z"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    at = [F.timestamp_add(unit.upper(), F.col(c), epoch).cast("timestamp_ntz").alias(n) for c, n in (("_a", "gap_start"), ("_z", "gap_end"))]
    return gaps.select(*keys, *at, (F.col("_z") - F.col("_a") + 1).alias("n_missing"))


def expand_gaps(gaps: DataFrame, keys: Sequence[str], ts: str, unit: str, chunk: int = CHUNK) -> DataFrame:
    """The missing steps of ``gap_intervals``, one row each; long gaps are first cut into pieces, so no array has more than ``chunk`` steps."""
    cut = gaps.select(*keys, "gap_start", "n_missing", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_missing") - 1) / chunk))).alias("_c"))
    last = F.least(F.col("n_missing"), (F.col("_c") + 1) * chunk) - 1
    steps = cut.select(*keys, "gap_start", F.explode(F.sequence(F.col("_c") * chunk, last)).alias("_i"))
    return steps.select(*keys, F.timestamp_add(unit.upper(), F.col("_i"), F.col("gap_start")).cast("timestamp_ntz").alias(ts))


def fill_gaps(df: DataFrame, keys: Sequence[str], ts: str, unit: str, per_series: bool = False) -> DataFrame:
    """``df`` and a row for each missing step, NULL but for key and time: a union, so the rows that are there meet no join."""
    return df.unionByName(expand_gaps(gap_intervals(df, keys, ts, unit, per_series), keys, ts, unit), allowMissingColumns=True)


# --- panel features ---------------------------------------------------------------------------------------

def lag_columns(w, value: str, lags: Sequence[int]) -> list[Column]:
    return [F.lag(value, k).over(w).alias(f"lag_{k}") for k in lags]


def rolling(w, value: str, n: int, how: str = "mean", closed: str = "right") -> Column:
    """Rolling aggregate over ``n`` rows. ``closed='left'`` ends one row before, so it cannot see the target."""
    frame = w.rowsBetween(-(n - 1), 0) if closed == "right" else w.rowsBetween(-n, -1)
    fn = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}[how]
    return fn(F.col(value)).over(frame)


def seasonal_shift(horizon: int, season: int = 24) -> int:
    """Rows to look back from the origin for the same phase of the last whole season before the target."""
    return season * -(-horizon // season) - horizon


def feature_panel(df: DataFrame, keys: Sequence[str], pos: str, value: str, horizon: int,
                  lags: Sequence[int] = FEATURE_LAGS, rolls: Sequence[int] = FEATURE_ROLLS,
                  closed: str = "right", season: int = 24, dense: bool = False) -> DataFrame:
    """Lags, rolling means, seasonal naive and the target ``horizon`` rows ahead, in one sort."""
    found = horizon_panel(df, keys, pos, value, [horizon], lags, rolls, closed, season, dense)
    return found.select(*[c for c in found.columns if c != "ahead"], F.col("ahead")[0]["snaive"].alias("snaive"), F.col("ahead")[0]["target"].alias("target"))


def horizon_panel(df: DataFrame, keys: Sequence[str], pos: str, value: str, horizons: Sequence[int],
                  lags: Sequence[int] = FEATURE_LAGS, rolls: Sequence[int] = FEATURE_ROLLS,
                  closed: str = "right", season: int = 24, dense: bool = False) -> DataFrame:
    """Lags and rolling means once for all horizons, in one sort, and ``ahead``: an array of (horizon, snaive, target), one for each of ``horizons``."""
    shifts = {h: seasonal_shift(h, season) for h in horizons}

    def build(w):
        ahead = [F.struct(F.lit(h).alias("horizon"), F.lag(value, shifts[h]).over(w).alias("snaive"), F.lead(value, h).over(w).alias("target")) for h in horizons]
        return [*lag_columns(w, value, lags), *[rolling(w, value, n, closed=closed).alias(f"roll_{n}") for n in rolls], F.array(*ahead).alias("ahead")]

    back = max([*lags, *[n + 1 for n in rolls], *shifts.values()])
    return over_chunks(df, keys, pos, build, back=back, ahead=max(horizons), dense=dense)


def at_horizon(df: DataFrame, horizons: Sequence[int], horizon: int) -> DataFrame:
    """The rows of a ``horizon_panel`` that have a target ``horizon`` rows ahead, with snaive and target of their own instead of the array."""
    own = F.col("ahead")[list(horizons).index(horizon)]
    rows = df.withColumns({"snaive": own["snaive"], "target": own["target"]})
    return rows.filter(F.col("target").isNotNull()).drop("ahead")


def clock_lag(df: DataFrame, keys: Sequence[str], ts: str, value: str, hours: int, name: str) -> DataFrame:
    """Value exactly ``hours`` earlier by the clock, NULL where that hour is missing."""
    past = df.select(*keys, F.timestamp_add("HOUR", F.lit(hours), ts).cast("timestamp_ntz").alias(ts),
                     F.col(value).alias(name))
    return on_keys(df, past, [*keys, ts], "left")


def group_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sigma"))


def zscore(df: DataFrame, keys: Sequence[str], value: str, name: str = "z", stats: DataFrame | None = None) -> DataFrame:
    """(value - mean) / sample deviation per group, keeping mu and sigma for the way back."""
    stats = group_stats(df, keys, value) if stats is None else stats
    return on_keys(df, stats, keys).withColumn(
        name, (F.col(value) - F.col("mu")) / F.when(F.col("sigma") != 0, F.col("sigma")))


def denormalize(value: Column, mu: Column, sigma: Column) -> Column:
    return value * sigma + mu


def minmax_scale(df: DataFrame, train: DataFrame, value: str, name: str) -> DataFrame:
    """Scale to 0..1 by the range of the training rows."""
    ends = train.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")))
    e = df.withColumn("_e", ends.scalar())
    span = F.col("_e.hi") - F.col("_e.lo")
    return (e.withColumn(name, (F.col(value) - F.col("_e.lo")) / F.when(span != 0, span))
            .withColumn(f"{name}_lo", F.col("_e.lo")).withColumn(f"{name}_hi", F.col("_e.hi")).drop("_e"))


def minmax_inverse(scaled: Column, lo: Column, hi: Column) -> Column:
    return scaled * (hi - lo) + lo


def difference(df: DataFrame, keys: Sequence[str], pos: str, value: str, seasons: Sequence[int], dense: bool = False) -> DataFrame:
    return over_chunks(df, keys, pos, lambda w: [
        (F.col(value) - F.lag(value, s).over(w)).alias(f"diff_{s}") for s in seasons], back=max(seasons), dense=dense)


def sequence_windows(df: DataFrame, keys: Sequence[str], pos: str, value: str, length: int, dense: bool = False) -> DataFrame:
    """Look-back arrays of the ``length`` rows before each row; rows without a full window are left out."""
    out = over_chunks(df, keys, pos, lambda w: [
        F.collect_list(value).over(w.rowsBetween(-length, -1)).alias("window")], back=length, dense=dense)
    return out.filter(F.size("window") == length)


def autocorrelation(df: DataFrame, keys: Sequence[str], pos: str, value: str, max_lag: int, dense: bool = False) -> DataFrame:
    """acf[k] = sum (y_t - m)(y_{t-k} - m) / sum (y_t - m)^2 for k = 1..max_lag."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    d = on_keys(df, mean, keys).withColumn("_d", F.col(value) - F.col("_m"))
    past = over_chunks(d, keys, pos, lambda w: [
        F.collect_list("_d").over(w.rowsBetween(-max_lag, 0)).alias("_past")], back=max_lag, dense=dense)
    # the lag rows exist only inside the task: partial aggregation folds them before the shuffle
    pairs = past.select(*keys, "_d", F.posexplode(F.reverse("_past")).alias("lag", "_dk"))
    sums = pairs.groupBy(*keys, "lag").agg(F.sum(F.col("_d") * F.col("_dk")).alias("_c"), F.count("*").alias("_n"))
    base = sums.filter("lag = 0").select(*keys, F.col("_c").alias("_c0"), F.col("_n").alias("n"))
    return (on_keys(sums.filter("lag > 0"), base, keys)
            .select(*keys, F.col("lag").cast("int").alias("lag"), "n",
                    (F.col("_c") / F.when(F.col("_c0") != 0, F.col("_c0"))).alias("acf")))


def partial_autocorrelation(acf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Durbin-Levinson over each series' acf array, which has ``max_lag`` values."""
    rho = acf.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("rho"))

    def step(state, k):
        phi = state["phi"]
        at = F.element_at(F.col("rho"), k)
        num = at - F.aggregate(F.arrays_zip(phi.alias("p"), F.reverse(F.slice(F.col("rho"), 1, k - 1)).alias("r")),
                               F.lit(0.0), lambda a, x: a + x["p"] * x["r"])
        den = 1.0 - F.aggregate(F.arrays_zip(phi.alias("p"), F.slice(F.col("rho"), 1, k - 1).alias("r")),
                                F.lit(0.0), lambda a, x: a + x["p"] * x["r"])
        new = num / den
        old = F.zip_with(phi, F.reverse(phi), lambda a, b: a - new * b)
        return F.struct(F.concat(old, F.array(new)).alias("phi"), F.concat(state["pacf"], F.array(new)).alias("pacf"))

    start = F.struct(F.array(F.element_at("rho", 1)).alias("phi"), F.array(F.element_at("rho", 1)).alias("pacf"))
    lags = F.sequence(F.lit(1), F.size("rho"))
    fold = F.aggregate(F.filter(lags, lambda k: k > 1), start, step)
    return (rho.select(*keys, fold["pacf"].alias("_p"))
            .select(*keys, F.posexplode("_p").alias("_k", "pacf"))
            .select(*keys, (F.col("_k") + 1).cast("int").alias("lag"), "pacf"))


def ljung_box(acf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n (n + 2) sum acf_k^2 / (n - k)."""
    return acf.groupBy(*keys).agg(
        F.max("lag").alias("m"), F.max("n").alias("n"),
        F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).alias("_s")).select(
        *keys, "m", "n", (F.col("n") * (F.col("n") + 2) * F.col("_s")).alias("q_stat"))


def gap_clusters(df: DataFrame, keys: Sequence[str], pos: str, tie: str, gap: float, name: str = "cluster") -> DataFrame:
    """Number the runs of tokens whose distance to the previous token stays below ``gap``.

    The keys name one page: its token count is bounded by the page, so a plain window holds.
    """
    w = W.partitionBy(*keys).orderBy(pos, tie)
    opened = F.when(F.abs(F.col(pos) - F.lag(pos).over(w)) >= gap, 1).otherwise(0)
    return (df.withColumn("_open", opened)
            .withColumn(name, F.sum("_open").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_open"))


def numeric_columns(df: DataFrame, drop: Sequence[str]) -> list[str]:
    """Names of the numeric columns that are neither keys nor targets."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if t in kinds and c not in drop]
