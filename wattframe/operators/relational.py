"""Filters, joins and aggregations that need more than one DataFrame call."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wattframe.joins import on_keys
from wattframe.operators.panel import with_row_index
from wattframe.operators.quantiles import quantiles


# --- filters ----------------------------------------------------------------------------------------------

def latest_slice(df: DataFrame, col: str) -> DataFrame:
    """Rows at the largest value of ``col``."""
    return df.filter(F.col(col) == df.agg(F.max(col)).scalar())


def row_slice(df: DataFrame, keys: Sequence[str], order: str, bucket: Column, offset: int, n: int) -> DataFrame:
    """``n`` contiguous rows of each ordered series from a 0-based offset."""
    return with_row_index(df, keys, [order], bucket).filter(F.col("idx").between(offset, offset + n - 1))


def drop_blank_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows whose columns are all NULL apart from the keys."""
    return df.filter(F.coalesce(*[F.col(c).cast("string") for c in df.columns if c not in keys]).isNotNull())


# --- joins ------------------------------------------------------------------------------------------------

def combine_first(old: DataFrame, fresh: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Left join where fresh values win and old ones fill the gaps."""
    new = fresh.select(*on, *[F.col(c).alias(f"_new_{c}") for c in cols])
    return (on_keys(old, new, on, "left")
            .select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in old.columns]))


def parity(a: DataFrame, b: DataFrame, on: Sequence[str], value: str, tol: float = 0.0) -> DataFrame:
    """Full outer comparison: rows on one side only, or with values further apart than ``tol``."""
    left = a.select(*on, F.col(value).alias("value_a"), F.lit(1).alias("_a"))
    right = b.select(*on, F.col(value).alias("value_b"), F.lit(1).alias("_b"))
    near = F.abs(F.col("value_a") - F.col("value_b")) <= tol
    status = (F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b")
              .when(F.col("value_a").eqNullSafe(F.col("value_b")) | F.coalesce(near, F.lit(False)), "match")
              .otherwise("differs"))
    return on_keys(left, right, on, "full").select(*on, "value_a", "value_b", status.alias("status"))


def tolerance_flag(a: DataFrame, b: DataFrame, on: Sequence[str], value: str, tol: float, name: str = "matched") -> DataFrame:
    """Does ``b`` hold a row with equal keys and a value within ``tol``?

    Values fall into bands of width ``tol``, and only the ends of a band matter: one in the same band always
    matches, and one in a neighbour band does if its nearest end is close enough. So each row of ``a`` meets at
    most three summary rows of ``b``, whatever the number of values behind them.
    """
    bands = (b.filter(F.col(value).isNotNull()).withColumn("_band", F.floor(F.col(value) / tol))
             .groupBy(*on, "_band").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    spread = (bands.select(*on, "_band", "_lo", "_hi", F.explode(F.lit([-1, 0, 1])).alias("_s"))
              .groupBy(*on, (F.col("_band") + F.col("_s")).alias("_band"))
              .agg(F.max(F.when(F.col("_s") == 1, F.col("_hi"))).alias("_below"),
                   F.min(F.when(F.col("_s") == -1, F.col("_lo"))).alias("_above"),
                   F.max(F.col("_s") == 0).alias("_same")))
    x = F.col(value)
    hits = [F.col("_same"), F.abs(x - F.col("_below")) <= tol, F.abs(x - F.col("_above")) <= tol]
    matched = reduce(or_, [F.coalesce(h, F.lit(False)) for h in hits])
    return (on_keys(a.withColumn("_band", F.floor(x / tol)), spread, [*on, "_band"], "left")
            .select(*a.columns, matched.alias(name)))


def nearest_points(points: DataFrame, lat: str, lon: str, places: Sequence[tuple]) -> DataFrame:
    """Nearest grid point per place of a short literal list (label, lat, lon, ...), in one pass over the grid."""
    def dist(p):
        dy, dx = F.col(lat) - F.lit(float(p[1])), F.col(lon) - F.lit(float(p[2]))
        return dy * dy + dx * dx

    best = points.agg(*[F.min(F.struct(dist(p).alias("d2"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))).alias(f"p{i}")
                        for i, p in enumerate(places)])
    rows = F.array(*[F.struct(F.lit(p[0]).alias("label"), F.col(f"p{i}.lat").alias("lat"), F.col(f"p{i}.lon").alias("lon"),
                              F.sqrt(F.col(f"p{i}.d2")).alias("dist")) for i, p in enumerate(places)])
    return best.select(F.inline(rows))


def sweep(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Repeat each row for every value of a short literal list."""
    return df.withColumn(name, F.explode(F.lit(list(values))))


# --- aggregations -----------------------------------------------------------------------------------------

def zero_sum(c: Column | str) -> Column:
    """Sum that gives 0 for a group without values."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def with_share(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "share_pct") -> DataFrame:
    """Percent of the total, of the table or of each group."""
    if by:
        totals = df.groupBy(*by).agg(F.sum(value).alias("_t"))
        return (on_keys(df, totals, by)
                .withColumn(name, 100 * F.col(value) / F.when(F.col("_t") != 0, F.col("_t"))).drop("_t"))
    total = df.agg(F.nullif(F.sum(value), F.lit(0.0))).scalar()
    return df.withColumn(name, 100 * F.col(value) / total)


def top_categories(df: DataFrame, col: str, k: int) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(k)


def best_per_group(df: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """Row with the smallest score per group, ties to the smallest tie key, by one partial aggregate."""
    rest = [c for c in df.columns if c not in (*keys, score, tie)]
    best = F.min(F.struct(score, tie, *rest)).alias("_b")
    return (df.filter(F.col(score).isNotNull()).groupBy(*keys).agg(best)
            .select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns]))


def improvement_vs(df: DataFrame, keys: Sequence[str], model: str, score: str, base: str, name: str = "improvement_pct") -> DataFrame:
    """100 (1 - score / score of the base row) per group."""
    ref = df.filter(F.col(model) == base).select(*keys, F.col(score).alias("_base"))
    return (on_keys(df, ref, keys, "left")
            .withColumn(name, 100 * (1 - F.col(score) / F.when(F.col("_base") != 0, F.col("_base")))).drop("_base"))


def median_ratio(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exact median of a / b over the rows where both exist and b is not zero."""
    r = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(b) != 0)).select((F.col(a) / F.col(b)).alias("_r"))
    return quantiles(r, [], "_r", {"ratio": 0.5})


def histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Counts per [edge, next edge), the last bin closed, and percent of the counted rows."""
    last = len(edges) - 2
    x = F.col(value)
    bin_no = F.coalesce(*[
        F.when((x >= edges[i]) & ((x < edges[i + 1]) if i < last else (x <= edges[i + 1])), F.lit(i)) for i in range(last + 1)])
    counts = df.select(bin_no.alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("n"))
    edge = F.lit([float(e) for e in edges])
    all_bins = df.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    total = counts.agg(F.sum("n")).scalar()
    return (all_bins.join(counts, "bin", "left")
            .select("bin", edge[F.col("bin")].alias("lo"), edge[F.col("bin") + 1].alias("hi"),
                    F.coalesce("n", F.lit(0)).alias("n"), (100 * F.coalesce("n", F.lit(0)) / total).alias("pct")))


def year_buckets(df: DataFrame, year: str, value: str, width: int = 5) -> DataFrame:
    """Sums per ``width``-year bucket with the running share; the bucket count is bounded by the calendar."""
    sums = (df.groupBy((F.floor(F.col(year) / width) * width).cast("int").alias("bucket"))
            .agg(F.sum(value).alias("total")))
    w = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    grand = sums.agg(F.sum("total")).scalar()
    return sums.withColumn("cum_share", F.sum("total").over(w) / grand)


def with_total_rows(df: DataFrame, keys: Sequence[str], group: str, value: str, label: str = "Total") -> DataFrame:
    """Group sums plus a total row per key."""
    sums = df.groupingSets([[F.col(k) for k in (*keys, group)], [F.col(k) for k in keys]], *keys, group).agg(
        F.sum(value).alias(value), F.grouping(group).alias("_g"))
    return sums.select(*keys, F.when(F.col("_g") == 1, label).otherwise(F.col(group)).alias(group), value)


def nearest_row(df: DataFrame, key: str, x: float, tie: str) -> DataFrame:
    """The row whose key is closest to ``x``."""
    best = df.agg(F.min(F.struct(F.abs(F.col(key) - x).alias("_d"), F.col(tie).alias("_t"), F.struct(*df.columns).alias("r"))).alias("b"))
    return best.select("b.r.*")


def balance(df: DataFrame, plus: str, minus: str) -> DataFrame:
    """plus - minus and whether it is a surplus, a deficit or even."""
    d = F.col(plus) - F.col(minus)
    return df.withColumn("balance", d).withColumn(
        "status", F.when(d > 0, "surplus").when(d < 0, "deficit").otherwise("even"))


# --- page tokens ------------------------------------------------------------------------------------------

# fixed values: which numbers are values of the charts, how far an axis row may be from its values, and their columns from each other
VALUE_RANGE, MILLIONS_RANGE = (50, 200), (50_000, 200_000)
NEAREST_DY, FARTHEST_DY, FARTHEST_DX = 5.0, 120.0, 60.0
AXIS_YEARS = (3, 6)


def tag_tokens(tokens: DataFrame, text: str = "txt") -> DataFrame:
    """Class YEAR, NUM or NUM_MLN of a page token, with its value."""
    from wattframe.functions.clean import strip, token_number

    s = strip(text)
    is_year = (F.length(s) == 4) & s.try_cast("int").between(2010, 2029)
    num = token_number(s)
    kind = (F.when(is_year, "YEAR").when(num.between(*VALUE_RANGE), "NUM").when(num.between(*MILLIONS_RANGE), "NUM_MLN"))
    return (tokens.withColumn("kind", kind)
            .withColumn("num", F.when(F.col("kind") == "YEAR", s.try_cast("double")).when(F.col("kind").isNotNull(), num)))


def align_token_rows(tagged: DataFrame, page: str, y: str, x: str, cluster: str,
                     near: float = NEAREST_DY, far: float = FARTHEST_DY, max_dx: float = FARTHEST_DX) -> DataFrame:
    """Pair the years of an axis row with the numbers of the nearest value row of the same page.

    Rows meet in bands of y as high as the farthest distance, so an axis row sees three bands whatever a page holds; the nearest row is a
    ``min_by``. Years and numbers are ranked by x within their rows and joined by rank. A NULL page is a page of its own.
    """
    used = tagged.filter(F.col("kind").isin("YEAR", "NUM"))
    year, key = F.col("kind") == "YEAR", [page, cluster]
    rows = tagged.filter(F.col("kind").isNotNull()).groupBy(*key).agg(
        F.min(F.struct(F.col(y), F.col(x)))[y].alias("_y"), F.count_if(year).alias("_years"), F.count_if(F.col("kind") == "NUM").alias("_nums"), F.min(F.when(year, F.col(y))).alias("_axis"))
    axis = rows.filter(F.col("_years").between(*AXIS_YEARS) & (F.col("_nums") == 0)).select(
        *key, "_axis", "_years", F.explode(F.sequence(F.floor(F.col("_axis") / far) - 1, F.floor(F.col("_axis") / far) + 1)).alias("_band"))
    values = rows.filter("_nums > 0").select(F.col(page), F.col(cluster).alias("_row"), "_y", "_nums", F.floor(F.col("_y") / far).alias("_band"))
    away = F.abs(F.col("_y") - F.col("_axis"))
    met = on_keys(axis, values, [page, "_band"]).filter((F.col("_row") != F.col(cluster)) & (F.col("_nums") >= F.col("_years") - 1) & (away > near) & (away < far))
    best = met.groupBy(*key).agg(F.min_by("_row", F.struct(away, F.col("_row"))).alias("_row"))
    rank = F.row_number().over(W.partitionBy(*key, "kind").orderBy(x, "num"))
    ranked = used.withColumn("_rank", rank).filter(F.col("_rank") <= AXIS_YEARS[1])  # no more are ever paired
    years = on_keys(best, ranked.filter(year).select(*key, "_rank", F.col(x).alias("_xa"), F.col("num").alias("_year")), key)
    nums = ranked.filter("kind = 'NUM'").select(page, F.col(cluster).alias("_row"), "_rank", F.col(x).alias("_xb"), F.col("num").alias("value"))
    pairs = on_keys(years, nums, [page, "_row", "_rank"]).filter(F.abs(F.col("_xa") - F.col("_xb")) < max_dx)
    return pairs.select(page, F.col("_year").cast("int").alias("year"), "value")
