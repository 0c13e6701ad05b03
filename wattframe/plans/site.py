"""Weather to capacity factors, the site study, dashboards and verification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions import resource
from wattframe.operators import decompose, quality, relational as rel, sites, splits
from wattframe.plans.lazy import LazyTables


def weather_to_cf(wind: DataFrame, sun: DataFrame, places: Sequence[tuple]) -> DataFrame:
    """Two gridded sources (time, lat, lon, variables) to derived weather and capacity factors at the given places."""
    near = rel.nearest_points(wind.select("lat", "lon").distinct(), "lat", "lon", places).select("label", "lat", "lon")
    kind = F.create_map(*[F.lit(x) for p in places for x in (p[0], p[3])])
    at = wind.join(near, ["lat", "lon"]).join(sun, ["ts", "lat", "lon"])
    return resource.derive_weather(at, F.element_at(kind, F.col("label")))


def site_study(candidates: DataFrame, site: str, weights: Mapping[str, float], benefit: Mapping[str, bool], temperatures: DataFrame,
               temp_keys: Sequence[str], ts: str, temp_c: str, cost: DataFrame, rate: float = 0.08, years: int = 10, tariffs: Sequence[float] = tuple(sites.linspace(0.02, 0.20, 50)),
               other: float = 60.0) -> Mapping[str, DataFrame]:
    """Ranking, efficiency, cooling hours, sensitivity and cost tables of the candidate sites.

    ``cost`` holds the site, mw, tariff, capex (millions) and, for ``emissions``, intensity (t per MWh).
    """
    matrix = decompose.to_matrix(candidates, site, list(weights))
    opex = resource.annual_opex("mw", "tariff") / 1e6
    kwh = resource.annual_energy_kwh("mw")
    dearest = cost.agg(F.max(opex))
    return LazyTables({
        "opex": lambda: cost.select(site, kwh.alias("kwh"), opex.alias("opex"), (100 * (1 - opex / dearest.scalar())).alias("savings_pct")),
        "sweep": lambda: sites.tariff_sweep(cost.drop("tariff"), tariffs, {"tco": resource.tco_undiscounted(F.col("capex"), opex, F.lit(other), years)}).select(site, "tariff", "tco"),
        "emissions": lambda: cost.select(site, resource.scope2_emissions("intensity", kwh / 1000).alias("tonnes")),
        "water": lambda: sites.water_by_technology(cost.select(site, kwh.alias("kwh")), "kwh").select(site, "technology", "water_l"),
        "ranking": lambda: decompose.topsis(matrix, site, weights, benefit),
        "scores": lambda: decompose.weighted_score(matrix, site, weights),
        "pue": lambda: sites.pue_by_month(temperatures, temp_keys, ts, temp_c),
        "cooling": lambda: sites.cooling_hours(temperatures, temp_keys, temp_c),
        "sensitivity": lambda: sites.threshold_sensitivity(temperatures, temp_keys, temp_c, [5, 8, 10, 12, 15, 18, 21, 27]),
        "tco": lambda: cost.select(site, resource.npv_cost(F.col("capex"), opex, rate, years).alias("npv"),
                                   resource.tco_undiscounted(F.col("capex"), opex, F.lit(other), years).alias("stacked")),
    })


def _series(page: str, name: str, df: DataFrame, item: Column, value: Column) -> DataFrame:
    return df.select(F.lit(page).alias("page"), F.lit(name).alias("series"), item.cast("string").alias("item"), value.cast("double").alias("value"))


def dashboard_queries(long: DataFrame, market: DataFrame, prod_cons: DataFrame, preds: DataFrame, unit: str, line: str, total_group: str,
                      year: int) -> DataFrame:
    """Every dashboard data set in one long table (page, series, item, value)."""
    one = long.filter((F.col("unit") == unit) & (F.col("line_item") == line) & (F.col("fuel_group") != total_group))
    by_year = one.groupBy("yr").agg(F.sum("value").alias("v"))
    mix = rel.with_share(one.filter(F.col("yr") == year).groupBy("fuel_group").agg(F.sum("value").alias("v")).filter("v > 0"), "v")
    err = F.abs(F.col("y_true") - F.col("y_pred"))
    recent = rel.latest_slice(prod_cons, "yr")
    latest = by_year.agg(F.max("yr").alias("yr"), F.max_by("v", "yr").alias("v"), F.avg("v").alias("mean"))
    monthly = market.groupBy("zone", F.date_format("d", "yyyy-MM").alias("mo")).agg(F.sum("payment").alias("v"))
    return splits.union_all(
        _series("overview", "kpi latest total", latest, F.col("yr"), F.col("v")),
        _series("overview", "kpi mean total", latest, F.lit("all years"), F.col("mean")),
        _series("market", "month by zone", monthly, F.concat_ws("/", "mo", "zone"), F.col("v")),
        _series("overview", "total by year", by_year, F.col("yr"), F.col("v")),
        _series("overview", "fuel mix pct", mix, F.col("fuel_group"), F.col("share_pct")),
        _series("demand", "hour profile", market.groupBy("zone", "hr").agg(F.avg("payment").alias("v")), F.concat_ws("/", "zone", F.col("hr").cast("string")), F.col("v")),
        _series("demand", "weekday profile", market.groupBy("zone", F.weekday("d").alias("w")).agg(F.avg("payment").alias("v")),
                F.concat_ws("/", "zone", F.col("w").cast("string")), F.col("v")),
        _series("generation", "balance", rel.balance(prod_cons, "production", "consumption"), F.col("yr"), F.col("balance")),
        _series("generation", "latest production", recent, F.col("yr"), F.col("production")),
        _series("forecast", "mae", preds.groupBy("model").agg(F.avg(err).alias("v")), F.col("model"), F.col("v")))


def verify_all(tables: Mapping[str, DataFrame], floors: Mapping[str, int], parity: DataFrame, parity_on: Sequence[str],
               null_columns: Mapping[str, Sequence[str]], complete: tuple[DataFrame, Sequence[str], str],
               acceptance: Sequence[DataFrame] = (), facts: tuple[DataFrame, Sequence[str]] | None = None,
               audit: tuple[DataFrame, Sequence[str], str] | None = None, realism: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All verification checks and their verdict.

    ``facts``: compared facts and their keys; ``audit``: audited facts, keys and the flag; ``realism``: metrics and comparison tests.
    """
    parts = [quality.row_floors(tables, floors), quality.parity_check(parity, parity_on),
             *[quality.null_check(tables[t], cols) for t, cols in null_columns.items()],
             quality.completeness_check(*complete), *acceptance,
             *([quality.fact_parity_check(*facts)] if facts else []), *([quality.audit_check(*audit)] if audit else []),
             *([quality.metric_realism(*realism)] if realism else [])]
    checks = quality.all_of(parts)
    return {"checks": checks, "verdict": quality.verdict(checks)}
