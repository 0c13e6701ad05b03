"""Weather, capacity-factor, efficiency and cost formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wattframe.functions.clean import clip

# --- fixed values ------------------------------------------------------------------------------------------
CUT_IN, RATED, CUT_OUT = 3.0, 12.0, 25.0  # wind turbine speeds, m/s
TEMP_COEFF, NOCT_RISE, REF_TEMP = 0.004, 25.0, 25.0  # solar panel temperature derating
MAGNUS_A, MAGNUS_B = 17.625, 243.04  # humidity formula
FREE_BELOW, MECHANICAL_ABOVE = 10.0, 20.0  # cooling regimes of the efficiency model, deg C
FREE_SHARE, MECHANICAL_SHARE = 0.05, 0.23  # cooling overhead shares at the ends of the ramp
TEMPERATURE_EDGES = (-50.0, -20.0, -10.0, 0.0, 10.0, 18.0, 27.0, 50.0)  # deg C
HOURS_PER_YEAR = 8760
WATER_USE = {"evaporative_tower": 2.0, "hybrid": 0.8, "air_cooled_chiller": 0.01, "direct_to_chip": 0.003,
             "single_phase_immersion": 0.001}  # litres per kWh


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wind_speed(u: Column | str, v: Column | str) -> Column:
    return F.sqrt(_c(u) * _c(u) + _c(v) * _c(v))


def wind_capacity_factor(speed: Column | str, cut_in: float = CUT_IN, rated: float = RATED, cut_out: float = CUT_OUT) -> Column:
    """Cubic ramp from cut-in to rated speed, 1 up to cut-out, else 0."""
    s = _c(speed)
    ramp = (s - cut_in) / (rated - cut_in)
    return (F.when(s.isNull(), F.lit(None).cast("double")).when(s < cut_in, 0.0).when(s < rated, ramp * ramp * ramp)
            .when(s <= cut_out, 1.0).otherwise(0.0))


def solar_capacity_factor(ghi: Column | str, temp_c: Column | str) -> Column:
    """Irradiance share derated by cell temperature, within 0..1."""
    cell = _c(temp_c) + NOCT_RISE
    return clip(_c(ghi) / 1000.0 * (1.0 - TEMP_COEFF * (cell - REF_TEMP)), 0, 1)


def kelvin_to_celsius(t: Column | str) -> Column:
    return _c(t) - 273.15


def accumulated_to_watts(j: Column | str, seconds: float = 3600.0) -> Column:
    """Accumulated J/m2 to mean W/m2, not below 0."""
    return clip(_c(j) / seconds, 0)


def relative_humidity(temp_c: Column | str, dew_c: Column | str) -> Column:
    t, d = _c(temp_c), _c(dew_c)
    return 100.0 * F.exp(MAGNUS_A * d / (MAGNUS_B + d) - MAGNUS_A * t / (MAGNUS_B + t))


def deaccumulate(df: DataFrame, keys: list[str], ts: str, col: str, name: str) -> DataFrame:
    """Hourly increments of a series that accumulates within each day: at most 24 rows per group."""
    w = W.partitionBy(*keys, F.col(ts).cast("date")).orderBy(ts)
    return df.withColumn(name, F.col(col) - F.coalesce(F.lag(col).over(w), F.lit(0.0)))


def derive_weather(df: DataFrame, resource: Column, u: str = "u100", v: str = "v100", t: str = "t2m_k", d: str = "d2m_k",
                   ssrd: str = "ssrd") -> DataFrame:
    """All derived weather columns in one projection; each capacity factor only where its resource applies."""
    a = df.select("*", wind_speed(u, v).alias("ws100"), kelvin_to_celsius(t).alias("t2m_c"),
                  kelvin_to_celsius(d).alias("d2m_c"), accumulated_to_watts(ssrd).alias("ghi_wm2"),
                  resource.alias("resource"))
    return a.select("*", relative_humidity("t2m_c", "d2m_c").alias("rh_pct"),
                    F.when(F.col("resource") == "wind", wind_capacity_factor("ws100")).alias("cf_wind"),
                    F.when(F.col("resource") == "solar", solar_capacity_factor("ghi_wm2", "t2m_c")).alias("cf_solar"))


def pue(temp_c: Column | str, low: float = FREE_BELOW, high: float = MECHANICAL_ABOVE, free: float = FREE_SHARE,
        mechanical: float = MECHANICAL_SHARE) -> Column:
    """1 + cooling share, linear between the free and the mechanical regime."""
    t = _c(temp_c)
    return 1.0 + (F.when(t <= low, free).when(t >= high, mechanical)
                  .otherwise(free + (t - low) / (high - low) * (mechanical - free)))


def cooling_mode(temp_c: Column | str, low: float = 10.0, high: float = 18.0) -> Column:
    t = _c(temp_c)
    return F.when(t < low, "free").when(t < high, "partial").when(t.isNotNull(), "mechanical")


def annual_energy_kwh(mw: Column | str) -> Column:
    return _c(mw) * 1000.0 * HOURS_PER_YEAR


def annual_opex(mw: Column | str, tariff_per_kwh: Column | str) -> Column:
    return annual_energy_kwh(mw) * _c(tariff_per_kwh)


def tco_undiscounted(capex: Column, opex: Column, other: Column, years: int = 10) -> Column:
    return capex + opex * years + other


def npv_cost(capex: Column, yearly: Column, rate: float, years: int = 10) -> Column:
    """Capital plus the discounted constant yearly cost of years 1..n."""
    factor = sum((1.0 + rate) ** -t for t in range(1, years + 1))
    return capex + yearly * F.lit(factor)


def scope2_emissions(intensity_t_per_mwh: Column | str, mwh: Column | str) -> Column:
    return _c(intensity_t_per_mwh) * _c(mwh)


def water_use(wue_l_per_kwh: Column | str, kwh: Column | str) -> Column:
    return _c(wue_l_per_kwh) * _c(kwh)
