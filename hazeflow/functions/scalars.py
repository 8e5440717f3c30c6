"""Column expressions: every function takes and returns a Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

HOUR_US = 3_600_000_000

# US EPA PM2.5 bands (concentration low/high, index low/high).
PM25_BANDS = [
    (0.0, 12.0, 0, 50),
    (12.1, 35.4, 51, 100),
    (35.5, 55.4, 101, 150),
    (55.5, 150.4, 151, 200),
    (150.5, 250.4, 201, 300),
    (250.5, 350.4, 301, 400),
    (350.5, 500.4, 401, 500),
]
PM25_CEILING = 500

# Upper index bound, category name, hex colour.
AQI_CATEGORIES = [
    (50, "Good", "#00e400"),
    (100, "Moderate", "#ffff00"),
    (150, "Unhealthy for Sensitive Groups", "#ff7e00"),
    (200, "Unhealthy", "#ff0000"),
    (300, "Very Unhealthy", "#8f3f97"),
    (None, "Hazardous", "#7e0023"),
]
UNKNOWN_CATEGORY = "Unknown"
DEFAULT_COLOR = "#cccccc"
DARK_TEXT_CATEGORIES = ["Good", "Moderate", UNKNOWN_CATEGORY]

# Season by month and weekday names from Monday.
SEASONS = {"winter": [12, 1, 2], "spring": [3, 4, 5], "summer": [6, 7, 8]}
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def finite(c: Column) -> Column:
    """NULL for NaN and infinities, so comparisons and sums treat them as missing."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def nan_as_null(c: Column) -> Column:
    """NULL for NaN; evaluates the column once."""
    return F.nanvl(c, F.lit(None).cast("double"))


def round_exact(c: Column, digits: int) -> Column:
    """Round the exact binary value, half to even: what rounding a float means in the stored tables.

    `bround` rounds the shortest decimal form instead and differs on ties that only look like ties.
    """
    text = F.call_function("format_number", c, F.lit("0." + "0" * digits))
    return F.coalesce(text.try_cast("double"), c)


def _iso_text(s: Column) -> Column:
    # finer than a microsecond is cut off
    tidy = F.regexp_replace(F.regexp_replace(s, r"([T ].*[+-]\d{2})(\d{2})$", "$1:$2"), r"([.]\d{6})\d+", "$1")
    return F.when(s.rlike(_ISO), tidy)


def parse_ts(s: Column) -> Column:
    """ISO text to an instant; text without an offset is UTC, bad text is NULL."""
    return _iso_text(s).try_cast("timestamp")


def wall_clock(s: Column) -> Column:
    """The local date and time written in ISO text, whatever its offset."""
    return F.regexp_replace(_iso_text(s), r"([T ].*?)(Z|[+-]\d{2}(:\d{2})?)$", "$1").try_cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def hour(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return F.when(F.weekday(ts) >= 5, 1).when(ts.isNotNull(), 0)


def season(month: Column) -> Column:
    named = [(month.isin(*months), name) for name, months in SEASONS.items()]
    chain = reduce(lambda acc, case: acc.when(*case), named[1:], F.when(*named[0]))
    return chain.when(month.isNotNull(), "autumn")


def time_features(ts: Column) -> dict[str, Column]:
    return {
        "hour": F.hour(ts),
        "day_of_week": day_of_week(ts),
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "is_weekend": is_weekend(ts),
        "season": season(F.month(ts)),
    }


def _interpolate(c: Column, c_low: float, c_high: float, i_low: int, i_high: int) -> Column:
    slope = F.lit(float(i_high - i_low)) / F.lit(c_high - c_low)
    return slope * (c - F.lit(c_low)) + F.lit(float(i_low))


def band_lookup(c: Column, bands=PM25_BANDS) -> Column:
    """Linear interpolation inside the band that holds `c`; NULL between and beyond the bands."""
    chain = None
    for band in bands:
        hit, value = (c >= band[0]) & (c <= band[1]), _interpolate(c, *band)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def _rounds_up_to(x: Column, high: float) -> Column:
    """Whether `x` rounded to one decimal is at most `high`, asked of `x` itself."""
    tie = round(high + 0.05, 2)
    return x <= tie if round(tie, 1) <= high else x < tie


def pm25_to_aqi(pm25: Column) -> Column:
    """US EPA index of the concentration rounded to one decimal; it is rounded once, in the band it falls in."""
    x = nan_as_null(pm25)
    c = round_exact(x, 1)
    chain = F.when(~(x >= 0), None)
    for band in PM25_BANDS:
        chain = chain.when(_rounds_up_to(x, band[1]), F.bround(_interpolate(c, *band), 0))
    return chain.when(x.isNotNull(), F.lit(float(PM25_CEILING)))


def pm_ratio(pm25: Column, pm10: Column) -> Column:
    return F.when(pm10 > 0, round_exact(F.try_divide(pm25, pm10), 4))


def aqi_category(aqi: Column) -> Column:
    whole = F.bround(nan_as_null(aqi), 0)
    chain = F.when(whole.isNull(), UNKNOWN_CATEGORY)
    for upper, name, _ in AQI_CATEGORIES[:-1]:
        chain = chain.when(whole <= upper, name)
    return chain.otherwise(AQI_CATEGORIES[-1][1])


def category_color(category: Column) -> Column:
    chain = None
    for _, name, color in AQI_CATEGORIES:
        chain = F.when(category == name, color) if chain is None else chain.when(category == name, color)
    return chain.otherwise(DEFAULT_COLOR)


def light_text(category: Column) -> Column:
    """True where the category's colour needs white text."""
    return ~F.coalesce(category, F.lit("")).isin(*DARK_TEXT_CATEGORIES)


def forecast_ts(ts: Column, hours: int = 72) -> Column:
    return ts + F.expr(f"INTERVAL {int(hours)} HOURS")


def day_name(dow: Column) -> Column:
    names = F.array(*[F.lit(n) for n in DAY_NAMES])
    index = dow.cast("int")
    known = dow.isNotNull() & (index >= 0) & (index < 7)
    return F.when(known, F.get(names, index)).otherwise(F.coalesce(dow.cast("string"), F.lit("nan")))


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "E, MMM dd - hh:mm a")


def abs_error(predicted: Column, actual: Column) -> Column:
    return F.abs(predicted - actual)


def exceeds(aqi: Column, level: int) -> Column:
    return aqi > level
