"""Scalar functions as Column expressions: coordinates, distances, costs, timestamps, casts and composite indices.

No function here needs Python on the executors. Grids use longitudes 0..360; NaN never reaches these functions,
because readers turn it into NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in km, km and m for a degree: fixed values that results depend on.
EARTH_KM = 6371.0
DEGREE_KM = 111.0
DEGREE_M = 111_000.0
LEGACY_DEGREE_M = 111_320.0
GATE_KM = 1.11
#: Pairs beyond this distance aren't matched, at this cost.
MATCH_KM, MATCH_PENALTY, FAR_PENALTY = 10.0, 1.0, 1000.0
WEIGHTS = {"distance": 0.5, "num_gates": 0.3, "max_reflectivity": 0.2}


def lon_360(lon: Column) -> Column:
    """-180..180 to 0..360 by one turn: only negative values move."""
    return F.when(lon < 0, lon + 360).otherwise(lon)


def lon_180(lon: Column) -> Column:
    """0..360 to -180..180 by one turn: only values above 180 move."""
    return F.when(lon > 180, lon - 360).otherwise(lon)


def wrap_180(lon: Column) -> Column:
    """Any longitude to -180 (included) .. 180 (excluded)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def wrap_360(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def haversine_km(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Great-circle distance."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    a = half(lat0, lat1) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * half(lon0, lon1)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def normalize_diff(a: Column, b: Column, most: Column) -> Column:
    return F.when(most > 0, F.abs(a - b) / most).otherwise(0.0)


def distance_cost(km: Column, gates: Column, reflectivity: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted cost by great-circle distance, from normalised differences; far pairs cost the large penalty."""
    cost = weights["distance"] * (km / MATCH_KM) + weights["num_gates"] * gates + weights["max_reflectivity"] * reflectivity
    return F.when(km > MATCH_KM, FAR_PENALTY).otherwise(cost)


def degree_cost(dlat: Column, dlon: Column, gates: Column, reflectivity: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted cost by Euclidean distance in degrees, a tenth of which counts up to 1."""
    near = F.least(F.sqrt(dlat * dlat + dlon * dlon) / 10.0, F.lit(1.0))
    return weights["distance"] * near + weights["num_gates"] * gates + weights["max_reflectivity"] * reflectivity


def degree_buffer(lat: Column, km: float) -> tuple[Column, Column]:
    """Kilometres as degrees of latitude and of longitude at a latitude."""
    return F.lit(km / DEGREE_KM), km / (DEGREE_KM * F.cos(F.radians(lat)))


def motion(lat0: Column, lon0: Column, lat1: Column, lon1: Column, metres: float = DEGREE_M) -> tuple[Column, Column]:
    """(dx, dy) in metres; no turn at the antimeridian."""
    return (lon1 - lon0) * metres * F.cos(F.radians((lat0 + lat1) / 2)), (lat1 - lat0) * metres


def beside(a: tuple[Column, ...], b: tuple[Column, ...], lat_buffer: Column, lon_buffer: Column) -> Column:
    """Whether boxes (lat_min, lat_max, lon_min, lon_max) come within a buffer of each other."""
    return ~((a[3] + lon_buffer < b[2]) | (a[2] - lon_buffer > b[3]) | (a[1] + lat_buffer < b[0]) | (a[0] - lat_buffer > b[1]))


# --- timestamps in names -------------------------------------------------------------------------------------------


def _group(name: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(name, pattern, group)
    return F.when(found != "", found)


def _stamp(text: Column, form: str) -> Column:
    return F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz")


def _of_two(name: Column, pattern: str, form: str = "yyyyMMddHHmmss") -> Column:
    return _stamp(F.concat(_group(name, pattern, 1), _group(name, pattern, 2)), form)


def name_minute(name: Column) -> Column:
    """The minute in a file's name; NULL if no pattern gives a valid date.

    Patterns in order, an invalid date going on to the next: 8-6 digits after the 3-D product's name, 8-6 digits
    before `_renamed`, 8-6, 8_6, and a satellite's sYYYYDDDHHMMSSx by day of year, which the year must have.
    """
    plain = [_of_two(name, p) for p in (r"MRMS_MergedReflectivityQC_3D_(\d{8})-(\d{6})", r"(\d{8})-(\d{6})_renamed", r"(\d{8})-(\d{6})", r"(\d{8})_(\d{6})", r".*(\d{8})-(\d{6}).*")]
    sat = r"s(\d{4})(\d{3})(\d{2})(\d{2})(\d{2})\d"
    year, day = _group(name, sat, 1).try_cast("int"), _group(name, sat, 2).try_cast("int")
    date = F.date_add(F.make_date(F.when(year >= 1, year), F.lit(1), F.lit(1)), day - 1)
    date = F.when((day >= 1) & (F.year(date) == year), date)
    clock = F.concat(_group(name, sat, 3), _group(name, sat, 4), _group(name, sat, 5))
    satellite = _stamp(F.concat(F.date_format(date, "yyyyMMdd"), clock), "yyyyMMddHHmmss")
    return F.date_trunc("minute", F.coalesce(*plain, satellite)).cast("timestamp_ntz")


def name_second(name: Column) -> Column:
    """The timestamp with seconds in a scan's name, of the patterns with 8-6 digits; NULL if there is no valid one."""
    return F.coalesce(*[_of_two(name, p) for p in (r"MRMS_MergedReflectivityQC_3D_(\d{8})-(\d{6})", r"(\d{8})-(\d{6})_renamed", r"(\d{8})-(\d{6})")])


def name_any(name: Column) -> Column:
    """The timestamp in a product's name; NULL if no pattern gives a valid one, and no name is an error.

    Patterns in order: 8 and 6 digits, 8 and 4, just 10 as seconds since 1970 (UTC), 8 digits however many follow, then
    of 10 and more digits 14 or 12 as a stamp, else the first 10 as seconds. A plain date so wins over a compact stamp.
    """
    run = _group(name, r"(\d{10,})", 1)
    seconds = lambda text: F.timestamp_seconds(text.try_cast("long")).cast("timestamp_ntz")  # noqa: E731 - ten digits end in the year 2286
    day = _stamp(_group(name, r"(\d{8})", 1), "yyyyMMdd")
    stamp = F.when(F.length(run) == 14, _stamp(run, "yyyyMMddHHmmss")).when(F.length(run) == 12, _stamp(run, "yyyyMMddHHmm")).otherwise(seconds(F.substring(run, 1, 10)))
    return F.coalesce(_of_two(name, r"(\d{8})[_.-](\d{6})"), _of_two(name, r"(\d{8})[_.-](\d{4})", "yyyyMMddHHmm"), F.when(F.length(run) == 10, seconds(F.substring(run, 1, 10))), day, stamp)


def parse_or_name(text: Column, name: Column) -> Column:
    """An ISO timestamp, or else the one in a name."""
    return F.coalesce(F.try_to_timestamp(text).cast("timestamp_ntz"), name_second(name))


def to_minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts).cast("timestamp_ntz")


def to_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def join_url(base: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(name, "^/+", ""))


def base_name(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


# --- casts ---------------------------------------------------------------------------------------------------------


def number_of(props: Column, key: str) -> tuple[Column, Column]:
    """(value, status) of a property: missing is 0, null or unparsable NULL with status MATCH_ERROR."""
    there, value = F.map_contains_key(props, F.lit(key)), F.try_element_at(props, F.lit(key)).try_cast("double")
    value = F.when(there, F.when(~F.isnan(value), value)).otherwise(0.0)
    return value, F.when(there & value.isNull(), "MATCH_ERROR")


def floats_in(text: Column) -> Column:
    """All numbers in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+\.?\d*)"), F.lit(1)), lambda x: x.cast("double"))


def half_even(value: Column, digits: int = 4) -> Column:
    """Rounding as Python does it for most values: half to even."""
    return F.bround(value, digits)


# --- composite indices ---------------------------------------------------------------------------------------------


def composite_echo_top(et18: Column, et30: Column, et50: Column) -> Column:
    """Echo tops at three thresholds in one number; NULL if one is missing."""
    low, high = 0.3 * et18 + 0.7 * et30, 0.1 * et18 + 0.3 * et30 + 0.6 * et50
    return F.when(et50 == 0, low).when(et50.isNotNull(), high)


def total_liquid(vil: Column, vii: Column) -> Column:
    return vil + vii


def liquid_density(vil: Column, vii: Column, et18: Column) -> Column:
    return F.try_divide(vil + vii, et18)


def precipitation_intensity(rala: Column, rate: Column, mesh: Column) -> Column:
    return (0.5 * F.tanh(0.05293 * rala) + 0.5 * F.tanh(0.06617 * rate)) * F.tanh(mesh / 25)


def flash_area_ratio(area: Column, gates: Column) -> Column:
    return F.try_divide(area, gates * (GATE_KM * GATE_KM))


def ground_flash_ratio(ground: Column, all_flashes: Column) -> Column:
    return F.coalesce(F.try_divide(ground, all_flashes), F.lit(0.0))
