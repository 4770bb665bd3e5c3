"""Readers: gridded products, probability polygons, directory listings, cell files, newest files."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType

from ..functions import scalars

GATES = "product string, scan string, i int, j int, lat double, lon double, value double"
POLYGONS = "ordinal int, id long, rings array<array<struct<lon:double,lat:double>>>, props map<string,string>"
HISTORY = "struct<timestamp:string,max_refl:double,num_gates:string,centroid:array<double>,dx:double,dy:double,dt:double>"
CELLS = f"id string, num_gates string, centroid array<double>, bbox array<array<double>>, max_refl double, storm_history array<{HISTORY}>"

# The sources of a cycle (path below the server, folder), those that needn't be there for it to start,
# the grids that are joined to cells (name, folder, key in the history), and the heights of a full stack of sweeps.
DOWNLOADS = (
    ("2D/EchoTop_18/", "EchoTop18"),
    ("2D/EchoTop_30/", "EchoTop30"),
    ("2D/FLASH/QPE_FFG01H/", "FLASH"),
    ("2D/NLDN_CG_005min_AvgDensity/", "NLDN"),
    ("2D/PrecipRate/", "PrecipRate"),
    ("2D/RadarOnly_QPE_01H/", "QPE_01H"),
    ("2D/RotationTrack30min/", "RotationTrack30min"),
    ("2D/VIL_Density/", "VILDensity"),
    ("ProbSevere/PROBSEVERE/", "ProbSevere"),
    ("2D/MergedRhoHV/", "RhoHV"),
    ("2D/PrecipFlag/", "PrecipFlag"),
    ("2D/ReflectivityAtLowestAltitude/", "RALA"),
    ("2D/MergedReflectivityQCComposite/", "CompRefQC"),
    ("2D/VII/", "VII"),
)
OPTIONAL = ("FLASH", "RhoHV")
CHECKED = tuple(x for x in DOWNLOADS if x[1] not in OPTIONAL)
INTEGRATED = (
    ("NLDN", "NLDN", "CGFlashDensity"),
    ("EchoTop18", "EchoTop18", "EchoTop18"),
    ("EchoTop30", "EchoTop30", "EchoTop30"),
    ("PrecipRate", "PrecipRate", "PrecipRate"),
    ("VIL Density", "VILDensity", "VILDensity"),
    ("Reflectivity at Lowest Altitude", "RALA", "RALA"),
    ("VII", "VII", "VII"),
)
HEIGHTS = (
    "00.50", "00.75", "01.00", "01.25", "01.50", "02.00", "02.50", "03.00", "03.50", "04.00", "04.50", "05.00", "05.50",
    "06.00", "06.50", "07.00", "07.50", "08.00", "08.50", "09.00", "10.00", "11.00", "12.00", "13.00", "14.00", "15.00",
)


def without_nan(df: DataFrame, *columns: str) -> DataFrame:
    """NaN becomes NULL, so that comparisons and maxima leave such gates out."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


#: Names under which a grid's values, coordinates and times may stand, in the order of preference (fixed values).
VALUES, LATITUDES, LONGITUDES = ("value", "reflectivity_combined", "unknown"), ("lat", "latitude", "y"), ("lon", "longitude", "x")
TIMES = ("time", "valid_time", "forecast_time", "reference_time")


def _pick(columns: list[str], names: tuple[str, ...]) -> str | None:
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[n] for n in names if n in by_lower), None)


def grid(
    spark: SparkSession, path: str, variables: tuple[str, ...] = VALUES, lat: tuple[str, ...] = LATITUDES, lon: tuple[str, ...] = LONGITUDES,
    lat_limits: tuple[float, float] | None = None, lon_limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Gates (.., lat, lon, value) from a long parquet table, under any of several column names, case-insensitively.

    Longitudes become 0..360 and NaN NULL. Limits (both included, longitudes 0..360) are turned into the file's own
    longitudes, of either convention, and so reach the scan. A table without such a column is an error: grid_status
    tells in advance.
    """
    found = spark.read.parquet(path)
    value, y, x = (_pick(found.columns, names) for names in (variables, lat, lon))
    if None in (value, y, x):
        raise ValueError(f"no column of {variables if value is None else lat if y is None else lon} in {path}")
    if lat_limits:
        found = found.where(F.col(y).between(min(lat_limits), max(lat_limits)))
    if lon_limits:
        a, b = min(lon_limits), max(lon_limits)
        found = found.where(F.col(x).between(a, b) | (F.col(x).between(a - 360, b - 360) & (F.col(x) < 0)))
    rest = [F.col(f"`{c}`") for c in found.columns if c not in (value, y, x)]
    plain = found.select(*rest, F.col(y).cast("double").alias("lat"), scalars.lon_360(F.col(x).cast("double")).alias("lon"), F.col(value).cast("double").alias("value"))
    return without_nan(plain, "value")


def grid_status(spark: SparkSession, path: str, variables: tuple[str, ...] = VALUES) -> str | None:
    """Why a grid can't be used, as the status that its cells get, or None if it can.

    DATASET_LOAD_ERROR: not there or not readable; EMPTY_DATASET: no gates; VAR_NOT_FOUND: no column of values or of
    coordinates. Grids too large for memory have no status here, as none is ever loaded whole.
    """
    try:
        found = spark.read.parquet(path)
        if found.isEmpty():
            return "EMPTY_DATASET"
    except PySparkException:
        return "DATASET_LOAD_ERROR"
    return None if all(_pick(found.columns, names) for names in (variables, LATITUDES, LONGITUDES)) else "VAR_NOT_FOUND"


def grid_time(gates: DataFrame, name: str) -> DataFrame:
    """(ts), one row: the time in a grid's name, or else the first of its time columns, as timestamps or nanoseconds since 1970."""
    column = _pick(gates.columns, TIMES)
    named = scalars.name_any(F.lit(name))
    if column is None:
        return gates.sparkSession.range(1).select(named.alias("ts"))
    own = F.col(column)
    if isinstance(gates.schema[column].dataType, (LongType, IntegerType, DoubleType)):
        own = F.timestamp_micros((own / 1000).cast("long"))
    return gates.agg(F.coalesce(named, F.min(own.cast("timestamp_ntz"))).alias("ts"))


def dense_grid(axes: DataFrame) -> DataFrame:
    """(i, j, lat, lon) of every gate of a grid given by rows (lat0, lon0, step, n_lat, n_lon)."""
    rows = axes.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_lat") - 1)))
    cells = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_lon") - 1)))
    return cells.select("i", "j", (F.col("lat0") + F.col("i") * F.col("step")).alias("lat"), (F.col("lon0") + F.col("j") * F.col("step")).alias("lon"))


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of GeoJSON feature collections, with their place in the file; a collection without features gives none.

    The id is the feature's, else its property ID; properties stay text, so a missing one differs from null.
    """
    feature = "struct<id:string,geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:map<string,string>>"
    files = spark.read.text(path, wholetext=True)
    features = F.from_json("value", f"struct<features:array<{feature}>>")["features"]
    rows = files.select(F.posexplode(features).alias("ordinal", "f"))
    ring = F.transform("f.geometry.coordinates", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    props = F.col("f.properties")
    key = F.coalesce(F.col("f.id"), F.try_element_at(props, F.lit("ID")))
    return rows.select("ordinal", key.try_cast("long").alias("id"), F.coalesce(ring, F.expr("array()").cast("array<array<struct<lon:double,lat:double>>>")).alias("rings"), props.alias("props"))


def listing(lines: DataFrame, line: str = "value") -> DataFrame:
    """(name) of data files in a listing's lines: the first href of each line, without folders, queries, `latest` and parents."""
    name = F.regexp_extract(line, 'href="([^"]+)"', 1)
    plain = (name != "") & ~name.endswith("/") & ~name.contains("?") & ~name.contains("=") & ~F.lower(name).contains("latest") & ~name.contains("..")
    data = name.rlike(r"\.(gz|grib2|nc|json)$") | name.rlike(r"\d{8}-\d{6}")
    return lines.where(plain & data).select(name.alias("name"))


def listed_files(lines: DataFrame, product: str, base: str, line: str = "value") -> DataFrame:
    """(product, url, ts) of a listing; names without a valid time have ts NULL."""
    found = listing(lines, line)
    return found.select(F.lit(product).alias("product"), scalars.join_url(F.lit(base), F.col("name")).alias("url"), scalars.name_minute(F.col("name")).alias("ts"))


def cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, history) of a JSON file of cells. Ids and gate counts may be numbers or text; an empty file has none."""
    raw = spark.read.schema(CELLS).option("multiLine", True).json(path).where("id IS NOT NULL")
    point = lambda p: F.struct(p[0].alias("lat"), p[1].alias("lon"))
    own = raw.select(F.col("id").cast("long").alias("cell_id"), F.col("num_gates").cast("long").alias("num_gates"), F.col("max_refl"), F.col("centroid")[0].alias("lat"), F.col("centroid")[1].alias("lon"), F.transform("bbox", point).alias("bbox"))
    h = raw.select(F.col("id").cast("long").alias("cell_id"), F.posexplode("storm_history").alias("seq", "h"))
    entries = h.select("cell_id", "seq", F.try_to_timestamp("h.timestamp").cast("timestamp_ntz").alias("ts"), "h.max_refl", F.col("h.num_gates").cast("long").alias("num_gates"), F.col("h.centroid")[0].alias("lat"), F.col("h.centroid")[1].alias("lon"), "h.dx", "h.dy", "h.dt")
    return own, entries


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(url, modified) of the files in a folder; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return found.select(F.col("path").alias("url"), F.col("modificationTime").alias("modified"))


def sweep_files(found: DataFrame, heights: DataFrame) -> DataFrame:
    """Files (url) with the height (height text) in their name, index files left out, in order of names."""
    name = scalars.base_name(F.col("url"))
    tagged = found.where(~F.col("url").endswith(".idx")).withColumn("height", F.regexp_extract(name, r"_(\d{2}\.\d{2})_", 1))
    return tagged.join(F.broadcast(heights.select("height").distinct()), "height").orderBy("url")  # a fixed list of heights
