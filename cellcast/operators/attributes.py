"""Polygon attributes for cells, and composite indices of the latest entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

#: Attributes of a cell and the polygon properties they come from (fixed values).
SOURCES = {
    "MLCAPE": "MLCAPE",
    "MUCAPE": "MUCAPE",
    "MLCIN": "MLCIN",
    "DCAPE": "DCAPE",
    "CAPE_M10M30": "CAPE_M10M30",
    "LCL": "LCL",
    "Wetbulb_0C_Hgt": "WETBULB_0C_HGT",
    "LLLR": "LLLR",
    "MLLR": "MLLR",
    "EBShear": "EBSHEAR",
    "SRH01km": "SRH01KM",
    "SRH02km": "SRW02KM",
    "SRW46km": "SRW46KM",
    "MeanWind_1-3kmAGL": "MEANWIND_1-3kmAGL",
    "LJA": "LJA",
    "CompRef": "COMPREF",
    "Ref10": "REF10",
    "Ref20": "REF20",
    "MESH": "MESH",
    "H50_Above_0C": "H50_Above_0C",
    "EchoTop50": "EchoTop_50",
    "VIL": "VIL",
    "MaxFED": "MaxFED",
    "MaxFCD": "MaxFCD",
    "AccumFCD": "AccumFCD",
    "MinFlashArea": "MinFlashArea",
    "TE@MaxFCD": "TE@MaxFCD",
    "FlashRate": "FLASH_RATE",
    "FlashDensity": "FLASH_DENSITY",
    "MaxLLAz": "MAXLLAZ",
    "p98LLAz": "P98LLAZ",
    "p98MLAz": "P98MLAZ",
    "MaxRC_Emiss": "MAXRC_EMISS",
    "ICP": "ICP",
    "PWAT": "PWAT",
    "avg_beam_hgt": "AVG_BEAM_HGT",
}


def attributes(cells: DataFrame, polygons: DataFrame, sources: dict[str, str] = SOURCES, id: str = "id") -> DataFrame:
    """Cells with a value and a status for each attribute of the polygon with their id (and scan, where both have one).

    Of polygons that repeat an id the last in file order counts; one without properties is no match. Without a match
    values are NULL and statuses NO_MATCH; a missing property is 0, one that isn't a number NULL with MATCH_ERROR.
    """
    by = [c for c in ("scan",) if c in cells.columns and c in polygons.columns]
    last = polygons.where(F.size("props") > 0).groupBy(*by, F.col("id").cast("long").alias(id)).agg(F.max_by("props", "ordinal").alias("props"))
    joined = cells.join(last, [*by, id], "left")
    columns = []
    for target, source in sources.items():
        value, status = scalars.number_of(F.col("props"), source)
        found = F.col("props").isNotNull()
        columns += [F.when(found, value).alias(target), F.when(found, status).otherwise("NO_MATCH").alias(f"{target}_status")]
    return joined.select(*[f"`{c}`" for c in cells.columns], *columns)


def indices(latest: DataFrame) -> DataFrame:
    """Composite indices from the latest entry of each cell; NULL where an operand is missing."""
    c = F.col
    return latest.select(
        "*",
        scalars.composite_echo_top(c("EchoTop18"), c("EchoTop30"), c("EchoTop50")).alias("CompET"),
        scalars.total_liquid(c("VIL"), c("VII")).alias("THL"),
        scalars.liquid_density(c("VIL"), c("VII"), c("EchoTop18")).alias("THLD"),
        scalars.precipitation_intensity(c("RALA"), c("PrecipRate"), c("MESH")).alias("PII"),
        scalars.flash_area_ratio(c("MinFlashArea"), c("num_gates")).alias("FAR"),
        scalars.ground_flash_ratio(c("CGFlashDensity"), c("FlashDensity")).alias("CGFlashRatio"),
    )
