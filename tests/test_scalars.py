import datetime

import pytest
from pyspark.sql import functions as F

from cellcast.functions import scalars as S

L = F.lit


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "column,want",
    [
        (lambda: S.lon_360(L(-75.0)), 285), (lambda: S.lon_180(L(285.0)), -75), (lambda: S.lon_180(L(180.0)), 180), (lambda: S.wrap_180(L(180.0)), -180), (lambda: S.wrap_360(L(-75.0)), 285),
        (lambda: S.haversine_km(L(40.0), L(280.0), L(40.1), L(280.2)), 20.3333396), (lambda: S.motion(L(40.0), L(280.0), L(40.1), L(280.2))[0], 16993.7273),
        (lambda: S.motion(L(40.0), L(280.0), L(40.1), L(280.2), S.LEGACY_DEGREE_M)[0], 17042.7183), (lambda: S.motion(L(40.0), L(280.0), L(40.1), L(280.2))[1], 11100),
        (lambda: S.degree_cost(L(0.05), L(0.05), L(20 / 100), L(5 / 55)), 0.0817173521), (lambda: S.composite_echo_top(L(12.0), L(8.0), L(0.0)), 9.2), (lambda: S.composite_echo_top(L(12.0), L(8.0), L(4.0)), 6.0),
        (lambda: S.composite_echo_top(L(12.0), L(None).cast("double"), L(4.0)), None), (lambda: S.total_liquid(L(30.0), L(10.0)), 40), (lambda: S.liquid_density(L(30.0), L(10.0), L(0.0)), None),
        (lambda: S.precipitation_intensity(L(50.0), L(20.0), L(25.0)), 0.7073777679), (lambda: S.ground_flash_ratio(L(2.0), L(0.0)), 0), (lambda: S.ground_flash_ratio(L(2.0), L(4.0)), 0.5),
        (lambda: S.normalize_diff(L(3.0), L(1.0), L(0.0)), 0), (lambda: S.distance_cost(L(11.0), L(0.0), L(0.0)), 1000), (lambda: S.half_even(L(0.125), 2), 0.12),
    ],
)
def test_goldens(spark, column, want):
    got = value(spark, column())
    assert got is None if want is None else got == pytest.approx(want, abs=1e-4 if abs(want) > 100 else 1e-7)


@pytest.mark.parametrize(
    "name,want",
    [
        ("MRMS_EchoTop_18_00.50_20251010-123456.grib2.gz", (12, 34)), ("MRMS_PROBSEVERE_20251010_120059.json", (12, 0)), ("s20252831234567", (12, 34)), ("x_20251399-123456", None),
        ("MRMS_MergedReflectivityQC_3D_20251010-010203.gz", (1, 2)), ("20251399-123456_20251010_010203", (1, 2)), ("plain", None), ("", None), (None, None),
        ("s20259991234567", None), ("s20253661234567", None), ("s20250001234567", None), ("s20259991234567_20251010-010203", (1, 2)),
    ],
)
def test_minutes_of_names(spark, name, want):
    got = value(spark, S.name_minute(L(name).cast("string")))
    assert got == (datetime.datetime(2025, 10, 10, *want) if want else None)


def test_times_of_product_names(spark):
    assert value(spark, S.name_any(L("a_20251010-1234.nc"))) == datetime.datetime(2025, 10, 10, 12, 34)
    assert value(spark, S.name_any(L("a_20251010_123456.nc"))) == datetime.datetime(2025, 10, 10, 12, 34, 56)
    assert value(spark, S.name_any(L("a_20251010.nc"))) == datetime.datetime(2025, 10, 10)
    assert value(spark, S.name_any(L("u1760099696"))) == datetime.datetime(2025, 10, 10, 12, 34, 56)
    for name, want in (("x_20251010123456.nc", (2025, 10, 10)), ("202513991234567890123456789.nc", (2034, 3, 5, 2, 51, 52)), ("x_20251399123456.nc", None), ("x_202513991234.nc", None), ("99999999999999999999", (2286, 11, 20, 17, 46, 39)), (None, None), ("", None)):
        got = value(spark, S.name_any(L(name).cast("string")))
        assert got == (want and datetime.datetime(*want)), (name, got)
    assert value(spark, S.parse_or_name(L("bad"), L("20251010-123456"))) == datetime.datetime(2025, 10, 10, 12, 34, 56)


def test_property_numbers(spark):
    m = F.create_map(L("a"), L("12.5"), L("b"), L(None).cast("string"), L("c"), L("x"), L("d"), L(" 5 "), L("e"), L("nan"))
    got = [(value(spark, S.number_of(m, k)[0]), value(spark, S.number_of(m, k)[1])) for k in "zabcde"]
    assert got == [(0.0, None), (12.5, None), (None, "MATCH_ERROR"), (None, "MATCH_ERROR"), (5.0, None), (None, "MATCH_ERROR")]
    assert value(spark, S.floats_in(L("(-1.5, 20) 3."))) == [-1.5, 20.0, 3.0]
