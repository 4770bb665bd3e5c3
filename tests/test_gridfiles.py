"""Grid files: values, windows that decode only their bands, and what can't be read."""

import datetime as dt
import gzip
import struct

import numpy as np
import pytest

from cellcast.sources import gridfiles

NOW = dt.datetime(2025, 10, 10, 12, 34, 56)


def sample(high=40, wide=30, seed=1, holes=0.1):
    rnd = np.random.default_rng(seed)
    value = np.round(rnd.random((high, wide)) * 80 - 10, 1)
    value[rnd.random((high, wide)) < holes] = np.nan
    return value


ENCODERS = {"grib": gridfiles.encode_grib, "png": lambda *a: gridfiles.encode_grib(*a, png=True), "odd bits": lambda *a: gridfiles.encode_grib(*a, bits=11), "netcdf": gridfiles.encode_netcdf}


@pytest.mark.parametrize("kind", ENCODERS)
@pytest.mark.parametrize("holes", [0.0, 0.3, 1.0])
def test_values_come_back(kind, holes):
    value = sample(holes=holes)
    (grid,) = gridfiles.grids(gzip.compress(ENCODERS[kind](value, -5.0, 250.0, 0.5, NOW)))
    assert grid.ts == NOW and np.allclose(grid.lat, -5 + np.arange(40) * 0.5) and np.allclose(grid.lon, 250 + np.arange(30) * 0.5)
    assert np.allclose(grid.rows(0, 40), value, atol=1e-5, equal_nan=True)
    assert np.allclose(grid.rows(7, 12), value[7:12], atol=1e-5, equal_nan=True)


@pytest.mark.parametrize("kind", ENCODERS)
def test_only_bands_in_the_window_are_decoded(kind):
    value = sample(400, 20)
    (grid,) = gridfiles.grids(ENCODERS[kind](value, 0.0, 350.0, 0.1, NOW))
    found = list(gridfiles.within(grid, (20.0, 26.0), (350.5, 351.0), band=50))
    assert grid.decoded == [(200, 250), (250, 261)]
    assert np.allclose(np.concatenate([v for *_, v in found]), value[200:261, 5:11], atol=1e-5, equal_nan=True)
    assert list(gridfiles.within(grid, (90.0, 91.0), None)) == [] and list(gridfiles.within(grid, None, (10.0, 20.0))) == []


@pytest.mark.parametrize("kinds", [(0, 1, 2), (0, 1, 2, 3, 4)])
@pytest.mark.parametrize("step", [1, 2, 3])
def test_picture_filters(kinds, step):
    rnd = np.random.default_rng(step)
    plain = rnd.integers(0, 256, (25, 12 * step))
    kind = rnd.choice(kinds, 25)
    out = np.zeros_like(plain)
    for r in range(25):  # the encoder, byte by byte
        for c in range(plain.shape[1]):
            left, up, corner = (int(plain[y, x]) if y >= 0 and x >= 0 else 0 for y, x in ((r, c - step), (r - 1, c), (r - 1, c - step)))
            guess = left + up - corner
            nearest = min((left, up, corner), key=lambda x: abs(guess - x))
            out[r, c] = (plain[r, c] - (0, left, up, (left + up) // 2, nearest)[kind[r]]) % 256
    got = gridfiles.unfiltered(kind.astype(np.uint8), out.astype(np.uint8), np.zeros(12 * step, np.uint8), step)
    assert (got == plain).all()
    with pytest.raises(ValueError):
        gridfiles.unfiltered(np.full(25, 7), out.astype(np.uint8), np.zeros(12 * step, np.uint8), step)


def test_netcdf_records_of_several_variables():
    """Two times of two variables by records, packed as scaled whole numbers, latitudes falling."""
    text = lambda x: struct.pack(">i", len(x)) + x.encode() + bytes(-len(x) % 4)
    value = np.arange(2 * 3 * 5).reshape(2, 3, 5).astype(">i2")

    def header(at):
        out = b"CDF\1" + struct.pack(">iii", 2, 10, 3) + text("time") + struct.pack(">i", 0) + text("y") + struct.pack(">i", 3) + text("x") + struct.pack(">i", 5) + struct.pack(">iiii", 0, 0, 11, 4)
        out += text("y") + struct.pack(">ii", 1, 1) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 5, 12, at)
        out += text("x") + struct.pack(">ii", 1, 2) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 5, 20, at + 12)
        more = struct.pack(">ii", 12, 2) + text("scale_factor") + struct.pack(">iid", 6, 1, 0.5) + text("missing_value") + struct.pack(">ii", 3, 1) + struct.pack(">h", 7) + bytes(2)
        out += text("Unknown") + struct.pack(">iiii", 3, 0, 1, 2) + more + struct.pack(">iii", 3, 32, at + 32)
        return out + text("other") + struct.pack(">ii", 1, 0) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 4, 4, at + 64)

    data = header(len(header(0))) + np.array([3, 2, 1], ">f4").tobytes() + np.array([-10, -5, 0, 5, 10], ">f4").tobytes()
    for t in range(2):
        data += value[t].tobytes() + bytes(2) + struct.pack(">i", t)
    found = list(gridfiles.grids(data))
    assert len(found) == 2
    for t, grid in enumerate(found):
        want = np.where(value[t] == 7, np.nan, value[t] * 0.5)
        assert np.allclose(grid.rows(0, 3), want, equal_nan=True) and np.allclose(grid.rows(1, 2), want[1:2], equal_nan=True)
    i, j, v = next(gridfiles.within(found[1], (2.0, 3.0), (350.0, 360.0)))
    assert i.tolist() == [0, 1] and j.tolist() == [0, 1] and np.allclose(v, value[1][:2, :2] * 0.5)


def test_files_and_statuses(spark, tmp_path):
    value = sample()
    whole = gridfiles.encode_grib(value, 20.0, 280.0, 0.1, NOW)
    cases = {
        "good.grib2": (whole, None), "two.grib2": (whole + gridfiles.encode_grib(value, 20.0, 280.0, 0.1, NOW, True), None), "good.nc.gz": (gzip.compress(gridfiles.encode_netcdf(value, 20.0, 280.0, 0.1, NOW)), None),
        "cut.grib2": (whole[:-40], "DATASET_LOAD_ERROR"), "text.nc": (b"no grid", "DATASET_LOAD_ERROR"), "bad.gz": (b"\x1f\x8b123", "DATASET_LOAD_ERROR"), "hdf.nc": (b"\x89HDF\r\n\x1a\n" + bytes(50), "DATASET_LOAD_ERROR"),
        "other.nc": (gridfiles.encode_netcdf(value, 20.0, 280.0, 0.1, NOW, "humidity"), "VAR_NOT_FOUND"), "empty.nc": (gridfiles.encode_netcdf(np.zeros((0, 3)), 20.0, 280.0, 0.1, NOW), "EMPTY_DATASET"), "cut.nc": (gridfiles.encode_netcdf(value, 20.0, 280.0, 0.1, NOW)[:150], "DATASET_LOAD_ERROR"),
    }
    for name, (data, _) in cases.items():
        (tmp_path / name).write_bytes(data)
    assert {r.url.rsplit("/", 1)[1]: r.status for r in gridfiles.status(spark, str(tmp_path)).collect()} == {n: s for n, (_, s) in cases.items()}
    got = gridfiles.read(spark, str(tmp_path), (21.0, 22.0), (281.0, 281.5)).collect()
    assert {r.url.rsplit("/", 1)[1] for r in got} == {"good.grib2", "two.grib2", "good.nc.gz"} and len(got) == 4 * 11 * 6
    for r in got:
        want = value[r.i, r.j]
        assert (r.value is None) == bool(np.isnan(want)) and (r.value is None or abs(r.value - want) < 1e-5)
        assert r.ts == NOW and abs(r.lat - 20 - r.i * 0.1) < 1e-6 and abs(r.lon - 280 - r.j * 0.1) < 1e-6
    assert {r.name for r in got} == {"0.9.0", "unknown"} or {r.name for r in got} == {"209.9.0", "unknown"}
    gates = spark.createDataFrame([(s, i, j, float(value[i, j])) for s in ("a", "b") for i in range(40) for j in range(30) if value[i, j] == value[i, j]], "scan string, i int, j int, value double")
    for kind in ("grib", "grib-png", "netcdf"):
        path = (tmp_path / kind).as_uri()
        assert gridfiles.write(gates, path, kind, 20.0, 280.0, 0.1, NOW).count() == 2
        back = gridfiles.read(spark, path).where("value IS NOT NULL")
        assert back.count() == gates.count() and back.where("abs(lat - 20 - i * 0.1) > 1e-6").count() == 0
