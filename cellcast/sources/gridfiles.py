"""Grids in GRIB2 and NetCDF-3 files, plain or gzipped, read by Spark from any store and decoded in tasks, row by row.

A file is read as bytes by Spark's own file source, so whatever store Spark reaches will do, and a task decodes one file
at a time, a band of grid rows after another. Only bands within the limits are decoded: packed values and NetCDF rows
are found by their offsets; a PNG, whose rows depend on those above, ends at the last row in the limits.
"""

from __future__ import annotations

import datetime
import gzip
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import LATITUDES, LONGITUDES, TIMES, VALUES

#: Grid rows that are decoded and handed on at a time.
BAND = 256
GRID = "url string, name string, ts timestamp_ntz, i int, j int, lat double, lon double, value double"


@dataclass
class Grid:
    """One grid of a file: its axes, and `rows(first, last)`, which decodes values of grid rows."""

    name: str
    ts: datetime.datetime | None
    lat: np.ndarray
    lon: np.ndarray
    rows: Callable[[int, int], np.ndarray]
    decoded: list[tuple[int, int]] = field(default_factory=list)


# --- GRIB2 (WMO manual on codes, FM 92; numbers below are octets as the manual counts them, from 1) -------------------------


def _signed(raw: bytes) -> int:
    """A number whose first bit is its sign."""
    value = int.from_bytes(raw, "big")
    top = 1 << (8 * len(raw) - 1)
    return value if value < top else top - value


def _grib(data: bytes) -> Iterator[Grid]:
    at = 0
    while (at := data.find(b"GRIB", at)) >= 0:
        if data[at + 7] != 2:
            raise ValueError("not an edition 2 message")
        end = at + int.from_bytes(data[at + 8 : at + 16], "big")
        if end > len(data) or data[end - 4 : end] != b"7777":
            raise ValueError("a message is cut short")
        sections: dict[int, bytes] = {0: data[at : at + 16]}
        at += 16
        while at < end - 4:
            size, number = int.from_bytes(data[at : at + 4], "big"), data[at + 4]
            if size < 5:
                raise ValueError("a section without a length")
            sections[number] = data[at : at + size]
            at += size
            if number == 7:
                yield _grib_grid(dict(sections))
        at = end


def _grib_grid(s: dict[int, bytes]) -> Grid:
    octet = lambda k, a, b: int.from_bytes(s[k][a - 1 : b], "big")
    if octet(3, 13, 14) != 0 or octet(3, 72, 72) & 0b00110000:
        raise ValueError("only grids of latitude and longitude, row by row, are read")
    wide, high = octet(3, 31, 34), octet(3, 35, 38)
    base, parts = octet(3, 39, 42), octet(3, 43, 46)
    unit = base / parts if base and parts not in (0, 0xFFFFFFFF) else 1e-6
    first = [_signed(s[3][a - 1 : b]) * unit for a, b in ((47, 50), (51, 54))]
    step = [octet(3, 68, 71) * unit, octet(3, 64, 67) * unit]
    mode = octet(3, 72, 72)
    lat = first[0] + np.arange(high) * (step[0] if mode & 0b01000000 else -step[0])
    lon = first[1] + np.arange(wide) * (-step[1] if mode & 0b10000000 else step[1])
    year, month, day, hour, minute, second = octet(1, 13, 14), *s[1][14:19]
    (reference,) = struct.unpack(">f", s[5][11:15])
    scale, decimal, bits, template = 2.0 ** _signed(s[5][15:17]), 10.0 ** -_signed(s[5][17:19]), s[5][19], octet(5, 10, 11)
    packed = s[7][5:]
    here = None
    if s[6][5] == 0:
        here = np.unpackbits(np.frombuffer(s[6], np.uint8, offset=6))[: wide * high].astype(bool)
    elif s[6][5] != 255:
        raise ValueError("only bitmaps of a message's own are read")
    before = np.concatenate([[0], np.cumsum(here)]) if here is not None else None
    if template == 41 and bits:
        picture = _Png(packed)
    elif template not in (0, 41):
        raise ValueError(f"data template 5.{template} isn't read")

    def rows(a: int, b: int) -> np.ndarray:
        low, top = (a * wide, b * wide) if before is None else (int(before[a * wide]), int(before[b * wide]))
        if not bits:
            number = np.zeros(top - low)
        elif template == 41:
            number = picture.values(low, top)
        else:
            number = _unpacked(packed, low, top, bits)
        value = (reference + number * scale) * decimal
        if before is not None:
            out = np.full((b - a) * wide, np.nan)
            out[here[a * wide : b * wide]] = value
            value = out
        return value.reshape(b - a, wide)

    name = f"{s[0][6]}.{s[4][9]}.{s[4][10]}"  # discipline, category, number
    return Grid(name, datetime.datetime(year, month, day, hour, minute, second), lat, lon, rows)


def _unpacked(data: bytes, low: int, top: int, bits: int) -> np.ndarray:
    """The numbers low..top-1 of a row of numbers of so many bits; only their bytes are looked at."""
    first, last = low * bits // 8, (top * bits + 7) // 8
    if last > len(data):
        raise ValueError("fewer values than the grid has")
    part = np.unpackbits(np.frombuffer(data, np.uint8, last - first, first))[low * bits - first * 8 :][: (top - low) * bits].reshape(-1, bits)
    return part @ (2.0 ** np.arange(bits - 1, -1, -1))


class _Png:
    """Grey values of a PNG picture, decoded from its top as far as they are asked for."""

    def __init__(self, data: bytes):
        if data[:8] != b"\x89PNG\r\n\x1a\n":
            raise ValueError("not a PNG picture")
        at, packed = 8, []
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"IHDR":
                self.wide, self.high, self.depth, colour, _, _, laced = struct.unpack(">IIBBBBB", data[at + 8 : at + 8 + size])
            elif kind == b"IDAT":
                packed.append(data[at + 8 : at + 8 + size])
            at += size + 12
        if laced or self.depth not in (8, 16) or colour not in (0, 2, 6):
            raise ValueError("a kind of PNG that isn't read")
        self.bytes = self.depth // 8 * {0: 1, 2: 3, 6: 4}[colour]  # numbers of 24 and 32 bits come as colours
        self.inflate, self.packed, self.rest = zlib.decompressobj(), b"".join(packed), b""
        self.done = np.zeros((0, self.wide * self.bytes), np.uint8)

    def values(self, low: int, top: int) -> np.ndarray:
        need = -(-top // self.wide) - len(self.done)
        if need > 0:
            size = self.wide * self.bytes + 1
            while len(self.rest) < need * size and (self.packed or self.inflate.unconsumed_tail):
                self.rest += self.inflate.decompress(self.packed, need * size - len(self.rest))
                self.packed = self.inflate.unconsumed_tail
            if len(self.rest) < need * size:
                raise ValueError("a PNG picture is cut short")
            lines = np.frombuffer(self.rest[: need * size], np.uint8).reshape(need, size)
            self.rest = self.rest[need * size :]
            above = self.done[-1] if len(self.done) else np.zeros(size - 1, np.uint8)
            self.done = np.concatenate([self.done, unfiltered(lines[:, 0], lines[:, 1:], above, self.bytes)])
        number = self.done.reshape(-1, self.bytes)[low:top].astype(np.float64)
        return number @ (256.0 ** np.arange(self.bytes - 1, -1, -1))


def unfiltered(kinds: np.ndarray, lines: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Lines of a PNG picture without their filters (0 none, 1 left, 2 up, 3 mean, 4 nearest of left, up and corner).

    A byte depends on the one `step` before it, and on those above both. So all bytes of one slanting front, a line
    lower for every `step` bytes further left, are worked out together.
    """
    if not np.isin(kinds, (0, 1, 2, 3, 4)).all():
        raise ValueError("an unknown PNG filter")
    n, size = lines.shape
    wide = size // step
    out = np.zeros((n + 1, wide + 1, step), np.int16)  # with a line above and a column to the left
    out[0, 1:] = above.reshape(wide, step)
    raw, kind = lines.reshape(n, wide, step), kinds.astype(np.int64)
    if not (kind > 2).any():
        for r in range(n):
            line = raw[r].astype(np.int64)
            line = np.cumsum(line, 0) if kind[r] == 1 else line + out[r, 1:] if kind[r] == 2 else line
            out[r + 1, 1:] = line & 255
        return out[1:, 1:].astype(np.uint8).reshape(n, size)
    for front in range(n + wide - 1):
        r = np.arange(max(0, front - wide + 1), min(n, front + 1))
        c = front - r
        left, up, corner, k = out[r + 1, c], out[r, c + 1], out[r, c], kind[r][:, None]
        guess = left + up - corner
        a, b, d = abs(guess - left), abs(guess - up), abs(guess - corner)
        nearest = np.where((a <= b) & (a <= d), left, np.where(b <= d, up, corner))
        out[r + 1, c + 1] = (raw[r, c] + np.choose(k, [np.zeros_like(left), left, up, (left + up) >> 1, nearest])) & 255
    return out[1:, 1:].astype(np.uint8).reshape(n, size)


# --- NetCDF-3 (classic format and its 64-bit offsets) --------------------------------------------------------------------------

_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def _netcdf(data: bytes, variables: tuple[str, ...]) -> Iterator[Grid]:
    at = 4
    wide_offsets = data[3] == 2

    def number(size: int = 4) -> int:
        nonlocal at
        if at + size > len(data):
            raise ValueError("a header is cut short")
        at += size
        return int.from_bytes(data[at - size : at], "big", signed=True)

    def text() -> str:
        nonlocal at
        size = number()
        found = data[at : at + size].decode()
        at += -(-size // 4) * 4
        return found

    def attributes() -> dict:
        nonlocal at
        _, count, found = number(), number(), {}
        for _ in range(count):
            name, kind, many = text(), number(), number()
            size = many * np.dtype(_TYPES[kind]).itemsize
            raw = data[at : at + size]
            at += -(-size // 4) * 4
            found[name] = raw.decode("latin-1") if kind == 2 else np.frombuffer(raw, _TYPES[kind])
        return found

    records = number()
    _, count = number(), number()
    dims = [(text(), number()) for _ in range(count)]
    attributes()
    _, count = number(), number()
    known = {}
    for _ in range(count):
        name = text()
        shape = [number() for _ in range(number())]
        more = attributes()
        kind, _, begin = number(), number(), number(8 if wide_offsets else 4)
        known[name.lower()] = (name, shape, more, np.dtype(_TYPES[kind]), begin)
    recorded = [v for v in known.values() if v[1] and dims[v[1][0]][1] == 0]
    sizes = lambda shape: [records if dims[d][1] == 0 else dims[d][1] for d in shape]
    item = lambda v: int(np.prod([dims[d][1] for d in v[1][1:]], dtype=np.int64)) * v[3].itemsize
    stride = sum(-(-item(v) // 4) * 4 for v in recorded) if len(recorded) > 1 else sum(map(item, recorded))

    def read(v: tuple, first: int, many: int) -> np.ndarray:
        """So many values of a variable in order; of a variable by records, all from one record."""
        _, shape, more, kind, begin = v
        if v in recorded:
            each = item(v) // kind.itemsize
            if each > many or first % each:
                begin, first = begin + first // each * stride, first % each
            else:
                parts = [np.frombuffer(data, kind, each, begin + r * stride) for r in range(first // each, (first + many) // each)]
                return np.concatenate(parts) if parts else np.zeros(0, kind)
        return np.frombuffer(data, kind, many, begin + first * kind.itemsize)

    pick = lambda names: next((known[n] for n in names if n in known), None)
    y, x, v = pick(LATITUDES), pick(LONGITUDES), pick(variables)
    if None in (y, x, v):
        raise KeyError("no variable of values or coordinates")
    lat, lon = (read(c, 0, int(np.prod(sizes(c[1]), dtype=np.int64))).astype(float) for c in (y, x))
    shape = sizes(v[1])
    if shape[-2:] != [len(lat), len(lon)]:
        raise ValueError("values aren't by latitude and longitude")
    times = [known[n] for n in TIMES if n in known]
    scale, offset = (float(v[2][k][0]) if k in v[2] else d for k, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
    missing = [float(v[2][k][0]) for k in ("_FillValue", "missing_value") if k in v[2]]
    for layer in range(int(np.prod(shape[:-2], dtype=np.int64))):

        def rows(a: int, b: int, layer: int = layer) -> np.ndarray:
            value = read(v, (layer * len(lat) + a) * len(lon), (b - a) * len(lon)).astype(float)
            gone = np.isin(value, missing)
            return np.where(gone, np.nan, value * scale + offset).reshape(b - a, len(lon))

        ts = None
        if times and layer < int(np.prod(sizes(times[0][1]), dtype=np.int64)):
            ts = _time(read(times[0], layer, 1)[0], times[0][2].get("units", ""))
        yield Grid(v[0], ts, lat, lon, rows)


def _time(value: float, units: str) -> datetime.datetime | None:
    """A time as so many seconds, minutes, hours or days since another."""
    unit, _, since = units.partition(" since ")
    each = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}.get(unit.strip().rstrip("s"))
    if each is None or not since:
        return None
    return datetime.datetime.fromisoformat(since.strip()[:19]) + datetime.timedelta(seconds=float(value) * each)


# --- reading ----------------------------------------------------------------------------------------------------------------------


def grids(data: bytes, variables: tuple[str, ...] = VALUES) -> Iterator[Grid]:
    """The grids of a file's bytes. What is neither format, or damaged, is a ValueError; no variable to read, a KeyError."""
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError, zlib.error) as e:
            raise ValueError("damaged gzip") from e
    try:
        if data[:3] == b"CDF" and data[3:4] in (b"\x01", b"\x02"):
            yield from _netcdf(data, variables)
        elif b"GRIB" in data[:64]:
            yield from _grib(data)
        else:
            raise ValueError("neither GRIB2 nor NetCDF-3")
    except (IndexError, struct.error, zlib.error, UnicodeDecodeError, OverflowError) as e:
        raise ValueError("a damaged file") from e


def within(grid: Grid, lat_limits: tuple[float, float] | None, lon_limits: tuple[float, float] | None, band: int = BAND) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, values) of a grid's gates within limits (both included, longitudes 0..360), a band of rows at a time.

    Bands without a row in the limits aren't decoded; a band begins and ends with such rows.
    """
    lon = np.where(grid.lon < 0, grid.lon + 360, grid.lon)
    inside = lambda axis, limits: np.flatnonzero((axis >= min(limits)) & (axis <= max(limits))) if limits else np.arange(len(axis))
    i, j = inside(grid.lat, lat_limits), inside(lon, lon_limits)
    if not len(j):
        return
    for k in np.unique(i // band):
        own = i[i // band == k]
        a, b = int(own[0]), int(own[-1]) + 1
        grid.decoded.append((a, b))
        yield own, j, grid.rows(a, b)[own - a][:, j]


def read(spark: SparkSession, path: str, lat_limits: tuple[float, float] | None = None, lon_limits: tuple[float, float] | None = None, variables: tuple[str, ...] = VALUES, pattern: str = "*") -> DataFrame:
    """GRID, the gates of all grids in files at `path`, within limits (both included, longitudes 0..360).

    i and j are the place in the file; longitudes become 0..360, missing values NULL. GRIB2 messages are named by their
    place in the code tables and have their reference time, NetCDF variables their name and time, if they have one.
    Files that can't be used have no rows: `status` says why.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    for grid in grids(content.as_py(), variables):
                        for i, j, value in within(grid, lat_limits, lon_limits):
                            yield _batch(url.as_py(), grid, i, j, value)
                except (ValueError, KeyError):
                    continue

    return files.mapInArrow(run, GRID)


def _batch(url: str, grid: Grid, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    n = value.size
    lon = np.where(grid.lon < 0, grid.lon + 360, grid.lon)
    columns = [pa.array([url] * n), pa.array([grid.name] * n), pa.array([grid.ts] * n, pa.timestamp("us")), pa.array(np.repeat(i, len(j)).astype(np.int32)), pa.array(np.tile(j, len(i)).astype(np.int32)), pa.array(np.repeat(grid.lat[i], len(j))), pa.array(np.tile(lon[j], len(i))), pa.array(value.ravel(), mask=np.isnan(value.ravel()))]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in GRID.split(", ")])


def status(spark: SparkSession, path: str, variables: tuple[str, ...] = VALUES, pattern: str = "*") -> DataFrame:
    """(url, status) of each file: DATASET_LOAD_ERROR, EMPTY_DATASET, VAR_NOT_FOUND, or NULL for one that can be used.

    Headers and the first row are read; damage further on shows when it is decoded. Files without a byte aren't listed by
    Spark. No file is loaded as a whole grid,
    so there is no MEMORY_ERROR.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def state(content: bytes) -> str | None:
        try:
            found = list(grids(content, variables))
            if not found or not all(len(g.lat) and len(g.lon) for g in found):
                return "EMPTY_DATASET"
            for g in found:
                g.rows(0, 1)
        except KeyError:
            return "VAR_NOT_FOUND"
        except ValueError:
            return "DATASET_LOAD_ERROR"
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([state(c.as_py()) for c in batch.column(1)], pa.string())], ["url", "status"])

    return files.mapInArrow(run, "url string, status string")


# --- writing ------------------------------------------------------------------------------------------------------------------------


def encode_grib(value: np.ndarray, lat0: float, lon0: float, step: float, ts: datetime.datetime, png: bool = False, bits: int = 16, decimals: int = 1) -> bytes:
    """A grid as a GRIB2 message: rows from `lat0` upwards, columns from `lon0`; NaN is left out by a bitmap, or as least value in PNG."""
    high, wide = value.shape
    number = np.round(value * 10**decimals)
    low = float(np.nanmin(number)) if np.isfinite(number).any() else 0.0
    here = np.isfinite(value)
    whole = np.where(here, number - low, 0).astype(np.int64)
    if whole.max(initial=0) >= 1 << bits:
        raise ValueError("more bits are needed")
    sign = lambda x, n: (abs(int(x)) | (1 << (8 * n - 1) if x < 0 else 0)).to_bytes(n, "big")
    micro = lambda x: sign(round(x * 1e6), 4)
    last = lat0 + (high - 1) * step, lon0 + (wide - 1) * step
    kept = whole[here]
    if png:
        plain = np.zeros(whole.size, ">u2")  # all numbers that are there, then zeros to the picture's end
        plain[: len(kept)] = kept
        raw = b"".join(b"\2" + line.tobytes() for line in np.diff(plain.reshape(high, wide).view(np.uint8).astype(np.int16), axis=0, prepend=0).astype(np.uint8))
        chunk = lambda k, x: struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x))
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
        bits = 16
    else:
        data = np.packbits((kept[:, None] >> np.arange(bits - 1, -1, -1)) & 1).tobytes()
    section = lambda k, x: struct.pack(">IB", len(x) + 5, k) + x
    parts = [
        section(1, struct.pack(">HHBBBHBBBBBBB", 161, 0, 2, 1, 0, ts.year, ts.month, ts.day, ts.hour, ts.minute, ts.second, 0, 1)),
        section(3, struct.pack(">BIBBH", 0, wide * high, 0, 0, 0) + b"\6" + bytes(15) + struct.pack(">IIII", wide, high, 0, 0xFFFFFFFF) + micro(lat0) + micro(lon0) + b"\x30" + micro(last[0]) + micro(last[1]) + micro(step) * 2 + b"\x40"),
        section(4, struct.pack(">HHBB", 0, 0, 9, 0) + bytes(23)),
        section(5, struct.pack(">IH", len(kept), 41 if png else 0) + struct.pack(">f", low) + sign(0, 2) + sign(decimals, 2) + bytes([bits, 0])),
        section(6, b"\xff" if here.all() else b"\0" + np.packbits(here.ravel()).tobytes()),
        section(7, data),
    ]
    body = b"".join(parts) + b"7777"
    return b"GRIB\0\0\xd1\2" + (len(body) + 16).to_bytes(8, "big") + body


def encode_netcdf(value: np.ndarray, lat0: float, lon0: float, step: float, ts: datetime.datetime, name: str = "unknown") -> bytes:
    """A grid as a NetCDF-3 file of 64-bit offsets with a time, values as floats."""
    high, wide = value.shape
    pad = lambda x: x + bytes(-len(x) % 4)
    text = lambda x: struct.pack(">i", len(x)) + pad(x.encode())
    attribute = lambda n, kind, many, raw: text(n) + struct.pack(">ii", kind, many) + pad(raw)
    units = "seconds since 1970-01-01T00:00:00"
    shapes = [("time", [0], 6, [attribute("units", 2, len(units), units.encode())], struct.pack(">d", (ts - datetime.datetime(1970, 1, 1)).total_seconds()))]
    shapes += [(n, [d], 6, [], (a + np.arange(m) * step).astype(">f8").tobytes()) for n, d, a, m in (("latitude", 1, lat0, high), ("longitude", 2, lon0, wide))]
    shapes.append((name, [0, 1, 2], 5, [attribute("_FillValue", 5, 1, struct.pack(">f", -999.0))], np.nan_to_num(value, nan=-999.0).astype(">f4").tobytes()))

    def header(begin: int) -> bytes:
        out = b"CDF\2" + struct.pack(">iii", 0, 10, 3) + b"".join(text(n) + struct.pack(">i", m) for n, m in (("time", 1), ("latitude", high), ("longitude", wide)))
        out += struct.pack(">iiii", 0, 0, 11, len(shapes))
        for n, dims, kind, more, raw in shapes:
            out += text(n) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + struct.pack(">ii", 12 if more else 0, len(more)) + b"".join(more) + struct.pack(">iiq", kind, len(pad(raw)), begin)
            begin += len(pad(raw))
        return out

    return header(len(header(0))) + b"".join(pad(s[4]) for s in shapes)


def write(gates: DataFrame, path: str, kind: str, lat0: float, lon0: float, step: float, ts: datetime.datetime) -> DataFrame:
    """(url), when done, of the files written below `path`, one for each scan of gates (scan, i, j, value): grib, grib-png or netcdf.

    A task holds one scan's grid. `path` is a folder that all tasks share, named by a URI.
    """
    encode = {"grib": encode_grib, "grib-png": lambda *a: encode_grib(*a, png=True), "netcdf": encode_netcdf}[kind]
    ending = "nc" if kind == "netcdf" else "grib2"

    def store(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        value = np.full((int(pdf.i.max()) + 1, int(pdf.j.max()) + 1), np.nan)
        value[pdf.i, pdf.j] = pdf.value
        system, folder = pyarrow.fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/{key[0]}.{ending}"
        with system.open_output_stream(f"{name}.part") as out:
            out.write(encode(value, lat0, lon0, step, ts))
        system.move(f"{name}.part", name)  # a task that is run again writes the same file
        return pd.DataFrame({"url": [name]})

    return gates.select("scan", "i", "j", "value").groupBy("scan").applyInPandas(store, "url string")
