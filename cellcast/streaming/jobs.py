"""Structured Streaming: the trigger on common minutes, deduplicated scans, and the tracker by micro-batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import scalars
from ..operators import history as hist
from ..operators import schedule
from ..sources.scratch import cut, passing

#: Seconds between polls, hours that late files count, minutes that inputs are kept.
POLL, LATE, KEEP = "15 seconds", "1 hour", 20
#: Versions of a stream's table that are kept: the newest ones, as a restarted batch reads the one before.
VERSIONS = 2
#: How far a time may lie after the clock: what is later comes from a wrong name and would move watermarks past all real rows.
AHEAD = "5 minutes"


def _come(ts: Column, ahead: str = AHEAD) -> Column:
    """Whether a time isn't after now, but for a tolerance."""
    return ts.cast("timestamp") <= F.current_timestamp() + F.expr(f"INTERVAL {ahead}")


def retained(files: DataFrame, minutes: int = KEEP, by: str = "ts") -> DataFrame:
    """Files of a stream that are at most `minutes` older than the newest ones seen in earlier batches: the watermark drops others.

    Rows of equal (product, url, time) count once, as state is kept for so long. Times after now are dropped.
    """
    timed = files.where(F.col(by).isNotNull() & _come(F.col(by))).withColumn(by, F.col(by).cast("timestamp")).withWatermark(by, f"{minutes} minutes")
    return timed.dropDuplicates(["product", "url", by])


def complete_windows(files: DataFrame, products: int, size: str = "1 minute", late: str = LATE) -> DataFrame:
    """(start) of the windows in which all products have a file, once the watermark has closed them. Times after now are dropped."""
    windows = files.where(F.col("ts").isNotNull() & _come(F.col("ts"))).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size)).agg(F.collect_set("product").alias("p"))
    return windows.where(F.size("p") >= products).select(F.col("window.start").cast("timestamp_ntz").alias("start"))


def once(scans: DataFrame, late: str = LATE) -> DataFrame:
    """Entries (cell_id, ts, ...) of which each is let through once while the watermark holds. Times after now are dropped."""
    return scans.where(_come(F.col("ts"))).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["cell_id", "ts"])


def poll(files: DataFrame, process: Callable[[SparkSession, object], None], checkpoint: str, back_hours: int = 1, every: str | None = POLL, unit: str = "minute") -> StreamingQuery:
    """Calls `process(spark, minute)` when a newer minute is common to all products seen in the last hours.

    Seen files are kept as (product, minute) in a table below the checkpoint; progress only moves forward, also across
    restarts. Minutes after now are left out, until they have come. Tables that `process` stores with `scratch.cut` go
    when its batch is done. `process` runs before that is stored: if the driver is lost in between, it is called again for the same
    minute, so it must be safe to repeat. every=None processes what is there and stops.
    """
    state = f"{checkpoint.rstrip('/')}/minutes"

    def batch(rows: DataFrame, number: int) -> None:
        with passing(rows.sparkSession):
            step(rows, number)

    def step(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        store = _stored(spark, state, number)
        known = schedule.minutes(rows, unit).withColumn("done", F.lit(False))
        known = (store.unionByName(known) if store is not None else known).groupBy("product", "minute").agg(F.bool_or("done").alias("done"))
        known = cut(known.withColumn("here", _come(F.col("minute"))))
        newest = known.where("here").agg(F.max("minute").alias("m")).first().m
        if newest is None:
            _write(known.drop("here"), state, number)
            return
        recent = F.col("minute") >= F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {back_hours} HOUR")
        seen = known.where("here").where(recent)
        found = schedule.latest_common(seen.select("product", F.col("minute").alias("ts")), unit).first().minute
        last = seen.where("done").agg(F.max("minute").alias("m")).first().m
        if found is not None and (last is None or found > last):
            process(spark, found)
            known = known.withColumn("done", F.col("done") | F.col("here") & (F.col("minute") <= F.lit(found).cast("timestamp_ntz")))
        # what is to come is kept for a day, so wrong names don't pile up
        soon = ~F.col("here") & _come(F.col("minute"), "1 day")
        _write(known.where(F.col("here") & recent | soon).drop("here"), state, number)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint.rstrip('/')}/progress")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _stored(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """The newest table below `path` written before batch `number`."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(context._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    earlier = [int(n.split("=")[1]) for n in names if n.startswith("batch=") and int(n.split("=")[1]) < number]
    return spark.read.parquet(f"{path}/batch={max(earlier)}") if earlier else None


def _write(df: DataFrame, path: str, number: int) -> None:
    """Stores a version of a table below `path` and removes those that no batch can read again."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")
    context = df.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(context._jsc.hadoopConfiguration())
    stored = sorted((int(s.getPath().getName().split("=")[1]), s.getPath()) for s in fs.listStatus(place) if s.getPath().getName().startswith("batch="))
    for _, old in stored[:-VERSIONS]:
        fs.delete(old, True)


def track(scans: DataFrame, path: str, checkpoint: str, every: str | None = POLL) -> StreamingQuery:
    """Keeps a history table of cells from a stream of whole scans (cell_id, ts, max_refl, num_gates, lat, lon).

    A micro-batch may hold any number of scans; they count in time order, all at once. A cell that a scan lacks ends
    with its history there, and if it comes back it begins anew; scans that aren't newer than the table change nothing,
    nor do entries without a time or cell. Of a cell's several entries of one scan one counts. The newest versions of
    the table lie below `path`.
    """
    fields = ["cell_id", "ts", "max_refl", "num_gates", "lat", "lon"]

    def batch(rows: DataFrame, number: int) -> None:
        with passing(rows.sparkSession):
            step(rows, number)

    def step(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        state = _stored(spark, path, number)
        last = state.agg(F.max("ts").alias("t")).first().t if state is not None else None
        rows = rows.select(*fields).withColumn("ts", F.col("ts").cast("timestamp_ntz")).where("ts IS NOT NULL AND cell_id IS NOT NULL").where(_come(F.col("ts")))
        fresh = rows.where(F.col("ts") > F.lit(last).cast("timestamp_ntz")) if last else rows
        fresh = cut(fresh.groupBy("cell_id", "ts").agg(F.min(F.struct(*fields[2:])).alias("e")).select("cell_id", "ts", "e.*"))  # the same one in a repeated batch
        # scans numbered from the newest back: a row for each scan, as for the driver of a plain loop
        scans = fresh.select("ts").distinct().withColumn("back", F.row_number().over(W.orderBy(F.desc("ts"))))
        n = scans.count()
        if not n:
            if state is not None:
                _write(state, path, number)
            return
        newest = W.partitionBy("cell_id").orderBy("back")
        # of each cell the run of scans up to the newest without a gap
        run = fresh.join(scans, "ts").withColumn("k", F.row_number().over(newest)).where("k = back").drop("k")
        new = run.select(*fields, F.lit(None).cast("int").alias("seq"))
        if state is not None:
            whole = run.groupBy("cell_id").agg(F.count("*").alias("n")).where(F.col("n") == n).select("cell_id")
            new = state.select(*fields, "seq").join(whole, "cell_id", "left_semi").unionByName(new)
        kept = hist.kept_entries(new, ["max_refl", "num_gates", "lat", "lon"], order="ts")
        numbered = kept.withColumn("seq", (F.row_number().over(W.partitionBy("cell_id").orderBy("ts")) - 1).cast("int"))
        _write(numbered.select(*fields, "seq"), path, number)

    writer = scans.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


#: Shards of the tracker's state.
SHARDS = 64
_CELL = "cell_id long, ts timestamp, max_refl double, num_gates long, lat double, lon double, life timestamp, seq int, kept_ts timestamp, kept_refl double, kept_gates long, kept_lat double, kept_lon double"
TRACKS = "cell_id long, life timestamp, seq int, ts timestamp, max_refl double, num_gates long, lat double, lon double, dx double, dy double, dt double, ended boolean"


def _tracker() -> StatefulProcessor:
    """A processor that names nothing of this package, as the process that sets it up for a stream may not find it."""
    cell, names, metres = _CELL, [f.split()[0] for f in TRACKS.split(", ")], scalars.DEGREE_M

    class Tracker(StatefulProcessor):
        """Follows the cells of a shard from scan to scan; its list state has a row for each cell that is alive, and no history.

        Rows are entries of cells, and markers (cell_id NULL) that say that a scan is complete: cells that it lacks end.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.cells = handle.getListState("cells", cell)
            self.last = handle.getValueState("last", "ts timestamp")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat([r.drop(columns="shard") for r in rows])
            alive = {c[0]: list(c) for c in self.cells.get()}
            last = self.last.get()[0] if self.last.exists() else None
            fields = ["cell_id", "ts", "max_refl", "num_gates", "lat", "lon"]
            batch = batch.sort_values(["ts", *fields[2:]], kind="stable", na_position="last")
            if last is not None:
                batch = batch[batch.ts > last]  # a scan counts once, and none that is older
            own = batch[batch.cell_id.notna()].drop_duplicates(["ts", "cell_id"])
            times = batch.ts.drop_duplicates()
            ends = own.ts.searchsorted(times, side="right").tolist()
            # plain values, once for the whole batch
            values = [own[c].astype(object).where(own[c].notna(), None).tolist() for c in fields[2:]]
            entries = list(zip(own.cell_id.astype("int64").tolist(), *values, strict=True))
            out, start = [], 0
            for ts, end in zip(times, ends, strict=True):
                last = ts = ts.to_pydatetime()
                here, start = {e[0]: e for e in entries[start:end]}, end
                for id in [c for c in alive if c not in here]:
                    c = alive.pop(id)
                    out.append((id, c[6], c[7], c[1], *c[2:6], None, None, None, True))
                for id, (_, refl, gates, lat, lon) in here.items():
                    new = [refl, None if gates is None else int(gates), lat, lon]
                    c = alive.get(id)
                    if c is None:
                        alive[id] = [id, ts, *new, ts, 0, ts, *new]
                        out.append((id, ts, 0, ts, *new, None, None, None, False))
                        continue
                    c[1:6] = [ts, *new]
                    if None in new or new != c[9:13]:
                        dx = dy = None
                        if None not in (lat, lon, c[11], c[12]):
                            dx, dy = (lon - c[12]) * metres * math.cos(math.radians((lat + c[11]) / 2)), (lat - c[11]) * metres
                        out.append((id, c[6], c[7] + 1, ts, *new, dx, dy, (ts - c[8]).total_seconds(), False))
                        c[7:] = [c[7] + 1, ts, *new]
            if alive:
                self.cells.put([tuple(c) for c in alive.values()])
            else:
                self.cells.clear()
            if last is not None:
                self.last.update((last,))
            yield pd.DataFrame(out, columns=names).astype({"num_gates": "Int64"})

        def close(self) -> None:
            pass

    return Tracker()


def tracks(scans: DataFrame, shards: int = SHARDS) -> DataFrame:
    """TRACKS, a row for each entry that a history keeps and for each end, from a stream of whole scans.

    scans: cell_id, ts, max_refl, num_gates, lat, lon, and for each scan at least one marker, a row without a cell_id,
    which comes in the same micro-batch as the scan's cells (`marked` adds markers). An entry is kept if it differs from
    the last kept one of its cell in anything but time; dx, dy (metres) and dt (seconds) lead from there. A cell that a
    scan lacks ends (a row with `ended`, naming its last entry), and begins a new `life` if it comes back. Scans that
    aren't newer than the last one change nothing, nor do entries without a time or with one after now; of a cell's
    several entries of a scan the smallest counts.

    Rows are only appended. The state is one row for each living cell, dealt out over shards, and every scan's marker
    reaches every shard, so what a scan lacks is forgotten: state follows the cells of a scan, not time.
    """
    rows = scans.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("max_refl").cast("double").alias("max_refl"), F.col("num_gates").cast("long").alias("num_gates"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    rows = rows.where(F.col("ts").isNotNull() & _come(F.col("ts")))
    own = F.array(F.pmod(F.xxhash64("cell_id"), F.lit(shards)).cast("int"))
    dealt = rows.withColumn("shard", F.explode(F.when(F.col("cell_id").isNotNull(), own).otherwise(F.array(*[F.lit(k) for k in range(shards)]))))
    return dealt.groupBy("shard").transformWithStateInPandas(_tracker(), TRACKS, "Append", "None")


def marked(scans: DataFrame, late: str = LATE) -> DataFrame:
    """A stream of scans with a marker for each time it holds; a scan without cells needs one from elsewhere."""
    times = scans.select("ts").where(F.col("ts").isNotNull() & _come(F.col("ts"))).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["ts"])
    types = {f.name: f.dataType for f in scans.schema}
    fields = ["cell_id", "ts", "max_refl", "num_gates", "lat", "lon"]
    marks = times.select(*[F.col(c) if c == "ts" else F.lit(None).cast(types[c]).alias(c) for c in fields])
    return scans.select(*fields).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).unionByName(marks)


def start_tracks(scans: DataFrame, path: str, checkpoint: str, every: str | None = POLL, shards: int = SHARDS) -> StreamingQuery:
    """Appends `tracks` of a stream to a table at `path`; every=None processes what is there and stops."""
    conf, key = scans.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # list state needs it
    try:
        writer = tracks(scans, shards).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        conf.set(key, before)
