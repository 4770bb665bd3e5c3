"""Per-cell time series: keyed upsert, appends, motion vectors and the latest entry."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars

#: Cells whose last move is longer than this many metres are dropped.
MAX_MOVE_M = 9000.0


def kept_entries(history: DataFrame, same: list[str], id: str = "cell_id", ts: str = "ts", order: str = "seq") -> DataFrame:
    """Entries that an append keeps: those that differ from the last kept one in time and in any of `same`.

    The rule compares with the last kept entry, not with the last one, so a cell's entries pass in order through a task
    that remembers one entry only; a long history needs no more memory than a short one. A NULL never equals anything,
    so such entries are kept. Of equal places in the order either may come first.
    """
    columns = history.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        fields = [id, ts, *same]
        for batch in batches:
            kept = []
            for k, entry in enumerate(zip(*[batch.column(columns.index(c)).to_pylist() for c in fields], strict=True)):
                # NaN equals NaN
                equal = [x is not None and y is not None and (x == y or (x != x and y != y)) for x, y in zip(entry, last, strict=True)] if last else None
                if last is None or entry[0] != last[0] or not (equal[1] or all(equal[2:])):
                    kept.append(k)
                    last = entry
            yield batch.take(pa.array(kept, pa.int64()))

    # dealt out by a hash of the id: a plain repartition by the id is dropped where a join below has dealt rows out by it,
    # and that join may still be changed at run time to one that leaves a cell's entries in several tasks
    return history.repartition(F.xxhash64(id)).sortWithinPartitions(id, order).mapInArrow(keep, history.schema)


def changed_entries(history: DataFrame, same: list[str], id: str = "cell_id", ts: str = "ts") -> DataFrame:
    """As kept_entries where (id, ts) is unique: entries equal to their predecessor go. One window, no arrays."""
    w = W.partitionBy(id).orderBy(ts)
    equal = F.lit(True)
    for c in same:
        equal = equal & F.coalesce(F.lag(c).over(w) == F.col(c), F.lit(False))
    return history.withColumn("_same", equal).where("NOT _same").drop("_same")


def vectors(history: DataFrame, every: bool = False, metres: float = scalars.DEGREE_M, id: str = "cell_id", order: str = "seq", ts: str = "ts") -> DataFrame:
    """Adds dx, dy in metres and dt in seconds from the entry before; to the last entry only, or to every one.

    A cell's first entry has none. The order column decides which entry is last; pass the time to order by time.
    """
    w = W.partitionBy(id).orderBy(order)
    before = {c: F.lag(c).over(w) for c in ("lat", "lon", ts)}
    dx, dy = scalars.motion(before["lat"], before["lon"], F.col("lat"), F.col("lon"), metres)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    out = history.select("*", dx.alias("dx"), dy.alias("dy"), (seconds(F.col(ts)) - seconds(before[ts])).alias("dt"), before["lat"].alias("prev_lat"), before["lon"].alias("prev_lon"), before[ts].alias("prev_ts"), F.lead(order).over(w).isNull().alias("_last"))
    if not every:
        out = out.select(*history.columns, *[F.when(F.col("_last"), F.col(c)).alias(c) for c in ("dx", "dy", "dt", "prev_lat", "prev_lon", "prev_ts")])
    return out.drop("_last")


def latest(history: DataFrame, id: str = "cell_id", order: str = "seq") -> DataFrame:
    """The last entry of each cell. A maximum of structs, which is aggregated before rows are exchanged."""
    rest = [c for c in history.columns if c != id]
    best = F.max_by(F.struct(*rest), F.col(order))
    return history.groupBy(id).agg(best.alias("e")).select(id, *[f"e.{c}" for c in rest])


def latest_position(cells: DataFrame, history: DataFrame, id: str = "cell_id", order: str = "seq") -> DataFrame:
    """Each cell with the values of its last entry, 0 where the entry lacks one."""
    last = latest(history, id, order).select(id, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("lat", "lon", "num_gates", "max_refl")])
    return cells.select(id).distinct().join(last, id)


def upsert(old_cells: DataFrame, new_cells: DataFrame, old_history: DataFrame, new_history: DataFrame, id: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """(cells, history) after a scan: new fields for every new cell, the old history for those known, others end."""
    known = old_cells.select(id).distinct()
    kept = old_history.join(new_cells.select(id).distinct(), id, "left_semi")
    fresh = new_history.join(new_cells.select(id).distinct(), id, "left_semi").join(known, id, "left_anti")
    cells = new_cells.join(known.withColumn("_known", F.lit(True)), id, "left")
    return cells.select(*new_cells.columns, F.coalesce("_known", F.lit(False)).alias("known")), kept.unionByName(fresh)


def upsert_entries(history: DataFrame, updates: DataFrame, id: str = "cell_id", ts: str = "ts") -> DataFrame:
    """History with updates by (id, ts): an update replaces the fields it has, and adds the entry if there is none."""
    fields = [c for c in history.columns if c not in (id, ts)]
    old = history.select(id, ts, F.struct(*fields).alias("old"))
    new = updates.select(id, ts, F.struct(*[F.col(c) if c in updates.columns else F.lit(None).cast(history.schema[c].dataType).alias(c) for c in fields]).alias("new"))
    return old.join(new, [id, ts], "full").select(id, ts, *[F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) for c in fields])


def without_jumps(history: DataFrame, most: float = MAX_MOVE_M, id: str = "cell_id", order: str = "seq") -> DataFrame:
    """Cells whose last move isn't longer than `most`; without a move they stay."""
    move = latest(history.select(id, order, "dx", "dy"), id, order)
    return history.join(move.where(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2) > most).select(id), id, "left_anti")


def entries_with(history: DataFrame, key: str, id: str = "cell_id", ts: str = "ts", metrics: str = "metrics") -> DataFrame:
    """(id, ts, value) of all entries that have a metric."""
    return history.where(F.map_contains_key(metrics, F.lit(key))).select(id, ts, F.col(metrics)[key].alias("value"))


def missing_keys(a: Column, b: Column) -> Column:
    """Keys of map a that map b lacks, sorted."""
    return F.sort_array(F.array_except(F.map_keys(a), F.map_keys(b)))
