"""Time-dependent behaviour on streams, each with the batch job it must agree with."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from evidence_spark.session import cut_lineage


def event_stream(spark: SparkSession, root: str, schema, files_per_trigger: int = 1, glob: str = "events*.parquet") -> DataFrame:
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(root)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # event time must carry a zone


def lifetime(provider: str, seconds: Mapping[str, int], default: int) -> Column:
    """Seconds an answer of ``provider`` stays fresh."""
    known = F.create_map(*[F.lit(v) for pair in seconds.items() for v in pair])
    return F.coalesce(F.element_at(known, F.col(provider)), F.lit(default))


def fresh_keys(stream: DataFrame, keys: Sequence[str], row_id: str, ts: str, seconds: int | Column, longest: int | None = None) -> DataFrame:
    """Rows that find no stored answer: the first of a key, then the first after each kept one has expired.

    ``seconds`` is the lifetime of an answer, one for all or a column (``lifetime``) whose values do not exceed ``longest``, so
    several providers live in one stream. A skipped row does not refresh the stored one. State is one expiry per key and leaves
    when the watermark passes it. A trigger's rows of one key are searched in order, jumping from kept row to kept row; what the
    stored answer covers is dropped as it arrives.
    """
    if not isinstance(seconds, Column):
        seconds, longest = F.lit(seconds), seconds
    if longest is None:
        raise ValueError("a column of lifetimes needs the longest one: late rows are awaited that long")
    fields = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = ", ".join(f"{c} {fields[c]}" for c in [*keys, row_id])

    def keep(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        expires = state.get[0] if state.exists else None
        parts = [[f[c].to_numpy() for c in ("_t", "_e", row_id)] for f in frames]
        times, ends, ids = parts[0] if len(parts) == 1 else (np.concatenate(column) for column in zip(*parts))
        if expires is not None:
            new = times > expires
            times, ends, ids = times[new], ends[new], ids[new]
        if len(times) > 1:
            order = np.lexsort((ids, times))
            times, ends, ids = times[order], ends[order], ids[order]
        at, kept = 0, []
        while at < len(times):
            kept.append(at)
            expires = int(ends[at])
            at = int(times.searchsorted(expires, side="right"))
        state.update((expires,))
        state.setTimeoutTimestamp(max(expires // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if kept:
            yield pd.DataFrame({**dict(zip(keys, key)), row_id: ids[kept]})

    marked = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, f"{longest} seconds").withColumn("_t", F.unix_micros(ts))
    marked = marked.withColumn("_e", F.col("_t") + seconds.cast("long") * 1_000_000)
    return marked.select(*keys, row_id, ts, "_t", "_e").groupBy(*keys).applyInPandasWithState(
        keep, out, "expires long", "append", GroupStateTimeout.EventTimeTimeout)


def fresh_keys_batch(df: DataFrame, keys: Sequence[str], row_id: str, ts: str, seconds: int | Column) -> DataFrame:
    """The twin of ``fresh_keys`` on a table: keys and ``row_id`` of the rows that find no stored answer.

    Each row knows the next row that would be kept after it (the first of its key after its expiry): its expiry is sorted
    among the rows of its key, latest first, and sees the last row before it. The kept ones are what the first row of a key
    reaches; steps are doubled each round, so the rounds follow the logarithm of the longest chain and no key's rows are
    walked one by one. A row without a time is never fresh.
    """
    life = (seconds if isinstance(seconds, Column) else F.lit(seconds)).cast("long") * 1_000_000
    rows = df.select(*keys, row_id, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), life.alias("_life"))
    rows = rows.filter("_t is not null")
    key = Window.partitionBy(*keys)
    first = F.min(F.struct("_t", row_id)).over(key)[row_id] == F.col(row_id)
    marked = cut_lineage(rows.withColumn("_first", first))
    answers = marked.select(*keys, F.col("_t").alias("_at"), F.lit(1).alias("_row"), F.col(row_id).alias("_id"))
    expiries = marked.select(*keys, (F.col("_t") + F.col("_life")).alias("_at"), F.lit(0).alias("_row"), F.col(row_id).alias("_id"))
    # Latest first, at one moment the expiries before the rows (a row must be later); of rows at one moment the smallest id is seen last.
    order = key.orderBy(F.desc("_at"), "_row", F.desc("_id")).rowsBetween(Window.unboundedPreceding, 0)
    seen = answers.unionByName(expiries).withColumn("_b", F.last(F.when(F.col("_row") == 1, F.col("_id")), ignorenulls=True).over(order))
    jumps = cut_lineage(seen.filter("_row = 0 and _b is not null").select(F.col("_id").alias("_a"), "_b"))
    kept = marked.filter("_first").select(F.col(row_id).alias("_a"))
    while not jumps.isEmpty():
        kept = cut_lineage(kept.union(kept.join(jumps, "_a").select("_b")).distinct())
        jumps = cut_lineage(jumps.join(jumps.select(F.col("_a").alias("_b"), F.col("_b").alias("_c")), "_b").select("_a", F.col("_c").alias("_b")))
    return marked.join(kept, F.col(row_id) == F.col("_a"), "left_semi").select(*keys, row_id)


def latest_request_batch(df: DataFrame, user: str, generation: str, columns: Sequence[str]) -> DataFrame:
    """The newest request of each user, one combinable aggregate."""
    return df.groupBy(user).agg(F.max_by(F.struct(generation, *columns), generation).alias("_r")).select(user, "_r.*")


def latest_request(stream: DataFrame, user: str, generation: str, ts: str, keep: str = "1 day") -> DataFrame:
    """Marks each answer ``current`` or ``late``: late when a newer request of its user came before it (by ``ts``).

    A trigger's rows of one user are judged in order of arrival against the running maximum, so neither chunks nor files
    change the verdict. State is one number per user and leaves ``keep`` after the watermark has passed the last row.
    """
    out = f"{user} long, {generation} long, status string"
    hold = int(pd.Timedelta(keep).total_seconds() * 1000)

    def mark(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["_t", generation])
        newest = rows[generation].cummax()
        if state.exists:
            newest = newest.clip(lower=state.get[0])
        state.update((int(newest.iloc[-1]),))
        state.setTimeoutTimestamp(max(int(rows["_t"].iloc[-1]) // 1000, state.getCurrentWatermarkMs()) + hold)
        status = (rows[generation] >= newest).map({True: "current", False: "late"})
        yield pd.DataFrame({user: rows[user], generation: rows[generation], "status": status})

    marked = stream.withWatermark(ts, keep).withColumn("_t", F.unix_micros(ts)).select(user, generation, ts, "_t")
    return marked.groupBy(user).applyInPandasWithState(mark, out, "newest long", "append", GroupStateTimeout.EventTimeTimeout)


def request_status_batch(df: DataFrame, user: str, generation: str, ts: str) -> DataFrame:
    """The twin of ``latest_request`` on a table: a running maximum per user in order of arrival."""
    before = Window.partitionBy(user).orderBy(ts, generation).rowsBetween(Window.unboundedPreceding, 0)
    late = F.col(generation) < F.max(generation).over(before)
    return df.select(user, generation, F.when(late, "late").otherwise("current").alias("status"))


def drift_watch(df: DataFrame, ts: str, kind: str, value: str, window: str = "1 day", slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Counts, share of high values and mean per time window and kind; the same expression on a table or a stream."""
    rows = df.withWatermark(ts, watermark) if watermark else df
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    return rows.groupBy(span.alias("w"), kind).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) > 100).alias("n_high"), F.sum(value).alias("total")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), kind, "n", "n_high", F.round(F.col("total") / F.col("n"), 6).alias("mean_value"))


def run_to_table(result: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drain a streaming result into parquet and return it as a table.

    ``complete``: each trigger replaces the preview. Otherwise each trigger has a folder of its own, named by its number,
    which a retry of the trigger replaces: no row is written twice.
    """

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/trigger={number}")

    query = (result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(replace).start())
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(path).select(*result.columns)


def preview_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Totals shown while results still arrive; the last preview equals the batch answer."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("best"), F.min(value).alias("worst"))


def run_to_upserts(result: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """Drain an aggregate in update mode and return the newest row of each key.

    Each trigger writes only the keys it changed, into a folder named by its number; a retry of the trigger replaces the
    folder, so nothing counts twice. Readers merge: at any time ``newest_rows`` is the preview as of the last whole trigger.
    """
    spark, schema = result.sparkSession, result.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/trigger={number}")

    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/trigger=-1")  # readable before the first trigger
    query = result.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return newest_rows(spark, keys, path, schema)


def newest_rows(spark: SparkSession, keys: Sequence[str], path: str, schema: StructType) -> DataFrame:
    """Merge on read of what ``run_to_upserts`` wrote: per key the row of the highest trigger, one combinable aggregate."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("trigger", LongType())])).parquet(path)
    values = [c for c in schema.names if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "trigger").alias("_v")).select(*keys, "_v.*").select(*schema.names)
