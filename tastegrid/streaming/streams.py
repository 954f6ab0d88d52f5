"""Structured Streaming: windows with watermarks, first deliveries, keyed counters and budgets, incremental scores.

`replay` runs a stream over files to its end and returns the sink as a table; a long-running job would use the same
transformations with its own source and trigger. Checkpoints and sinks live in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tastegrid.operators import scoring as S
from tastegrid.session import run_dir


def stream(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    """A table's file as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).options(**options).parquet(f"{sf_dir}/{name}.parquet*")
    ntz = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return s.withColumns({c: F.col(c).cast("timestamp") for c in ntz})


def replay(df: DataFrame, mode: str = "append") -> DataFrame:
    """Everything there is, once, into a sink of files (append) or of batches whose last one holds (complete)."""
    spark = df.sparkSession
    at = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", at + "/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", at + "/out").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(at + "/out")
    writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(at + "/out")).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(at + "/out")


def windowed(df: DataFrame, ts: str, keys: list[str], length: str, slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums of `value` by event-time window and keys; rows later than `late` are dropped."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    g = df.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, key: str, gap: str, late: str = "2 hours") -> DataFrame:
    g = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), "n")


def first_deliveries(df: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The first delivery of each key within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def spent_budgets(df: DataFrame, key: str, order: list[str], cost: str, limit: int) -> DataFrame:
    """(key, allowed, refused, spent): costs in order, each refused if it would exceed the limit; refused ones don't count."""
    schema = "key string, allowed long, refused long, spent long"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, yes, no = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        for c in rows[cost].tolist():
            if spent + c <= limit:
                spent, yes = spent + c, yes + 1
            else:
                no += 1
        state.update((spent, yes, no))
        yield pd.DataFrame({"key": [k[0]], "allowed": [yes], "refused": [no], "spent": [spent]})

    return df.groupBy(key).applyInPandasWithState(step, schema, "spent long, yes long, no long", "update", GroupStateTimeout.NoTimeout)


def replay_updates(df: DataFrame, key: str) -> DataFrame:
    """Replays a stream of updates; the last update of each key holds."""
    spark = df.sparkSession
    at = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(at + "/out")

    df.writeStream.outputMode("update").option("checkpointLocation", at + "/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.parquet(at + "/out")
    return S.latest_per_key(rows, [key], F.col("_batch").desc()).drop("_batch")


def refused_requests(df: DataFrame, key: str, ts: str, order: str, hours: float, limit: int) -> DataFrame:
    """(key, refused): requests beyond the limit in windows that open at a key's first request after the last one closed.

    Requests are sorted on disk and read as a stream, so only one window's state is held, whatever a key's size."""
    rows = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, F.unix_micros(ts).alias("at"), F.col(order).alias("o"))
    rows = rows.repartition(key).sortWithinPartitions(key, "at", "o")
    length = int(hours * 3_600_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, end, used, refused = None, None, 0, 0
        for got in batches:
            done = []
            for x, at in zip(got[key].tolist(), got["at"].tolist()):
                if x != k:
                    if k is not None:
                        done.append((k, refused))
                    k, end, refused = x, None, 0
                if end is None or at >= end:
                    end, used = at + length, 0
                used += 1
                refused += used > limit
            if done:
                yield pd.DataFrame(done, columns=[key, "refused"])
        if k is not None:
            yield pd.DataFrame([(k, refused)], columns=[key, "refused"])

    return rows.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, refused long")


def incremental_scores(batches: list[DataFrame], now: Column, settle: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Scores kept up to date by batches of observations: only (dish, city) groups a batch touches are computed anew, as their
    priors and medians move with it. Equal to one computation over all observations."""
    seen, scores, group = None, None, ["dish_id", "city_id"]
    for batch in batches:
        seen = batch if seen is None else seen.unionByName(batch)
        dirty = batch.select(*group).distinct()
        fresh = S.score_pairs(seen.join(dirty, group, "left_semi"), now)
        scores = fresh if scores is None else scores.join(dirty, group, "left_anti").unionByName(fresh)
        scores, seen = settle(scores, "scores"), settle(seen, "observations")
    return scores
