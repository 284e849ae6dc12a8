"""Incremental forms: a stream of assertions folded batch by batch, order planes and sessions over event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import fold

STATE = "id binary, subject_id binary, type_id binary, object_id binary, rating long, rd long, volatility long, witness_count long, last_observed_at timestamp"


#: Parts that a stream's consensus is kept in by a hash of the cell's id; only those that a batch touches are written.
PARTS = 64


def fold_stream(assertions: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, parts: int = PARTS) -> StreamingQuery:
    """Fold each micro-batch of assertions (see fold.observe) onto the consensus under path.

    The consensus is dealt into parts. Batch n writes the parts that it touches as path/data/batch=n/part=p and then, in one
    file, path/heads/batch=n: which batch each part is from. A batch that is run again after a failure starts from the heads
    of the batch before and writes its own over, so nothing is folded twice; what a failed batch leaves is never read. Heads
    and parts that no head names any more can be removed with vacuum(). Read the newest state with current().
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        heads = _heads(spark, path, number - 1)
        changes = fold.deltas(fold.observe(rows)).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
        work = f"{checkpoint}/attesta-work/{number}"
        changes.write.mode("overwrite").parquet(work)
        changes = spark.read.schema(changes.schema).parquet(work)
        # at most one row for each part
        touched = [r.part for r in changes.select("part").distinct().collect()]
        if touched:
            prior = _parts(spark, path, {p: b for p, b in heads.items() if p in touched})
            folded = fold.fold_onto(prior, changes.drop("part")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
            folded.repartition(len(touched), "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/batch={number}")
        rows_ = [(p, b) for p, b in (heads | dict.fromkeys(touched, number)).items()]
        spark.createDataFrame(rows_, "part int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/heads/batch={number}")

    return assertions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _heads(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """Which batch each part is from, after a batch; at most one row for each part."""
    if number < 0:
        return {}
    return {r.part: r.batch for r in spark.read.schema("part int, batch long").parquet(f"{path}/heads/batch={number}").collect()}


def _parts(spark: SparkSession, path: str, heads: dict[int, int]) -> DataFrame:
    if not heads:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(*[f"{path}/data/batch={b}/part={p}" for p, b in sorted(heads.items())])


def _newest(spark: SparkSession, path: str) -> int:
    """The last batch whose heads are whole."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/heads")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return -1
    done = [f.getPath() for f in fs.listStatus(root)]
    return max((int(p.getName().split("=")[1]) for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), default=-1)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of the consensus."""
    return _parts(spark, path, _heads(spark, path, _newest(spark, path)))


def vacuum(spark: SparkSession, path: str) -> None:
    """Remove heads before the newest but one, and batches' parts that the two newest heads don't name. Not while a stream runs."""
    newest = _newest(spark, path)
    kept = {pb for n in (newest, newest - 1) if n >= 0 for pb in _heads(spark, path, n).items()}
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(jvm.Path(f"{path}/heads")):
        if int(status.getPath().getName().split("=")[1]) < newest - 1:
            fs.delete(status.getPath(), True)
    for folder in fs.globStatus(jvm.Path(f"{path}/data/batch=*/part=*")):
        part, number = int(folder.getPath().getName().split("=")[1]), int(folder.getPath().getParent().getName().split("=")[1])
        if (part, number) not in kept:
            fs.delete(folder.getPath(), True)


def transitions(events: DataFrame, key: str, item: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Ordered pairs of each key's consecutive items, over a stream: the last item of each key is its state."""
    schema = f"{key} long, x string, y string, at timestamp"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values([time, item])
        out = []
        for r in rows.itertuples(index=False):
            now = getattr(r, item)
            if last is not None:
                out.append((k[0], last, now, getattr(r, time)))
            last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "x", "y", "at"])

    return events.withWatermark(time, late).groupBy(key).applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key: rows closer than a gap, with begin, end and number of events; works on streams and tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("events"))
    return out.select(key, F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("until"), "events")


def windowed(events: DataFrame, time: str, keys: list[str], width: str, slide: str | None = None, late: str = "10 minutes", **aggregates: Callable) -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width, slide) if slide else F.window(time, width), *keys).agg(*[f().alias(n) for n, f in aggregates.items()] or [F.count("*").alias("n")])
