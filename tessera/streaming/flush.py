"""Count-or-age micro-batches.

A key's buffer is flushed when it holds ``capacity`` entries or when ``ttl`` seconds have passed since its last flush, which
starts at the key's first event. Both are tested when an entry arrives, never by a timer; a flush resets the clock. What
stays is flushed by hand (``manual``). The batch form folds a key's entries in event order inside one sorted
pass, holding one flush counter and not the entries; the streaming form keeps the same three numbers and the buffer in state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

DELAY = 1


def by_capacity(rows: DataFrame, key: str, order: list[str], capacity: int) -> DataFrame:
    """Adds flush_id; without an age limit it is a row number."""
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    place = F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("flush_id", F.floor(place / capacity).cast("long"))




def by_capacity_or_age(rows: DataFrame, key: str, at: str, ident: str, capacity: int, ttl: float) -> DataFrame:
    """key, ident, flush_id, trigger ('flush' for the entry that flushes its batch, 'hold' else; 'manual' for what stays). at: timestamp."""
    out = f"{key} bigint, {ident} bigint, flush_id bigint, trigger string"
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / F.lit(1e6)
    keyed = rows.select(F.col(key).cast("bigint").alias(key), F.col(ident).cast("bigint").alias(ident), seconds.alias("__at"))
    ordered = keyed.repartition(F.col(key)).sortWithinPartitions(key, "__at", ident)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, flush, held, last = None, 0, 0, None
        for pdf in batches:
            made = []
            for k, t in zip(pdf[key], pdf["__at"]):
                if k != now:
                    now, flush, held, last = k, 0, 0, t
                held += 1
                fires = held >= capacity or t - last >= ttl
                made.append((flush, "flush" if fires else "hold"))
                if fires:
                    flush, held, last = flush + 1, 0, t
            yield pd.DataFrame({key: pdf[key], ident: pdf[ident], "flush_id": [m[0] for m in made], "trigger": [m[1] for m in made]})

    folded = ordered.mapInPandas(run, out)
    done = F.max(F.col("trigger") == "flush").over(W.partitionBy(key, "flush_id"))
    return folded.withColumn("__done", done).withColumn("trigger", F.when(F.col("__done"), F.col("trigger")).otherwise("manual")).drop("__done")


def serial_done(flushes: DataFrame, key: str, arrival: str, order: str, delay: float = DELAY) -> DataFrame:
    """Adds done: a consumer takes one batch at a time, ``delay`` seconds each: done = max(arrival, done before) + delay."""
    # done_i - i x delay is a running maximum of arrival_i - (i - 1) x delay.
    window = W.partitionBy(key).orderBy(order)
    place = F.row_number().over(window)
    ready = F.max(F.col(arrival) - (F.col("__n") - 1) * delay).over(window.rowsBetween(W.unboundedPreceding, 0))
    return flushes.withColumn("__n", place).withColumn("done", ready + F.col("__n") * delay).drop("__n")


def processor(capacity: int, ttl: float):
    """StatefulProcessor for ``transformWithStateInPandas``: key, ts_s, ident in; key, ident, flush_id out when flushed."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Flush(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.clock = handle.getValueState("clock", "flush bigint, last double")
            self.buffer = handle.getListState("buffer", "ident bigint")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802
            got = pd.concat(list(rows)).sort_values(["ts_s", "ident"])
            flush, last = self.clock.get() if self.clock.exists() else (0, float(got["ts_s"].iloc[0]))
            held = [r[0] for r in self.buffer.get()] if self.buffer.exists() else []
            out = []
            for t, ident in zip(got["ts_s"], got["ident"]):
                held.append(int(ident))
                if len(held) >= capacity or t - last >= ttl:
                    out += [(key[0], i, flush) for i in held]
                    flush, held, last = flush + 1, [], float(t)
            self.clock.update((flush, last))
            self.buffer.clear()
            if held:
                self.buffer.put([(i,) for i in held])
            yield pd.DataFrame(out, columns=["key", "ident", "flush_id"]).astype({"key": "int64", "ident": "int64", "flush_id": "int64"})

        def close(self) -> None:
            pass

    return Flush()


OUTPUT = "key bigint, ident bigint, flush_id bigint"


def streaming_flush(stream: DataFrame, capacity: int, ttl: float) -> DataFrame:
    """stream: key, ts_s (double), ident. Needs the RocksDB state store."""
    return stream.groupBy("key").transformWithStateInPandas(processor(capacity, ttl), OUTPUT, "Append", "None")


def append_batches(flushed: DataFrame, path: str, checkpoint: str):
    """Streaming query that appends flushed entries, batch by batch; a batch that runs again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return flushed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def priority(rows: DataFrame) -> DataFrame:
    """Hook for a priority of entries; constant."""
    return rows.withColumn("priority", F.lit(1.0).cast("float"))
