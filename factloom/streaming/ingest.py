"""Pages, facts and runs that arrive over time, taken in with the same functions as a batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from factloom.operators.text import split_chunks
from factloom.sources.tables import append_facts_evidence


def chunk_stream(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame], None], per_trigger: int = 1000) -> StreamingQuery:
    """Cuts the pages of Parquet files (document_id, page_id, text) that come into `folder` in chunks
    and hands each batch, with its `batch`, to `sink`. It ends once all files there are read; a
    restart goes on from `checkpoint`, and `sink` may see its last batch again."""
    pages = spark.readStream.schema("document_id string, page_id string, text string").option("maxFilesPerTrigger", per_trigger).parquet(folder)
    write = lambda batch, n: sink(split_chunks(batch).withColumn("batch", F.lit(n)))
    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fact_stream(facts: DataFrame, folder: str, checkpoint: str, name: str) -> StreamingQuery:
    """Appends a stream of accepted facts to the stored tables of `folder` (see `append_facts_evidence`), each micro-batch as
    the batch `name`-number. A batch that is handed over again after a crash is known by its name and adds nothing, as
    long as `checkpoint` belongs to `name`."""

    def write(batch: DataFrame, n: int) -> None:
        append_facts_evidence(batch, folder, f"{name}-{n}")

    return facts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_states(events: DataFrame, minutes: int = 5, late: str = "0 seconds") -> DataFrame:
    """(id, status, at) of runs as they change, from a stream of events (id, status, at: timestamp).

    A run that is PROCESSING and silent for `minutes` of event time turns FAILED at that time; an event that comes later
    than that opens it again. State is one row for each run that processes; others keep none.
    """

    def follow(key, frames, state):
        out = []
        if state.hasTimedOut:
            (last,) = state.get
            out.append((key[0], "FAILED", pd.Timestamp(last + minutes * 60_000, unit="ms")))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("at", kind="stable")
            last, status = None, None
            for status, at in zip(rows["status"], rows["at"], strict=True):
                last = int(at.timestamp() * 1000)
                out.append((key[0], status, at))
            if status == "PROCESSING":
                state.update((last,))
                state.setTimeoutTimestamp(max(last + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["id", "status", "at"])

    timed = events.select("id", "status", "at").withWatermark("at", late)
    return timed.groupBy("id").applyInPandasWithState(follow, "id string, status string, at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)
