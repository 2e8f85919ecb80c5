"""Facts of replayed micro-batches count once; runs that fall silent fail."""

import datetime as dt
import shutil

from factloom.sources import tables as S
from factloom.streaming.ingest import fact_stream, run_states

FACT = "id string, dataset_id string, raw_claim string, quote string"


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    folder, source = str(tmp_path / "store"), str(tmp_path / "in")
    spark.createDataFrame([("a", "s", "c", "q"), ("b", "s", "d", "r")], FACT).coalesce(1).write.parquet(source)
    go = lambda state: fact_stream(spark.readStream.schema(FACT).parquet(source), folder, str(tmp_path / state), "facts").awaitTermination(120)
    go("state")
    go("state")  # nothing new
    shutil.rmtree(tmp_path / "state")  # as if the batch had not been noted as done
    go("state")
    assert sorted(r.id for r in S.stored(spark, folder, "facts").collect()) == ["a", "b"] == sorted(r.fact_id for r in S.stored(spark, folder, "evidence").collect())


def test_silent_runs_fail(spark, tmp_path):
    at = lambda m, s=0: dt.datetime(2024, 1, 1, 0, m, s)
    schema = "id string, status string, at timestamp"
    for k, rows in enumerate([[("r1", "PROCESSING", at(0)), ("r2", "QUEUED", at(0)), ("r2", "PROCESSING", at(1))], [("r2", "COMPLETED", at(4)), ("r3", "PROCESSING", at(8))], [("r3", "PROCESSING", at(12)), ("r4", "QUEUED", at(13))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        states = run_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        out = str(tmp_path / "out")
        states.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(150)
    got = sorted((r.id, r.at, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [g for g in got if g[2] == "FAILED"] == [("r1", at(5), "FAILED")]
    assert len(got) == 8 and ("r2", at(4), "COMPLETED") in got
