"""Stored tables of facts and evidence that grow by whole batches, and checkpoints.

A folder holds `facts` and `evidence`, each in folders of a batch and an attempt to write it, and
`commits`, a small file per batch that names the attempt that counts. Both tables are written first, then
the commit file is created, which fails if there is one: so a batch counts in both tables or in neither,
and once at most. Readers take committed attempts only.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of an accepted fact that belong to its evidence alone, by the names they have there.
EVIDENCE = {"page_id": "page_id", "chunk_id": "chunk_id", "quote": "quote", "start": "start_offset", "end": "end_offset", "offset_base": "offset_base"}
COMMIT = "batch string, attempt string, n_facts long, n_evidence long"
#: Folder names start with letters, so that Spark reads them as text.
_PLACES = ("batch_of", "attempt_of", "dataset_of")
#: Folders that the datasets of a batch share at most.
SLOTS = 64


def files_of(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, attempt, n_facts, n_evidence) of every batch that counts."""
    path, files = files_of(spark, f"{folder}/commits")
    if not files.exists(path):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).option("pathGlobFilter", "*.json").json(f"{folder}/commits")


def _commit(spark: SparkSession, folder: str, batch: str, attempt: str, n_facts: int, n_evidence: int) -> bool:
    """Creates the batch's commit file; False if another attempt was first. The file is written under another
    name and renamed, so that it is whole or absent; a rename onto an existing file fails (on HDFS in one step, so that of
    two attempts at once one counts)."""
    name = uuid.uuid5(uuid.NAMESPACE_OID, batch).hex
    final, files = files_of(spark, f"{folder}/commits/{name}.json")
    draft, _ = files_of(spark, f"{folder}/commits/_{name}-{attempt}")
    out = files.create(draft, False)
    out.write((json.dumps({"batch": batch, "attempt": attempt, "n_facts": n_facts, "n_evidence": n_evidence}) + "\n").encode())
    out.close()
    done = not files.exists(final) and files.rename(draft, final)
    if not done:
        files.delete(draft, False)
        if not files.exists(final):
            raise OSError(f"the commit file of batch {batch} could not be renamed in {folder}/commits")
    return done


def append_facts_evidence(accepted: DataFrame, folder: str, batch: str | None = None, now: Column | None = None, method: str = "structured_extraction") -> DataFrame:
    """Appends accepted facts (id, dataset_id, document_id, quote, ...) and one row of evidence for each to the tables
    `facts` and `evidence` under `folder` as one batch, and returns what the batch holds: (dataset_id, facts, evidence).

    batch: a name by which a rerun is known (by default a hash of the facts' ids); if it is committed
    already, nothing is written and what is stored is returned. A crash at any point leaves files that no reader sees;
    the rerun writes its own. The facts are computed once. Columns that only evidence has (EVIDENCE) leave the facts; the
    rows of evidence also get id (of the fact's), fact_id, dataset_id, document_id, page_number, extraction_method,
    extraction_confidence, metadata (where facts have these) and created_at (`now`).
    """
    spark = accepted.sparkSession
    if batch is None:
        accepted = settled(accepted)
        named = accepted.agg(F.count("*"), F.sum(F.xxhash64("id").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("id", F.lit(1)))).first()
        batch = "-".join(map(str, named))
    done = commits(spark, folder).where(F.col("batch") == batch)
    if done.isEmpty():
        attempt = uuid.uuid4().hex
        accepted = settled(accepted)
        at = now if now is not None else F.current_timestamp()
        own = {c: n for c, n in EVIDENCE.items() if c in accepted.columns}
        shared = [c for c in ("document_id", "page_number", "metadata") if c in accepted.columns]
        sure = F.col("confidence").cast("double") if "confidence" in accepted.columns else F.lit(1.0)
        evidence = accepted.select(
            F.concat("id", F.lit("-e")).alias("id"), F.col("id").alias("fact_id"), "dataset_id", *shared, *[F.col(c).alias(n) for c, n in own.items()],
            F.lit(method).alias("extraction_method"), sure.alias("extraction_confidence"), at.alias("created_at"),
        )
        facts = accepted.drop(*own) if "created_at" in accepted.columns else accepted.drop(*own).withColumn("created_at", at)
        for name, table in (("facts", facts), ("evidence", evidence)):
            _write(table, f"{folder}/{name}", batch, attempt)
        n = accepted.count()
        _commit(spark, folder, batch, attempt, n, n)
    stored_ = stored(spark, folder, "facts", batch=batch)
    if stored_ is None:
        return spark.createDataFrame([], "dataset_id string, facts long, evidence long")
    return stored_.groupBy("dataset_id").agg(F.count("*").alias("facts")).withColumn("evidence", F.col("facts"))


def _place(batch: Column | str) -> Column:
    """A folder name for any batch name."""
    return F.concat(F.lit("b-"), F.md5((F.lit(batch) if isinstance(batch, str) else batch).cast("binary")))


def _slot(dataset: Column) -> Column:
    return F.concat(F.lit("d-"), F.pmod(F.xxhash64(dataset), F.lit(SLOTS)).cast("string"))


def _owner() -> Column:
    return F.coalesce(F.col("dataset_id").cast("string"), F.lit(""))


def _write(table: DataFrame, path: str, batch: str, attempt: str) -> None:
    """A batch has a folder for each of SLOTS groups of datasets at most, and its rows are dealt out in ranges, so that a
    task writes a few folders: files are about as many as folders and tasks, however many datasets there are."""
    places = (_place(batch), F.lit(f"a-{attempt}"), _slot(_owner()))
    placed = table.withColumns(dict(zip(_PLACES, places, strict=True)))
    placed.repartitionByRange("dataset_of", "dataset_id", "id").sortWithinPartitions("dataset_of", "dataset_id").write.mode("append").partitionBy(*_PLACES).parquet(path)


def stored(spark: SparkSession, folder: str, name: str, dataset: str | None = None, batch: str | None = None) -> DataFrame | None:
    """A table as committed batches make it, or its part of a dataset or a batch (folders that cannot hold it are not read);
    None while nothing is committed. Columns that some batches lack are null there."""
    counted = commits(spark, folder)
    counted = counted.where("n_facts > 0" if batch is None else (F.col("n_facts") > 0) & (F.col("batch") == batch))
    if counted.isEmpty():
        return None
    table = spark.read.option("mergeSchema", True).parquet(f"{folder}/{name}")
    if dataset is not None:
        # Folders of earlier versions bear the dataset's name.
        table = table.where(F.col("dataset_of").isin(f"d-{dataset}") | (F.col("dataset_of") == _slot(F.lit(dataset)))).where(_owner() == dataset)
    keys = counted.select(_place(F.col("batch")).alias("batch_of"), F.concat(F.lit("a-"), "attempt").alias("attempt_of"))
    return table.join(keys, ["batch_of", "attempt_of"], "left_semi").drop(*_PLACES)


def vacuum(spark: SparkSession, folder: str) -> int:
    """Deletes attempts that no commit names (of crashes) and returns how many. No writer may be at work."""
    good = {(r["b"], r["a"]) for r in commits(spark, folder).select(_place(F.col("batch")).alias("b"), F.concat(F.lit("a-"), "attempt").alias("a")).collect()}
    gone = 0
    for name in ("facts", "evidence"):
        root, files = files_of(spark, f"{folder}/{name}")
        for b in files.listStatus(root) if files.exists(root) else []:
            for a in files.listStatus(b.getPath()) if b.isDirectory() else []:
                if (b.getPath().getName().removeprefix("batch_of="), a.getPath().getName().removeprefix("attempt_of=")) not in good:
                    gone += files.delete(a.getPath(), True)
    return gone


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A temporary one stands in for it only where driver and executors are
    one process; on a cluster without that setting this is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return (named or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


@contextmanager
def _passing(spark: SparkSession) -> Iterator[None]:
    """Queries made and run here delete what they shuffled as they end: what is stored is read, not made again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    with _passing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def rewritten(df: DataFrame) -> DataFrame:
    """`df` computed once and kept as Parquet in the shared folder, where texts take a third of a checkpoint's room."""
    if any(kind in df.schema.simpleString() for kind in ("void", "interval")):  # that Parquet has not
        return settled(df)
    path = f"{shared_folder(df.sparkSession)}/rewritten-{uuid.uuid4().hex}"
    with _passing(df.sparkSession):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
