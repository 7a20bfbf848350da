"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: the session's ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is used on a local master (and set for ``DataFrame.checkpoint`` too); on a
    cluster that is an error, as its machines don't share such a folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = os.path.join(tempfile.gettempdir(), "agroloom-checkpoints")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; it goes, at the latest, when the session's JVM ends."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    hadoop, files = at_path(spark, path)
    files.deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: cuts lineage and survives lost executors.

    Nulls, repeated rows and empty tables come back as they were. The folder goes by ``discard``, at the latest when the
    session's JVM ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``written`` wrote for ``df``; nothing that is still to be computed may read it."""
    hadoop, files = at_path(df.sparkSession, df.written_at)
    files.delete(hadoop, True)


def at_path(spark: SparkSession, path: str):
    """Hadoop's path and file system of ``path``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, files = at_path(spark, path)
    return files.exists(hadoop)


def latest_version(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest at ``path``; None without any."""
    pattern, files = at_path(spark, f"{path}/manifest-*.json")
    found = sorted(str(s.getPath().toString()) for s in files.globStatus(pattern) or [])
    return json.loads(spark.read.text(found[-1], wholetext=True).first()[0]) if found else None


def commit_version(spark: SparkSession, path: str, manifest: dict) -> None:
    """Makes ``manifest`` (with its ``version``) the newest: written beside, then renamed, so that readers see the state
    before or after. Fails if another writer took the version."""
    draft, files = at_path(spark, f"{path}/draft-{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    final, _ = at_path(spark, f"{path}/manifest-{manifest['version']:09d}.json")
    if files.exists(final) or not files.rename(draft, final):
        raise RuntimeError(f"version {manifest['version']} at {path} was written by someone else")
