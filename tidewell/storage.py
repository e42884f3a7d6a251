"""Folders that all workers share, and small manifests in them."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode without one, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/tidewell/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back, which ends its lineage in a form that outlives executors."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """Writes a small JSON document as a one-row table, in place of what was there; readers see the old or the new one whole."""
    new = f"{path}/v{int(content.get('version', 0)):09d}"
    spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "content string").coalesce(1).write.mode("overwrite").parquet(new)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest at the path that was written whole, or None."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    versions = sorted((s.getPath().toString() for s in fs.listStatus(hadoop)), reverse=True)
    for v in versions:
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{v}/_SUCCESS")):
            return json.loads(spark.read.parquet(v).first().content)
    return None


def parquet_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the Parquet files and folders right below a path, sorted."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop) if s.getPath().getName().endswith(".parquet"))


def create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Creates a small text file whole, unless its name is taken: of several writers of one name exactly one gets True.

    The content goes to a file of another name first.  On local disks a hard
    link gives it its name, elsewhere the file system's own rename that does not
    replace, which is atomic on HDFS and its like.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    draft, final = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.{uuid.uuid4().hex}.draft", path))
    fs = draft.getFileSystem(conf)
    fs.mkdirs(final.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            return True
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, final, none)
        except Exception:
            if fs.exists(final):
                return False
            raise
        return True
    finally:
        fs.delete(draft, False)  # also what a rename has moved away is no error


def newest_version(spark: SparkSession, path: str) -> dict | None:
    """The JSON object in the last of the files v000000001.json and so on of a folder, or None."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    versions = [p for s in fs.listStatus(hadoop) if (p := s.getPath()).getName().endswith(".json")]
    if not versions:
        return None
    last = max(versions, key=lambda p: p.getName())
    return json.loads(spark.read.text(last.toString(), wholetext=True).first().value)
