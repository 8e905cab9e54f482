"""Tables staged in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where there is none, a local session (one machine, as in
    tests) gets a folder of its own; a cluster is refused, as its executors wouldn't see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike a cached block the files outlive any executor, and numbering made by
    ``monotonically_increasing_id`` is fixed once it is written.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*staged: DataFrame) -> None:
    """Deletes the files of staged tables (:func:`stage`) that nothing reads any more: call it when what was made of them is written."""
    for df in staged:
        session = df.sparkSession
        folder = f"{shared_dir(session)}/"
        jvm = session.sparkContext._jvm
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            if path.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath()):
                path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
