"""Small things that several operators share: the shared folder and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: the session's checkpoint folder.

    A cluster names it in spark.checkpoint.dir. Only where that is unset and Spark runs on one machine a folder is made
    here; on a cluster without the setting this raises, as a folder of one machine would be lost with it.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; it is not created yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: later jobs don't depend on executors that computed it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns, cast: only(docs, doc_id="long", text="string"). Other columns, whatever their names, go."""
    return df.select(*[df[c].cast(kind).alias(c) for c, kind in columns.items()])
