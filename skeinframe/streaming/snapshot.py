"""Stitch progress as a partitioned snapshot that grows by micro-batches.

folder/part=<p>/batch=<n>: the cells of hash part p as of batch n. A batch reads and writes only the parts that its marks
touch, by dynamic partition overwrite, so what is written follows the batch and not the state. A part's cells are those
of some designs, in stretches of STRETCH cells, so one huge design spreads over parts. Readers take the newest finished
version of each part; a marker folder/_done/<n> finishes a batch. Versions that two newer finished batches have replaced are
removed. A batch that runs again writes its own versions again from the older ones, which gives the same.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinframe.streaming.marks import apply_marks, merge_marks

#: Cells of one design that stay together.
STRETCH = 1 << 14
COLUMNS = ("design_id", "idx", "done", "ts", "mark_id")


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("design_id", F.floor(F.col("idx") / STRETCH)), F.lit(parts)).cast("int")


def _system(spark: SparkSession, folder: str):
    """The folder's file system, by Spark's own JVM (not on Spark Connect)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def finished(spark: SparkSession, folder: str) -> set[int]:
    system, path = _system(spark, f"{folder}/_done")
    return {int(s.getPath().getName()) for s in system.listStatus(path)} if system.exists(path) else set()


def versions(spark: SparkSession, folder: str) -> dict[int, list[int]]:
    """The batches of each part, in order."""
    system, path = _system(spark, f"{folder}/part=*/batch=*")
    found: dict[int, list[int]] = {}
    for s in system.globStatus(path) or []:
        m = re.search(r"/part=(\d+)/batch=(\d+)$", s.getPath().toString())
        if m:
            found.setdefault(int(m[1]), []).append(int(m[2]))
    return {p: sorted(b) for p, b in found.items()}


def read_parts(spark: SparkSession, folder: str, parts: list[int] | None = None, before: int | None = None) -> DataFrame | None:
    """(COLUMNS, part, batch) of the newest finished version of each part, or of some parts; None if there is none."""
    done = {b for b in finished(spark, folder) if before is None or b < before}
    newest = {p: max(ok) for p, b in versions(spark, folder).items() if (ok := done & set(b)) and (parts is None or p in parts)}
    if not newest:
        return None
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/part={p}/batch={b}" for p, b in sorted(newest.items())])


def snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    """(COLUMNS): the cells as of the last finished batch."""
    rows = read_parts(spark, folder)
    return None if rows is None else rows.select(*COLUMNS)


def write_batch(marks: DataFrame, folder: str, epoch: int, parts: int = 64) -> None:
    """Applies a batch of cell marks."""
    spark = marks.sparkSession
    new = apply_marks(marks.select(*COLUMNS)).select(*COLUMNS).withColumn("part", part_of(parts)).persist()
    try:
        touched = [r.part for r in new.select("part").distinct().collect()]  # at most `parts` numbers
        if touched:
            old = read_parts(spark, folder, touched, epoch)
            rows = new.drop("part") if old is None else merge_marks(old.select(*COLUMNS), new)
            rows = rows.withColumns({"part": part_of(parts), "batch": F.lit(epoch)}).repartition("part")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(folder)
    finally:
        new.unpersist()
    system, path = _system(spark, f"{folder}/_done/{epoch}")
    system.create(path, True).close()
    tidy(spark, folder, epoch)


def tidy(spark: SparkSession, folder: str, epoch: int) -> None:
    """Removes versions older than the two newest finished ones of a part, and their markers once nothing needs them."""
    done = {b for b in finished(spark, folder) if b <= epoch}
    needed = {epoch}
    for p, batches in versions(spark, folder).items():
        kept = [b for b in batches if b in done][-2:]
        needed |= set(kept)
        for b in batches:
            if b in done and b not in kept:
                system, path = _system(spark, f"{folder}/part={p}/batch={b}")
                system.delete(path, True)
    for b in done - needed:
        system, path = _system(spark, f"{folder}/_done/{b}")
        system.delete(path, False)


def stream_snapshot(marks: DataFrame, folder: str, checkpoint: str, parts: int = 64):
    """A stream writer of cell marks into a snapshot."""
    return marks.writeStream.foreachBatch(lambda batch, epoch: write_batch(batch, folder, epoch, parts)).option("checkpointLocation", checkpoint).outputMode("append")
