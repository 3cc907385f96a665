"""What the operators of this subpackage share: the shared folder, written stages and row identities."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
#: Rows of up to this many keys are broadcast (a key is at most 40 bytes); beyond it joins shuffle.
BROADCAST_ROWS = 100_000
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master, whose executors share the driver's disk, gets a folder here where it is unset; a cluster without one is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lexarium-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage so that lost executors cost one stage.

    The files stay until discard() or the session's owner removes them, since any later plan may read them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    _FOLDERS[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that written() gave and that no plan still to be run reads."""
    for table in tables:
        path = _FOLDERS.pop(table, None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_keys(id_column: str = "doc_id", text_column: str = "text") -> list[Column]:
    """128 bits for a row: rows with the same key have the same id and text, so any of them stands for all."""
    parts = [F.coalesce(F.col(id_column).cast("string"), F.lit("\x00null")), text_of(text_column)]
    return [F.xxhash64(*parts).alias("_row"), F.xxhash64(F.lit(11), *parts).alias("_row2")]


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, .., which no operator's own names clash with, and what each column is called now."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows; counts no further than limit + 1."""
    return df.limit(limit + 1).count() <= limit
