"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACES = r"[\x20\x09-\x0D]+"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; without a setting only a local session has one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/ruleloom-{spark.sparkContext.applicationId}"


_paths: dict[int, tuple[DataFrame, str]] = {}


ROWS_A_TASK = 100_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later reads neither recompute it nor lose it.

    The shuffle files of the write go when it ends: nothing reads them again. Where the caller knows that there are
    ``rows`` narrow rows at most, as many tasks write them as that asks, one for each core at least: a small table in
    a file for each shuffle partition costs more to write than to compute.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))
    path = f"{shared_folder(spark).rstrip('/')}/ruleloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = out, path
    return out


def with_row_numbers(documents: DataFrame) -> DataFrame:
    """``documents`` with a number for each row, ``__doc``: the integer id where ids are unique and not null.

    Else rows are numbered in the order in which they are read, and written, so that the numbers stay.
    """
    if documents.schema["doc_id"].dataType.simpleString() in ("int", "bigint", "smallint", "tinyint"):
        n = documents.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
        if n.rows == n.ids:
            return documents.withColumn("__doc", F.col("doc_id").cast("long"))
    return written(documents.withColumn("__doc", F.monotonically_increasing_id()), "numbered")


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for t in tables:
        _delete(t.sparkSession, _paths.pop(id(t))[1])


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Write what ``make`` returns and delete the tables that it wrote on the way."""
    before = set(_paths)
    out = written(make(), name)
    discard(*[df for key, (df, _) in list(_paths.items()) if key not in before and df is not out])
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _discard_all() -> None:
    """At the end of the driver's program, what results were read from goes too."""
    with contextlib.suppress(Py4JError, OSError):  # the JVM may have ended before
        for df, path in list(_paths.values()):
            if df.sparkSession._jsc.sc().isStopped():
                break
            _delete(df.sparkSession, path)


def words_alnum(text: Column) -> Column:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, in the JVM; null counts as empty."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def words_space(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as they stand, in the JVM; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def row_key() -> list[Column]:
    """What tells rows of a document table apart where an id may repeat: the id and a hash of the text."""
    return [F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash")]
