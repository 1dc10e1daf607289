"""What the operators of this subpackage share: tables, row ids, intermediate tables and word columns."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words wherever the contracts say words are `[^\x20\x09-\x0D]+`.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of text that Spark hands to a Python worker at once, at most (one row may be larger), unless the application sets its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors once for each Spark application, for those without it on their path, and bounds the batches they get."""
    for key, most in BATCH.items():
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, str(most))
    sc = spark.sparkContext
    if getattr(sc, "_tracemill_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp()) / "tracemill_code.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(str(to))
    sc._tracemill_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent (local tests) a folder of this machine takes its place."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        got = "file://" + tempfile.gettempdir() + "/checkpoints"
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/tracemill/{spark.sparkContext.applicationId}"


def cleared(spark: SparkSession) -> None:
    """Removes every table that written() made in this application, those included that results still read: call it when they are consumed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Removes a query's shuffle files when it ends (Spark 4.1); else they stay until the driver's garbage collector finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives the loss of any executor. Its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tm_path = path
    return out


def kept(df: DataFrame, name: str) -> DataFrame:
    """df if written() made it, else written()."""
    return df if getattr(df, "_tm_path", None) else written(df, name)


def together(frames: list[DataFrame]) -> DataFrame:
    """All rows of tables made by written(), which dropped() removes at once."""
    if len(frames) == 1:
        return frames[0]
    out = reduce(DataFrame.union, frames)
    out._tm_tables = frames
    return out


def dropped(*frames: DataFrame) -> None:
    """Removes tables made by written() that no later plan reads."""
    for df in frames:
        dropped(*getattr(df, "_tm_tables", ()))
        path = getattr(df, "_tm_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: So many ids are broadcast at most to pick rows; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000


def picked(rows: DataFrame, ids: DataFrame, key: str = "_rid") -> DataFrame:
    """The rows whose key is among ids (a written table with that one column, distinct)."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def with_row_id(docs: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ("text",)) -> DataFrame:
    """docs' columns `keep` with a unique long `_rid` in front.

    An integer id without nulls or repeats is taken as it is. Otherwise the rows are written once
    with a running number, so that every later read sees the same numbers."""
    cols = [F.col(c) for c in keep]
    if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        n = docs.agg(F.count(F.lit(1)).alias("n"), F.count(id_col).alias("k")).first()
        if n.n == n.k and docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty():
            return docs.select(F.col(id_col).cast("long").alias("_rid"), *cols)
    return written(docs.select(F.monotonically_increasing_id().alias("_rid"), *cols), "rows")


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as the empty text, hence as held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits; [] for null and for texts without any."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
