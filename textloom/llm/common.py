"""What the operators of this subpackage share: the shared folder, tables written into it, and Arrow passes."""

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Tables written by this process, removed when it ends.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, a local session (as in tests) gets one of this machine; on a cluster that is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts lineage and outlives lost executors. The table goes when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not WRITTEN:
        atexit.register(clean)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean() -> None:
    """Removes the tables of this process, if its session is still there."""
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jsc is not None:
        for path in WRITTEN:
            there = sc._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(sc._jsc.hadoopConfiguration()).delete(there, True)
    WRITTEN.clear()


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, mod modulus; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    return fold(doc_id, modulus) == F.lit(remainder)


def without(df: DataFrame, names) -> list[str]:
    """df's columns but those that names holds, in any case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def sums_before(counts: DataFrame, group: list[str], at: str, value: str, name: str, fan: int = 4_096) -> DataFrame:
    """counts, one row for each (group, at), at a long of 0 or more, with the sum of value over the group's rows of smaller at.

    Summed within stretches of fan numbers and over stretches, so a task holds fan rows or a group's stretches, never a group. Group
    columns are not null.
    """
    wide = counts.withColumn("__stretch", F.floor(F.col(at) / fan))
    tops = wide.groupBy(*group, "__stretch").agg(F.sum(value).alias("__n"))
    tops = tops.withColumn("__top", F.sum("__n").over(Window.partitionBy(*group).orderBy("__stretch")) - F.col("__n")).drop("__n")
    within = F.sum(value).over(Window.partitionBy(*group, "__stretch").orderBy(at)) - F.col(value)
    return wide.withColumn("__within", within).join(tops, [*group, "__stretch"]).withColumn(name, F.col("__within") + F.col("__top")).drop("__stretch", "__within", "__top")


def append_columns(df: DataFrame, needs: list[Column], fields: list[T.StructField], make) -> DataFrame:
    """df with more columns, made batch by batch in Arrow; a column of df with the name of a new one is replaced.

    make() is called once in each task; what it returns takes the arrays of needs and returns the new arrays. Only needs go to
    Python; the other columns wait in the JVM. The function is marked as not deterministic so that no filter or second use runs it again.
    """
    names = [f.name for f in fields]
    several = len(needs) > 1

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            yield pa.StructArray.from_arrays(work(*batch.flatten()) if several else work(batch), names=names)

    made = F.arrow_udf(run, T.StructType(fields)).asNondeterministic()
    wide = df.select(*map(quoted, without(df, names)), made(F.struct(*needs) if several else needs[0]).alias("__made"))
    return wide.select("*", *(F.col("__made")[n].alias(n) for n in names)).drop("__made")


def texts(array: pa.Array) -> list:
    """UTF-8 bytes, or None, of a column of strings."""
    return array.cast(pa.binary()).to_pylist()
