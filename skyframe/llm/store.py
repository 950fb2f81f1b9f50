"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local master may fall back to a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="skyframe-"))
    return sc.getCheckpointDir()


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: a lost executor costs no recomputation of what came before.
    What drop() does not delete earlier goes when the driver's JVM ends: a result that is still to be computed may read it until then."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/skyframe-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def drop(df: DataFrame) -> None:
    """Deletes a table made by table() that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if "skyframe-" in folder:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Most bytes of keys that are sent to all tasks.
SENT = 32 << 20
#: A key with more rows than this is joined apart from the others.
HOT = 50_000


def width(schema: T.StructType) -> Column:
    """About how many bytes a row takes in memory."""
    def of(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(t, T.ArrayType):
            return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * 8 + 24
        return F.lit(8)

    return reduce(lambda a, b: a + b, [of(F.col(f.name), f.dataType) for f in schema.fields], F.lit(16))


def sent(keys: DataFrame, most: int = SENT) -> DataFrame:
    """A table of keys for the side of a join that texts are on the other side of: broadcast while it takes at most `most` bytes, so that
    the texts stay where they are read; beyond, both are shuffled. keys: made by table()."""
    size = keys.agg(F.sum(width(keys.schema).cast("long"))).first()[0]
    return F.broadcast(keys) if (size or 0) <= most else keys


def join_dealt(many: DataFrame, keys: DataFrame, on: list[str], times: str) -> DataFrame:
    """many joined with keys (one row for each value of `on`; times: how many rows of many have it, a column that is dropped).

    Keys of over HOT rows are few, as there can't be more than rows / HOT: their rows are joined where they are read, so none
    of these keys lands in one task; beyond what sent() sends, adaptive execution splits them. The others are shuffled. Both are made by table()."""
    hot = table(keys.where(F.col(times) > HOT).drop(times), "hot")
    if hot.isEmpty():
        return many.join(keys.drop(times), on)
    cold = many.join(sent(hot.select(on)), on, "left_anti").join(keys.where(F.col(times) <= HOT).drop(times), on)
    return many.join(sent(hot), on).unionByName(cold)


def kept_apart(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs with its columns that are called like one of names (in upper or lower case) renamed: an underscore, or more, is put behind them."""
    taken = {n.lower() for n in names}
    for c in docs.columns:
        if c.lower() in taken:
            new = c + "_"
            while new.lower() in taken | {x.lower() for x in docs.columns}:
                new += "_"
            docs = docs.withColumnRenamed(c, new)
    return docs


def free_name(docs: DataFrame, name: str) -> str:
    """name, with underscores behind it until no column of docs is called so."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def small_arrow_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bounds what a Python worker holds at once. Texts may be long, so a batch has few rows and a few MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
