"""Intermediate tables in the folder that driver and executors share, and broadcasts behind a check of their size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side may be broadcast; both are summed over the side before the hint is given.
BROADCAST_ROWS = 250_000
BROADCAST_BYTES = 48 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary folder in local mode, and on a cluster the warehouse if that is no folder of one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
        found = f"file://{_local_dir()}"
    if not found:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith("file:") or "://" not in warehouse:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{warehouse}/_scratch"
    return found.rstrip("/")


_made: list[str] = []


def _local_dir() -> str:
    if not _made:
        import shutil

        _made.append(tempfile.mkdtemp(prefix="quillstream-"))
        atexit.register(shutil.rmtree, _made[0], ignore_errors=True)
    return _made[0]


_run = uuid.uuid4().hex
_scratch: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """This process's own folder below the shared one; it is removed by forget() or when the process ends."""
    path = f"{shared_dir(spark)}/quillstream/{_run}"
    if path not in _scratch:
        if not _scratch:
            atexit.register(_forget_all)
        _scratch.add(path)
    return path


def forget(spark: SparkSession) -> None:
    """Remove the intermediate tables of this process. Results that haven't been stored can't be read afterwards."""
    for path in list(_scratch):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _scratch.discard(path)


def _forget_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        forget(spark)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it again. Survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage and keep the partitions and the order of rows in them."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def _fixed(kind: T.DataType) -> int | None:
    """Bytes of a value of a type whose values are all of one size."""
    if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)):
        return None
    if isinstance(kind, T.StructType):
        each = [_fixed(f.dataType) for f in kind]
        return None if None in each else 8 + sum(each)
    return 8


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in a broadcast relation."""
    if (n := _fixed(kind)) is not None:
        return F.lit(n).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind), F.lit(8).cast("long"))
    if isinstance(kind, T.MapType):
        return _bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _bytes(F.map_values(value), T.ArrayType(kind.valueType))
    if (n := _fixed(kind.elementType)) is not None:
        return F.lit(16).cast("long") + n * F.coalesce(F.size(value), F.lit(0))
    return F.lit(16).cast("long") + F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda s, x: s + _bytes(x, kind.elementType)), F.lit(0))


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether counting proves that df has at most `rows` rows and `most` bytes."""
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(8).cast("long"))
    n, b = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= rows and b <= most


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast df if counting proves that it fits; else leave the join to a shuffle."""
    return F.broadcast(df) if fits(df, rows, most) else df
