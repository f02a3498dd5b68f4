"""Tables written to the shared folder, to cut lineage and share results.

The folder is `spark.checkpoint.dir` of the session.  Only where that is unset
(tests, a laptop) a folder of our own is chosen, which is safe in local mode
since driver and executors then share one machine.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for one table or folder of files; it goes when Python ends."""
    path = f"{shared_dir(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once and return it as read back: later plans start from the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path  # for drop()
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A name for a column that df lacks, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _has_map(kind: DataType) -> bool:
    match kind:
        case MapType():
            return True
        case ArrayType():
            return _has_map(kind.elementType)
        case StructType():
            return any(_has_map(f.dataType) for f in kind.fields)
    return False


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row. Maps, which have no hash, are hashed as JSON: in the order of their entries."""
    spelled = lambda c: F.to_json(F.struct(c), {"ignoreNullFields": "false"})
    return F.xxhash64(*(spelled(F.col(f"`{f.name}`")) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields))


def sampled(rows: DataFrame, draw: Column, wanted: int) -> DataFrame:
    """About `wanted` of the rows, those with the smallest values of a 64-bit hash; all of them if there are no more. Any share can be drawn, however small."""
    total = rows.count()
    if total <= wanted:
        return rows
    return rows.where(draw < F.lit((wanted << 64) // total - (1 << 63)))


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: for costly work on a table of few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores)


def drop(df: DataFrame) -> None:
    """Remove a table that materialize() made and that no later plan reads."""
    _remove(df.sparkSession, df.scratch_path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may have ended before us
            return
