"""Session helpers: reading tables, cutting lineage, salting, bounded broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Side size up to which a join side may be broadcast (bytes, from Spark's own statistics).
BROADCAST_BYTES = 1 << 20
#: Rows per bucket below which a bucketed table gets fewer buckets.
BUCKET_ROWS = 200_000
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a test-data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set a temporary folder is taken in local mode only; elsewhere that is an error, as executors would
    write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if of_context.isDefined():
            return of_context.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def spill(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet under the shared folder and read it back.

    Columnar, so later readers prune columns; survives the loss of executors. The
    files are removed by :func:`release` or when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meshquarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._spilled = path
    return out


def spill_bucketed(df: DataFrame, by: str, rows: int, name: str = "t") -> DataFrame:
    """Like :func:`spill`, but hash-partitioned and sorted by ``by``: later joins and groups on it need no shuffle of this side.

    One file per bucket; as many buckets as shuffle partitions, fewer for few ``rows``.
    """
    spark = df.sparkSession
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS)))
    label = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/meshquarry/{label}"
    df.repartition(n, by).write.bucketBy(n, by).sortBy(by).option("path", path).format("parquet").saveAsTable(label)
    _written.append((spark, path))
    out = spark.table(label)
    out._spilled, out._table = path, label
    return out


def release(*dfs: DataFrame) -> None:
    """Remove the files of spilled tables that no later step reads (rounds of a loop); anything else is left alone."""
    for df in dfs:
        if path := getattr(df, "_spilled", None):
            if name := getattr(df, "_table", None):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
            _delete(df.sparkSession, path)
            _written[:] = [w for w in _written if w[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_spilled() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have gone first
            pass


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of ``df`` (exact file sizes for a plain scan)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the estimated size is at most ``limit``; else leave the choice to AQE."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def salted_join(big: DataFrame, small: DataFrame, key: str, salt_by: Column, salts: int = 16, how: str = "left") -> DataFrame:
    """Equi-join that spreads each key of ``big`` over ``salts`` tasks.

    ``small`` has few rows per key and is repeated once per salt, so a key that
    holds a third of ``big`` is shared by ``salts`` tasks. A null key matches nothing.
    """
    if plan_bytes(small) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), key, how)
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).join(s, [key, "_salt"], how).drop("_salt")


def empty_like(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
