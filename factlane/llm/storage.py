"""Tables in the folder that all executors share, used to cut lineage."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset on one machine (tests) a local folder.  A cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    if not base:  # it cannot be set in a running session: remembered here
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="factlane-")
        base = _OWN[app]
    if "://" not in base:  # a bare path belongs to the session's default file system
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().replace("file:/", "file:///", 1)
    return base.rstrip("/")


_MADE: list[str] = []


def fresh(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/factlane/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clean(spark: SparkSession) -> None:
    """Delete what this process has written to the shared folder; results that still read it must have been consumed."""
    while _MADE:
        _delete(spark, _MADE.pop())


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write once, read back: later stages never recompute what stands before."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


#: Where stored tables are, as long as somebody holds them.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more (a result must not have them in its plan)."""
    for df in tables:
        if (path := _PATHS.pop(df, None)) is not None:
            _MADE.remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored_buckets(df: DataFrame | list[DataFrame], name: str, key: str, n: int, codec: str = "zstd") -> DataFrame:
    """As ``stored``, bucketed, so that a join on ``key`` moves only the other side; several tables are written one after
    the other.  The catalog forgets the table at once; the plan that read it keeps its files and buckets."""
    parts = df if isinstance(df, list) else [df]
    spark = parts[0].sparkSession
    table = f"factlane_{name}_{uuid.uuid4().hex}"
    path = fresh(spark, name)
    for part in parts:
        part.write.mode("append").format("parquet").option("compression", codec).option("path", path).bucketBy(n, key).saveAsTable(table)
    out = spark.table(table)
    _PATHS[out] = path
    spark.sql(f"DROP TABLE {table}")  # external: its files stay
    return out


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Inside, what a query shuffled is deleted when it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan_bytes(df: DataFrame) -> int:
    """What the optimizer takes df's size to be, without running anything; 0 where it doesn't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if size >= 1 << 55 else size


#: Keys with more than one row in HOT are hot; there are HOT such at most, however large a table is.
HOT = 1000


def hot_keys(big: DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """(hash, copies) of the hot keys of big: the tasks that each is to be split into, a power of two.  At most HOT entries."""
    most = max(1.0, big.count() / HOT)
    hot = big.groupBy(F.xxhash64(*keys).alias("hash")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return [(r["hash"], 1 << math.ceil(math.log2(r["n"] / most))) for r in hot.collect()]


def hot_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", hot: list[tuple[int, int]] | None = None) -> DataFrame:
    """big joined with small, which has one row a key; how is inner or left.  Hot keys of big are salted by a hash of their
    rows and what small has for them is copied, 4 * HOT rows more in all at most, so that no task gets a whole hot key."""
    hot = hot_keys(big, keys) if hot is None else hot
    if not hot:
        return big.join(small, keys, how)
    sizes: dict[int, list[int]] = {}
    for key, n in hot:
        sizes.setdefault(n, []).append(key)
    copies = F.lit(1)
    for n, some in sizes.items():
        copies = F.when(F.xxhash64(*keys).isin(some), n).otherwise(copies)
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), copies).cast("int"))
    return dealt.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))), [*keys, "_salt"], how).drop("_salt")
