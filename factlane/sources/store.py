"""The facts store: decoded units kept as Parquet, found again by the content that they were decoded from.

A file's facts are keyed by the SHA-256 of its bytes, the parser's version and the depth, so neither names nor times decide, a
changed input or decoder never finds old facts, and equal files share theirs.  Files are decoded once a digest; what would
go over the capacity is decoded without being kept.  Results with and without the store are the same; counters tell
hits, misses and refusals.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import algebra as A
from . import artifact as S

PARSER_VERSION = 2
_OWN: dict[str, str] = {}


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the folder that all executors share and read it back: plans stay small, lost tasks redo little."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # one machine, as in tests
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="factlane-"))
    path = f"{base.rstrip('/')}/factlane/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass
class FactsStore:
    folder: str
    capacity: int | None = None  # bytes of files whose facts are kept; None: all
    counters: dict[str, int] = field(default_factory=lambda: {"consultations": 0, "hits": 0, "misses": 0, "refused": 0})

    def _kept(self, spark: SparkSession, depth: int) -> DataFrame:
        """(snapshot_id, length) of the files whose facts are here."""
        place = f"{self.folder}/v{PARSER_VERSION}-depth{depth}/files"
        at = spark._jvm.org.apache.hadoop.fs.Path(place)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], _FILES)
        return spark.read.schema(_FILES).parquet(place).distinct()

    def units(self, spark: SparkSession, path: str, depth: int = S.DEPTH) -> DataFrame:
        place = f"{self.folder}/v{PARSER_VERSION}-depth{depth}"
        files = spark.read.format("binaryFile").load(path).select("path", "length", "content", F.sha2("content", 256).alias("snapshot_id"))
        asked = settled(files.select("path", "length", "snapshot_id"), "asked")
        kept = settled(self._kept(spark, depth), "kept")
        new = asked.join(kept.select("snapshot_id"), "snapshot_id", "left_anti").groupBy("snapshot_id").agg(F.min("path").alias("path"), F.first("length").alias("length"))
        used = kept.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        new = settled((A.prefix_sum(new.withColumn("mark", F.conv(F.substring("snapshot_id", 1, 12), 16, 10).cast("long")), "mark", "length") if self.capacity is not None
                       else new.withColumn("running", F.lit(0))).withColumn("stays", F.col("running") + used <= F.lit(self.capacity if self.capacity is not None else 2**62)), "new")
        told = new.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("stays"), 1)).alias("refused")).first()
        self.counters["consultations"] += 1
        self.counters["misses" if told["n"] else "hits"] += 1
        self.counters["refused"] += told["refused"]
        again = files.select("path", "content")
        if told["n"] > told["refused"]:
            fresh = new.where("stays")
            S.decoded(again.join(fresh.select("path"), "path", "left_semi"), depth).write.mode("append").option("compression", "zstd").parquet(f"{place}/units")
            fresh.select("snapshot_id", "length").write.mode("append").parquet(f"{place}/files")  # last: files without this row are never read
        out = S.decoded(again.join(new.where("not stays").select("path"), "path", "left_semi"), depth)
        have = self._kept(spark, depth).select("snapshot_id")
        if not have.isEmpty():
            stored = spark.read.schema(S.SCHEMA).parquet(f"{place}/units").join(have, "snapshot_id", "left_semi")
            out = stored.unionByName(out)
        places = asked.select("snapshot_id", F.col("path").alias("_path"))
        return out.dropDuplicates(["snapshot_id", "unit_seq"]).join(places, "snapshot_id").withColumn("path", F.col("_path")).select(*S.SCHEMA.names)


_FILES = "snapshot_id string, length bigint"
