"""Whole-package export: ordered events, written as JSON lines, with a manifest that is written last.

Events of a class stand together: class_prepared, its methods, class_end; a header comes first.  Discovered, executed
and delivered are counted apart, and the manifest exists only where everything before it was written, so a folder
without one holds an honest prefix.  A folder that exists is never overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import methods as M

KEEP = ("path", "unit_seq", "def_key", "digest", "name", "is_class_candidate", "read_status", "stop_code", "class_state", "class_code", "problems")


def events(u: DataFrame) -> DataFrame:
    """Events with their total order (path, unit_seq, step, member_index); body is JSON.  The units are read once."""
    return _events(M.with_texts(u, *KEEP))


def events_of_files(files: DataFrame) -> DataFrame:
    """As ``events``, from (path, content) in one pass."""
    return _events(M.texts_of_files(files, *KEEP))


def _events(rows: DataFrame) -> DataFrame:

    def event(step: int, kind: str, *fields) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit(-1).alias("member_index"), F.lit(kind).alias("event"), F.to_json(F.struct(*fields)).alias("body"))

    def method(t: Column) -> Column:
        body = F.struct(F.col("def_key"), F.decode(t["name"], "UTF-8").alias("name"), F.decode(t["descriptor"], "UTF-8").alias("descriptor"), t["representation"].alias("representation"),
                        t["quality"].alias("quality"), t["reason"].alias("reason"), t["text"].alias("text"), t["segments"].alias("segments"), F.length(t["text"]).alias("weight"))
        return F.struct(F.lit(2).alias("step"), t["member_index"].alias("member_index"), F.lit("method").alias("event"), F.to_json(body).alias("body"))

    state = F.when(F.col("read_status") != "read", "refused").when(F.col("class_state") == "complete", "completed").otherwise("stopped")
    prepared = event(1, "class_prepared", "def_key", "digest", "name", "declared_members", "declared_bodies")
    ended = event(3, "class_end", "def_key", state.alias("completion"), F.coalesce("stop_code", "class_code").alias("code"))
    told = event(4, "diagnostic", "name", "read_status", "stop_code", "problems")
    of_class = F.concat(F.array(prepared), F.transform("texts", method), F.array(ended))
    empty = F.slice(of_class, 1, 0)
    every = F.concat(F.when(F.col("is_class_candidate"), of_class).otherwise(empty),
                     F.when((F.col("read_status") != "read") | (F.size("problems") > 0), F.array(told)).otherwise(empty))
    return rows.select("path", "unit_seq", F.explode(every).alias("e")).select("path", "unit_seq", "e.*")


def summary(rows: DataFrame) -> DataFrame:
    """What was discovered, executed and delivered, of classes and methods."""
    count = lambda e: F.count(F.when(F.col("event") == e, 1))
    declared = F.sum(F.when(F.col("event") == "class_prepared", F.get_json_object("body", "$.declared_bodies").cast("long")))
    return rows.agg(count("class_prepared").alias("classes_discovered"), count("class_end").alias("classes_delivered"), F.coalesce(declared, F.lit(0)).alias("bodies_declared"),
                    count("method").alias("bodies_delivered"), F.count(F.when((F.col("event") == "method") & (F.get_json_object("body", "$.quality") == "recovered"), 1)).alias("bodies_recovered"),
                    count("diagnostic").alias("diagnostics"))


def export(u: DataFrame, folder: str) -> DataFrame:
    """Write header, events and then the final manifest under folder; returns the summary.

    Files are ranges of the total order; within and across them lines are in order, by file name.
    """
    spark = u.sparkSession
    rows = events(u)
    spark.createDataFrame([("header", 1)], "event string, schema_version int").coalesce(1).write.mode("errorifexists").json(f"{folder}/0-header")
    order = ["path", "unit_seq", "step", "member_index"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").json(f"{folder}/1-events")
    done = summary(spark.read.schema(rows.schema).json(f"{folder}/1-events"))
    done.withColumn("event", F.lit("final")).coalesce(1).write.mode("errorifexists").json(f"{folder}/2-final")
    return spark.read.schema(done.schema).json(f"{folder}/2-final")
