"""What class file releases know: attributes and flags with the first major version and the places that allow them.

Majors FIRST..LAST can be read; bodies are understood up to DIALECT.  A name that isn't registered is no claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST, LAST, DIALECT = 45, 71, 52
#: Fixed values: (attribute, since major, section of JVMS chapter 4.7, places), in the specification's order.
ATTRIBUTES = [
    ("ConstantValue", 45, "4.7.2", "field_info"), ("Code", 45, "4.7.3", "method_info"), ("StackMapTable", 50, "4.7.4", "Code"), ("Exceptions", 45, "4.7.5", "method_info"),
    ("InnerClasses", 45, "4.7.6", "ClassFile"), ("EnclosingMethod", 49, "4.7.7", "ClassFile"), ("Synthetic", 45, "4.7.8", "ClassFile,field_info,method_info"),
    ("Signature", 49, "4.7.9", "ClassFile,field_info,method_info,record_component_info"), ("SourceFile", 45, "4.7.10", "ClassFile"),
    ("SourceDebugExtension", 49, "4.7.11", "ClassFile"), ("LineNumberTable", 45, "4.7.12", "Code"), ("LocalVariableTable", 45, "4.7.13", "Code"),
    ("LocalVariableTypeTable", 49, "4.7.14", "Code"), ("Deprecated", 45, "4.7.15", "ClassFile,field_info,method_info"),
    ("RuntimeVisibleAnnotations", 49, "4.7.16", "ClassFile,field_info,method_info,record_component_info"),
    ("RuntimeInvisibleAnnotations", 49, "4.7.17", "ClassFile,field_info,method_info,record_component_info"),
    ("RuntimeVisibleParameterAnnotations", 49, "4.7.18", "method_info"), ("RuntimeInvisibleParameterAnnotations", 49, "4.7.19", "method_info"),
    ("RuntimeVisibleTypeAnnotations", 52, "4.7.20", "ClassFile,field_info,method_info,Code,record_component_info"),
    ("RuntimeInvisibleTypeAnnotations", 52, "4.7.21", "ClassFile,field_info,method_info,Code,record_component_info"), ("AnnotationDefault", 49, "4.7.22", "method_info"),
    ("BootstrapMethods", 51, "4.7.23", "ClassFile"), ("MethodParameters", 52, "4.7.24", "method_info"), ("Module", 53, "4.7.25", "ClassFile"),
    ("ModulePackages", 53, "4.7.26", "ClassFile"), ("ModuleMainClass", 53, "4.7.27", "ClassFile"), ("NestHost", 55, "4.7.28", "ClassFile"),
    ("NestMembers", 55, "4.7.29", "ClassFile"), ("Record", 60, "4.7.30", "ClassFile"), ("PermittedSubclasses", 61, "4.7.31", "ClassFile"),
]


def attributes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n.encode(), s, c, p.split(",")) for n, s, c, p in ATTRIBUTES], "name binary, since int, section string, places array<string>")


def release(major: int) -> str:
    return "registered" if FIRST <= major <= LAST else "unregistered_future_release" if major > LAST else "unknown_release"


def dialect(major: Column) -> Column:
    """What can be said of a class of this major version."""
    return F.when(major > LAST, "unregistered_future_release").when(major > DIALECT, "structure_only").otherwise("dialect_validated")


def placement(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Attribute rows (name, owner_kind, major) with their placement: legal, too early, misplaced or not registered."""
    place = F.when(F.col("owner_kind") == "class", "ClassFile").when(F.col("owner_kind") == "code", "Code").otherwise(F.concat("owner_kind", F.lit("_info")))
    told = rows.join(F.broadcast(attributes(spark)), "name", "left").withColumn("place", place)  # a fixed table
    state = (F.when(F.col("since").isNull(), "not_registered").when(~F.array_contains("places", F.col("place")), "location_not_applicable")
             .when(F.col("major") < F.col("since"), "version_not_applicable").otherwise("legal"))
    return told.withColumn("placement", state).drop("places", "place")


#: Reference types and their direct supertypes in the platform, as far as widening of arguments needs them.
WIDENS = {"java/lang/String": ("java/lang/CharSequence", "java/lang/Comparable", "java/io/Serializable"), "java/lang/Integer": ("java/lang/Number", "java/lang/Comparable"),
          "java/lang/Long": ("java/lang/Number", "java/lang/Comparable"), "java/math/BigDecimal": ("java/lang/Number", "java/lang/Comparable"),
          "java/math/BigInteger": ("java/lang/Number", "java/lang/Comparable"), "java/lang/Number": ("java/io/Serializable",), "java/util/ArrayList": ("java/util/List",),
          "java/util/List": ("java/util/Collection",), "java/util/Collection": ("java/lang/Iterable",), "java/lang/StringBuilder": ("java/lang/CharSequence",)}


def reference_widens(source: str, required: str) -> bool:
    """Whether the platform's own types widen; nothing is inferred for other types."""
    if required == "java/lang/Object" or source == required:
        return True
    return any(reference_widens(above, required) for above in WIDENS.get(source, ()))
