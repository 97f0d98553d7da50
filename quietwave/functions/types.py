"""Return types of the batch functions, usable before a session exists."""

from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

DOUBLES = ArrayType(DoubleType())


def struct_of(*names: str, kind=DoubleType()) -> StructType:
    return StructType([StructField(n, kind) for n in names])
