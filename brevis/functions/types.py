"""Column types of the library's Python functions, made without a session."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

DOUBLE = DoubleType()
DOUBLES = ArrayType(DoubleType())
VECTORS = ArrayType(ArrayType(FloatType()))


def struct(**fields: DataType) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


SCORES = struct(p=DoubleType(), r=DoubleType(), f=DoubleType())
SPANS = ArrayType(struct(lo=IntegerType(), hi=IntegerType()))
LINES = ArrayType(struct(chap=IntegerType(), sub=IntegerType(), ord=IntegerType(), id=StringType(), text=StringType()))
PARSED = struct(status=StringType(), lines=LINES)
MATCH = struct(picks=ArrayType(struct(idx=IntegerType(), f=DoubleType(), p=DoubleType(), r=DoubleType())), target=StringType())
