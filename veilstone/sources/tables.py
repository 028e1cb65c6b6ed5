"""Reading the parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, StructType


def table(spark: SparkSession, data_dir: str, name: str, *columns: str) -> DataFrame:
    """Table `name` of `data_dir`; naming columns prunes the scan to them."""
    df = spark.read.parquet(f"{data_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def has_field(schemas: StructType | list[StructType], path: str) -> bool:
    """Whether any of the schemas holds a field, its name dotted through nested structs, lists of
    structs included. Hybrid search needs such a field of vectors; without one it falls back."""
    for schema in schemas if isinstance(schemas, list) else [schemas]:
        node = schema
        for part in path.split("."):
            while isinstance(node, ArrayType):
                node = node.elementType
            node = node[part].dataType if isinstance(node, StructType) and part in node.names else None
        if node is not None:
            return True
    return False
