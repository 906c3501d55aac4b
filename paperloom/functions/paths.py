"""Dotted paths with alternatives over typed records and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.blanks import is_blank


def declared(schema: T.StructType, path: str) -> bool:
    """Whether ``path`` names a field of ``schema``; elements of arrays count as their array's."""
    kind: T.DataType = schema
    for step in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or step not in kind.names:
            return False
        kind = kind[step].dataType
    return True


def at(schema: T.StructType, path: str) -> Column:
    """The first alternative (``a.b|c``) that isn't null; an empty text holds. Unknown alternatives are skipped."""
    known = [F.col(p) for p in path.split("|") if declared(schema, p)]
    return F.coalesce(*known) if known else F.lit(None)


def present_at(schema: T.StructType, path: str) -> Column:
    """(value, path) of the first alternative that isn't blank."""
    ways = [F.when(~is_blank(F.col(p).cast("string")), F.struct(F.col(p).cast("string").alias("value"), F.lit(p).alias("path"))) for p in path.split("|") if declared(schema, p)]
    return F.coalesce(*ways) if ways else F.lit(None).cast("struct<value:string,path:string>")


def in_variant(value: Column, path: str, kind: str = "string") -> Column:
    """The first alternative of a path in a variant."""
    return F.coalesce(*[F.try_variant_get(value, f"$.{p}", kind) for p in path.split("|")])


def declared_in_variant(value: Column, path: str) -> Column:
    """Whether the path is there, null or not."""
    return F.variant_get(value, f"$.{path}", "variant").isNotNull()


def with_value(df: DataFrame, path: str, value: Column) -> DataFrame:
    """``df`` with ``value`` written at a dotted path of an existing record."""
    root, _, rest = path.partition(".")
    return df.withColumn(root, F.col(root).withField(rest, value) if rest else value)


def leaves(df: DataFrame, key: str) -> DataFrame:
    """(key, path, value): every scalar of each record, elements of arrays by their place. Null scalars give a row."""

    def walk(value: Column, kind: T.DataType, path: Column) -> Column:
        none = F.array().cast("array<struct<path:string,value:string>>")
        if isinstance(kind, T.StructType):
            parts = [walk(value.getField(f.name), f.dataType, F.concat(path, F.lit("." + f.name))) for f in kind.fields]
            return F.when(value.isNotNull(), F.concat(*parts)).otherwise(none)
        if isinstance(kind, T.ArrayType):
            each = F.transform(value, lambda x, i: walk(x, kind.elementType, F.concat(path, F.lit("."), i.cast("string"))))
            return F.coalesce(F.flatten(each), none)
        return F.array(F.struct(path.alias("path"), value.cast("string").alias("value")))

    parts = [walk(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in df.schema.fields if f.name != key]
    return df.select(F.col(f"`{key}`"), F.inline(F.concat(*parts)))
