"""Functions of texts carried through structs, arrays and maps, whatever their depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

TextFunction = Callable[[Column], Column]


def holds_text(kind: DataType) -> bool:
    """Whether a type has strings anywhere."""
    if isinstance(kind, StructType):
        return any(holds_text(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return holds_text(kind.elementType)
    if isinstance(kind, MapType):
        return holds_text(kind.keyType) or holds_text(kind.valueType)
    return isinstance(kind, StringType)


def each_text(value: Column, kind: DataType, f: TextFunction) -> Column:
    """The value with ``f`` of every string in it, keys of maps too; of keys that become equal the first stays."""
    if not holds_text(kind):
        return value
    if isinstance(kind, StructType):
        fields = [each_text(value.getField(x.name), x.dataType, f).alias(x.name) for x in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: each_text(x, kind.elementType, f))
    if isinstance(kind, MapType):
        pairs = F.transform(F.map_entries(value), lambda x: F.struct(each_text(x["key"], kind.keyType, f).alias("key"), each_text(x["value"], kind.valueType, f).alias("value")))
        if not holds_text(kind.keyType):
            return F.map_from_entries(pairs)
        first = F.filter(pairs, lambda x, k: F.array_position(F.transform(pairs, lambda y: y["key"]), x["key"]) == k + 1)
        return F.map_from_entries(first)
    return f(value)


def any_text(value: Column, kind: DataType, test: TextFunction) -> Column:
    """Whether ``test`` holds for a string in the value; false where there is none."""
    if not holds_text(kind):
        return F.lit(False)
    if isinstance(kind, StructType):
        found = F.lit(False)
        for x in kind.fields:
            found = found | any_text(value.getField(x.name), x.dataType, test)
        return found
    if isinstance(kind, ArrayType):
        return F.coalesce(F.exists(value, lambda x: any_text(x, kind.elementType, test)), F.lit(False))
    if isinstance(kind, MapType):
        inside = lambda x: any_text(x["key"], kind.keyType, test) | any_text(x["value"], kind.valueType, test)
        return F.coalesce(F.exists(F.map_entries(value), inside), F.lit(False))
    return F.coalesce(test(value), F.lit(False))


def rows_with(df: DataFrame, test: TextFunction) -> DataFrame:
    """Rows that have a string, at any depth, for which the test holds."""
    found = F.lit(False)
    for x in df.schema:
        found = found | any_text(F.col(f"`{x.name}`"), x.dataType, test)
    return df.where(found)


def mapped(df: DataFrame, f: TextFunction) -> DataFrame:
    """All rows with ``f`` of every string at any depth."""
    return df.select(*[each_text(F.col(f"`{x.name}`"), x.dataType, f).alias(x.name) for x in df.schema])
