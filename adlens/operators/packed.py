"""Rows as one text on their way through a shuffle.

A row of many columns takes 8 bytes and more per column there, most of them padding. As a
text with a sign between its values it is a third shorter after compression. Doubles and
nested values travel as they are. A row with one of the signs in its texts, or with bytes
that are no valid text, travels unpacked, so every row comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKED = "_packed"
_NEXT, _NULL = "\x01", "\x02"
_WHOLE, _TEXT, _ODD = "_whole", "_text", "_odd"


def _is_packed(kind: T.DataType) -> bool:
    # a text with a collation of its own is left alone
    return isinstance(kind, (T.LongType, T.IntegerType, T.BooleanType)) or kind == T.StringType()


def pack(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``PACKED``, a struct of the columns for :func:`unpack`."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    packed = [c for c in columns if _is_packed(kinds[c])]
    if len(packed) < 2:
        return rows.withColumn(PACKED, F.struct(*columns))
    given = F.concat_ws("", *[F.col(c) for c in packed if kinds[c] == T.StringType()])
    odd = F.contains(given, F.lit(_NEXT)) | F.contains(given, F.lit(_NULL)) | ~F.is_valid_utf8(given)
    text = F.concat_ws(_NEXT, *[F.coalesce(F.col(c).cast("string"), F.lit(_NULL)) for c in packed])
    # in steps of their own: a value that is used twice would be worked out twice
    return rows.withColumn(_TEXT, given).withColumn(_ODD, odd).withColumn(
        PACKED,
        F.struct(
            F.when(~F.col(_ODD), text).alias(_TEXT),
            F.when(F.col(_ODD), F.struct(*packed)).alias(_WHOLE),
            *[c for c in columns if c not in packed],
        ),
    )


def unpack(rows: DataFrame, packed: str, schema: T.StructType, columns: list[str], keep: list[Column | str]) -> DataFrame:
    """``columns`` out of the struct ``packed``, with the types of ``schema``, beside the columns ``keep``."""
    fields = rows.schema[packed].dataType.fieldNames()
    if _TEXT not in fields:
        return rows.select(*[F.col(f"{packed}.{c}").alias(c) for c in columns], *keep)
    inside = [c for c in columns if c not in fields]
    # cut once in a step of its own
    cut = rows.withColumn("_parts", F.split(F.col(f"{packed}.{_TEXT}"), _NEXT))

    def value(c: str) -> Column:
        if c not in inside:
            return F.col(f"{packed}.{c}").alias(c)
        part = F.get("_parts", F.lit(inside.index(c)))
        read = F.when(part != _NULL, part).cast(schema[c].dataType)
        return F.when(F.col(f"{packed}.{_WHOLE}").isNull(), read).otherwise(F.col(f"{packed}.{_WHOLE}.{c}")).alias(c)

    return cut.select(*[value(c) for c in columns], *keep)
