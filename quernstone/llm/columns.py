"""Small column helpers of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def n_words(text: Column) -> Column:
    """How many words a text has; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that none can clash with the operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def with_columns(df: DataFrame, row: str, made: dict[str, Column]) -> DataFrame:
    """The fields of the struct ``row``, with ``made`` in place of fields of the same name, or after them."""
    fields = df.schema[row].dataType.names
    low = {name.lower() for name in made}
    kept = [made[next(k for k in made if k.lower() == f.lower())].alias(f) if f.lower() in low else F.col(f"{row}.`{f}`").alias(f) for f in fields]
    have = {f.lower() for f in fields}
    return df.select(*kept, *[c.alias(name) for name, c in made.items() if name.lower() not in have])


def parts(df: DataFrame) -> int:
    """One part of a hash space for each shuffle partition the session is set to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
