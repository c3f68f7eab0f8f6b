"""Rows of a table that has no key of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def content_key(rows: DataFrame) -> Column:
    """128 bits of all columns: equal rows have equal keys."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))


def free_names(rows: DataFrame, *names: str) -> list[str]:
    """`names`, each with underscores before it as far as `rows` has columns of that name, in whatever case."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def repeated(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """Each distinct row of `rows` as often as `copies` (_key, _copies, _rows) says, not at all if its key is missing.

    _rows tells how many equal rows there are: only rows that occur more than once are made distinct, all others are
    joined and not grouped. Columns of `rows` may have any names.
    """
    key, often, equal, copy = free_names(rows, "_key", "_copies", "_rows", "_copy")
    wanted = copies.where("_copies > 0").select(F.col("_key").alias(key), F.col("_copies").cast("long").alias(often), F.col("_rows").alias(equal))
    found = rows.withColumn(key, content_key(rows)).join(wanted, key)
    single = found.where(F.col(equal) == 1).unionAll(found.where(F.col(equal) > 1).dropDuplicates([key]))
    names = [f"`{c}`" for c in rows.columns]
    return single.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(often)))).select(*names)
