"""Join helpers that stay safe when a side or a key grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusquery.session import shared_dir

# A side is broadcast only when a count proves it within both bounds.  Sides
# are projected to a few short columns first.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024

# Copies of the small side when a hot key has to be spread over tasks.
SALTS = 32


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a compact intermediate table once and go on from there.

    Used where a derived table is read more than once and its source is the
    content of files.  The table lies in the shared folder, so it outlives
    executors.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """Measure a table: one aggregation, combined on the map side."""
    max_rows = MAX_BROADCAST_ROWS if max_rows is None else max_rows
    max_bytes = MAX_BROADCAST_BYTES if max_bytes is None else max_bytes
    width = F.lit(8 * len(df.columns)).cast("bigint")
    for field in df.schema.fields:
        if field.dataType.typeName() in ("string", "binary", "array", "map", "struct"):
            size = F.octet_length(F.col(field.name).cast("string"))
            width = width + F.coalesce(size, F.lit(0))
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(width), F.lit(0).cast("bigint")).alias("b"),
    ).first()
    return row["n"] <= max_rows and row["b"] <= max_bytes


def join_by_size(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str,
    spread_by: list[str] | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Join a large table to a side with few rows per key, whatever its size.

    When the small side is proven small it is broadcast and the large table is
    not moved.  Otherwise both sides are shuffled.  ``spread_by`` is for keys
    that many rows of the large table may share, such as a repository: the key
    is extended by a salt of those columns, every row of the small side is
    repeated per salt, and one hot key goes to ``SALTS`` tasks.  ``how`` must
    not keep unmatched rows of the small side.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join_by_size cannot keep the small side: {how}")
    # A stream cannot be measured ahead of time; its static side is left to Spark.
    if big.isStreaming:
        return big.join(small, on, how)
    if is_small(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    if spread_by is None:
        return big.join(small, on, how)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")
