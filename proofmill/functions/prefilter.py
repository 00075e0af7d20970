"""Bloom prefilter for joins against a smaller side: only rows that may match reach the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Bits of a block of ``bitmap_construct_agg``; blocks are rows of 4 KiB.
_BLOCK = 32768
#: Bits of the filter: at most 512 blocks, 2 MiB, so it may always be broadcast.
BITS = 1 << 24


def flag_possible(rows: DataFrame, side: DataFrame, keys: list[str], name: str, bits: int = BITS) -> DataFrame:
    """Rows with a boolean column: false where ``side`` surely has no row of the same keys.

    The side's key hashes are gathered, map-side first, in a bitmap of a fixed size, which is
    broadcast, so the rows do not move. As the side grows the bitmap fills and more rows pass;
    what follows has to compare the keys themselves. Null keys match nothing.
    """
    cell = F.pmod(F.xxhash64(*keys), F.lit(bits))
    some = side.select(*keys).dropna().select(cell.alias("__cell"))
    blocks = some.groupBy(F.expr(f"cast(__cell div {_BLOCK} as int)").alias("__block")).agg(
        F.expr(f"bitmap_construct_agg(__cell % {_BLOCK})").alias("__bits"))
    placed = rows.withColumn("__cell", F.when(F.concat(*[F.col(k).isNotNull().cast("string") for k in keys])
                                              == "true" * len(keys), cell))
    placed = placed.withColumn("__block", F.expr(f"cast(__cell div {_BLOCK} as int)")).join(F.broadcast(blocks), "__block", "left")
    byte = f"conv(hex(substring(__bits, cast(__cell % {_BLOCK} div 8 as int) + 1, 1)), 16, 10)"
    bit = F.expr(f"coalesce((shiftright(cast({byte} as int), cast(__cell % 8 as int)) & 1) = 1, false)")
    return placed.withColumn(name, bit).drop("__cell", "__block", "__bits")


def possible(rows: DataFrame, side: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """The rows that may have a match in ``side``, to be joined with it afterwards."""
    return flag_possible(rows, side, keys, "__may_match", bits).where("__may_match").drop("__may_match")
