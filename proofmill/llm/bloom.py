"""Bloom bitmaps of a fixed size, built and probed by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of one 4 KiB block of ``bitmap_construct_agg``.
BLOCK = 32768
#: 2^26 bits: at most 2,048 blocks, 8 MiB, so a filter may always be broadcast.
BITS = 1 << 26


def cell(key: Column, seed: int, bits: int = BITS) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(bits))


def bitmap(cells: DataFrame) -> DataFrame:
    """(block, bitmap) of the set cells of a one-column frame ``cell``; merged map-side."""
    return (cells.groupBy(F.expr(f"cast(cell div {BLOCK} as int)").alias("block"))
            .agg(F.expr(f"bitmap_construct_agg(cell % {BLOCK})").alias("bitmap")))


def members(keys: DataFrame, key: Column, seed: int, bits: int = BITS) -> DataFrame:
    """The ordinary Bloom filter: cells that some key hits."""
    return bitmap(keys.select(cell(key, seed, bits).alias("cell")))


def repeated(keys: DataFrame, key: Column, seed: int, bits: int = BITS) -> DataFrame:
    """Cells that at least two rows hit. Equal cells are counted map-side first."""
    return bitmap(keys.select(cell(key, seed, bits).alias("cell"))
                  .groupBy("cell").count().where("count > 1"))


def probe(rows: DataFrame, filter_: DataFrame, key: Column, seed: int, hit: str,
          bits: int = BITS) -> DataFrame:
    """Rows with a boolean column ``hit``: false means surely not in the filter.

    The filter has at most ``bits / 8`` bytes and is broadcast; the rows do not move.
    """
    at, block, bits_ = f"{hit}_at", f"{hit}_block", f"{hit}_bitmap"
    side = filter_.select(F.col("block").alias(block), F.col("bitmap").alias(bits_))
    rows = rows.withColumn(at, cell(key, seed, bits))
    joined = rows.join(F.broadcast(side), F.expr(f"cast(`{at}` div {BLOCK} as int)") == F.col(block), "left")
    byte = f"cast(conv(hex(substring(`{bits_}`, cast(`{at}` % {BLOCK} div 8 as int) + 1, 1)), 16, 10) as int)"
    bit = F.expr(f"coalesce((shiftright({byte}, cast(`{at}` % 8 as int)) & 1) = 1, false)")
    return joined.withColumn(hit, bit).drop(at, block, bits_)
