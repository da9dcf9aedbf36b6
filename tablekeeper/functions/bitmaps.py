"""Bitmaps of bounded size as column functions: which rows may be among a set of numbers."""

import math

from pyspark.sql import functions as F

#: Bits of one bitmap that Spark's aggregate makes.
PIECE = 32768
#: A bitmap has at least one piece and at most 2 MiB; a full one lets every row through.
MOST_BITS = 1 << 24
BITS_PER_NUMBER = 32


def size_for(count):
    """Bits for so many numbers: a power of two, so that about one in 32 other numbers passes, while it fits."""
    return min(MOST_BITS, max(PIECE, 1 << (count * BITS_PER_NUMBER - 1).bit_length()))


def share_held(count):
    """Share of other numbers that a bitmap of so many lets through."""
    return 1 - math.exp(-count / size_for(count)) if count else 0.0


def bitmap_of(numbers, count):
    """(bytes, bits) of the one bigint column of ``numbers``, at most ``count`` of them."""
    bits = size_for(count)
    at = F.pmod(F.col(numbers.columns[0]), F.lit(bits))
    pieces = numbers.select(at.alias("at")).groupBy(F.call_function("div", "at", F.lit(PIECE)).alias("piece")).agg(
        F.bitmap_construct_agg((F.col("at") % PIECE).cast("bigint")).alias("bits")).collect()  # MOST_BITS together
    whole = bytearray(bits // 8)
    for row in pieces:
        whole[row["piece"] * PIECE // 8:(row["piece"] + 1) * PIECE // 8] = row["bits"]
    return bytes(whole), bits


def may_hold(bitmap, number):
    """False only where ``number`` is not in the bitmap of ``bitmap_of``; NULL counts as 0."""
    data, bits = bitmap
    at = F.pmod(F.coalesce(number, F.lit(0)), F.lit(bits))
    byte = F.substring(F.lit(data), (F.call_function("div", at, F.lit(8)) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) == 1
