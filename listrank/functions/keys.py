"""Hash keys of (user, item) pairs: unsigned 64-bit values kept as the bit pattern of a long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the mixer.
GOLDEN = 0x9E3779B97F4A7C15
FIRST = 0xFF51AFD7ED558CCD
SECOND = 0xC4CEB9FE1A85EC53
_SIGN = -(1 << 63)


def signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def times(a: Column, b: int) -> Column:
    """a * b modulo 2^64, from limbs of 22 bits, so that no product overflows under ANSI arithmetic."""
    low = F.lit((1 << 22) - 1).cast("long")
    a0, a1, a2 = a.bitwiseAND(low), F.shiftrightunsigned(a, 22).bitwiseAND(low), F.shiftrightunsigned(a, 44)
    b0, b1, b2 = (F.lit((b >> s) & ((1 << 22) - 1)).cast("long") for s in (0, 22, 44))
    c0 = a0 * b0
    c1 = a0 * b1 + a1 * b0 + F.shiftrightunsigned(c0, 22)
    c2 = a0 * b2 + a1 * b1 + a2 * b0 + F.shiftrightunsigned(c1, 22)
    top = F.shiftleft(c2.bitwiseAND(F.lit((1 << 20) - 1).cast("long")), 44)
    return c0.bitwiseAND(low).bitwiseOR(F.shiftleft(c1.bitwiseAND(low), 22)).bitwiseOR(top)


def add_key(df: DataFrame, name: str, user: Column, item: Column, seed: Column | int) -> DataFrame:
    """Adds the mixed key of each row. Each step is a column of its own: the optimizer keeps the steps apart, since each
    is used more than once, and all of them run in one generated stage."""
    seed = F.lit(signed(seed)) if isinstance(seed, int) else seed
    own = df.columns
    df = df.withColumn("_u", user.cast("long")).withColumn("_i", item.cast("long"))
    df = df.withColumn("_z", seed.bitwiseXOR(times(F.col("_u"), GOLDEN)).bitwiseXOR(times(F.col("_i"), GOLDEN >> 1)))
    for factor in (FIRST, SECOND):
        df = df.withColumn("_y", F.col("_z").bitwiseXOR(F.shiftrightunsigned("_z", 33)))
        df = df.withColumn("_z", times(F.col("_y"), factor))
    return df.select(*[c for c in own if c != name], F.col("_z").bitwiseXOR(F.shiftrightunsigned("_z", 33)).alias(name))


def unsigned_order(key: Column) -> Column:
    """A long that sorts as the unsigned key does."""
    return key.bitwiseXOR(F.lit(_SIGN))


def float32_key(key: Column) -> Column:
    """key / 2^64 as a float: rounded to double first, then to float."""
    wide = key.cast("decimal(20,0)")
    whole = F.when(key < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide)
    return (whole.cast("double") / F.lit(float(1 << 64))).cast("float")
