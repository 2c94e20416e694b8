"""Table schemas, the split rule and the portable hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())

POSITIONS = T.StructType([
    T.StructField("pos_id", T.LongType()), T.StructField("split", T.StringType()), T.StructField("chunk_id", T.LongType()),
    T.StructField("x", VECTOR), T.StructField("y", T.IntegerType()),
])
NEIGHBOURS = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("entry_id", T.LongType()),
    T.StructField("dist", T.DoubleType()),
])

#: Positions of a chunk, as the last of the ids has no next token.
POSITIONS_PER_CHUNK = 10
#: Fixed multiplier, increment and modulus of the portable generator.
LCG = (1103515245, 12345, 2147483648)


def split_of(pos_id: str) -> Column:
    """70 / 15 / 15 by id: ds (datastore), ct (tuning), val (evaluation)."""
    r = F.col(pos_id) % 20
    return F.when(r < 14, "ds").when(r < 17, "ct").otherwise("val")


def split_of_draw(r: Column, ds: float = 0.7, ct: float = 0.15) -> Column:
    """Split name of a uniform draw."""
    return F.when(r < ds, "ds").when(r < ds + ct, "ct").otherwise("val")


def draw(id_col: Column, salt: int = 0) -> Column:
    """A portable pseudo-random integer below 2 ** 31 of any 64-bit id; the same in every engine with 64-bit integers.

    The id is reduced first, so that no id overflows.
    """
    a, c, m = LCG
    small = F.pmod(id_col.cast("long"), F.lit(m).cast("long"))
    return (F.pmod(small + F.lit(salt), F.lit(m).cast("long")) * F.lit(a).cast("long") + F.lit(c)) % F.lit(m).cast("long")


def pick(id_col: Column, many: Column | int, salt: int = 0) -> Column:
    """A portable choice among ``many``, from the high halves of two draws: 30 bits."""
    one = draw(id_col, salt)
    high = lambda d: F.floor(d / 65536)
    return (high(one) * 32768 + high(draw(one))) % many


def lcg_sql(x: str) -> str:
    """``draw`` in SQL."""
    a, c, m = LCG
    return f"(((({x}) % {m} + {m}) % {m} * {a} + {c}) % {m})"


def pick_sql(x: str, many: int) -> str:
    """``pick`` in SQL."""
    high = lambda d: f"({d} // 65536)"
    return f"(({high(lcg_sql(x))} * 32768 + {high(lcg_sql(lcg_sql(x)))}) % {many})"
