"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

A source's target is its weight's share of the whole, clamped at ``max_epochs`` times its size; what
the clamp leaves over goes to the others by weight until no target is above its clamp. In order of
clamp over weight the clamped sources are a prefix, so that fixed point is one running sum over the
sources. A target then becomes whole repetitions of every document, and a fractional one of the
documents first in a seeded order, the last of them in part, so a source's words meet its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P, Scratch, n_words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Hex digits of the order that make a bucket: a source is spread over 16 ** 3 tasks at most.
BUCKET_DIGITS = 3

_SRC, _NUL, _SIZE, _ORD, _BKT, _TIE = (P + x for x in ("src", "nul", "size", "order", "bucket", "tie"))


def cyclic_weights(weights: tuple[float, ...] = WEIGHTS) -> Column:
    """The weight of the n-th source (column ``n``, from 0), repeating."""
    return F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("n") % len(weights) + 1).cast("int"))


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources(..., total, weight)`` plus ``target``: the capped water level of each.

    One row per source, so the single-partition window sees as many rows as there are sources.
    """
    cap, ratio = F.col("total") * float(max_epochs), F.col("cap") / F.col("weight")
    order = Window.orderBy("ratio", "n")
    whole = Window.partitionBy()
    s = sources.withColumn("cap", cap).withColumn("ratio", ratio)
    s = s.withColumn("before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("after", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("want", F.sum("total").over(whole) * float(share))
    level = (F.col("want") - F.coalesce("before", F.lit(0.0))) / F.col("after")
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
    return s.withColumn(
        "target", F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    ).drop("cap", "ratio", "before", "after", "want", "level")


def seeded_order(id_col: str, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """All columns and the working ones: size in words, source key, seeded order, bucket, and what settles ties."""
    src = F.col(f"`{source_col}`")
    return (
        df.withColumn(_SIZE, n_words(text_col))
        .withColumn(_SRC, F.coalesce(src, F.lit("")))
        .withColumn(_NUL, src.isNull())
        .withColumn(_ORD, seeded_order(id_col))
        .withColumn(_BKT, F.substring(_ORD, 1, BUCKET_DIGITS))
        .withColumn(_TIE, F.xxhash64(F.col(f"`{text_col}`")))
    )


def mix_sized(
    rows: DataFrame,
    id_col: str,
    scratch: Scratch,
    weight: Column | None = None,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """``sized`` rows plus source_size, target and taken, under working names.

    Running sums are two-level: over the buckets of a source, then over the rows of a bucket.
    """
    buckets = scratch.table(rows.groupBy(_SRC, _NUL, _BKT).agg(F.sum(_SIZE).alias("b")), "buckets")
    sources = buckets.groupBy(_SRC, _NUL).agg(F.sum("b").alias("total"))
    sources = sources.withColumn("n", F.row_number().over(Window.orderBy(_NUL, _SRC)) - 1)
    filled = water_fill(sources.withColumn("weight", cyclic_weights() if weight is None else weight), share, max_epochs)
    plan = buckets.join(filled.select(_SRC, _NUL, "total", "target"), [_SRC, _NUL])
    before = Window.partitionBy(_SRC, _NUL).orderBy(_BKT).rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("before", F.coalesce(F.sum("b").over(before), F.lit(0)))
    plan = plan.withColumn("epochs", F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(F.lit(0)))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("total")).cast("long"))
    plan = scratch.table(
        plan.select(_SRC, _NUL, _BKT, *(F.col(c).alias(P + c) for c in ("total", "target", "before", "epochs", "rest"))), "plan"
    )
    within = Window.partitionBy(_SRC, _NUL, _BKT).orderBy(_ORD, f"`{id_col}`", _SIZE, _TIE).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(plan, [_SRC, _NUL, _BKT])
    out = out.withColumn(P + "at", F.col(P + "before") + F.coalesce(F.sum(_SIZE).over(within), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col(_SIZE), F.col(P + "rest") - F.col(P + "at")))
    return out.withColumn(P + "part", part.cast("long")).withColumn(
        P + "taken", (F.col(P + "epochs") * F.col(_SIZE) + F.col(P + "part")).cast("long")
    )


def mix_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``(id, size, source_size, target, taken)`` for every row.

    A null text has size 0 and takes 0; a null source is a source of its own, last in order; a
    source without words has target 0. Repeated rows are each taken on their own; of rows with one id the
    shorter come first, of equally long ones the order is by a hash of the text. Empty tables give no rows.
    """
    scratch = Scratch(df.sparkSession)
    narrow = sized(df.select(f"`{id_col}`", f"`{text_col}`", f"`{source_col}`"), id_col, text_col, source_col)
    rows = scratch.table(narrow.drop(text_col, source_col), "sized")
    return mix_sized(rows, id_col, scratch, **how).select(
        f"`{id_col}`", F.col(_SIZE).alias("size"), F.col(P + "total").alias("source_size"),
        F.round(P + "target", 3).alias("target"), F.col(P + "taken").alias("taken"),
    )


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row once for every whole repetition, once more for a fractional one.

    The document at the edge of a source's target comes with its first words up to the target.
    Rows without words, null texts among them, are in no repetition; a null source is one of its own, last
    in order. Repeated rows and null ids are rows like any other; ties are settled as in ``mix_report``. Columns are those
    of ``df``, whatever their names; an empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession)
    got = mix_sized(sized(df, id_col, text_col, source_col), id_col, scratch, **how)
    whole = F.col(P + "epochs") + (F.col(P + "part") == F.col(_SIZE)).cast("long")
    cut = (F.col(P + "part") > 0) & (F.col(P + "part") < F.col(_SIZE))
    got = got.where(F.col(P + "taken") > 0).withColumn(P + "copies", F.array_repeat(F.lit(False), whole.cast("int")))
    got = got.withColumn(P + "copies", F.when(cut, F.concat(P + "copies", F.array(F.lit(True)))).otherwise(F.col(P + "copies")))
    got = got.withColumn(P + "cut", F.explode(P + "copies"))
    first = F.array_join(
        F.slice(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)")), 1, F.col(P + "part").cast("int")), ""
    )
    text = F.when(F.col(P + "cut"), first).otherwise(F.col(f"`{text_col}`"))
    return got.withColumn(text_col, text).select(*(f"`{c}`" for c in df.columns))
