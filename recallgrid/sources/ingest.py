"""Sources and sinks: token streams, chunks, positions, the surrogate model, result files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.vectors import nearest, vector_sums
from ..schema import POSITIONS_PER_CHUNK, draw, split_of, split_of_draw

#: Turns that a conversation may have before ids of the next begin.
TURNS = 1 << 20
#: Named corpora: a reader giving (doc_id, text).
CORPORA: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "documents": lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"),
    "benchmark": lambda spark, d: spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text"),
    "conversations": lambda spark, d: spark.read.parquet(f"{d}/conversations.parquet").select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("doc_id"), "text"
    ),
}

#: A title line: a single equals sign, a space and the title, and the same behind.
TITLE = r"^ = [^=].* = \n?$"
END = "<eos>"


def is_title(text: str) -> Column:
    return F.col(text).rlike(TITLE)


def words(text: str) -> Column:
    """Whitespace tokens of a text and the end mark."""
    return F.concat(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\r]+"), lambda w: w != ""), F.array(F.lit(END)))


def with_offsets(docs: DataFrame, size: str, by: list[str], order: str, buckets: int = 1024) -> DataFrame:
    """Add ``offset``: the sizes before a row in the order, by group, as a two-level running sum.

    Rows are first summed by ranges of the order, so no task sees a whole group.
    """
    b = docs.withColumn("_b", F.floor(F.col(order) / buckets))
    sums = b.groupBy(*by, "_b").agg(F.sum(size).alias("_s"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    within = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = b.join(sums, [*by, "_b"]).withColumn("offset", F.col("_before") + F.coalesce(F.sum(size).over(within), F.lit(0)))
    return out.drop("_b", "_before")


def chunks(docs: DataFrame, length: int, by: list[str] | None = None) -> DataFrame:
    """Fixed-length chunks of the token stream: ``(by..., chunk_id, doc_id, tokens)``.

    Documents are cut where the stream's chunk edges fall and the pieces, not single tokens, are
    shuffled to their chunk. doc_id is the last document in it; a short last chunk is dropped. What is shuffled are texts: an
    array takes at least 16 bytes a token.
    """
    by = by or []
    rows = docs.select(*by, "doc_id", "text", F.size(words("text")).cast("long").alias("n"))
    rows = with_offsets(rows, "n", by, "doc_id").withColumn("t", words("text"))
    first, last = F.floor(F.col("offset") / length), F.floor((F.col("offset") + F.col("n") - 1) / length)
    pieces = rows.withColumn("chunk_id", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("chunk_id") * length - F.col("offset"), F.lit(0))
    stop = F.least((F.col("chunk_id") + 1) * length - F.col("offset"), F.col("n"))
    pieces = pieces.select(*by, "chunk_id", "doc_id", "offset", F.array_join(F.slice("t", (start + 1).cast("int"), (stop - start).cast("int")), " ").alias("p"))
    got = pieces.groupBy(*by, "chunk_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "p"))).alias("ps"))
    got = got.select(*by, "chunk_id", F.element_at("ps", -1)["doc_id"].alias("doc_id"), F.split(F.array_join(F.transform("ps", lambda s: s["p"]), " "), " ").alias("tokens"))
    return got.where(F.size("tokens") == length)


def chunks_by_split(docs: DataFrame, length: int, articles: bool = False, salt: int = 0) -> DataFrame:
    """Chunks within each split; documents are split one by one, or as articles from title to title."""
    unit = F.col("doc_id")
    if articles:
        flagged = docs.withColumn("_t", is_title("text").cast("long"))
        docs = with_offsets(flagged, "_t", [], "doc_id").withColumn("_article", F.col("offset") + F.col("_t")).drop("offset", "_t")
        unit = F.col("_article")
    r = draw(draw(unit, salt), 1) / float(1 << 31)
    return chunks(docs.withColumn("split", split_of_draw(r)), length, ["split"])


def next_tokens(chunked: DataFrame) -> DataFrame:
    """``(chunk_id, pos, token, target)``: each token with its successor in the chunk, the last dropped."""
    pairs = F.arrays_zip(F.slice("tokens", F.lit(1), F.size("tokens") - 1).alias("a"), F.slice("tokens", F.lit(2), F.size("tokens") - 1).alias("b"))
    return chunked.select("chunk_id", F.posexplode(pairs).alias("pos", "p")).select(
        "chunk_id", "pos", F.col("p.a").alias("token"), F.col("p.b").alias("target")
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as positions: key vectors in double precision, label as the observed token."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(
        F.col("vec_id").alias("pos_id"), split_of("vec_id").alias("split"), F.floor(F.col("vec_id") / POSITIONS_PER_CHUNK).alias("chunk_id"),
        F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"),
    )


def surrogate_model(pos: DataFrame, temperature: float = 0.25) -> DataFrame:
    """``(pos_id, token, p)``: softmax over tokens of minus the distance to the token's mean key.

    A stand-in for a language model, from datastore rows only.
    """
    mu = vector_sums(pos.where("split = 'ds'").withColumn("y", F.col("y").cast("long")), "y")
    mu = mu.select(F.col("y").alias("pos_id"), F.transform("s", lambda v: v / F.col("n")).alias("x"))
    d = nearest(pos, mu, 1 << 30).select(F.col("query_id").alias("pos_id"), F.col("entry_id").alias("token"), "dist")
    w = Window.partitionBy("pos_id")
    d = d.withColumn("e", F.exp(-(F.col("dist") - F.min("dist").over(w)) / temperature))
    return d.select("pos_id", "token", (F.col("e") / F.sum("e").over(w)).alias("p"))


def save_cache(pos: DataFrame, path: str) -> None:
    """Positions by split, so that reading one split prunes the others' folders."""
    pos.write.mode("overwrite").partitionBy("split").parquet(path)


def load_cache(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def save_rows(frames: list[DataFrame], path: str, kind: str = "csv") -> None:
    """Rows of unlike frames under the union of their columns, as csv, json lines or parquet."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    w = out.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.format(kind).save(path)
