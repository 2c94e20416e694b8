"""Byte-level BPE encoders of a vocabulary file, one per Python worker, and a cached token count."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices

LIMIT = 512
#: Bytes of text up to which texts are shuffled by digest in any case.
SMALL_BYTES = 64 << 20
#: Digests at most that are broadcast (32 bytes and an id each: about 40 MB).
BROADCAST_DIGESTS = 500_000
#: Characters of one kind in a row that send a text to the library (any half as many may).
LONG_RUN = 4000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def library_tokenizer(path: str):
    """The library's own tokenizer of a .json file: its defaults, no truncation, no padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=2)
def sentence_model(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text by the library for the file: tokenizers for .json, sentencepiece for .model."""
    if path.endswith(".model"):
        return [len(x) for x in sentence_model(path).encode(texts, num_threads=1)]
    tok = library_tokenizer(path)
    return [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def fast_encoder(path: str):
    """The library's ids of a text, by tiktoken over the same vocabulary where that is safe: about four times as fast.

    Equal for byte-level BPE files whose ids ascend in merge order and which have neither a
    normalizer nor an added prefix space; any other file goes to the library itself. So does a text with
    a run of ``LONG_RUN`` characters of one kind, on which tiktoken's pattern gives up or takes the square
    of the run's length, and any text it refuses.
    """
    import public_tokenizers
    import regex
    import tiktoken

    library = library_tokenizer(path)
    plain = lambda text: library.encode(text, add_special_tokens=False).ids
    spec = json.load(open(path, encoding="utf-8"))
    model, pre = spec["model"], spec.get("pre_tokenizer") or {"type": None}
    if model["type"] != "BPE" or spec.get("normalizer") or pre["type"] != "ByteLevel" or pre.get("add_prefix_space"):
        return plain
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(back[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if merged != sorted(merged):
        return plain
    enc = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    common = regex.compile(r"[\s\p{L}\p{N}]")

    def long_run(text: str) -> bool:
        """Whether an aligned stretch of half the length is of one kind, as any run of the whole length holds one."""
        half = LONG_RUN // 2
        for at in range(0, len(text) - half + 1, half):
            part = text[at : at + half]
            if part.isspace() or part.isalpha() or part.isnumeric() or not common.search(part):
                return True
        return False

    def ids(text: str) -> list[int]:
        if not long_run(text):
            try:
                return enc.encode(text, allowed_special="all", disallowed_special=())
            except ValueError:  # the pattern gave up
                pass
        return plain(text)

    return ids


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    with open(path, "rb") as f:
        body = f.read()
    lib = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    return hashlib.sha256(body + lib.encode()).hexdigest()[:32]


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def token_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, cache: str | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every row, through a digest cache.

    A text is normalised (null to empty; any other change would change counts) and named by its
    SHA-256. ``cache`` is a folder that holds one Parquet table of (digest, n_tokens) for each
    tokenizer version; digests found there are not encoded. The distinct others are encoded once,
    appended, and every row gets its count by a join. Without ``cache`` a new folder is used.

    Which rows to encode is decided on the narrow table of digests: one holder, by id, of each missing digest.
    Texts are encoded where they lie as long as the digests that tell so are at most ``BROADCAST_DIGESTS``
    (counted first): those with several holders, and the hits or the misses, whichever are fewer. Otherwise the
    missing texts are shuffled by digest.

    A count appended twice, by concurrent runs or for rows that repeat id and text, is read once. Repeated rows
    and null ids each come back; other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    vocabulary = vocabulary or default_vocabulary()
    cache = cache or f"{scratch.base}/cache"
    table = f"{cache.rstrip('/')}/{tokenizer_version(vocabulary)}"
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = scratch.table(rows, "digests")
    wanted = scratch.table(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("holder")), "wanted")
    texts = df.select(F.col(f"`{id_col}`").alias("id"), digest.alias("digest"), text.alias("text"))
    several = wanted.where("rows > 1").select("digest", "holder")
    few = lambda t: t.count() <= BROADCAST_DIGESTS
    # A table so small may lie in one task's share of the input; its texts are spread by a shuffle that costs nothing.
    stay = (rows.agg(F.sum("n_bytes")).first()[0] or 0) > SMALL_BYTES and few(several)
    if path_exists(spark, f"{table}/_SUCCESS"):
        known = spark.read.schema("digest binary, n_tokens long").parquet(table).select("digest")
        hits = scratch.table(wanted.join(known, "digest", "left_semi").select("digest"), "hits")
        misses = scratch.table(wanted.join(hits, "digest", "left_anti").select("digest"), "misses")
        if stay and few(misses):
            texts = texts.join(F.broadcast(misses), "digest", "left_semi")
        elif stay and few(hits):
            texts = texts.join(F.broadcast(hits), "digest", "left_anti")
        else:
            stay, texts = False, texts.join(misses, "digest", "left_semi")
    if stay:
        own = F.col("holder_digest").isNull() | F.col("id").eqNullSafe(F.col("holder"))
        once = texts.join(F.broadcast(several.withColumnRenamed("digest", "holder_digest")), F.col("digest") == F.col("holder_digest"), "left").where(own)
    else:
        once = texts.groupBy("digest").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                counts = count_tokens(part.column(1).to_pylist(), vocabulary)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    once.select("digest", "text").mapInArrow(encode, "digest binary, n_tokens long").write.mode("append").parquet(table)
    stored = spark.read.schema("digest binary, n_tokens long").parquet(table)
    counts = stored.join(wanted.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = scratch.table(counts, "counts")
    return rows.join(counts, "digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
