"""Shared pieces of the training-data operators: scratch tables, Arrow plumbing, names.

Conventions every operator here follows:

* a null text is read as the empty text; a null id is an id of its own, below all others;
* rows may repeat, tables may be empty, extra columns of any name may be present: working
  columns carry the prefix ``__rg_`` and only the named id/text/source columns are read;
* tables reused by later steps are written once, to the folder ``spark.checkpoint.dir`` names,
  so a lost executor costs a re-read and never a recomputation from another executor's disk.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_root, ship

#: A word: a run of anything but the space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
P = "__rg_"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written tables of one operator call.

    ``table`` writes once and reads back; ``drop`` removes what no later step needs. What the
    returned (lazy) result still reads stays until the driver's Python ends.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.base = f"{scratch_root(spark)}/rg-{uuid.uuid4().hex}"
        self._count = 0
        self._paths: dict[int, str] = {}
        self._keep: list[DataFrame] = []  # so that no other frame gets the number of one that is gone
        atexit.register(self._at_exit)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self._count += 1
        path = f"{self.base}/{self._count:02d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        self._keep.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self._paths.pop(id(t), None)
            if path:
                delete_path(self.spark, path)

    def _at_exit(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                delete_path(self.spark, self.base)
        except Exception:  # the JVM may already be gone
            pass


def text_bytes(col: str) -> Column:
    """The UTF-8 bytes of a text; null is the empty text."""
    return F.coalesce(F.col(f"`{col}`"), F.lit("")).cast("binary")


def n_words(col: str) -> Column:
    """Number of words of a text, without Python; null has none."""
    return F.regexp_count(F.coalesce(F.col(f"`{col}`"), F.lit("")), F.lit(WORD)).cast("long")


def add_columns(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    fn: Callable[[list[bytes]], list[list]],
    replace_text: bool = False,
    batch_bytes: int = 8 << 20,
) -> DataFrame:
    """Append columns computed from whole texts, one Arrow batch at a time, without a shuffle.

    ``fn`` gets the texts of a slice as bytes and returns one list per field. Slices hold at most
    ``batch_bytes`` of text (a single longer text is a slice of its own), so memory stays bounded.
    With ``replace_text`` the first list replaces the text column.
    """
    schema = T.StructType(
        [T.StructField(f.name, T.StringType()) if replace_text and f.name == text_col else f for f in df.schema.fields] + fields
    )
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, at, batch_bytes):
                texts = [b"" if t is None else t.encode() for t in part.column(at).to_pylist()]
                lists = fn(texts)
                cols = list(part.columns)
                if replace_text:
                    cols[at] = pa.array(lists[0], pa.string())
                    lists = lists[1:]
                cols += [pa.array(v, out_schema.field(len(cols) + i).type) for i, v in enumerate(lists)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out_schema)], schema=out_schema)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each piece hold at most ``most`` bytes."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if n == 0:
        return
    lens = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
