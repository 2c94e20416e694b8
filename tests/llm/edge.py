"""One awkward table that every operator must read, and brute-force versions."""

from pyspark.sql import types as T

LONG = "lorem ipsum dolor sit amet " * 20_000
LINE = "This is a line that many documents share."
#: Null id, null text, empty text, white space only, ties, repeated rows, one very long text.
ROWS = [
    (1, f"first words here\n{LINE}\nand some more words to make it ten or so", "a"),
    (2, None, "a"),
    (3, "", "b"),
    (3, "", "b"),
    (4, f"second\n  {LINE.upper()} \t\nends", None),
    (5, f"{LINE}\n{LINE}\nlast holder of the line", "b"),
    (6, " \t\n \x0b\x0c\r ", "c"),
    (7, LONG, "a"),
    (8, "ünïcödé wörds — ß   ten or more of them are in this very text 🎉 <|endoftext|> end", ""),
    (None, f"no id at all\n{LINE}", "a"),
    (None, None, None),
    (9, "same text in two documents, word for word, ten words at least", "b"),
    (10, "same text in two documents, word for word, ten words at least", "b"),
    (11, "blank " + " " * 1_000_000 + " run", "a"),
]
#: Further columns whose names operators might use themselves.
CLASH = ["id", "size", "score", "t", "key", "keys", "fp", "root", "component_id", "n", "y", "digest", "start", "length", "target", "n_words", "x", "n_lines", "n_dropped", "n_tokens", "taken", "offset", "page", "feature", "failures", "label", "hub"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASH]
)


def table(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(i, t, s, "en", len(t or ""), *["clash"] * len(CLASH)) for i, t, s in rows], SCHEMA).repartition(3)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def texts(spark, path="/root/testdata/sf0.001"):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
