"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are read off its bits.

``ledger`` appends measurements and one long whose bit i says that rule i failed. A policy is a
version name and the mask of rules it enforces, so another policy, or the effect of leaving a rule
out, is bit arithmetic on the ledger and never another pass over texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import P, add_columns

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Measurements of a text, in this order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "max_run")
_NOT_COUNTED = bytes([9, 10, 11, 12, 13, 32, *range(0x80, 0xC0)])
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by a window of words that occurs twice or more in the text, exactly."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    size, code, top = len(ids), w[: n - window + 1].copy(), len(ids)
    for i in range(1, window):
        if top > (1 << 62) // size:  # renumber what has been combined so far
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            top = len(code)
        code = code * size + w[i : n - window + 1 + i]
        top *= size
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    edge[: len(code)] += twice
    edge[window : window + len(code)] -= twice
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: bytes) -> list[int]:
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    longest = run = 0
    before = None
    for x in words:
        run = run + 1 if x == before else 1
        before = x
        if run > longest:
            longest = run
    return [
        n,
        len(text.translate(None, _NOT_COUNTED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, _UPPER)),
        len(text) - len(text.translate(None, _UPPER + _LOWER)),
        longest,
    ]


@dataclass(frozen=True)
class Rule:
    """A name and what makes a text fail, over the measurement columns."""

    name: str
    fails: str


#: Bit i of the ledger belongs to rule i. Rules are only ever appended.
RULES = (
    Rule("few_words", "{n_words} < 10"),
    Rule("repeated_windows", "100 * {n_repeat_words} > 20 * {n_words}"),
    Rule("symbols", "10 * {n_symbols} > 3 * {n_words}"),
    Rule("word_length", "{word_chars} < 2 * {n_words} OR {word_chars} > 20 * {n_words}"),
    Rule("duplicate_lines", "2 * {n_dup_lines} > {n_lines}"),
    Rule("capitals", "2 * {n_upper} > {n_letters} AND {n_letters} >= 40"),
    Rule("one_word_run", "{max_run} >= 8"),
)


def mask(*names: str) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(RULES)}
    return sum(bits[n] for n in names)


#: Versioned policies. "base" holds the two rules whose failure is reported on its own.
POLICIES = {
    "base": mask("few_words", "repeated_windows"),
    "v1": mask("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": mask(*(r.name for r in RULES)),
}
CURRENT = "v2"


def failed(bits: str, policy: str | int) -> Column:
    """Whether the ledger's bits break the policy."""
    m = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col(bits).bitwiseAND(F.lit(m)) != 0


def ledger(df: DataFrame, text_col: str = "text", prefix: str = P, bits: str = P + "failures") -> DataFrame:
    """All rows and columns, the measurements (named with ``prefix``) and the failure bits.

    Null and empty texts measure zero throughout and fail ``few_words``. Repeated rows and null ids are rows like
    any other, an empty table gives no rows. A column of ``df`` that has the name of a measurement (with ``prefix``)
    gives way to it; choose another prefix to keep it. Nothing is shuffled.
    """
    df = df.drop(*({prefix + m for m in MEASURES} | {bits}) & set(df.columns))

    def run(texts: list[bytes]) -> list[list]:
        return list(np.array([measure(t) for t in texts], np.int64).reshape(-1, len(MEASURES)).T)

    out = add_columns(df, text_col, [T.StructField(prefix + m, T.LongType()) for m in MEASURES], run)
    names = {m: f"`{prefix}{m}`" for m in MEASURES}
    one = [F.when(F.expr(r.fails.format(**names)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES)]
    total = one[0]
    for x in one[1:]:
        total = total.bitwiseOR(x)
    return out.withColumn(bits, total)


def ablations(led: DataFrame, bits: str = P + "failures", policy: str = CURRENT) -> DataFrame:
    """One row per rule of a policy: documents it fails, fails alone, and kept without it.

    The ledger is first counted by its distinct bit patterns, so the rest handles at most
    2 ** rules rows whatever the corpus. A ledger without rows gives none.
    """
    m = POLICIES[policy]
    patterns = led.groupBy(F.col(bits).bitwiseAND(F.lit(m)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if m >> i & 1))
    each = patterns.select("b", "n", F.explode(rules).alias("r")).select("b", "n", "r.rule", "r.bit")
    hit = F.col("b").bitwiseAND(F.col("bit")) != 0
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        total(hit).alias("failed"),
        total(F.col("b") == F.col("bit")).alias("failed_alone"),
        total(F.col("b") == 0).alias("kept"),
        total((F.col("b") == 0) | (F.col("b") == F.col("bit"))).alias("kept_without"),
    )


def keep_good(df: DataFrame, text_col: str = "text", policy: str = CURRENT) -> DataFrame:
    """The rows that pass the policy, with their own columns only, whatever their names.

    Null and empty texts fail (``few_words``); repeated rows and null ids are judged like any other; an empty
    table gives no rows.
    """
    led = ledger(df, text_col)
    return led.where(~failed(P + "failures", policy)).select(*(f"`{c}`" for c in df.columns))
