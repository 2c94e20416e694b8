"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Texts are measured once and each measurement put into a few fixed bins. The cross of all bins is
bounded, so counting rows by bin pattern keeps everything the risk needs of the whole corpus: all
unlabelled text takes part, and the fit itself runs on a table whose size doesn't grow with it.

Trusted positives are the training rows labelled 1; everything is unlabelled text; labels 0 are
never read. The class prior is the best-bin estimate: the least ratio, over score thresholds, of
the unlabelled mass above to the positive mass above.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import P, Scratch, add_columns
from .rules import measure
from .toxicity import held_out

#: Fixed features: an expression over the measurements and the upper edges of its bins but the last.
FEATURES: tuple[tuple[str, str, tuple[float, ...]], ...] = (
    ("length", "n_words", (0, 4, 9, 49)),
    ("symbols", "n_symbols / greatest(n_words, 1)", (0.0, 0.1, 0.3, 1.0)),
    ("windows", "n_repeat_words / greatest(n_words, 1)", (0.0, 0.05, 0.2, 0.5)),
    ("lines", "n_dup_lines / greatest(n_lines, 1)", (0.0, 0.1, 0.3)),
    ("capitals", "n_upper / greatest(n_letters, 1)", (0.05, 0.2, 0.5)),
    ("run", "max_run", (1, 2, 5)),
    ("word_length", "word_chars / greatest(n_words, 1)", (3.0, 8.0, 12.0)),
    ("marks", "n_marks / greatest(n_words, 1)", (0.05, 0.2)),
    ("line_words", "n_words / greatest(n_lines, 1)", (4.0, 11.0, 39.0)),
    ("distinct", "n_distinct / greatest(n_words, 1)", (0.2, 0.4, 0.7)),
)
MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "max_run", "n_marks", "n_distinct")
BINS = [len(edges) + 1 for _, _, edges in FEATURES]
STEPS, RATE, RIDGE = 400, 0.1, 1e-3


def measured(df: DataFrame, text_col: str) -> DataFrame:
    """All columns and the pattern of bins of each text, as one number."""

    def run(texts: list[bytes]) -> list[list]:
        rows = [[*measure(t), len(t) - len(t.translate(None, b"!?")), len(set(t.split()))] for t in texts]
        return list(np.array(rows, np.int64).reshape(-1, len(MEASURED)).T)

    out = add_columns(df, text_col, [T.StructField(P + m, T.LongType()) for m in MEASURED], run)
    code: Column = F.lit(0).cast("long")
    for (_, expr, edges), n in zip(FEATURES, BINS):
        expr = re.sub(r"\b(" + "|".join(MEASURED) + r")\b", rf"`{P}\1`", expr)
        bin_of = F.lit(n - 1)
        for i in range(n - 2, -1, -1):
            bin_of = F.when(F.expr(expr) <= F.lit(float(edges[i])), F.lit(i)).otherwise(bin_of)
        code = code * n + bin_of
    return out.withColumn(P + "pattern", code).drop(*(P + m for m in MEASURED))


class Bins:
    """The bins of pattern numbers as a sparse 0/1 matrix with one column a bin and a constant last.

    Kept as the column of each feature's bin: two bytes a feature and row, so that every pattern there can be
    (1.5 million) takes 31 MB.
    """

    def __init__(self, patterns: np.ndarray):
        rest, offset = patterns.copy(), sum(BINS)
        self.width, self.rows, self.at = offset + 1, len(patterns), []
        for n in reversed(BINS):
            rest, b = np.divmod(rest, n)
            offset -= n
            self.at.append((offset + b).astype(np.int16))

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.full(self.rows, w[-1])
        for at in self.at:
            out += w[at]
        return out

    def adjoint(self, v: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(at, v, self.width) for at in self.at)
        out[-1] = v.sum()
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(z: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Best-bin estimate of the share of positives: scores ``z`` with both weights."""
    o = np.argsort(-z, kind="stable")
    p, u = np.cumsum(positive[o]), np.cumsum(unlabelled[o])
    last = np.r_[z[o][1:] != z[o][:-1], True]
    p, u = p[last], u[last]
    np_, nu = p[-1], u[-1]
    slack = np.sqrt(np.log(20) / (2 * nu)) + np.sqrt(np.log(20) / (2 * np_))
    ok = p >= min(np_, max(5.0, 0.02 * np_))
    bound = (u[ok] / nu + slack) / (p[ok] / np_)
    best = int(np.argmin(bound))
    return float(np.clip((u[ok] / nu)[best] / (p[ok] / np_)[best], 0.02, 0.98))


def nn_pu(x: Bins, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> np.ndarray:
    """Minimise pi R_p(+) + max(0, R_u(-) - pi R_p(-)) with the logistic loss, by Adam.

    Where the second part is negative, a step follows its ascent alone, as the published estimator does.
    """
    p, u = positive / positive.sum(), unlabelled / unlabelled.sum()
    w, m, v = np.zeros(x.width), np.zeros(x.width), np.zeros(x.width)
    for t in range(1, steps + 1):
        z = x.times(w)
        s = sigmoid(z)
        negative = float(u @ np.logaddexp(0, z) - prior * (p @ np.logaddexp(0, z)))
        down = u * s - prior * p * s
        grad = x.adjoint(prior * p * (s - 1) + down if negative >= 0 else -down) + RIDGE * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class QualityModel:
    """Weights of the bins and the constant, and the prior they were fitted with."""

    weights: tuple[float, ...]
    prior: float

    def score(self, pattern: str) -> Column:
        """The probability of good quality, from the pattern number, without Python."""
        rest: Column = F.col(pattern)
        z: Column = F.lit(self.weights[-1])
        offset = sum(BINS)
        for n in reversed(BINS):
            offset -= n
            table = F.array(*(F.lit(w) for w in self.weights[offset : offset + n]))
            z = z + F.element_at(table, (F.pmod(rest, F.lit(n)) + 1).cast("int"))
            rest = F.floor(rest / n)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_patterns(patterns: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray) -> QualityModel:
    """A model from the pattern table. Without positives or text every score is one half."""
    if not len(patterns) or positive.sum() == 0:
        return QualityModel((0.0,) * (sum(BINS) + 1), 0.5)
    o = np.argsort(patterns)
    patterns, positive, unlabelled = patterns[o], positive[o].astype(float), unlabelled[o].astype(float)
    x, prior = Bins(patterns), 0.5
    for _ in range(3):
        w = nn_pu(x, positive, unlabelled, prior)
        prior = estimate_prior(x.times(w), positive, unlabelled)
    w = nn_pu(x, positive, unlabelled, prior)
    return QualityModel(tuple(round(float(v), 6) for v in w), round(prior, 6))


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(id, score, prior)`` for every row; fitted on the same corpus.

    Labels are read from training rows only (crc32 of the id as text, mod 5, not 0) and only where
    they are 1. Null and empty texts are the pattern of no words. Repeated rows and null ids are
    scored like any other; a null id has no label; an id labelled twice counts once. Other columns are
    ignored. With no trusted positive all scores are 0.5; an empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession)
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = scratch.table(measured(narrow, "text").select("id", F.col(P + "pattern").alias("pattern")), "patterns")
    trusted = labels.where(F.col(label_col) == 1).where(~held_out(id_col)).select(F.col(f"`{id_col}`").alias("id")).distinct()
    marked = rows.join(trusted.withColumn("pos", F.lit(1)), "id", "left")
    table = marked.groupBy("pattern").agg(F.count(F.lit(1)).alias("u"), F.count("pos").alias("p")).toArrow()  # bounded by the bins
    model = fit_patterns(*(table[c].to_numpy() for c in ("pattern", "p", "u")))
    return rows.select(F.col("id").alias(id_col), model.score("pattern").alias("score"), F.lit(model.prior).alias("prior"))
