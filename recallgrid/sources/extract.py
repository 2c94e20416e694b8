"""Where a real language model would come in: an extractor protocol over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FeatureExtractor(Protocol):
    """For the token ids of a chunk: one key and one row of token probabilities for each position."""

    def __call__(self, tokens: list[int]) -> tuple[np.ndarray, np.ndarray]: ...


def extract(chunks: DataFrame, make: Callable[[], FeatureExtractor], second: Callable[[], FeatureExtractor] | None = None) -> DataFrame:
    """Positions of ``chunks(chunk_id, tokens array<int>)``: keys, next token, its probability, entropy.

    The model is made once for each Python worker. Position t is paired with token t + 1 and the last
    one dropped. ``second`` adds the keys of another representation as ``x2``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        other = second() if second else None
        for frame in frames:
            out = []
            for chunk, tokens in zip(frame["chunk_id"], frame["tokens"]):
                ids = [int(t) for t in tokens]
                keys, probs = model(ids)
                keys2 = other(ids)[0] if other else None
                for t in range(len(ids) - 1):
                    p = np.asarray(probs[t], float)
                    row = [chunk, t, ids[t + 1], np.asarray(keys[t], float).tolist(), float(p[ids[t + 1]]), float(-(p * np.log(p + 1e-12)).sum())]
                    out.append(row + ([np.asarray(keys2[t], float).tolist()] if other else []))
            yield pd.DataFrame(out, columns=names)

    names = ["chunk_id", "pos", "y", "x", "p_lm", "entropy"] + (["x2"] if second else [])
    schema = "chunk_id long, pos long, y int, x array<double>, p_lm double, entropy double" + (", x2 array<double>" if second else "")
    return chunks.select("chunk_id", "tokens").mapInPandas(run, schema)


def chunk_losses(positions: DataFrame) -> DataFrame:
    """Mean base-model loss of each chunk."""
    return positions.groupBy("chunk_id").agg(F.avg(-F.ln(F.col("p_lm") + 1e-12)).alias("mean_nll"))
