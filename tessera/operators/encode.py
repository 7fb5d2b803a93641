"""Text encoders as Arrow functions: pluggable, with a hashing stand-in."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import unit_rows

#: Takes texts, gives one row per text; or states (texts, places, dimensions) and their mask, which are then pooled.
Encoder = Callable[[list[str]], "np.ndarray | tuple[np.ndarray, np.ndarray]"]


def _word_place(w: str, dims: int) -> tuple[int, float]:
    """Dimension and sign of a word, from its md5."""
    h = hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()
    return int(h[:8], 16) % dims, 1.0 if int(h[8], 16) >= 8 else -1.0


def _split(t: str) -> list[str]:
    return [w for w in re.split(r"[ \t\n\r\f]+", t) if w]


def hashing_encoder(dims: int = 64) -> Encoder:
    """A deterministic stand-in for a model: signed counts of hashed words (at white space)."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in _split(t):
                at, sign = _word_place(w, dims)
                out[i, at] += sign
        return out

    return encode


def hashing_states(dims: int = 64, *, left: bool = False) -> Encoder:
    """The same as states: one place per word, padded to the longest text of the batch."""

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [_split(t) for t in texts]
        n = max(1, max(map(len, split), default=1))
        states, mask = np.zeros((len(texts), n, dims)), np.zeros((len(texts), n), np.int64)
        for i, ws in enumerate(split):
            first = n - len(ws) if left else 0
            for j, w in enumerate(ws):
                at, sign = _word_place(w, dims)
                states[i, first + j, at], mask[i, first + j] = sign, 1
        return states, mask

    return encode


def pool_states(states: np.ndarray, mask: np.ndarray, pool: str) -> np.ndarray:
    """One vector per text of a batch: mean of the places of the mask, or the last of them.

    last takes the batch for padded on the left only if the last place of every text is a true one.
    """
    if pool == "mean":
        return (states * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1e-9)[:, None]
    if pool != "last":
        raise ValueError(f"Unknown pool: {pool}; known are last, mean")
    if mask[:, -1].all():
        return states[:, -1]
    return states[np.arange(len(states)), np.maximum(mask.sum(axis=1), 1) - 1]


def encode_texts(df: DataFrame, encoder: Encoder, *, key: str, text: str, batch: int = 256, pool: str = "last", projection: np.ndarray | None = None) -> DataFrame:
    """(key, embedding array<float>): texts encoded in batches, pooled if they come as states, projected where asked for, at length 1.

    Null texts are encoded as empty ones. Nothing is shuffled.
    """
    sent = df.sparkSession.sparkContext.broadcast(projection)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                b = whole.slice(lo, batch)
                m = encoder([t or "" for t in b.column(1).to_pylist()])
                if isinstance(m, tuple):
                    m = pool_states(*m, pool)
                if sent.value is not None:
                    m = m @ sent.value
                m = unit_rows(np.asarray(m, np.float64)).astype(np.float32)
                n, d = m.shape
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(m.ravel()))], ["key", "embedding"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, embedding array<float>").withColumnRenamed("key", key)
