"""Vector expressions over array columns, and Arrow forms for whole matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def doubles(c: Column | str) -> Column:
    """The vector in double precision, in which all arithmetic is done."""
    return F.transform(c if isinstance(c, Column) else F.col(c), lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where the lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column) -> Column:
    """a at length 1; the zero vector stays zero."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x / n)


def softmax(a: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def mean_pool(states: Column, mask: Column) -> Column:
    """Mean of the state vectors whose mask is 1; zeros where no mask is set."""
    total = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, x: s + x), F.lit(1e-9))
    pairs = F.zip_with(states, mask, lambda v, m: F.transform(v, lambda x: x * m))
    zero = F.transform(F.element_at(states, 1), lambda x: F.lit(0.0))
    return F.transform(F.aggregate(pairs, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y)), lambda x: x / total)


def last_token_pool(states: Column, mask: Column, left_padded: Column) -> Column:
    """The last state if the batch is padded on the left, else the one at the last position of the text."""
    n = F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int"))
    return F.when(left_padded, F.element_at(states, -1)).otherwise(F.element_at(states, F.greatest(n, F.lit(1))))


def batch_left_padded(mask: Column, batch: str) -> Column:
    """Whether a batch counts as padded on the left: the last place of every row of it is a true one."""
    return F.min(F.element_at(mask, -1)).over(W.partitionBy(batch)) == 1


def times_matrix(v: Column, matrix: np.ndarray) -> Column:
    """v times a small matrix (d, e), as an expression."""
    columns = np.asarray(matrix, np.float64).T.tolist()
    return F.array(*[dot(v, F.array(*map(F.lit, c))) for c in columns])


def embed_states(states: Column, mask: Column, matrix: np.ndarray) -> Column:
    """An embedding model after its encoder: masked mean of the states, projected by a small matrix, at length 1."""
    return l2_normalize(times_matrix(mean_pool(states, mask), matrix))


def gated_pool(items: Column, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> Column:
    """Gated attention over the few vectors of one row, as an expression; see gated_attention_pool."""
    d = np.asarray(v).shape[1]

    def score(h: Column) -> Column:
        terms = F.lit(0.0)
        for a, b, c in zip(np.asarray(v).tolist(), np.asarray(u).tolist(), np.asarray(w).tolist()):
            gate = F.tanh(dot(h, F.array(*map(F.lit, a)))) / (1 + F.exp(-dot(h, F.array(*map(F.lit, b)))))
            terms = terms + gate * c
        return terms * float(np.sqrt(d))

    weights = softmax(F.transform(items, score))
    scaled = F.zip_with(items, weights, lambda h, x: F.transform(h, lambda y: y * x))
    zero = F.transform(F.element_at(items, 1), lambda x: F.lit(0.0))
    return F.aggregate(scaled, zero, lambda s, h: F.zip_with(s, h, lambda x, y: x + y))


def layer_pool(layers: Column, mask: Column, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> Column:
    """Hidden layers (each a list of states under one mask) pooled by mean, then pooled together by gated attention."""
    return gated_pool(F.transform(layers, lambda states: mean_pool(states, mask)), v, u, w)


def stack_vectors(col: pa.Array) -> np.ndarray:
    """An (n, d) double matrix from an Arrow list column without nulls."""
    if len(col) == 0:
        return np.zeros((0, 0))
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay zero."""
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def _list_column(m: np.ndarray) -> pa.Array:
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(m.ravel()))


def project(df: DataFrame, matrix: np.ndarray, *, key: str = "vec_id", vector: str = "embedding", out: str = "projected") -> DataFrame:
    """(key, out): vectors times matrix (d, e), in Arrow batches; rows with a null vector are left out."""
    sent = df.sparkSession.sparkContext.broadcast(np.asarray(matrix, np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), _list_column(stack_vectors(b.column(1)) @ sent.value)], ["key", "v"])

    src = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    return src.mapInArrow(run, "key bigint, v array<double>").select(F.col("key").alias(key), F.col("v").alias(out))


def gated_attention_pool(items: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted mean of the rows of items (n, d); weights are softmax(w . (tanh(V h) * sigmoid(U h)) * sqrt(d))."""
    gate = np.tanh(items @ v.T) * (1 / (1 + np.exp(-(items @ u.T))))
    score = gate @ w * np.sqrt(items.shape[1])
    e = np.exp(score - score.max())
    return (e / e.sum()) @ items


def pool_groups(df: DataFrame, v: np.ndarray, u: np.ndarray, w: np.ndarray, *, group: str, vector: str) -> DataFrame:
    """(group, pooled): gated attention over the vectors of each group.

    Groups are the layers or tokens of one text, so each is small; the softmax
    is kept in sums that add up, so a group of any size is pooled from partial
    sums per task and never gathered. All weights of a group are relative to its own
    maximum over tasks.
    """
    sent = df.sparkSession.sparkContext.broadcast((v, u, w))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b_, c = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            g, m = b.column(0).to_numpy(zero_copy_only=False), stack_vectors(b.column(1))
            gate = np.tanh(m @ a.T) * (1 / (1 + np.exp(-(m @ b_.T))))
            score = gate @ c * np.sqrt(m.shape[1])
            keys, at = np.unique(g, return_inverse=True)
            top = np.full(len(keys), -np.inf)
            np.maximum.at(top, at, score)
            e = np.exp(score - top[at])
            den, num = np.zeros(len(keys)), np.zeros((len(keys), m.shape[1]))
            np.add.at(den, at, e)
            np.add.at(num, at, e[:, None] * m)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(top), pa.array(den), _list_column(num)], ["g", "top", "den", "num"])

    parts = df.where(F.col(vector).isNotNull()).select(F.col(group).cast("bigint").alias("g"), F.col(vector).alias("v")).mapInArrow(partial, "g bigint, top double, den double, num array<double>")
    best = parts.groupBy("g").agg(F.max("top").alias("best"))
    scaled = parts.join(best, "g").withColumn("f", F.exp(F.col("top") - F.col("best")))
    long_ = scaled.select("g", (F.col("den") * F.col("f")).alias("den"), F.posexplode(F.transform("num", lambda x: x * F.col("f"))).alias("dim", "x"))
    dims = long_.groupBy("g", "dim").agg((F.sum("x") / F.sum("den")).alias("x"))
    return dims.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("pooled")).withColumnRenamed("g", group)
