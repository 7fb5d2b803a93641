"""Contrastive losses over the pairs inside each batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPERATURE = 0.07
MARGIN = 0.1


def _log_sum_exp(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]


def info_nce(q: np.ndarray, d: np.ndarray, temperature: float = TEMPERATURE) -> float:
    """Symmetric InfoNCE: positives on the diagonal, mean of both directions."""
    x = q @ d.T / temperature
    pos = np.diagonal(x)
    return float(((_log_sum_exp(x) - pos).mean() + (_log_sum_exp(x.T) - pos).mean()) / 2)


def spherical(m: np.ndarray) -> float:
    """Sum of squared dots of different rows over n(n-1); 0 for fewer than two rows."""
    n = len(m)
    if n < 2:
        return 0.0
    g = (m @ m.T) ** 2
    return float((g.sum() - np.trace(g)) / (n * (n - 1)))


def masked_info_nce(q: np.ndarray, d: np.ndarray, ids: np.ndarray, temperature: float = TEMPERATURE, margin: float = MARGIN) -> tuple[float, int]:
    """(loss, masked pairs): one-direction InfoNCE without false negatives.

    A pair off the diagonal is left out if both documents have one id or its
    logit is at least the positive's plus the margin (on scaled logits).
    """
    x = q @ d.T / temperature
    pos = np.diagonal(x).copy()
    mask = (ids[:, None] == ids[None, :]) | (x >= pos[:, None] + margin)
    np.fill_diagonal(mask, False)
    e = np.where(mask, 0.0, np.exp(np.minimum(x - pos[:, None], 700.0)))
    return float(np.log(e.sum(axis=1)).mean()), int(mask.sum())


def hard_negative_loss(q: np.ndarray, d: np.ndarray, neg: np.ndarray, temperature: float = TEMPERATURE) -> float:
    """InfoNCE over the positive, all documents of the batch and each query's own negatives (n, h, d);
    the positive is counted in its column and among the documents."""
    pos = (q * d).sum(axis=1, keepdims=True) / temperature
    own = np.einsum("nd,nhd->nh", q, neg) / temperature
    x = np.concatenate([pos, q @ d.T / temperature, own], axis=1)
    return float((_log_sum_exp(x) - pos[:, 0]).mean())


def batch_losses(pairs: DataFrame, *, temperature: float = TEMPERATURE, margin: float = MARGIN) -> DataFrame:
    """Losses of every batch: batch_id, n, info_nce, spherical, masked_info_nce, n_masked, total.

    pairs: batch_id, pos, doc_id, q, d (vectors of equal length). A batch is of
    fixed size, so its matrix of logits fits a task; batches spread over the
    cluster by their id. Rows with a null vector are left out; without rows
    there is no batch. total is spherical plus masked_info_nce.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        q, d = np.stack(pdf["q"]).astype(np.float64), np.stack(pdf["d"]).astype(np.float64)
        masked, n_masked = masked_info_nce(q, d, pdf["doc_id"].to_numpy(), temperature, margin)
        sph = spherical(q) + spherical(d)
        return pd.DataFrame({"batch_id": pdf["batch_id"].iloc[:1], "n": [len(pdf)], "info_nce": [info_nce(q, d, temperature)], "spherical": [sph], "masked_info_nce": [masked], "n_masked": [n_masked], "total": [sph + masked]})

    src = pairs.where("q is not null and d is not null").select("batch_id", "pos", "doc_id", "q", "d")
    schema = "batch_id bigint, n bigint, info_nce double, spherical double, masked_info_nce double, n_masked bigint, total double"
    return src.groupBy("batch_id").applyInPandas(run, schema)


def batch_hard_negative_losses(pairs: DataFrame, *, temperature: float = TEMPERATURE) -> DataFrame:
    """(batch_id, n, loss): the hard-negative loss of every batch of pairs (batch_id, pos, q, d, neg array of vectors).

    Every pair of a batch has as many negatives. Rows with a null vector are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        q, d = np.stack(pdf["q"]).astype(np.float64), np.stack(pdf["d"]).astype(np.float64)
        neg = np.stack([np.stack(x) for x in pdf["neg"]]).astype(np.float64)
        return pd.DataFrame({"batch_id": pdf["batch_id"].iloc[:1], "n": [len(pdf)], "loss": [hard_negative_loss(q, d, neg, temperature)]})

    src = pairs.where("q is not null and d is not null and neg is not null").select("batch_id", "pos", "q", "d", "neg")
    return src.groupBy("batch_id").applyInPandas(run, "batch_id bigint, n bigint, loss double")


def batch_pairs(vectors: DataFrame, batch: int = 64) -> DataFrame:
    """Neighbouring vectors (2i, 2i+1) as query and document, in batches; the document's label is its id."""
    v = vectors.select((F.col("vec_id") / 2).cast("bigint").alias("pos"), (F.col("vec_id") % 2).alias("side"), "embedding", "label")
    g = v.groupBy("pos").agg(
        F.max(F.when(F.col("side") == 0, F.col("embedding"))).alias("q"), F.max(F.when(F.col("side") == 1, F.col("embedding"))).alias("d"), F.max(F.when(F.col("side") == 1, F.col("label"))).cast("bigint").alias("doc_id")
    )
    return g.where("q is not null and d is not null").select(F.floor(F.col("pos") / batch).cast("bigint").alias("batch_id"), "pos", "doc_id", "q", "d")


def interval_loss(log: DataFrame, interval: int, *, step: str = "step", loss: str = "loss") -> DataFrame:
    """(bucket, avg_loss): mean loss of each run of `interval` steps, steps counted from 1."""
    return log.groupBy(F.floor((F.col(step) - 1) / interval).cast("bigint").alias("bucket")).agg(F.avg(loss).alias("avg_loss"))

