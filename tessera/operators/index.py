"""Vector search by a plan: flat, cells, or cells with product codes; fitted, saved, appended to and probed."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, doubles, l2_normalize, stack_vectors, unit_rows
from tessera.operators.search import GROUP_BYTES, HITS, QUERY_BYTES, QueryTops, collected, extent, keyed_vectors, merge_top, score_groups, top_k
from tessera.session import cut

#: Vectors on which cells and codebooks are fitted, at most.
TRAIN_ROWS = 100_000
#: Cells that are probed at least, as far as there are so many.
LEAST_PROBES = 128
#: Cells whose rows lie in one folder of a saved index.
FOLDER_CELLS = 16
#: Candidates that may be broadcast.
BROADCAST_ROWS = 500_000
#: Rows that are compared with all centroids at a time.
_FIT_CHUNK = 8192


@dataclass(frozen=True)
class IndexPlan:
    """Which index a corpus of n vectors gets."""

    kind: str
    cells: int
    subspaces: int = 0
    bits: int = 0


def choose_index(n: int) -> IndexPlan:
    """flat below 100,000 vectors, cells below 1,000,000, cells with product quantization beyond."""
    if n < 100_000:
        return IndexPlan("flat", 0)
    if n < 1_000_000:
        return IndexPlan("ivf_flat", cell_count(n))
    return IndexPlan("ivf_pq", 8192, 64, 8)


def cell_count(n: int) -> int:
    """min(4096, floor of the root of n), at least 1."""
    return max(1, min(4096, math.isqrt(n)))


def share_count(cells: int) -> int:
    """Three quarters of the cells: recall at 10 stays above 0.9 whatever their number."""
    return -(-3 * cells // 4)


def probe_count(cells: int) -> int:
    """Cells that a query probes unless more are asked for: LEAST_PROBES, but never a smaller share than share_count."""
    return min(cells, max(LEAST_PROBES, share_count(cells)))


# --- fitting -------------------------------------------------------------------


def training_sample(df: DataFrame, n: int = TRAIN_ROWS, *, key: str = "vec_id", seed: int = 0) -> DataFrame:
    """n rows without replacement, chosen by a seeded hash of the key, so always the same ones."""
    return df.orderBy(F.md5(F.concat_ws("/", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def _nearest(x: np.ndarray, c: np.ndarray, *, euclid: bool = False) -> np.ndarray:
    """The centroid nearest to each row, a bounded number of rows at a time."""
    half = (c * c).sum(axis=1) / 2 if euclid else 0.0
    return np.concatenate([(x[i : i + _FIT_CHUNK] @ c.T - half).argmax(axis=1) for i in range(0, len(x), _FIT_CHUNK)] or [np.zeros(0, np.int64)])


def _means(x: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the rows of each centroid, number of them)."""
    o = np.argsort(at, kind="stable")
    n = np.bincount(at, minlength=k)
    total = np.zeros((k, x.shape[1]))
    there = np.flatnonzero(n)
    if len(there):
        total[there] = np.add.reduceat(x[o], (np.cumsum(n) - n)[there], axis=0)
    return total, n


def spherical_kmeans(x: np.ndarray, k: int, *, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """k unit centroids of unit rows x; a cell that runs empty keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        total, n = _means(x, _nearest(x, c), len(c))
        c[n > 0] = unit_rows(total[n > 0])
    return c


def _sample_matrix(df: DataFrame, key: str, vector: str, sample: int, seed: int = 0) -> np.ndarray:
    return collected(training_sample(keyed_vectors(df, key, vector), sample, key="k", seed=seed))[1]


def train_cells(df: DataFrame, cells: int, *, key: str = "vec_id", vector: str = "embedding", sample: int = TRAIN_ROWS, seed: int = 0) -> np.ndarray:
    """Centroids fitted on a bounded sample; every row is indexed afterwards."""
    m = _sample_matrix(df, key, vector, sample, seed)
    return spherical_kmeans(m, cells, seed=seed) if len(m) else np.zeros((0, 0))


@dataclass(frozen=True)
class Codebook:
    """Centroids (subspaces, codes, width) of a product quantizer."""

    books: np.ndarray

    def encode(self, m: np.ndarray) -> np.ndarray:
        s, _, w = self.books.shape
        parts = m.reshape(len(m), s, w)
        return np.stack([_nearest(parts[:, i], self.books[i], euclid=True) for i in range(s)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for; their product with a query is the coded score."""
        s, _, w = self.books.shape
        return self.books[np.arange(s), codes].reshape(len(codes), s * w)


def train_codebook(df: DataFrame, subspaces: int = 16, bits: int = 8, *, key: str = "vec_id", vector: str = "embedding", sample: int = TRAIN_ROWS, rounds: int = 10) -> Codebook:
    """Codes of each part of the vector by k-means on a bounded sample."""
    m = _sample_matrix(df, key, vector, sample)
    if m.shape[1] % subspaces:
        raise ValueError(f"vectors of {m.shape[1]} dimensions do not split into {subspaces} parts")
    rng = np.random.default_rng(0)
    books = []
    for part in np.split(m, subspaces, axis=1):
        c = part[rng.permutation(len(part))[: min(1 << bits, len(part))]].copy()
        for _ in range(rounds):
            total, n = _means(part, _nearest(part, c, euclid=True), len(c))
            c[n > 0] = total[n > 0] / n[n > 0, None]
        books.append(c)
    return Codebook(np.stack(books))


# --- rows of an index ------------------------------------------------------------


def assign_cells(df: DataFrame, centroids: np.ndarray, book: Codebook | None = None, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(cell, id, vec), and code with a codebook: every vector, at length 1, with its nearest cell. No shuffle."""
    sent = df.sparkSession.sparkContext.broadcast((centroids, book))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, book_ = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            m = unit_rows(stack_vectors(b.column(1)))
            n, d = m.shape
            cols = [pa.array(_nearest(m, c).astype(np.int32)), b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(m.astype(np.float32).ravel()))]
            if book_ is not None:
                cols.append(pa.array([x.tobytes() for x in book_.encode(m)], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["cell", "id", "vec", "code"][: len(cols)])

    return keyed_vectors(df, key, vector).mapInArrow(run, "cell int, id bigint, vec array<float>" + (", code binary" if book is not None else ""))


def _write_cells(rows: DataFrame, path: str, batch: int) -> None:
    """Rows in folders by group of cells, sorted by cell in files, so that a probe reads the folders and row
    groups of its cells; a hot cell is spread over many files by id. A batch written again replaces itself."""
    folder = F.floor(F.col("cell") / FOLDER_CELLS).cast("int")
    out = rows.withColumn("cells", folder).repartition("cells", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("cells", "cell")
    out.write.mode("overwrite").partitionBy("cells").parquet(f"{path}/cells/batch={batch}")


def _write_table(spark: SparkSession, rows: list, schema: str, path: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def save_index(index: DataFrame, centroids: np.ndarray, path: str, book: Codebook | None = None) -> None:
    """Write the rows of an index with its centroids and, where it has one, its codebook."""
    spark = index.sparkSession
    _write_cells(index, path, 0)
    if book is not None:
        _write_table(spark, [(i, [[float(x) for x in c] for c in b]) for i, b in enumerate(book.books)], "subspace int, codes array<array<double>>", f"{path}/books")
    _write_table(spark, [(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, centroid array<double>", f"{path}/centroids")


def append_index(rows: DataFrame, path: str, batch: int = 1, *, key: str = "vec_id", vector: str = "embedding") -> None:
    """Add vectors to a saved index of cells, as batch number `batch`, which replaces that batch if it is already there."""
    spark = rows.sparkSession
    _, centroids = load_index(spark, path)
    book = _load_book(spark, path)
    _write_cells(assign_cells(rows, centroids, book, key=key, vector=vector), path, batch)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _load_book(spark: SparkSession, path: str) -> Codebook | None:
    if not _there(spark, f"{path}/books"):
        return None
    return Codebook(np.array([r.codes for r in spark.read.parquet(f"{path}/books").orderBy("subspace").collect()]))


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """(rows with the folder they lie in, centroids) of a saved index."""
    c = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    code = ", code binary" if _there(spark, f"{path}/books") else ""
    rows = spark.read.schema(f"cell int, id bigint, vec array<float>{code}, batch int, cells int").parquet(f"{path}/cells")
    return rows.drop("batch"), np.array([r["centroid"] for r in c])


def index_exists(spark: SparkSession, path: str) -> bool:
    """Whether an index is saved at path."""
    return _there(spark, f"{path}/centroids")


# --- probing -------------------------------------------------------------------


def _near_cells(q: np.ndarray, centroids: np.ndarray, p: int) -> np.ndarray:
    return np.argpartition(-(q @ centroids.T), p - 1, axis=1)[:, :p] if p and len(q) else np.zeros((len(q), 0), int)


def _only(index: DataFrame, cells: np.ndarray, of: int) -> DataFrame:
    """The rows of the cells; folders without any are not read."""
    if len(cells) == of:
        return index
    out = index.where(F.col("cell").isin(cells.tolist()))
    if "cells" in index.columns:
        out = out.where(F.col("cells").isin(np.unique(cells // FOLDER_CELLS).tolist()))
    return out


def probe(
    queries: DataFrame, index: DataFrame, centroids: np.ndarray, k: int, nprobe: int | None = None, book: Codebook | None = None, *, key: str = "vec_id", vector: str = "embedding",
    query_bytes: int = QUERY_BYTES, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(qid, did, score, rank): top k by cosine among the members of each query's nearest nprobe cells (None: probe_count).

    With a codebook, rows hold codes and scores are those of what the codes
    stand for. Queries of up to query_bytes are broadcast with their cells: only
    those cells are read, and each task keeps running tops, so members are never
    shuffled and a hot cell is no hot key. More queries go, distributed, to the
    cells they probe; a cell of more than group_bytes is split. nprobe of all cells is exact for vectors.
    """
    spark = index.sparkSession
    p = probe_count(len(centroids)) if nprobe is None else min(nprobe, len(centroids))
    asked = keyed_vectors(queries, key, vector)
    last = "vec" if book is None else "code"
    n, dim = extent(asked)

    def matrix(col: pa.Array) -> np.ndarray:
        return stack_vectors(col) if book is None else book.decode(np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1))

    if n * dim * 8 > query_bytes:
        return merge_top(_probe_groups(asked, index, centroids, k, p, last, dim, matrix, group_bytes), k)
    qids, q = collected(asked)
    near = _near_cells(q, centroids, p)
    by_cell = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
    sent = spark.sparkContext.broadcast((qids, q, by_cell))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_, q_, cells = sent.value
        groups: dict[int, QueryTops] = {}
        for b in batches:
            if not b.num_rows:
                continue
            cell, did = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            o = np.argsort(cell, kind="stable")
            edge = np.r_[0, np.flatnonzero(np.diff(cell[o])) + 1, len(o)]
            m = matrix(b.column(2))
            for lo, hi in zip(edge, edge[1:]):
                c = int(cell[o[lo]])
                who = cells.get(c)
                if who is not None:
                    if c not in groups:
                        groups[c] = QueryTops(ids_[who], q_[who], k)
                    groups[c].add(did[o[lo:hi]], m[o[lo:hi]])
        for top in groups.values():
            yield from top.batches()

    return merge_top(_only(index, np.unique(near), len(centroids)).select("cell", "id", last).mapInArrow(scan, HITS), k)


def _probe_groups(asked: DataFrame, index: DataFrame, centroids: np.ndarray, k: int, p: int, last: str, dim: int, matrix, group_bytes: int) -> DataFrame:
    """Hits of queries that are too many to broadcast: cells, split where they are large, meet the queries that probe them."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(centroids)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, _FIT_CHUNK):
                c = b.slice(lo, _FIT_CHUNK)
                near = _near_cells(unit_rows(stack_vectors(c.column(1))), sent.value, p)
                row = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), c.column(0).take(row), c.column(1).take(row)], ["cell", "k", "v"])

    # one row per cell, so the broadcast is bounded
    splits = F.broadcast(index.groupBy("cell").agg(F.ceil(F.count("*") * dim * 8 / group_bytes).cast("int").alias("splits")))
    none_v, none_c = F.lit(None).cast("array<double>"), F.lit(None).cast("binary")
    own_v = F.col("vec").cast("array<double>") if last == "vec" else none_v
    own_c = F.col("code") if last == "code" else none_c
    group = F.col("cell").cast("bigint") * 1_000_000
    rows = index.join(splits, "cell").select((group + F.pmod(F.xxhash64("id"), F.col("splits"))).alias("g"), F.lit(0).alias("kind"), F.col("id").alias("k"), own_v.alias("v"), own_c.alias("c"))
    kind = asked.schema["v"].dataType.simpleString()
    routed = asked.mapInArrow(route, f"cell int, k bigint, v {kind}").join(splits, "cell")
    parts = F.explode(F.sequence(group, group + F.col("splits") - 1))
    routed = routed.select(parts.alias("g"), F.lit(1).alias("kind"), "k", F.col("v").cast("array<double>").alias("v"), none_c.alias("c"))
    return score_groups(rows.unionByName(routed), k, stack_vectors if last == "vec" else matrix)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(k, recall): share of the exact top k that was found."""
    top = exact.where(F.col("rank") <= k)
    hit = top.join(found.where(F.col("rank") <= k).select("qid", "did", F.lit(1).alias("hit")), ["qid", "did"], "left")
    return hit.agg(F.lit(k).alias("k"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def exact_scores(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, did, score, rank): the k best of candidate hits (qid, did) by the cosine of whole vectors.

    queries and vectors: (k, v). Candidates of up to BROADCAST_ROWS are broadcast, so that vectors are filtered where they are read.
    """
    found = cut(candidates.select("qid", "did"))
    c = (F.broadcast(found) if found.count() <= BROADCAST_ROWS else found).join(vectors.select(F.col("k").alias("did"), F.col("v").alias("dv")), "did").join(queries.select(F.col("k").alias("qid"), F.col("v").alias("qv")), "qid")
    score = dot(l2_normalize(doubles("qv")), l2_normalize(doubles("dv")))
    return merge_top(c.select("qid", "did", score.alias("score")), k)


def search_codes(queries: DataFrame, corpus: DataFrame, book: Codebook, k: int, *, rerank: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, did, score, rank): top k by coded scores over all of the corpus, of which the best rerank * k a query are scored exactly."""
    codes = _codes(corpus, book, key, vector)
    rough = probe(queries, codes, np.zeros((1, book.books.shape[0] * book.books.shape[2])), rerank * k, 1, book, key=key, vector=vector)
    return exact_scores(rough, keyed_vectors(queries, key, vector), keyed_vectors(corpus, key, vector), k)


def _codes(corpus: DataFrame, book: Codebook, key: str, vector: str) -> DataFrame:
    """The rows of an index of one cell, with codes."""
    return assign_cells(corpus, np.zeros((1, book.books.shape[0] * book.books.shape[2])), book, key=key, vector=vector)


# --- an index by plan ------------------------------------------------------------


def build_index(df: DataFrame, path: str, plan: IndexPlan | None = None, *, key: str = "vec_id", vector: str = "embedding", sample: int = TRAIN_ROWS) -> IndexPlan:
    """Fit and write the index that the plan names (None: choose_index of the number of vectors).

    flat keeps the vectors; ivf_flat has them in cells; ivf_pq has codes in
    cells, and the vectors in a column beside them, read for exact scores of the best candidates only.
    Subspaces that do not divide the vectors are a ValueError. Rows without id or vector are left out.
    """
    spark = df.sparkSession
    if plan is None:
        plan = choose_index(extent(keyed_vectors(df, key, vector))[0])
    if plan.kind not in ("flat", "ivf_flat", "ivf_pq"):
        raise ValueError(f"Unknown index: {plan.kind}; known are flat, ivf_flat, ivf_pq")
    if plan.kind == "flat":
        keyed_vectors(df, key, vector).write.mode("overwrite").parquet(f"{path}/vectors")
    else:
        centroids = train_cells(df, plan.cells, key=key, vector=vector, sample=sample)
        book = train_codebook(df, plan.subspaces, plan.bits, key=key, vector=vector, sample=sample) if plan.kind == "ivf_pq" else None
        save_index(assign_cells(df, centroids, book, key=key, vector=vector), centroids, path, book)
    _write_table(spark, [(plan.kind, plan.cells, plan.subspaces, plan.bits)], "kind string, cells int, subspaces int, bits int", f"{path}/plan")
    return plan


def search_index(queries: DataFrame, path: str, k: int, nprobe: int | None = None, *, rerank: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, did, score, rank): top k of a saved index, whatever its plan; a path without one is a ValueError."""
    spark = queries.sparkSession
    if not _there(spark, f"{path}/plan"):
        raise ValueError(f"no index at {path}")
    plan = IndexPlan(**spark.read.parquet(f"{path}/plan").first().asDict())
    if plan.kind == "flat":
        return top_k(queries, spark.read.parquet(f"{path}/vectors").select(F.col("k").alias(key), F.col("v").alias(vector)), k, key=key, vector=vector)
    rows, centroids = load_index(spark, path)
    if plan.kind == "ivf_flat":
        return probe(queries, rows, centroids, k, nprobe, key=key, vector=vector)
    rough = probe(queries, rows, centroids, rerank * k, nprobe, _load_book(spark, path), key=key, vector=vector)
    asked = keyed_vectors(queries, key, vector)
    n, dim = extent(asked)
    if n * dim * 8 <= QUERY_BYTES:  # the vectors, too, are read from the folders of the probed cells only
        p = probe_count(len(centroids)) if nprobe is None else min(nprobe, len(centroids))
        rows = _only(rows, np.unique(_near_cells(collected(asked)[1], centroids, p)), len(centroids))
    return exact_scores(rough, asked, rows.select(F.col("id").alias("k"), F.col("vec").alias("v")), k)
