"""Order by length, spread over replicas, batches and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import cut


def with_position(df: DataFrame, *order: tuple[Column, bool] | Column, key: str, name: str = "pos") -> DataFrame:
    """df with its place (bigint from 0) in the order, found without a single-task sort.

    Only the columns of the order and the key, which must be unique, are sorted:
    they are range-partitioned, and the counts of the partitions, one row each,
    give every partition its first place. Rows get their place by a join on the
    key. The order should be total (end it with the key), so that hot values are split.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    narrow = df.select(F.col(key).alias("_key"), *[c.alias(f"_o{i}") for i, (c, _) in enumerate(map(_parts, order))])
    by = [F.desc_nulls_last(f"_o{i}") if down else F.asc_nulls_first(f"_o{i}") for i, (_, down) in enumerate(map(_parts, order))]
    ranged = cut(narrow.repartitionByRange(n, *by).sortWithinPartitions(*by).select("_key", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33).cast("int")
    counts = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    rows, first = [], 0
    for p in sorted(counts):
        rows.append((p, first))
        first += counts[p]
    # one row per partition, so the broadcast is bounded
    base = F.broadcast(spark.createDataFrame(rows, "_part int, _first bigint"))
    placed = ranged.withColumn("_part", part).join(base, "_part")
    placed = placed.select("_key", (F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
    return df.join(placed, df[key].eqNullSafe(placed["_key"])).drop("_key")


def _parts(c: tuple[Column, bool] | Column) -> tuple[Column, bool]:
    """(column, whether it falls) of an item of an order."""
    return c if isinstance(c, tuple) else (c, False)


def by_length(df: DataFrame, length: str = "total_len", key: str = "example_id") -> DataFrame:
    """df with pos, its place from the longest to the shortest row, ties by key."""
    return with_position(df, (F.col(length), True), F.col(key), key=key)


def shuffle_in_buckets(df: DataFrame, replicas: int, seed: int, *, pos: str = "pos", batches: int = 100) -> DataFrame:
    """df with its places permuted within buckets of replicas * batches rows, by a seeded hash."""
    size = replicas * batches
    bucket = F.floor(F.col(pos) / size)
    w = W.partitionBy("_bucket").orderBy(F.md5(F.concat_ws("/", F.col(pos).cast("string"), F.lit(str(seed)))), pos)
    out = df.withColumn("_bucket", bucket).withColumn("_new", F.col("_bucket") * size + F.row_number().over(w) - 1)
    return out.withColumn(pos, F.col("_new").cast("bigint")).drop("_bucket", "_new")


def to_replicas(df: DataFrame, replicas: int, *, pos: str = "pos", drop_last: bool = False) -> DataFrame:
    """df dealt to replicas in turn: replica, replica_pos, padded.

    All replicas get ceil(n / replicas) rows: one that comes out short takes its
    own first rows again (padded). With drop_last they get floor(n / replicas).
    """
    n = df.count()
    dealt = df.withColumn("replica", F.pmod(F.col(pos), F.lit(replicas)).cast("int")).withColumn("replica_pos", F.floor(F.col(pos) / replicas).cast("bigint")).withColumn("padded", F.lit(False))
    if drop_last:
        return dealt.where(F.col("replica_pos") < n // replicas)
    each = -(-n // replicas)
    own = F.floor((F.lit(n) - 1 - F.col("replica")) / replicas) + 1  # rows of the replica
    pad = dealt.where(F.col("replica_pos") < F.lit(each) - own).withColumn("replica_pos", (F.col("replica_pos") + own).cast("bigint")).withColumn("padded", F.lit(True))
    return dealt.unionByName(pad)


def in_batches(df: DataFrame, size: int, *, pos: str = "pos") -> DataFrame:
    """df with batch_id, the number of the batch of its place."""
    return df.withColumn("batch_id", F.floor(F.col(pos) / size).cast("bigint"))


def _pad(ids: Column, to: Column, pad: int, left: bool) -> Column:
    fill = F.array_repeat(F.lit(pad), (to - F.size(ids)).cast("int"))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def pad_by_token(df: DataFrame, *columns: str, pad: int = 0, batch: str = "batch_id") -> DataFrame:
    """Each id column padded on the right to the longest of its batch, with <column>_mask = (id != pad).

    A real token that equals pad is masked, too. Null lists count as empty.
    """
    w = W.partitionBy(batch)
    for c in columns:
        ids = F.coalesce(F.col(c), F.array().cast("array<int>"))
        full = _pad(ids, F.max(F.size(ids)).over(w), pad, False)
        df = df.withColumn(c, full).withColumn(f"{c}_mask", F.transform(F.col(c), lambda x: (x != pad).cast("int")))
    return df


def pad_by_length(df: DataFrame, column: str, *, pad: int = 0, batch: str = "batch_id", left: bool = False) -> DataFrame:
    """The id column padded to the longest of its batch on either side; <column>_mask is 1 on every true place."""
    ids = F.coalesce(F.col(column), F.array().cast("array<int>"))
    longest = F.max(F.size(ids)).over(W.partitionBy(batch))
    ones, none = F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), (longest - F.size(ids)).cast("int"))
    mask = F.concat(none, ones) if left else F.concat(ones, none)
    return df.withColumn(f"{column}_mask", mask).withColumn(column, _pad(ids, longest, pad, left))


def joint_batch(df: DataFrame, query: str, document: str, *, pad: int = 0, batch: str = "batch_id", pos: str = "pos") -> DataFrame:
    """Queries and documents of a batch as one block of 2B rows, padded together: batch_id, side, pos, ids, ids_mask."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col(query).alias("ids")), F.struct(F.lit(1).alias("side"), F.col(document).alias("ids")))
    long_ = df.select(F.col(batch).alias("batch_id"), F.col(pos).alias("pos"), F.explode(sides).alias("x")).select("batch_id", "pos", "x.side", "x.ids")
    return pad_by_token(long_, "ids", pad=pad)


def pad_negatives(df: DataFrame, column: str, *, pad: int = 0, batch: str = "batch_id") -> DataFrame:
    """Lists of token lists padded to one rectangle per batch: as many negatives, each as long, as the most of the batch."""
    w = W.partitionBy(batch)
    lists = F.coalesce(F.col(column), F.array().cast("array<array<int>>"))
    df = df.withColumn(column, lists)
    n = F.max(F.size(column)).over(w)
    m = F.max(F.coalesce(F.array_max(F.transform(column, F.size)), F.lit(0))).over(w)
    df = df.withColumn("_n", n).withColumn("_m", m)
    inner = F.transform(column, lambda a: _pad(a, F.col("_m"), pad, False))
    rest = F.array_repeat(F.array_repeat(F.lit(pad), F.col("_m")), F.col("_n") - F.size(column))
    return df.withColumn(column, F.concat(inner, rest)).drop("_n", "_m")


def length_totals(df: DataFrame) -> DataFrame:
    """One row of a tokenized table: n pairs, tokens, mean query, passage and total length (true, not the stored total)."""
    true_len = F.col("query_len") + F.col("pos_len")
    return df.agg(F.count("*").alias("n_pairs"), F.sum(true_len).alias("n_tokens"), F.avg("query_len").alias("mean_query_len"), F.avg("pos_len").alias("mean_pos_len"), F.max(true_len).alias("max_len"))


def longest(df: DataFrame, n: int = 30, *, length: str = "total_len", key: str = "example_id") -> DataFrame:
    """The n longest rows (ties by key): a top-n, not a sort of the table."""
    return df.orderBy(F.desc_nulls_last(length), F.asc(key)).limit(n)


def mean_negative_length(negatives: Column, n: int) -> Column:
    """Mean length of the first n negatives, divided by n however many there are."""
    return F.aggregate(F.transform(F.slice(negatives, 1, n), F.size), F.lit(0), lambda s, x: s + x) / F.lit(float(n))


def total_length(query: Column, passage: Column, mean_negative: Column | None = None, n: int = 0) -> Column:
    """Query plus passage, and n times the mean negative where negatives are used."""
    return query + passage if mean_negative is None else query + passage + mean_negative * n
