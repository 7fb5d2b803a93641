"""References to records that do not exist, or not at the time they are made."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.ids import canonical_id, is_blank
from tessera.session import cut

#: A key with more than this share of all references is hot; at most 1/HOT_SHARE keys can be.
HOT_SHARE = 1 / 64
#: Parts into which the references of a hot key, and the rows of a parent key, are split.
SALTS = 32


@dataclass(frozen=True)
class Parent:
    """A table referred to: its name in reports, its rows, and the foreign key in the referring table."""

    name: str
    rows: DataFrame
    foreign_key: str
    key: str = "_id"
    since: str = "added_at"
    until: str = "deleted_at"


def _key(c: str) -> Column:
    """The number a value spells, else the damaged value itself, marked so that it equals no number."""
    return F.coalesce(canonical_id(c), F.concat(F.lit("!"), F.col(c)))


def _islands(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, since, until): the spans of each key joined where they overlap or touch.

    Sorted runs and running values only, so a key with very many rows spills to
    disk instead of growing an array.
    """
    order = W.partitionBy(*keys).orderBy("since", "until")
    before = F.max("until").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.coalesce(F.col("since") > before, F.lit(True)).cast("int")
    marked = rows.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy(*keys, "_island").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("_island")


def live_spans(parents: Sequence[Parent]) -> DataFrame:
    """(ref_table, k, spans): when each key of each table is live, as disjoint spans.

    Keys that are no number, and rows without since, are live never; a null
    until is open. Rows are merged in two steps, so that a key with very many
    rows is first thinned in parts; only its separate lives end up in one row.
    """
    rows = None
    forever = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    for p in parents:
        one = p.rows.select(
            F.lit(p.name).alias("ref_table"),
            canonical_id(p.key).alias("k"),
            F.col(p.since).cast("timestamp_ntz").alias("since"),
            F.coalesce(F.col(p.until).cast("timestamp_ntz"), forever).alias("until"),
        ).where("k is not null and since < until")
        rows = one if rows is None else rows.unionByName(one)
    part = F.pmod(F.xxhash64("since"), F.lit(SALTS)).cast("int")
    thin = _islands(rows.withColumn("part", part), "ref_table", "k", "part").drop("part")
    whole = _islands(thin, "ref_table", "k")
    return whole.groupBy("ref_table", "k").agg(F.sort_array(F.collect_list(F.struct("since", "until"))).alias("spans"))


def references(df: DataFrame, parents: Sequence[Parent], at: str, row_id: str) -> DataFrame:
    """One row (row_id, ref_table, k, at) per row of df and reference; null and blank ids are none."""
    pairs = F.array(*[F.struct(F.lit(p.name).alias("ref_table"), F.when(~is_blank(p.foreign_key), _key(p.foreign_key)).alias("k")) for p in parents])
    long = df.select(F.col(row_id).alias("row_id"), F.col(at).cast("timestamp_ntz").alias("at"), F.explode(pairs).alias("r"))
    return long.select("row_id", "at", "r.ref_table", "r.k").where("k is not null")


def _orphan_keys(refs: DataFrame, parents: Sequence[Parent]) -> tuple[DataFrame, DataFrame]:
    """(counts, orphans): references per distinct (ref_table, k, at), and those of them for which no span of the parent key holds at.

    The counts are written once: keys, hot keys and the report are all made of them.
    """
    counts = cut(refs.groupBy("ref_table", "k", "at").agg(F.count("*").alias("n")))
    per_key = counts.groupBy("ref_table", "k").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # at most 1/HOT_SHARE rows by construction, so the broadcast is bounded
    hot = F.broadcast(per_key.where(F.col("n") > total * HOT_SHARE).select("ref_table", "k", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    left = counts.join(hot, ["ref_table", "k"], "left").select("ref_table", "k", "at", "n", salt.alias("salt"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = live_spans(parents).join(hot, ["ref_table", "k"], "left").select("ref_table", "k", "spans", F.explode(salts).alias("salt"))
    a, b = left.alias("a"), right.alias("b")
    live = F.exists(F.col("b.spans"), lambda x: (F.col("a.at") >= x["since"]) & (F.col("a.at") < x["until"]))
    same = (F.col("a.ref_table") == F.col("b.ref_table")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.salt") == F.col("b.salt"))
    return counts, a.join(b, same & live, "left_anti").select("ref_table", "k", "at", "n")


def orphan_references(df: DataFrame, parents: Sequence[Parent], *, at: str = "judged_at", row_id: str = "ord") -> DataFrame:
    """(row_id, ref_table): one row for each row of df and each of its references that is an orphan.

    A reference is an orphan unless some row of the parent table has that id and
    is live at the time of the reference: from since (inclusive) to until
    (exclusive, null for ever). Two spellings of one number are one id; a value
    that spells no number equals no id and so is an orphan; null and blank values
    are no reference. A null time is inside no span, so such references are
    orphans; a parent row with a null since is never live. Repeated rows of df
    count one by one, repeated parent rows do no harm, and empty tables on
    either side are allowed. Extra columns are not read.

    Distinct non-null foreign keys go through a left anti-join against the live
    spans of the parent keys; what is left is joined back to the rows.
    """
    refs = references(df, parents, at, row_id)
    orphans = _orphan_keys(refs, parents)[1].alias("o")
    r = refs.alias("r")
    same = (F.col("r.ref_table") == F.col("o.ref_table")) & (F.col("r.k") == F.col("o.k")) & F.col("r.at").eqNullSafe(F.col("o.at"))
    return r.join(orphans, same, "left_semi").select(F.col("row_id").alias(row_id), "ref_table")


def orphan_report(df: DataFrame, parents: Sequence[Parent], *, at: str = "judged_at") -> DataFrame:
    """(ref_table, period, refs, orphans): references and orphans per table and month of at.

    References are first counted per distinct key and time, and orphans are
    looked up among those, so a hot key costs no more than its distinct times.
    A null time has the period null.
    """
    counts, orphans = _orphan_keys(references(df, parents, at, at), parents)
    period = F.date_format("at", "yyyy-MM").alias("period")
    every = counts.groupBy("ref_table", period).agg(F.sum("n").alias("refs"), F.lit(0).cast("bigint").alias("orphans"))
    gone = orphans.groupBy("ref_table", period).agg(F.lit(0).cast("bigint").alias("refs"), F.sum("n").alias("orphans"))
    return every.unionByName(gone).groupBy("ref_table", "period").agg(F.sum("refs").alias("refs"), F.sum("orphans").alias("orphans"))
