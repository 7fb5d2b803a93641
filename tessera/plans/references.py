"""Queries and SQL of problem 4, references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.references import Parent, orphan_references, orphan_report
from tessera.plans.sqltext import blanks, sql_id
from tessera.sources.tables import table


def _parents(spark: SparkSession, sf_dir: str) -> list[Parent]:
    return [Parent("corpus", table(spark, sf_dir, "corpus"), "corpus-id"), Parent("queries", table(spark, sf_dir, "queries"), "query-id")]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each orphan reference of qrels: ord, ref_table."""
    return orphan_references(table(spark, sf_dir, "qrels"), _parents(spark, sf_dir))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and orphans per table referred to and month of judged_at."""
    return orphan_report(table(spark, sf_dir, "qrels"), _parents(spark, sf_dir))


def _refs_sql() -> str:
    """Common tables refs (ord, ref_table, k, at, orphan) and what they need, for DuckDB."""
    def side(name: str, fk: str) -> str:
        return (
            f"SELECT ord, '{name}' AS ref_table, coalesce({sql_id(fk)}, '!' || {fk}) AS k, judged_at AS seen FROM qrels "
            f"WHERE {fk} IS NOT NULL AND trim({fk}, {blanks()}) <> ''"
        )

    def parent(name: str) -> str:
        return f"SELECT '{name}' AS ref_table, {sql_id('_id')} AS k, added_at AS since, deleted_at AS until FROM {name}"

    fks = {"corpus": '"corpus-id"', "queries": '"query-id"'}
    return (
        f"WITH r AS MATERIALIZED ({side('corpus', fks['corpus'])} UNION ALL {side('queries', fks['queries'])}), "
        f"p AS MATERIALIZED ({parent('corpus')} UNION ALL {parent('queries')}), "
        "refs AS (SELECT r.*, NOT EXISTS (SELECT 1 FROM p WHERE p.ref_table = r.ref_table AND p.k = r.k "
        "AND r.seen >= p.since AND (p.until IS NULL OR r.seen < p.until)) AS orphan FROM r) "
    )


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
SQL = {
    "p4_found": _refs_sql() + "SELECT ord, ref_table FROM refs WHERE orphan",
    "p4_report": _refs_sql()
    + "SELECT ref_table, strftime(seen, '%Y-%m') AS period, count(*)::bigint AS refs, sum(CASE WHEN orphan THEN 1 ELSE 0 END)::bigint AS orphans FROM refs GROUP BY 1, 2",
}
