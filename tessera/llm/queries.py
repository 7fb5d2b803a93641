"""Queries and SQL of the operators on training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ids import canonical_id
from tessera.llm.containers import fill_containers, filling_totals
from tessera.llm.encode import TOKENIZER, encode_texts
from tessera.llm.leaks import leaked_items
from tessera.llm.neardup import record_rows, search_report, similar_classes, similar_records
from tessera.llm.quality import fitted_profiles, not_prose, text_statistics
from tessera.llm.topn import top_n_per_group
from tessera.plans.sqltext import sql_id
from tessera.sources.tables import table


def p1_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence of 2,048 tokens of every example, and its place there."""
    return fill_containers(table(spark, sf_dir, "tokenized_dataset"), F.col("query_len") + F.col("pos_len"), 2048)


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any valid filling keeps: every example and token is placed, no sequence overflows, no short example is cut."""
    return filling_totals(p1_sequences(spark, sf_dir), 2048)


def _passages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows and owners of the passages of corpus, and of those that only data_doc has."""
    corpus = table(spark, sf_dir, "corpus").select(canonical_id("_id").try_cast("bigint").alias("id"), "ord", "text")
    pos = table(spark, sf_dir, "data_doc").select(canonical_id("positive_id").try_cast("bigint").alias("id"), "ord", F.col("positive_text").alias("text"))
    return record_rows(corpus, pos)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of passages whose sets of three successive words have a similarity of at least a half."""
    return similar_records(*_passages(spark, sf_dir), width=3, threshold=0.5, least_words=20)


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage with its class of equal sets as p2_found takes them: class_id is the representative."""
    return similar_classes(*_passages(spark, sf_dir), width=3, threshold=0.5, least_words=20)


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage with its class of equal sets, at five words and a similarity of 0.8."""
    return similar_classes(*_passages(spark, sf_dir), width=5, threshold=0.8, least_words=20)


def p2_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the signature trees of p2_found visited, pruned and compared, by search partition."""
    return search_report(_passages(spark, sf_dir)[0], width=3, threshold=0.5, least_words=20)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of each query."""
    hits = table(spark, sf_dir, "search_results").select(F.coalesce(canonical_id("query_id"), "query_id").alias("query_id"), "doc_ids", "scores")
    return top_n_per_group(hits, 10).select(F.col("group").alias("query_id"), F.col("item").alias("doc_id"))


def p5_ids(spark: SparkSession, sf_dir: str, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """The token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each evaluation item of which it has 12 successive words."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches: documents in which 12 successive words of an item stand, each up to one word from its place."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), slop=1)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation items that leaked: task, and number of documents they leaked into."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "task")
    n = p6_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
    return n.join(items, "item_id", "left").select("item_id", "task", "documents")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are for the greater part no running text."""
    docs = table(spark, sf_dir, "documents")
    return not_prose(docs, fitted_profiles(docs, table(spark, sf_dir, "doc_labels")))


def p7_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and the nearest structural profile of every document."""
    docs = table(spark, sf_dir, "documents")
    return text_statistics(docs, fitted_profiles(docs, table(spark, sf_dir, "doc_labels")))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basic counts among the statistics: words of every document, and their mean length."""
    return text_statistics(table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("mean_word_len", 6).alias("mean_word_len"))


QUERIES = {"p1_sequences": p1_sequences, "p1_totals": p1_totals, "p2_found": p2_found, "p2_members": p2_members, "p2_classes": p2_classes, "p2_trees": p2_trees, "p3_found": p3_found, "p5_ids": p5_ids, "p6_found": p6_found, "p6_near": p6_near, "p6_report": p6_report, "p7_found": p7_found, "p7_statistics": p7_statistics, "p7_counts": p7_counts}


def _sql_words(c: str) -> str:
    """Words of c: runs of letters and digits in lower case. Of NFKC, what these tables need: NFC, full-width forms, a half and the trade mark sign."""
    wide = "".join(chr(0xFEE0 + i) for i in range(0x21, 0x7F))
    plain = "".join(chr(i) for i in range(0x21, 0x7F)).replace("'", "''")
    return f"regexp_extract_all(lower(nfc_normalize(translate(replace(replace({c}, '\u2122', 'TM'), '\u00bd', '1/2'), '{wide}', '{plain}'))), '[\\p{{L}}\\p{{N}}]+')"


def _sql_grams(source: str, key: str, width: int, *, distinct: bool = True) -> str:
    """(key, g): the runs of `width` successive words of the lists w of source."""
    gram = "list_aggregate(w[i:i + {k}], 'string_agg', ' ')".format(k=width - 1)
    return f"SELECT {'DISTINCT' if distinct else ''} {key}, {gram} AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {width - 2})) AS i FROM {source} WHERE len(w) >= {width})"


def _sql_sets(width: int, share: str) -> str:
    """Common tables of the near-duplicates: s (id, g), n (id, n) and p (a, b), pairs of records with sets that are similar enough."""
    num, den = share.split("/")
    return f"""WITH c AS (SELECT ({sql_id("_id")})::bigint AS id, text, ord FROM corpus WHERE {sql_id("_id")} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1),
        d AS (SELECT ({sql_id("positive_id")})::bigint AS id, positive_text AS text, ord FROM data_doc WHERE {sql_id("positive_id")} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1),
        r AS (SELECT id, text FROM c UNION ALL SELECT id, text FROM d WHERE id NOT IN (SELECT id FROM c)),
        w AS (SELECT id, {_sql_words("text")} AS w FROM r WHERE text IS NOT NULL), k AS (SELECT id, w FROM w WHERE len(w) >= 20),
        s AS MATERIALIZED ({_sql_grams("k", "id", width)}), n AS (SELECT id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY 1),
        j AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
        p AS (SELECT a, b, x.h AS ha, y.h AS hb FROM j JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k * {den} >= (x.n + y.n - k) * {num}) """


def _sql_classes(width: int, share: str) -> str:
    return (
        _sql_sets(width, share)
        + """, e AS (SELECT DISTINCT ha AS h, hb AS o FROM p WHERE ha <> hb UNION SELECT DISTINCT hb, ha FROM p WHERE ha <> hb),
        l AS (SELECT h, count(*) AS links FROM e GROUP BY 1)
        SELECT n.id, min(n.id) OVER w AS class_id, count(*) OVER w AS copies, coalesce(links, 0)::bigint AS links FROM n LEFT JOIN l ON n.h = l.h WINDOW w AS (PARTITION BY n.h)"""
    )


_LEAKS = (
    f"WITH d AS (SELECT doc_id, {_sql_words('text')} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_sql_words('text')} AS w FROM eval_items WHERE text IS NOT NULL), "
    f"x AS ({_sql_grams('d', 'doc_id', 12)}), y AS ({_sql_grams('e', 'item_id', 12)}), f AS (SELECT DISTINCT doc_id, item_id FROM x JOIN y ON x.g = y.g) "
)

SQL = {
    "p2_found": _sql_sets(3, "1/2") + "SELECT a AS id_a, b AS id_b FROM p",
    "p2_members": _sql_classes(3, "1/2"),
    "p2_classes": _sql_classes(5, "4/5"),
    "p6_found": _LEAKS + "SELECT * FROM f",
    "p7_counts": f"""SELECT doc_id, coalesce(len(w), 0)::bigint AS n_words, round(list_avg(list_transform(w, lambda x: length(x))), 6) AS mean_word_len
        FROM (SELECT doc_id, {_sql_words("text")} AS w FROM documents)""",
    "p6_report": _LEAKS + "SELECT item_id, task, count(*) AS documents FROM f JOIN eval_items USING (item_id) GROUP BY 1, 2",
    "p1_totals": "SELECT count(*) AS items, sum(query_len + pos_len)::bigint AS tokens, 0::bigint AS wrongly_cut, 0::bigint AS overfull FROM tokenized_dataset",
    "p3_found": """
        WITH h AS (SELECT CASE WHEN regexp_full_match(trim(query_id), '[0-9]+') THEN coalesce(nullif(ltrim(trim(query_id), '0'), ''), '0') ELSE query_id END AS query_id,
                          unnest(doc_ids) AS doc_id, unnest(scores) AS score
                   FROM search_results WHERE query_id IS NOT NULL),
        b AS (SELECT query_id, doc_id, max(score) AS score FROM h WHERE doc_id >= 0 AND isfinite(score) GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM b)
        SELECT query_id, doc_id FROM r WHERE k <= 10""",
}
