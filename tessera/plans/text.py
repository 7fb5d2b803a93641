"""Queries and SQL of text projections, prompts and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.ids import canonical_id
from tessera.operators import pairs as P
from tessera.operators import tokens as K
from tessera.plans.sqltext import sql_id, sql_strip, sql_valid, sql_word_ids
from tessera.sources.tables import table, text_dataset
from tessera.session import shared_path
from tessera.sources.tasks import Task, evaluation_data, export_task, metadata, pick_subset, prompted, select_tasks, task_rows

_TYPES = sorted(T.TASK_PREFIX)
_PROMPTS = {"statute_search-query": "find the statute", "statute_search": "statutes", "Retrieval-document": "a passage", "Retrieval": "search", "document": "a text"}


def strip_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus").select("ord", T.strip("title").alias("title"))


def valid_rows(spark: SparkSession, d: str) -> DataFrame:
    return P.valid_rows(table(spark, d, "corpus")).select("ord")


def title_default(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "data_doc").select("ord", T.title_or_none("positive_title").alias("title"))


def prompt_query_instruct(spark: SparkSession, d: str) -> DataFrame:
    return P.valid_rows(table(spark, d, "queries")).select("ord", T.query_instruct("text").alias("prompt"))


def prompt_document_titled(spark: SparkSession, d: str) -> DataFrame:
    return P.valid_rows(table(spark, d, "corpus")).select("ord", T.document_titled("text", "title").alias("prompt"))


def prompt_query_task(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("ord") % len(_TYPES)).cast("int") + 1)
    return P.valid_rows(table(spark, d, "queries")).select("ord", T.query_by_task("text", kind).alias("prompt"))


def prompt_document_task(spark: SparkSession, d: str) -> DataFrame:
    return P.valid_rows(table(spark, d, "corpus")).select("ord", T.document_by_title("text", "title").alias("prompt"))


def training_query_prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("ord", T.training_query("text").alias("prompt"))


def training_document_prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "data_doc").select("ord", T.training_document("positive_text", "positive_title").alias("prompt"))


def prompted_dataset(spark: SparkSession, d: str) -> DataFrame:
    src = P.valid_rows(table(spark, d, "queries"))
    out = prompted(src, T.query_instruct("text"), K.with_end(K.word_ids(F.col("text")), 0), key="_id")
    return out.select("id", "ord", "body", "text", F.size("input_ids").alias("n_ids"), F.md5(F.array_join("input_ids", ",")).alias("ids"))


def prompt_resolution(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    by_type = F.when(F.col("task_name") == "statute_search", F.create_map(F.lit("query"), F.lit("find the statute"))).when(F.col("task_name") == "code_help", F.create_map(F.lit("document"), F.lit("a snippet")))
    override = F.when(F.col("task_name") == "fact_lookup", F.lit("look up the fact")).otherwise(none)
    out = T.resolve_prompt(override, F.col("title"), by_type, F.lit("query"), F.lit("search"))
    return table(spark, d, "documents").select("doc_id", out.alias("prompt"))


def prompt_priority(spark: SparkSession, d: str) -> DataFrame:
    """The most specific of prompts by task name, task type and prompt type."""
    kind = F.when(F.col("lang") == "en", "Retrieval").otherwise("STS")
    side = F.when(F.length("title") > 0, "document").otherwise("query")
    return table(spark, d, "documents").select("doc_id", T.prompt_by_priority(F.col("task_name"), kind, side, _PROMPTS).alias("prompt"))


def task_splits(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the evaluation splits of a task over documents, with the split; splits that are not for evaluation stay out."""
    docs = table(spark, d, "documents")
    task = Task("documents", "Retrieval", ("en", "de"), splits={g: docs.where(F.col("lang") == g) for g in ("en", "de", "fr")})
    out = None
    for name, rows in evaluation_data(task).items():
        one = rows.select("doc_id", F.lit(name).alias("split"))
        out = one if out is None else out.unionByName(one)
    return out


def task_subset(spark: SparkSession, d: str) -> DataFrame:
    """A subset of a split; where a split has no default subset, the default is all of it."""
    docs = table(spark, d, "documents").withColumn("split", F.when(F.col("source").isNull(), "none").otherwise("test"))
    named = docs.withColumn("subset", F.coalesce(F.lower("lang"), F.lit("default")))
    return pick_subset(named, "test", "de").select("doc_id", F.lit("de").alias("subset")).unionByName(pick_subset(docs.withColumn("subset", F.lit("all")), "test").select("doc_id", F.lit("default").alias("subset")))


def task_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The public metadata of tasks of a kind, as rows."""
    tasks = [Task("a", "Retrieval", ("test",), "first", _cache=1), Task("b", "STS", ("test",)), Task("c", "Retrieval", ("dev",), "third")]
    rows = [(t.name, k, str(v)) for t in select_tasks(tasks) for k, v in sorted(metadata(t).items()) if k in ("name", "type", "description", "main_score")]
    return spark.createDataFrame(rows, "task string, field string, value string")


def task_export(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an evaluation split exported as JSON lines and read back."""
    path = shared_path(spark, "task")
    export_task(Task("queries", "Retrieval", ("test",), splits={"test": table(spark, d, "queries").select("ord", "_id", "text")}), path)
    return spark.read.schema("ord bigint, _id string, text string").json(f"{path}/data/test")


def load_probe(spark: SparkSession, d: str) -> DataFrame:
    """A load test: every title repeated 50 times, tokenized at 64 words as a query and at 128 as a passage."""
    ids = K.word_ids(T.repeated("title", 50))
    t = table(spark, d, "documents").select("doc_id", K.truncated(ids, 64).alias("q"), K.truncated(ids, 128).alias("p"))
    return t.select("doc_id", F.size("q").alias("query_len"), F.size("p").alias("pos_len"), F.md5(F.array_join("p", ",")).alias("ids"))


def given_texts(spark: SparkSession, d: str) -> DataFrame:
    """A few given texts as a table."""
    return text_dataset(spark, ["red fox", "", None])


def formatted_instruction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.format_instruction("Instruct: {instruction}\nQuery:", F.coalesce("task_name", F.lit("none"))).alias("prompt"))


def task_rows_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return task_rows(table(spark, d, "data_doc").withColumnRenamed("positive_text", "positive"), "Retrieval")


def task_rows_classification(spark: SparkSession, d: str) -> DataFrame:
    return task_rows(table(spark, d, "documents"), "Classification")


def weight_decay_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.weight_decay("source", 0.1, ("wiki", "export")).alias("weight_decay"))


def pair_build_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return P.build_pairs(table(spark, d, "queries"), table(spark, d, "corpus"), table(spark, d, "qrels"))


def qrel_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return P.referenced_corpus(table(spark, d, "corpus"), table(spark, d, "qrels")).select("ord")


def queries_with_positives(spark: SparkSession, d: str) -> DataFrame:
    return P.queries_with_positives(table(spark, d, "queries"), table(spark, d, "qrels")).select("ord")


def zip_aligned(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tokenized_dataset")
    return P.zip_aligned(t.select("example_id", "query_text"), t.select("example_id", "pos_text"), "example_id")


def tokenized_examples(spark: SparkSession, d: str) -> DataFrame:
    """Training pairs tokenized at the lengths that training asks for; 1,024 and 4,096 words."""
    pairs = pair_build_last_wins(spark, d)
    doc = T.training_document("positive_text", "positive_title")
    out = K.tokenized_examples(pairs, max_query=1024, max_passage=4096, query_text=T.training_query("query_text"), passage_text=doc)
    return out.select("query_id", "pos_ids", "query_len", "pos_len", "total_len", F.md5(F.array_join("pos_token_ids", ",")).alias("ids"))


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Extension: hits of search_results that no judgement calls relevant."""
    pair = F.explode(F.arrays_zip("doc_ids", "scores")).alias("h")
    hits = table(spark, d, "search_results").where("query_id is not null").select(canonical_id("query_id").alias("query_id"), pair).select("query_id", F.col("h.doc_ids").alias("doc_id"), F.col("h.scores").alias("score"))
    hits = hits.where("query_id is not null and doc_id >= 0 and score is not null and not isnan(score) and abs(score) < double('infinity')")
    best = hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return P.exclude_positives(best, table(spark, d, "qrels"))


def _pairs_sql() -> str:
    return (
        f"WITH g AS (SELECT {sql_id('\"query-id\"')} AS q, {sql_id('\"corpus-id\"')} AS d, ord FROM qrels WHERE score = 1), "
        "c AS (SELECT q, d, min(ord) OVER (PARTITION BY q) AS first_ord FROM g WHERE q IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY ord DESC) = 1), "
        f"qs AS (SELECT {sql_id('_id')} AS q, text FROM queries WHERE {sql_id('_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {sql_id('_id')} ORDER BY ord DESC) = 1), "
        f"ds AS (SELECT {sql_id('_id')} AS d, title, text FROM corpus WHERE {sql_id('_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {sql_id('_id')} ORDER BY ord DESC) = 1), "
        "p AS (SELECT c.q AS query_id, qs.text AS query_text, c.d AS positive_id, CASE WHEN length(ds.title) > 0 THEN ds.title ELSE 'none' END AS positive_title, ds.text AS positive_text, first_ord "
        "FROM c JOIN qs ON c.q = qs.q JOIN ds ON c.d = ds.d) "
    )


QUERIES = {
    f.__name__: f
    for f in (
        strip_titles, valid_rows, title_default, prompt_query_instruct, prompt_document_titled, prompt_query_task, prompt_document_task,
        training_query_prompts, training_document_prompts, prompted_dataset, prompt_resolution, formatted_instruction, task_rows_retrieval,
        task_rows_classification, weight_decay_groups, pair_build_last_wins, qrel_semi_join, queries_with_positives, zip_aligned,
        tokenized_examples, hard_negatives, prompt_priority, task_splits, task_subset, task_metadata, task_export, load_probe, given_texts,
    )
}

_TITLED = "'title: ' || CASE WHEN length({t}) > 0 THEN {t} ELSE 'none' END || ' | text: ' || {x}"
_INSTRUCT = f"'Instruct: {T.GENERIC_INSTRUCTION}' || chr(10) || 'Query:' || {sql_strip('text')}"
_PREFIXES = "[" + ", ".join(f"'{T.TASK_PREFIX[k]}'" for k in _TYPES) + "]"

SQL = {
    "strip_titles": f"SELECT ord, {sql_strip('title')} AS title FROM corpus",
    "valid_rows": f"SELECT ord FROM corpus WHERE {sql_valid('text')}",
    "title_default": "SELECT ord, CASE WHEN length(positive_title) > 0 THEN positive_title ELSE 'none' END AS title FROM data_doc",
    "prompt_query_instruct": f"SELECT ord, {_INSTRUCT} AS prompt FROM queries WHERE {sql_valid('text')}",
    "prompt_document_titled": f"SELECT ord, CASE WHEN length(title) > 0 THEN title || ' ' || {sql_strip('text')} ELSE {sql_strip('text')} END AS prompt FROM corpus WHERE {sql_valid('text')}",
    "prompt_query_task": f"SELECT ord, {sql_strip(f'{_PREFIXES}[(ord % {len(_TYPES)}) + 1] || text')} AS prompt FROM queries WHERE {sql_valid('text')}",
    "prompt_document_task": f"SELECT ord, {sql_strip('(' + _TITLED.format(t='title', x='text') + ')')} AS prompt FROM corpus WHERE {sql_valid('text')}",
    "training_query_prompts": f"SELECT ord, '{T.QUERY_PREFIX}' || text AS prompt FROM queries",
    "training_document_prompts": f"SELECT ord, {_TITLED.format(t='positive_title', x='positive_text')} AS prompt FROM data_doc",
    "prompted_dataset": f"""SELECT _id AS id, ord, text AS body, {_INSTRUCT} AS text, (len({sql_word_ids('(' + _INSTRUCT + ')')}) + 1)::int AS n_ids,
        md5(array_to_string(list_append({sql_word_ids('(' + _INSTRUCT + ')')}, 0), ',')) AS ids FROM queries WHERE {sql_valid('text')}""",
    "prompt_resolution": """SELECT doc_id, CASE WHEN task_name = 'fact_lookup' THEN 'look up the fact' WHEN task_name = 'statute_search' THEN 'find the statute'
        WHEN task_name = 'code_help' THEN '' WHEN length(title) > 0 THEN title ELSE 'search' END AS prompt FROM documents""",
    "formatted_instruction": "SELECT doc_id, 'Instruct: ' || coalesce(task_name, 'none') || chr(10) || 'Query:' AS prompt FROM documents",
    "task_rows_retrieval": "SELECT '' AS query, positive_text AS positive, '' AS negative FROM data_doc",
    "task_rows_classification": "SELECT text, 0 AS label FROM documents",
    "weight_decay_groups": "SELECT doc_id, CASE WHEN contains(source, 'wiki') OR contains(source, 'export') THEN 0.0::double ELSE 0.1::double END AS weight_decay FROM documents",
    "pair_build_last_wins": _pairs_sql() + "SELECT * FROM p",
    "qrel_semi_join": f"SELECT ord FROM corpus WHERE {sql_id('_id')} IN (SELECT {sql_id('\"corpus-id\"')} FROM qrels WHERE score = 1)",
    "queries_with_positives": f"SELECT ord FROM queries WHERE {sql_id('_id')} IN (SELECT {sql_id('\"query-id\"')} FROM qrels WHERE score > 0)",
    "zip_aligned": "SELECT example_id, query_text, pos_text FROM tokenized_dataset",
    "tokenized_examples": _pairs_sql()
    + f"""SELECT query_id, positive_id::bigint AS pos_ids, least(1024, len(qi))::int AS query_len, least(4096, len(di))::int AS pos_len,
        (least(1024, len(qi)) + least(4096, len(di)))::int AS total_len, md5(array_to_string(di[1:4096], ',')) AS ids
        FROM (SELECT *, {sql_word_ids(f"('{T.QUERY_PREFIX}' || query_text)")} AS qi, {sql_word_ids('(' + _TITLED.format(t='positive_title', x='positive_text') + ')')} AS di FROM p)""",
    "given_texts": "SELECT * FROM (VALUES (0::bigint, 'red fox'), (1, ''), (2, NULL)) v(pos, text)",
    "load_probe": f"""SELECT doc_id, least(64, len(i))::int AS query_len, least(128, len(i))::int AS pos_len, md5(array_to_string(i[1:128], ',')) AS ids
        FROM (SELECT doc_id, {sql_word_ids("repeat(title || ' ', 50)")} AS i FROM documents)""",
    "prompt_priority": """SELECT doc_id, CASE WHEN task_name = 'statute_search' AND NOT coalesce(length(title) > 0, false) THEN 'find the statute' WHEN task_name = 'statute_search' THEN 'statutes'
        WHEN lang = 'en' AND length(title) > 0 THEN 'a passage' WHEN lang = 'en' THEN 'search' WHEN length(title) > 0 THEN 'a text' END AS prompt FROM documents""",
    "task_splits": "SELECT doc_id, lang AS split FROM documents WHERE lang IN ('en', 'de')",
    "task_subset": "SELECT doc_id, 'de' AS subset FROM documents WHERE source IS NOT NULL AND lower(lang) = 'de' UNION ALL SELECT doc_id, 'default' FROM documents WHERE source IS NOT NULL",
    "task_metadata": """SELECT * FROM (VALUES ('a', 'description', 'first'), ('a', 'main_score', 'ndcg_at_10'), ('a', 'name', 'a'), ('a', 'type', 'Retrieval'),
        ('c', 'description', 'third'), ('c', 'main_score', 'ndcg_at_10'), ('c', 'name', 'c'), ('c', 'type', 'Retrieval')) v(task, field, value)""",
    "task_export": "SELECT ord, _id, text FROM queries",
    "hard_negatives": f"""WITH h AS (SELECT {sql_id('query_id')} AS query_id, unnest(doc_ids) AS doc_id, unnest(scores) AS score FROM search_results WHERE query_id IS NOT NULL),
        b AS (SELECT query_id, doc_id, max(score) AS score FROM h WHERE query_id IS NOT NULL AND doc_id >= 0 AND isfinite(score) GROUP BY 1, 2),
        k AS (SELECT {sql_id('\"query-id\"')} AS q, ({sql_id('\"corpus-id\"')})::bigint AS d FROM qrels WHERE score > 0)
        SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.q = b.query_id AND k.d = b.doc_id)""",
}
