"""Text expressions: stripping, validity, prompt templates. All are Columns, none runs Python per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.ids import _blank_chars

# Prompt prefixes by task type.
TASK_PREFIX = {
    "BitextMining": "task: search result | query: ",
    "Classification": "task: classification | query: ",
    "Clustering": "task: clustering | query: ",
    "InstructionRetrieval": "task: code retrieval | query: ",
    "MultilabelClassification": "task: classification | query: ",
    "PairClassification": "task: sentence similarity | query: ",
    "Reranking": "task: search result | query: ",
    "Retrieval": "task: search result | query: ",
    "STS": "task: sentence similarity | query: ",
    "Summarization": "task: summarization | query: ",
}
QUERY_PREFIX = "task: search result | query: "
UNTITLED_PREFIX = "title: none | text: "
GENERIC_INSTRUCTION = "Given a web search query, retrieve relevant passages that answer the query"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """c without Unicode white space at its ends (29 code points, not just U+0020)."""
    return F.btrim(_col(c), F.lit(_blank_chars()))


def is_valid_text(c: Column | str) -> Column:
    """True if c is there and not blank; never null."""
    return F.coalesce(strip(c) != "", F.lit(False))


def title_or_none(c: Column | str) -> Column:
    """The title, or 'none' where it is empty or null."""
    c = _col(c)
    return F.when(F.length(c) > 0, c).otherwise(F.lit("none"))


def query_instruct(text: Column | str, instruction: Column | str | None = None) -> Column:
    """'Instruct: ...' over 'Query:...', both stripped; a null instruction is the generic one."""
    given = F.lit(None).cast("string") if instruction is None else _col(instruction)
    return F.concat(F.lit("Instruct: "), F.coalesce(strip(given), F.lit(GENERIC_INSTRUCTION)), F.lit("\nQuery:"), strip(text))


def document_titled(text: Column | str, title: Column | str | None = None) -> Column:
    """Title as it is, a space, and the stripped text; the text alone where the title is null or empty."""
    if title is None:
        return strip(text)
    title = _col(title)
    return F.when(F.length(title) > 0, F.concat(title, F.lit(" "), strip(text))).otherwise(strip(text))


def prefix_of(task_type: Column | str, prefixes: Mapping[str, str] = TASK_PREFIX) -> Column:
    """The prompt prefix of a task type; an unknown type is an error, as a silent empty prompt would be worse."""
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    got = F.try_element_at(table, _col(task_type))
    return F.coalesce(got, F.raise_error(F.concat(F.lit("no prompt for task type "), F.coalesce(_col(task_type), F.lit("null")))))


def query_by_task(text: Column | str, task_type: Column | str) -> Column:
    """Prefix of the task type and the text, stripped as a whole."""
    return strip(F.concat(prefix_of(task_type), _col(text)))


def document_by_title(text: Column | str, title: Column | str | None = None) -> Column:
    """'title: ... | text: ...' stripped as a whole; null, empty and missing titles read 'none'."""
    if title is None:
        return strip(F.concat(F.lit(UNTITLED_PREFIX), _col(text)))
    return strip(F.concat(F.lit("title: "), title_or_none(title), F.lit(" | text: "), _col(text)))


def training_query(text: Column | str, prefix: str = QUERY_PREFIX) -> Column:
    """The prefix before the text as it is."""
    return F.concat(F.lit(prefix), _col(text))


def training_document(text: Column | str, title: Column | str) -> Column:
    """The training template with title (default 'none') and text as they are."""
    return F.concat(F.lit("title: "), title_or_none(title), F.lit(" | text: "), _col(text))


def resolve_prompt(override: Column, prompt: Column, by_type: Column, prompt_type: Column, default: Column) -> Column:
    """The prompt of a task: its override, else its own, else its map by prompt type, else the default.

    by_type is a map<string,string>; where it is there and prompt_type is too,
    a missing or empty entry gives the empty string, not the default.
    """
    entry = F.coalesce(F.try_element_at(by_type, prompt_type), F.lit(""))
    return (
        F.when(F.length(override) > 0, override)
        .when(by_type.isNotNull() & prompt_type.isNotNull(), entry)
        .when(F.length(prompt) > 0, prompt)
        .otherwise(default)
    )


def prompt_by_priority(name: Column, task_type: Column, prompt_type: Column, prompts: Mapping[str, str]) -> Column:
    """The prompt of the most specific key there is: name-prompt type, name, type-prompt type, type, prompt type; null if none is."""
    table = F.create_map(*[F.lit(x) for kv in prompts.items() for x in kv])
    dash = F.lit("-")
    keys = (F.concat(name, dash, prompt_type), name, F.concat(task_type, dash, prompt_type), task_type, prompt_type)
    return F.coalesce(*[F.try_element_at(table, k) for k in keys])


def format_instruction(template: str, instruction: Column | str) -> Column:
    """The template with its {instruction} filled in; a template without the place for it is an error."""
    if "{instruction}" not in template:
        raise ValueError("the template has no place for {instruction}")
    return F.replace(F.lit(template), F.lit("{instruction}"), _col(instruction))


def repeated(c: Column | str, n: int) -> Column:
    """c written n times, a space between: a long text for load tests."""
    return F.rtrim(F.repeat(F.concat(_col(c), F.lit(" ")), n))


def weight_decay(name: Column | str, rate: float, exempt: tuple[str, ...] = ("bias", "layer_norm.weight")) -> Column:
    """rate, or 0 for parameters whose name holds one of the exempt parts."""
    hit = F.lit(False)
    for part in exempt:
        hit = hit | _col(name).contains(part)
    return F.when(hit, F.lit(0.0)).otherwise(F.lit(float(rate)))
