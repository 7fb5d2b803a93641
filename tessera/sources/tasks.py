"""Evaluation tasks: metadata, splits and rows by kind of task."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Task:
    """Metadata of a task and its splits; names with a leading underscore are private."""

    name: str
    type: str
    eval_splits: Sequence[str]
    description: str = ""
    prompt: Mapping[str, str] | str | None = None
    main_score: str = "ndcg_at_10"
    splits: Mapping[str, DataFrame] = field(default_factory=dict, repr=False)
    _cache: object = None


def metadata(task: Task) -> dict:
    """The public metadata of a task: everything but its data and private names."""
    return {f.name: getattr(task, f.name) for f in fields(task) if not f.name.startswith("_") and f.name != "splits"}


def export_task(task: Task, path: str) -> None:
    """Write the public metadata (metadata.json) and the rows of the evaluation splits (one folder of JSON lines each) under path."""
    rows = {s: load_split(task, s) for s in task.eval_splits}
    for name, df in rows.items():
        df.write.mode("overwrite").json(f"{path}/data/{name}")
    for df in list(rows.values())[:1]:
        text = json.dumps(metadata(task), sort_keys=True, default=str)
        df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata.json")


def load_split(task: Task, split: str = "test") -> DataFrame:
    """The rows of a split; an unknown one is a ValueError that names those there are."""
    if split not in task.splits:
        raise ValueError(f"Split '{split}' not found in task '{task.name}'. Available splits: {sorted(task.splits)}")
    return task.splits[split]


def evaluation_data(task: Task) -> dict[str, DataFrame]:
    """The evaluation splits of a task, and only those."""
    return {s: load_split(task, s) for s in task.eval_splits}


def only_eval_split(task: Task) -> str:
    """The one evaluation split; more or fewer are a ValueError."""
    if len(task.eval_splits) != 1:
        raise ValueError(f"task '{task.name}' has {len(task.eval_splits)} evaluation splits, not one")
    return task.eval_splits[0]


def pick_subset(df: DataFrame, split: str, subset: str = "default") -> DataFrame:
    """Rows of the split and subset.

    Where 'default' is asked for and the table has no such subset, it is the
    whole split, which then must hold no more than one subset. Any other subset
    that is not there, and a split that is not, are a ValueError, not an empty result.
    """
    out = df.where(F.col("split") == split)
    there = {r[0] for r in (out.select("subset") if "subset" in df.columns else out.select(F.lit(None))).distinct().limit(1000).collect()}
    if not there:
        raise ValueError(f"no split '{split}'")
    if subset in there:
        return out.where(F.col("subset") == subset)
    if subset != "default":
        raise ValueError(f"no subset '{subset}' in split '{split}'; there are {sorted(map(str, there - {None})) or 'none'}")
    if len(there) > 1:
        raise ValueError(f"split '{split}' has {len(there)} subsets and no default")
    return out


def select_tasks(tasks: Sequence[Task], kind: str = "Retrieval") -> list[Task]:
    """The tasks of a kind."""
    return [t for t in tasks if t.type == kind]


def _or_default(df: DataFrame, name: str, default: Column) -> Column:
    """The column, or the default where the table lacks it; a null stays null."""
    return (F.col(name) if name in df.columns else default).alias(name)


def task_rows(df: DataFrame, kind: str) -> DataFrame:
    """Rows as the kind of task needs them: triples for retrieval, text and label for classification, else as they are."""
    if kind == "Retrieval":
        return df.select(*[_or_default(df, c, F.lit("")) for c in ("query", "positive", "negative")])
    if kind == "Classification":
        return df.select(_or_default(df, "text", F.lit("")), _or_default(df, "label", F.lit(0)))
    return df


def prompted(df: DataFrame, prompt: Column, input_ids: Column, *, key: str, text: str = "text", modality: str = "text") -> DataFrame:
    """df with id, body (the text as it was), text (prompted) and input_ids (of the prompted text); other columns stay.

    prompt is an expression over df, input_ids one over the result. Only text is supported, and texts that are lists of turns are refused.
    """
    if modality != "text":
        raise ValueError(f"modality '{modality}' is not supported")
    if df.schema[text].dataType.typeName() != "string":
        raise ValueError("queries that are conversations are not supported")
    rest = [c for c in df.columns if c not in {text, key, "id", "body", "input_ids"}]
    return df.select(F.col(key).alias("id"), *rest, F.col(text).alias("body"), prompt.alias("text")).withColumn("input_ids", input_ids)
