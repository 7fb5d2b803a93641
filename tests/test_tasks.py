import pytest

from tessera.sources import tasks as K


def task(df=None, splits=("test",)):
    return K.Task("t", "Retrieval", splits, splits={} if df is None else {"test": df}, _cache=1)


def test_metadata_is_public(spark):
    m = K.metadata(task())
    assert m["name"] == "t" and not any(k.startswith("_") for k in m) and "splits" not in m


def test_splits(spark):
    df = spark.range(1)
    assert K.load_split(task(df)).count() == 1
    assert set(K.evaluation_data(task(df))) == {"test"}
    with pytest.raises(ValueError, match="Available splits"):
        K.load_split(task(df), "dev")
    with pytest.raises(ValueError):
        K.only_eval_split(task(splits=("a", "b")))
    assert K.only_eval_split(task()) == "test"
    assert [t.name for t in K.select_tasks([task(), K.Task("s", "STS", ())])] == ["t"]


def test_subsets(spark):
    df = spark.createDataFrame([("test", "en"), ("test", "default"), ("dev", "en")], "split string, subset string")
    assert K.pick_subset(df, "test", "en").count() == K.pick_subset(df, "test").count() == 1
    assert K.pick_subset(df.where("subset = 'en'"), "test").count() == 1
    for split, subset in (("test", "fr"), ("train", "default")):
        with pytest.raises(ValueError):
            K.pick_subset(df, split, subset)
    two = spark.createDataFrame([("test", "en"), ("test", "fr")], "split string, subset string")
    with pytest.raises(ValueError, match="2 subsets"):
        K.pick_subset(two, "test")
    assert K.pick_subset(df.drop("subset"), "test").count() == 2
    with pytest.raises(ValueError):
        K.pick_subset(df.drop("subset"), "test", "en")


def test_defaults_are_for_missing_columns_only(spark):
    df = spark.createDataFrame([("q", None)], "query string, positive string")
    assert [tuple(r) for r in K.task_rows(df, "Retrieval").collect()] == [("q", None, "")]
    assert [tuple(r) for r in K.task_rows(df, "Classification").collect()] == [("", 0)]
    assert K.task_rows(df, "STS").columns == df.columns


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\u001cb"), (2, None)], "id int, text string")
    K.export_task(task(df), str(tmp_path))
    assert {tuple(r) for r in spark.read.schema("id int, text string").json(f"{tmp_path}/data/test").collect()} == {(1, "a\u001cb"), (2, None)}
    assert '"name": "t"' in spark.read.text(f"{tmp_path}/metadata.json").first()[0] and "_cache" not in spark.read.text(f"{tmp_path}/metadata.json").first()[0]
