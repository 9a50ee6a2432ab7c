"""Where written steps go."""

import os

import pytest

from tidemark.llm import _shared


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Session:
    def __init__(self, app, master="local[2]", **conf):
        self.conf = Conf(conf)
        self.sparkContext = type("Context", (), {"applicationId": app, "master": master})()


def test_the_session_names_the_folder():
    assert _shared.shared_dir(Session("a", **{"spark.checkpoint.dir": "file:///x/"})) == "file:///x"


def test_one_folder_of_its_own_where_none_is_set():
    assert _shared.shared_dir(Session("b")) == _shared.shared_dir(Session("b")) != _shared.shared_dir(Session("c"))


def test_a_cluster_must_name_one():
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        _shared.shared_dir(Session("d", master="spark://host:7077"))


def test_rows_of_any_column_names(spark):
    df = spark.createDataFrame([(1, "a", (2, "b")), (3, None, None)], "`a.b` int, a string, `x``y` struct<`p.q`: int, r: string>")
    got = _shared.rows_in_arrow(df, lambda batches: batches)
    assert got.schema == df.schema and got.collect() == df.collect()


def test_a_step_that_nothing_reads_is_deleted(spark):
    df = _shared.staged(spark.range(5), "t")
    folder = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    _shared.dropped(df)
    assert not os.path.exists(folder)


def test_staged_is_read_again(spark):
    df = _shared.staged(spark.range(5), "t")
    assert sorted(r.id for r in df.collect()) == list(range(5)) and "parquet" in df.inputFiles()[0]
