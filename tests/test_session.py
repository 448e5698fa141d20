"""Session helpers: cluster sizing and checkpoint-directory handling."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import DataFrameWriter

from mercato.session import at_once, cluster_conf, ensure_checkpoint_dir
from mercato.sources.catalog import write_tables


def test_cluster_conf_scales_with_input():
    small = cluster_conf(10 << 30, 64)
    big = cluster_conf(100 << 40, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 128
    assert int(big["spark.sql.shuffle.partitions"]) == 819_200
    assert int(cluster_conf(1 << 30, 4000)["spark.sql.shuffle.partitions"]) == 8000


def test_checkpoint_dir_kept_when_set(spark):
    before = spark.sparkContext.getCheckpointDir()
    assert before
    assert ensure_checkpoint_dir(spark) == before


class _Ctx:
    def __init__(self, master, current=None):
        self.master, self._dir = master, current

    def getCheckpointDir(self):
        return self._dir

    def setCheckpointDir(self, d):
        self._dir = d


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Session:
    def __init__(self, master, conf=None):
        self.sparkContext = _Ctx(master)
        self.conf = _Conf(conf or {})


def test_cluster_without_checkpoint_dir_refuses_local_folder():
    import pytest
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session("spark://cluster:7077"))


def test_checkpoint_dir_read_from_session_setting():
    s = _Session("spark://cluster:7077", {"spark.checkpoint.dir": "hdfs://shared/ckpt"})
    assert ensure_checkpoint_dir(s) == "hdfs://shared/ckpt"


def test_local_session_without_setting_gets_scratch_folder():
    s = _Session("local[2]")
    assert "mercato-ckpt-" in ensure_checkpoint_dir(s)


def test_independent_actions_run_side_by_side(spark):
    meeting = threading.Barrier(2, timeout=60)

    def count(n):
        meeting.wait()
        return spark.range(n).count()

    assert at_once(spark, [lambda: count(3), lambda: count(5)]) == [3, 5]


def test_the_first_failed_action_is_raised_when_all_have_ended(spark):
    ended = []

    def slow():
        time.sleep(0.5)
        ended.append(True)

    def fail(message):
        raise ValueError(message)

    with pytest.raises(ValueError, match="one"):
        at_once(spark, [lambda: fail("one"), slow, lambda: fail("two")])
    assert ended == [True]


def test_tables_are_written_side_by_side(spark, tmp_path, monkeypatch):
    meeting, write = threading.Barrier(2, timeout=60), DataFrameWriter.parquet

    def parquet(self, path):
        meeting.wait()
        write(self, path)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    write_tables({"a": spark.range(2), "b": spark.range(3)}, str(tmp_path))
    assert [spark.read.parquet(f"{tmp_path}/{t}").count() for t in "ab"] == [2, 3]
