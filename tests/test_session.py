"""The folder in which lineage is cut."""

from types import SimpleNamespace

import pytest

from leafmill import session


class Conf(dict):
    def set(self, key, value):
        self[key] = value


def made(master, **conf):
    context = SimpleNamespace(master=master, getConf=lambda: Conf(conf))
    return SimpleNamespace(sparkContext=context, conf=Conf())


def test_the_folder_of_the_session_is_used():
    spark = made("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://nn/shared/"})
    assert session.shared_dir(spark) == "hdfs://nn/shared"


def test_a_cluster_without_a_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(made("spark://host:7077"))


def test_a_local_session_gets_one_folder(tmp_path, monkeypatch):
    monkeypatch.setattr(session.tempfile, "mkdtemp", lambda prefix: str(tmp_path / prefix))
    spark = made("local[2]")
    assert session.shared_dir(spark) == session.shared_dir(spark) == f"file://{tmp_path}/leafmill-"


def test_written_tables_lie_in_it(spark):
    rows = session.materialize(spark.range(3), "check")
    assert rows.count() == 3 and all(f.startswith(session.shared_dir(spark).replace("file://", "file://")) for f in rows.inputFiles())
