"""Where shared files go."""

from types import SimpleNamespace

import pytest

from accountlens.session import new_shared_path, require_utc, shared_dir


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def fake(master, **conf):
    settings = SimpleNamespace(get=lambda key, default=None: conf.get(key.rsplit(".", 1)[-1] if key.endswith("Zone") else "dir", default))
    return SimpleNamespace(conf=settings, sparkContext=Context(master))


def test_the_cluster_names_the_folder():
    assert shared_dir(fake("spark://host:7077", dir="/shared/x")) == "/shared/x"


def test_a_local_session_gets_its_own_folder_once():
    spark = fake("local[8]")
    assert shared_dir(spark) == shared_dir(spark)


def test_a_cluster_without_the_setting_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake("spark://host:7077"))


def test_every_run_gets_a_path_of_its_own():
    spark = fake("local[8]", dir="/shared/x/")
    first, second = (new_shared_path(spark, "p") for _ in range(2))
    assert first != second and first.startswith("/shared/x/p-")


def test_zone():
    require_utc(fake("local[8]", timeZone="UTC"))
    with pytest.raises(ValueError, match="Europe/Paris"):
        require_utc(fake("local[8]", timeZone="Europe/Paris"))
