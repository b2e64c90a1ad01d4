from types import SimpleNamespace

import pytest

from tallyfold.sources import new_shared_folder

MASTERS = ["local", "local[4]", "local-cluster[2,1,1024]", "yarn"]


def session(master, **settings):
    settings = {key.replace("__", "."): value for key, value in settings.items()}
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)),
        sparkContext=SimpleNamespace(master=master),
    )


@pytest.mark.parametrize("master", MASTERS)
def test_the_folder_the_cluster_names_is_used(master):
    spark = session(
        master,
        spark__checkpoint__dir="hdfs://shared/checkpoints/",
        spark__sql__warehouse__dir="hdfs://shared/warehouse",
    )
    made = {new_shared_folder(spark) for _ in range(2)}
    assert len(made) == 2
    assert all(path.startswith("hdfs://shared/checkpoints/tallyfold-") for path in made)


@pytest.mark.parametrize("master", MASTERS)
def test_the_warehouse_is_used_where_no_folder_is_named(master):
    spark = session(master, spark__sql__warehouse__dir="hdfs://shared/warehouse")
    assert new_shared_folder(spark).startswith("hdfs://shared/warehouse/tallyfold-")
