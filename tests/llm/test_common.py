"""Connected components against a plain union-find."""

import random

import pytest

from factloom.llm.common import connected_components


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("shape", ["random", "path", "star", "none", "loops"])
def test_components(spark, shape):
    rng = random.Random(4)
    edges = {
        "random": [(rng.randint(-50, 250), rng.randint(-50, 250)) for _ in range(160)],
        "path": [(k * 7 % 101, (k + 1) * 7 % 101) for k in range(100)],
        "star": [(5, k) for k in range(6, 60)] + [(3, 5)],
        "none": [],
        "loops": [(1, 1), (2, 1), (2, 1), (None, 3), (4, None)],
    }[shape]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == plain(edges)


def test_threads_keep_each_others_tables(spark):
    """What one thread settles doesn't delete what another is reading."""
    import threading

    from factloom.llm.common import cut, settled

    inside, done, got = threading.Event(), threading.Event(), []

    def slow():
        def make():
            table = cut(spark.range(10).selectExpr("id"))
            inside.set()
            done.wait(60)
            return table.where("id > 2")

        got.append(settled(spark, make).count())

    other = threading.Thread(target=slow)
    other.start()
    inside.wait(60)
    assert settled(spark, lambda: cut(spark.range(5).selectExpr("id"))).count() == 5
    done.set()
    other.join()
    assert got == [7]


def test_local_session_without_a_shared_folder(spark, monkeypatch):
    """Nothing static is set; the folder is a value."""
    from factloom.llm import common

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"getConf": lambda self: Conf(), "master": "local[2]"})()

    assert common.shared_dir(Session()).endswith("factloom-scratch")
    Session.sparkContext.__class__.master = "spark://there:7077"
    with pytest.raises(ValueError):
        common.shared_dir(Session())
