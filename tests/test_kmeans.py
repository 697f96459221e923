"""Lloyd steps against numpy."""

import numpy as np
import pytest

from lexiscope.operators import kmeans as km


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    return np.concatenate([rng.normal(c, 0.3, (25, 3)) for c in ((0, 0, 0), (6, 0, 0), (0, 6, 0), (0, 0, 6))])


@pytest.fixture(scope="module")
def frame(spark, points):
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)] + [(1000, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def brute(x, c, steps):
    for _ in range(steps):
        d = np.round(((x[:, None] - c[None]) ** 2).sum(axis=2), 9)
        at = d.argmin(axis=1)
        c = np.array([x[at == k].mean(axis=0) if (at == k).any() else c[k] for k in range(len(c))])
    return c


def test_steps_equal_numpy(frame, points):
    start = points[[0, 1, 30, 99]]
    for steps in (1, 3):
        got = km.lloyd(frame, "embedding", start, max_iter=steps, tol=0)
        assert np.allclose(got.centers, brute(points, start, steps)) and got.iterations == steps
    done = km.lloyd(frame, "embedding", points[[0, 30, 60, 99]], tol=0)
    assert done.iterations < 20 and np.allclose(done.centers, brute(points, done.centers, 1))


def test_an_empty_cluster_takes_the_farthest_row(frame, points):
    start = np.array([[0, 0, 0], [500.0, 0, 0]])
    far = points[((points - start[0]) ** 2).sum(axis=1).argmax()]
    assert np.allclose(km.lloyd(frame, "embedding", start, max_iter=1).centers[1], far)


def test_whole_fit_finds_the_groups_whatever_the_partitions(frame, points):
    seeds = km.seeds(frame, "vec_id", "embedding", 4)
    assert np.allclose(seeds, km.seeds(frame.repartition(7), "vec_id", "embedding", 4))
    got = {r.vec_id: r.cluster for r in km.kmeans(frame, "vec_id", "embedding", 4).collect()}
    assert got.pop(1000) is None
    groups = [{got[i] for i in range(a, a + 25)} for a in range(0, 100, 25)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4
    assert km.kmeans(frame.limit(0), "vec_id", "embedding", 4).count() == 0
    same = frame.sparkSession.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {r.cluster for r in km.kmeans(same, "vec_id", "embedding", 3).collect()} == {0}
