import numpy as np
import pytest

from planloom.operators import kernels as K


def rng(n):
    return np.random.default_rng(n)


def test_distance_matches_brute_force():
    for k in range(20):
        m = rng(k).random((14, 11)) < 0.85
        zero = np.argwhere(~m)
        want = np.array([[0 if not m[r, c] else np.sqrt(((zero - [r, c]) ** 2).sum(1).min()) for c in range(11)] for r in range(14)])
        assert np.allclose(K.distance(m), want)


@pytest.mark.parametrize("diagonal", [False, True])
def test_label_matches_flood_fill(diagonal):
    for k in range(20):
        m = rng(k).random((12, 15)) < 0.55
        got, n = K.label(m, diagonal)
        want, count = np.zeros(m.shape, int), 0
        for r, c in np.argwhere(m):
            if want[r, c]:
                continue
            count += 1
            todo = [(r, c)]
            while todo:
                y, x = todo.pop()
                if 0 <= y < 12 and 0 <= x < 15 and m[y, x] and not want[y, x]:
                    want[y, x] = count
                    todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not a or not b)]
        assert n == count and (got == want).all()


def test_grow_highest_label_wins():
    assert K.grow(np.array([[1, 0, 2]]), np.ones((1, 3), bool)).tolist() == [[1, 2, 2]]


def test_sweep_splits_two_rooms():
    m = np.zeros((60, 130), bool)
    m[5:55, 5:60] = m[5:55, 70:125] = True
    m[26:34, 60:70] = True
    seeds = K.sweep_seeds(m, 0.04)
    assert len(np.unique(K.grow(seeds, m))) == 3


def test_outline_and_simplify():
    m = np.zeros((10, 12), bool)
    m[2:7, 3:9] = True
    m[4:7, 9:11] = True
    ring = K.simplify(K.outline(m), 0.1)
    assert np.isclose(K.area(ring), m.sum()) and len(ring) == 6
    hole = m.copy()
    hole[4, 5] = False
    assert np.isclose(K.area(K.outline(hole)), m.sum())


def test_triangles_cover_their_centres():
    got = K.fill_triangles((10, 10), np.array([1.0, 1.0]), np.array([[9.0, 1.0]]), np.array([[1.0, 9.0]]))
    assert got[1, 1] and got[1, 7] and not got[8, 8] and got.sum() == 36


def test_clip_and_hull():
    a, b = np.array([[0, 0], [4, 0], [4, 3], [0, 3]]), np.array([[3, 1], [5, 1], [5, 3], [3, 3]])
    assert np.isclose(K.area(K.clip_convex(a, b)), 2.0)
    assert len(K.hull(np.array([[0, 0], [2, 0], [1, 0], [2, 2], [0, 2], [1, 1]]))) == 4


def test_smooth_shifts():
    assert np.allclose(K.smooth_shifts(np.ones(1), np.array([0.05])), 0.05 / 1.15)
    assert np.allclose(K.smooth_shifts(np.ones(2), np.array([0.1, 0.1])), 0.08)
    w, o = rng(3).random(30), rng(4).normal(size=30) * 0.02
    n = len(w)
    full = np.diag(w + 0.15 + 4) - 2 * np.eye(n, k=1) - 2 * np.eye(n, k=-1)
    full[0, 0] -= 2
    full[-1, -1] -= 2
    assert np.allclose(K.smooth_shifts(w.copy(), o), np.clip(np.linalg.solve(full, w * o), -0.08, 0.08))


def test_peaks():
    s = np.zeros(60)
    s[10], s[15], s[40:43] = 100, 60, 50
    assert K.peaks(s).tolist() == [10, 41]


def test_forest():
    assert K.spanning_forest(5, [(0, 1, 5.0), (1, 2, 3.0), (0, 2, 4.0), (3, 4, 1.0)]) == [(0, 0, 1), (0, 0, 2), (3, 3, 4)]


def test_hot_vertices_are_joined_apart(spark):
    from planloom.operators import graph

    star = [(0, k) for k in range(1, 60)] + [(100, 101), (101, 102), (59, 60)]
    edges = spark.createDataFrame(star, "u long, v long")
    want = sorted([(k, 0) for k in range(61)] + [(k, 100) for k in (100, 101, 102)])
    for hot_rows in (5, 1000):
        assert sorted((r.u, r.root) for r in graph.connected_components(edges, hot_rows=hot_rows).collect()) == want


def test_components_on_the_driver(spark):
    from planloom.operators import graph

    r = rng(11)
    pairs = [(int(a), int(b)) for a, b in r.integers(-(2**62), 2**62, 80)[r.integers(0, 80, (55, 2))]] + [(k, k + 1) for k in range(40)] + [(7, 7), (None, 3)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    far, near = graph.connected_components(edges), graph.connected_components(edges, driver_edges=1000)
    assert near.columns == far.columns and near.dtypes == far.dtypes
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))
    assert graph.connected_components(edges.limit(0), driver_edges=1000).count() == 0


def test_cut_shrinks_a_grown_heap_of_the_driver(spark, monkeypatch):
    from planloom import storage

    jvm, app = spark.sparkContext._jvm, spark.sparkContext.applicationId
    full = lambda: sum(x.getCollectionCount() for x in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in x.getName() or "MarkSweep" in x.getName())
    monkeypatch.setattr(storage, "HEAP_SHARE", 0.0)
    monkeypatch.setitem(storage._HEAP_LEFT, app, -(1 << 50))
    before = full()
    assert storage.cut(spark.range(10)).count() == 10
    assert full() > before
    assert storage._HEAP_LEFT[app] > 0
    # A heap that has not grown since is left alone.
    monkeypatch.setitem(storage._HEAP_LEFT, app, 1 << 50)
    before = full()
    assert not storage.shrink(spark)
    assert full() == before


def test_few_links_are_united_on_the_driver_without_a_table(spark, monkeypatch):
    from planloom.operators import graph

    def none(df):
        raise AssertionError("no intermediate table is needed")

    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 2), (5, 5), (None, 7), (8, 9)], "u long, v long")
    monkeypatch.setattr(graph, "cut", none)
    found = {(r.u, r.root) for r in graph.connected_components(edges, driver_edges=7).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
