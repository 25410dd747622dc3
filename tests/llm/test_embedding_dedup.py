import numpy as np
import pytest
from siftline.llm import embedding_dedup as ed


def brute(rows, cosine=0.9):
    unit = []
    for _, v in rows:
        x = None if v is None or None in v else np.array(v, np.float64)
        ok = x is not None and len(x) and np.isfinite(x).all() and np.abs(x).max() > 0
        unit.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if ok else None)
    n = len(rows)
    link = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    out, seen = {}, set()
    for i in range(n):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for j in link[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        for j in group:
            out[j] = (rows[j][0], len(link[j]), min(rows[x][0] for x in group), rows[j][0] == min(rows[x][0] for x in group))
    return sorted(out.values())


def vectors(dims=16):
    rng = np.random.default_rng(5)
    rows = []
    for spread, many in ((0.0, 5), (0.1, 20), (0.35, 40), (0.5, 60)):
        for _ in range(3):
            c = rng.normal(size=dims)
            rows += [(c / np.linalg.norm(c) + spread * rng.normal(size=dims) / np.sqrt(dims)) * rng.uniform(0.1, 9) for _ in range(many)]
    rows += [rows[3]] * 30 + list(rng.normal(size=(60, dims)))
    rows = [r.astype(np.float32).tolist() for r in rows]
    rows += [None, [], [0.0] * dims, [1.0] * (dims - 1), [1.0] * (dims - 1), [float("nan")] + [1.0] * (dims - 1), [float("inf")] * dims, [None] + [1.0] * (dims - 1), [1e30] * dims, [1e-30] * dims]
    return [(500 - i, v) for i, v in enumerate(rows)]


@pytest.mark.parametrize(("grid", "rows", "each"), [(1, 6000, 4), (2, 7, 4), (3, 6000, 16)])
def test_matches_brute_force(spark, monkeypatch, grid, rows, each):
    monkeypatch.setattr(ed, "grid_dims", lambda n: grid)
    monkeypatch.setattr(ed, "CELL_ROWS", rows)
    data = vectors()
    got = ed.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>"), block_dims=each).collect()
    assert sorted(map(tuple, got)) == brute(data)


def test_pairs_at_the_threshold_over_several_blocks(spark):
    """64 dimensions, so 4 blocks as in the query: pairs just above and just below the cosine, and pairs that differ in one axis only."""
    rng, data = np.random.default_rng(2), []
    for k in range(60):
        a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        c = 0.9 + (1e-9 if k % 2 else -1e-9)
        data += [(10 * k, a), (10 * k + 1, c * a + np.sqrt(1 - c * c) * b)]
    for k in range(64):
        a = rng.normal(size=64)
        b = a / np.linalg.norm(a)
        b[k] += 0.4
        data += [(1000 + 10 * k, a), (1001 + 10 * k, b)]
    data = [(i, v.tolist()) for i, v in data]
    assert len(ed.block_bounds(64, ed.BLOCK_DIMS)) == 4
    got = ed.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == brute(data) and sum(r.n_links for r in got if r.vec_id < 1000) == 60


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ed.near_vectors(df).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>").selectExpr("*", "1 AS row_id", "2 AS n_links", "3 AS component_id")
    got = ed.near_vectors(df).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in got) == [(0, 0), (1, 1), (1, 1)]
