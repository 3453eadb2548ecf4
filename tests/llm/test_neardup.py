import math

import numpy as np
import pytest

from ledgerline.llm import neardup as N


def brute(rows):
    n = len(rows)
    x = [None if v is None or label is None or not v or any(c is None or not math.isfinite(c) for c in v) or not any(v) else np.array(v, dtype=float) for _, v, label in rows]
    links, parent = [0] * n, list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                if x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(n)]


def made(seed, n, copies):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        base = rng.standard_normal(16)
        for _ in range(copies[k % len(copies)]):
            rows.append((len(rows), [float(np.float32(v)) for v in base + rng.standard_normal(16) * 0.03], int(k % 3)))
    return rows


@pytest.mark.parametrize("chunk", [1024, 5])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(N, "CHUNK", chunk)
    monkeypatch.setattr(N, "GROWTH", chunk)
    monkeypatch.setattr(N, "FEW", 16 if chunk > 5 else 3)
    monkeypatch.setattr(N, "STEP", 200)
    rows = made(1, 60, [1, 2, 40, 3])
    base = rows[5][1]
    odd = [base, base, [2 * v for v in base], None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + base[1:], [None] + base[1:], base[:8], [-v for v in base]]
    for v in odd:
        rows.append((len(rows), v, rows[5][2]))
    rows += [(len(rows), base, None), (len(rows) + 1, base, 99)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, times int")
    got = {r.vec_id: r for r in N.groups(df).collect()}
    links, component = brute(rows)
    assert len(got) == len(rows)
    assert [got[i].component_id for i in range(len(rows))] == component
    assert sum(got[i].n_links for i in range(len(rows))) >= 0.98 * sum(links)
    assert all(got[i].n_links <= links[i] for i in range(len(rows)))
    assert all(got[i].kept == (component[i] == i) for i in range(len(rows)))
    assert N.groups(df.limit(0)).count() == 0


def test_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None, r.label) for r in df.orderBy("vec_id").collect()]
    links, component = brute(rows)
    got = {r.vec_id: r for r in N.groups(df).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(links)
    assert np.mean([got[r[0]].component_id == rows[component[i]][0] for i, r in enumerate(rows)]) >= 0.99


def test_calibration():
    for rows in (10, 5_000, 10**9):
        plan = N.calibrate(rows)
        assert N.passing(plan, 0.98) >= 0.99 and N.passing(plan, 0.99) > 0.999 and plan.count == 2
    rng = np.random.default_rng(3)
    plan, hits = N.calibrate(5000), 0
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((400, 64))
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    (cx, px), (cy, py) = N.projected(plan, x), N.projected(plan, y)
    hits = ((cx == cy) & (np.abs(px - py) <= N.WINDOW * plan.distance)).sum(axis=1)
    assert (hits >= plan.count).mean() >= 0.97


def test_repeated_and_null_ids(spark):
    v = [1.0, 2.0]
    df = spark.createDataFrame([(3, v, 1), (3, v, 1), (None, v, 1), (None, [5.0, -1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in N.groups(df).collect()), key=repr)
    assert got == [(0, 0, None, True), (0, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True)]


def test_recall_by_cosine_band(spark):
    """Pairs of different vectors, found link by link against brute force, most of all those just above the threshold."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("label IS NOT NULL AND embedding IS NOT NULL")
    rows = {}
    for r in df.orderBy("vec_id").collect():
        rows.setdefault((r.label, tuple(r.embedding)), r.vec_id)
    base = np.array([e for (_, e) in rows], dtype=float)[:400]
    rng = np.random.default_rng(8)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal(base.shape)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = np.repeat([0.979, 0.9805, 0.983, 0.99], 100)[:, None]
    other = cosine * base + np.sqrt(1 - cosine**2) * other
    filler = rng.standard_normal((6000, base.shape[1]))
    vectors = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, other, filler]))]
    got = {r.vec_id: r.n_links for r in N.groups(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")).where("vec_id < 800").collect()}
    unit = np.concatenate([base, other])
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    found = np.array([got[i] for i in range(800)])
    assert (found <= want).all()
    for k, least in ((1, 0.95), (2, 0.97), (3, 0.99)):
        band = np.r_[k * 100 : k * 100 + 100, 400 + k * 100 : 500 + k * 100]
        assert found[band].sum() >= least * want[band].sum() > 0, k
