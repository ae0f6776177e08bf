import numpy as np
import pytest

from rolefit.operators import nearest as N


def table(spark, rows, key):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{key} long, embedding array<float>")


def brute(queries, jobs, k):
    def unit(v):
        v = np.asarray(v, np.float32).astype(np.float64)
        n = np.sqrt((v * v).sum())
        return v / n if n else v

    out = set()
    for q, qv in queries:
        if qv is None:
            continue
        scored = sorted((-round(max(float(unit(qv) @ unit(v)), 0.0) * 100, 2), j) for j, v in jobs if v is not None)
        out |= {(q, j, -s, r + 1) for r, (s, j) in enumerate(scored[:k])}
    return out


def some(seed, n, groups=6, width=8):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(groups, width))
    return [(i, centres[g.integers(groups)] + 0.3 * g.normal(size=width)) for i in range(n)]


@pytest.mark.parametrize("block, chunk", [(8192, 4096), (7, 3)])
def test_exact_search_equals_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    monkeypatch.setattr(N, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(N, "CELLS", 8)
    jobs = some(1, 120) + [(1000 + i, np.ones(8)) for i in range(30)] + [(2000, np.zeros(8)), (2001, None)]
    queries = some(2, 20) + [(500, np.ones(8)), (501, np.zeros(8)), (502, None), (503, -np.ones(8))]
    got = N.top_matches(table(spark, queries, "resume_id"), table(spark, jobs, "job_id"), 5).collect()
    want = brute(queries, jobs, 5)
    assert {(r.resume_id, r.job_id, round(r.match_score, 2) + 0.0, r.rank) for r in got} == {(a, b, c + 0.0, d) for a, b, c, d in want}


def test_near_cells_alone_find_nine_in_ten(spark):
    jobs, queries = some(3, 600, groups=20), some(3, 40, groups=20)
    near = {(r.resume_id, r.job_id) for r in N.top_matches(table(spark, queries, "resume_id"), table(spark, jobs, "job_id"), 5, exact=False).collect()}
    want = {(a, b) for a, b, _, _ in brute(queries, jobs, 5)}
    assert len(near & want) >= 0.9 * len(want)


def test_few_and_no_jobs(spark):
    queries = table(spark, some(4, 3), "resume_id")
    assert N.top_matches(queries, table(spark, [], "job_id"), 3).count() == 0
    assert N.top_matches(queries, table(spark, some(4, 2), "job_id"), 3).count() == 6
