import numpy as np
import pytest

from curbline.llm import embeddings
from curbline.llm.embeddings import forest, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, kept string"


def brute(rows, cosine=0.95):
    ids, vectors = [], []
    alone = []
    for i, v in rows:
        x = np.array([np.nan if c is None else c for c in v], float) if v is not None else np.zeros(0)
        if len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            ids.append(i)
            vectors.append(x / np.linalg.norm(x))
        else:
            alone.append(i)
    x = np.array(vectors)
    link = x @ x.T >= cosine
    np.fill_diagonal(link, False)
    group = np.array(ids)
    while True:
        new = np.minimum(group, np.where(link, group[None, :], 1 << 60).min(axis=1))
        if (new == group).all():
            break
        group = new
    out = {i: (int(n), int(g), bool(i == g)) for i, n, g in zip(ids, link.sum(axis=1), group, strict=True)}
    return out | {i: (0, i, True) for i in alone}


def run(frame, rows, **more):
    out = near_duplicates(frame([(i, v, "x") for i, v in rows], SCHEMA), **more).collect()
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}


def clusters(seed, n=700, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, width))
    x = centres[rng.integers(0, 25, n)] + rng.normal(scale=0.25, size=(n, width))
    x[: n // 3] = centres[0] + rng.normal(scale=0.02, size=(n // 3, width))
    x[n // 3 : n // 2] = centres[1]
    return [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(rng.permutation(n), x, strict=True)]


@pytest.mark.parametrize("cell, block", [(2048, 2048), (40, 2048), (40, 16)])
def test_links_and_components_equal_brute_force(frame, monkeypatch, cell, block):
    monkeypatch.setattr(embeddings, "CELL_ROWS", cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = clusters(cell + block)
    assert run(frame, rows) == brute(rows)


def test_shorter_reach_only_loses_links(frame, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_ROWS", 40)
    rows = clusters(5)
    want, got = brute(rows), run(frame, rows, reach=0.1)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(v[0] for v in got.values()) >= 0.9 * sum(v[0] for v in want.values())


def test_edge_rows(frame):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]),
            (8, [inf, 1.0]), (9, [1.0]), (10, [1e38, 1e-30]), (11, [1e-38, 0.0]), (12, [0.0, 1.0])]
    out = run(frame, rows)
    for i in (1, 2, 9, 10, 11):
        assert out[i] == (4, 1, i == 1)
    for i in (3, 4, 5, 6, 7, 8, 12):
        assert out[i] == (0, i, True)
    both = near_duplicates(frame([(1, [1.0], ""), (1, [1.0], ""), (None, [1.0], "")], SCHEMA)).collect()
    assert sorted(((r.vec_id or 0), r.n_links, r.kept) for r in both) == [(0, 0, True), (1, 2, True), (1, 2, True)]
    assert near_duplicates(frame([], SCHEMA)).count() == 0


def test_forest_connects_what_the_pairs_connect():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (5, 3), (50, 60), (200, 5000)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        kept = forest(a, b, n)

        def groups(x, y):
            label = np.arange(n)
            for _ in range(n):
                for i, j in zip(x, y, strict=True):
                    label[i] = label[j] = min(label[i], label[j])
            return label.tolist()

        if m < 100:
            assert groups(a, b) == groups(a[kept], b[kept])
        assert len(kept) <= max(n - 1, 0)


def test_structureless_vectors_are_stored_twice_at_most(spark, frame, monkeypatch):
    """Vectors that lie near the borders of most cells cost products, not disk: none is copied per cell."""
    rng, taken = np.random.default_rng(8), []
    x = rng.normal(size=(600, 64)).astype(np.float32)
    x[:60] = x[100:160] + rng.normal(scale=0.02, size=(60, 64))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]

    def counted(df, keep=embeddings.stored):
        out = keep(df)
        binary = [c for c, kind in out.dtypes if kind == "binary"]
        if binary:
            taken.append(out.selectExpr(f"coalesce(sum({' + '.join(f'octet_length({c})' for c in binary)}), 0)").first()[0])
        return out

    monkeypatch.setattr(embeddings, "CELL_ROWS", 20)
    monkeypatch.setattr(embeddings, "stored", counted)
    assert run(frame, rows) == brute(rows)
    assert sum(taken) <= 2.5 * x.nbytes


def test_cosines_within_single_precision_of_the_bound(frame, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_ROWS", 20)
    rng = np.random.default_rng(2)
    turns = np.arccos(0.95 + rng.uniform(-1e-6, 1e-6, 60))
    angles = np.cumsum(np.concatenate([[0.1], turns]))  # neighbours are at the bound, all others apart or beyond a turn
    vectors = [[float(np.cos(t)), float(np.sin(t)), float(k // 15)] for k, t in enumerate(angles)]
    rows = list(enumerate(vectors))
    out = near_duplicates(frame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == brute(rows)


def test_spanning_connects_rows_and_columns():
    rng = np.random.default_rng(6)
    for n, m, share in ((1, 1, 1.0), (40, 30, 0.02), (60, 80, 0.5), (50, 50, 1.0)):
        hit = rng.random((n, m)) < share
        hit[: n // 2, m // 2 :] = hit[n // 2 :, : m // 2] = False
        a, b = embeddings.spanning(hit)
        assert hit[a, b].all() and len(a) < n + m

        def groups(x, y):
            label = np.arange(n + m)
            for _ in range(n + m):
                before = label.copy()
                for i, j in zip(x, n + y, strict=True):
                    label[i] = label[j] = min(label[i], label[j])
                if (before == label).all():
                    break
            return label.tolist()

        assert groups(a, b) == groups(*np.nonzero(hit))
