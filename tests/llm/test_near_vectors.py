"""Near vectors against all pairs in double precision."""

import duckdb
import numpy as np
import pytest

from filingloom.llm import near_vectors as V


def brute(rows, threshold=0.98):
    """(vec_id, n_links, component_id, kept) of [(vec_id, vector, label)], sorted."""
    able = [k for k, (i, v, g) in enumerate(rows) if i is not None and v and g is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {k: set() for k in range(len(rows))}
    for p in able:
        for q in able:
            if p != q and rows[p][2] == rows[q][2] and len(rows[p][1]) == len(rows[q][1]):
                a, b = (np.array(rows[k][1], float) for k in (p, q))
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    near[p].add(q)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for q in near[todo.pop()] - seen:
                seen.add(q)
                todo.append(q)
        least = min((rows[q][0] for q in seen), default=None) if i is not None else None
        out.append((i, len(near[k]), least, i is not None and least == i))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in df.collect()), key=str)


def hard_rows(dim, rng):
    centres = rng.standard_normal((6, dim))
    rows = []
    for k in range(150):
        v = centres[k % 6] + rng.standard_normal(dim) * rng.choice([0.02, 0.1, 0.14, 0.3])
        rows.append((k, v.astype(np.float32).tolist(), int(k % 2)))
    rows += [(1000 + k, rows[3][1], 1) for k in range(40)]  # copies
    rows += [(2000 + k, [2.0**k * x for x in rows[4][1]], 0) for k in range(5)]  # same direction
    bad = [None, [], [0.0] * dim, [float("nan")] * dim, [1.0] * (dim - 1) + [None], [float("inf")] + [0.0] * (dim - 1)]
    rows += [(3000 + k, v, 1) for k, v in enumerate(bad)]
    rows += [(4000, rows[3][1], None), (None, rows[3][1], 1), (3, rows[3][1], 1), (5, rows[0][1], 0)]
    rows += [(5000, rows[3][1] + [0.0], 1), (5001, [-0.0 if x == 0 else x for x in [0.0, *rows[3][1][1:]]], 1), (5002, [0.0, *rows[3][1][1:]], 1)]
    return rows


@pytest.mark.parametrize(("dim", "kind"), [(2, "float"), (16, "float"), (70, "double")])
def test_against_brute_force(spark, dim, kind, monkeypatch):
    """Small slabs and tiles, so that pairs of slabs, pruned ones among them, and dense tiles all occur."""
    monkeypatch.setattr(V, "SLAB_BYTES", 10 * dim * 8)
    monkeypatch.setattr(V, "TILE", 7)
    rows = hard_rows(dim, np.random.default_rng(dim))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, digest string, node int").repartition(4)
    assert got(V.near_duplicates(df)) == brute(rows)


def test_huge_and_tiny_components(spark):
    rows = [(k, [s * x for x in (3.0, 4.0, 0.1)], 1) for k, s in enumerate((1e300, 1e-300, 1.0, -1e300))]
    assert got(V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))) == brute(rows)


def test_empty_table(spark):
    assert V.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_given_tables(spark):
    """Also the SQL; copies and near copies are added to the given vectors."""
    given = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    rng = np.random.default_rng(1)
    rows = given + [(10_000 + k, [float(x + e) for x, e in zip(v, rng.standard_normal(len(v)) * s, strict=True)], g) for k, ((_, v, g), s) in enumerate(zip(given[:150], rng.choice([0, 0.01, 0.025], 150), strict=True))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = got(V.near_duplicates(table))
    assert sum(r[1] for r in want) > 50
    con = duckdb.connect()
    arrow = table.toArrow()  # noqa: F841  read by name
    con.execute("CREATE VIEW embeddings AS SELECT * FROM arrow")
    assert sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({V.ORACLE})").fetchall(), key=str) == want


@pytest.mark.parametrize("dim", [3, 64, 2500])
def test_bounds_hold(dim):
    """The bound of a product is never under the product."""
    rng = np.random.default_rng(dim)
    u, v = (V.unit(rng.standard_normal((200, dim)) ** 3) for _ in "uv")
    (p, step_p, error_p), (q, step_q, error_q) = V.quantised(u), V.quantised(v)
    about = V._products(p, q) * step_p[:, None] * step_q[None]
    assert (np.abs(u @ v.T - about) <= error_p[:, None] + error_q[None] * (1 + error_p[:, None])).all()
    assert (V._products(p, q) == p.astype(np.int64) @ q.astype(np.int64).T).all()


def test_forest_joins_the_same_nodes():
    rng = np.random.default_rng(3)
    for n, m in ((5, 3), (50, 40), (50, 400), (300, 290)):
        a, b = rng.integers(0, n, (2, m))
        a, b = a[a != b], b[a != b]
        x, y = V.forest(a, b, n)

        def sets(a, b):
            name = list(range(n))
            for _ in range(n):
                for p, q in zip(a.tolist(), b.tolist(), strict=True):
                    name[p] = name[q] = min(name[p], name[q])
            return name

        assert sets(x, y) == sets(a, b)
        assert len(x) == n - len(set(sets(a, b)))
