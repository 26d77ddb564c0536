import numpy as np

from voxelake.llm import ann_forest as A


def table(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "v": F.lit(2), "dim": F.lit(3), "score": F.lit(4)})


def brute(rows, every=20, k=20):
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in usable:
        if q % every == 0:
            scored = sorted(((-float(x @ y), i) for i, y in usable if i != q and len(y) == len(x)))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_small_tables_are_found_whole(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(8)], 0) for i in range(60)]
    same = [1.0] * 8
    rows += [(1000 + i, same, 0) for i in range(40)]
    rows += [(5000, None, 0), (5020, [0.0] * 8, 0), (5040, [float("nan")] + same[1:], 0), (5060, [None] + same[1:], 0), (5080, [], 0), (None, same, 0), (6000, [1.0, 2.0], 0), (6001, [2.0, 1.0], 0)]
    got, want = found(A.search(table(spark, rows))), brute(rows)
    assert set(got) == {q for q, w in want.items() if w}
    for q, w in want.items():
        assert [s for _, s in got[q]] == [s for _, s in w] or np.allclose([s for _, s in got[q]], [s for _, s in w], rtol=1e-12)
    # ties of copies go to the smaller id
    assert [i for i, _ in got[1000]] == [1001 + i for i in range(20)]


def test_recall_and_exact_scores():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((8192, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(len(x))
    forest, hits, share, enough = A.Forest(x), [], [], A.enough_of(len(x), 20)
    q = x[:200]
    for (_, got, score), c in zip(forest.nearest(q, ids[:200], ids, 20, enough), forest.candidates(q, enough), strict=True):
        i = len(hits)
        exact = x @ q[i]
        exact[i] = -9
        hits.append(len(set(got) & set(np.argsort(-exact)[:20])) / 20)
        share.append(len(c) / len(x))
        assert np.allclose(score, exact[got], rtol=1e-12)
    assert np.mean(hits) >= 0.9 and np.mean(share) < 0.25


def test_unequal_lengths_and_copies():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.5, 1.5, 3000)[:, None]
    x = np.vstack([x, np.repeat(x[:1], 500, 0)])
    ids = np.arange(len(x))
    hits = []
    for i, (_, got, _) in enumerate(A.Forest(x).nearest(x[:50], ids[:50], ids, 20, A.enough_of(len(x), 20))):
        exact = x @ x[i]
        exact[i] = -np.inf
        hits.append(len(set(got) & set(np.lexsort((ids, -exact))[:20])) / 20)
    assert np.mean(hits) >= 0.9


def test_empty(spark):
    assert A.search(table(spark, [])).collect() == []
    assert A.search(table(spark, [(20, [1.0], 0)])).collect() == []


def test_own_rows_do_not_end_the_ascent():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    # forty copies of the first row, and forty near it, are its own
    x = np.vstack([x, np.repeat(x[:1], 40, 0), x[:1] + 1e-3 * rng.standard_normal((40, 16))])
    ids = np.r_[np.arange(3000), np.zeros(80, int)]
    ((query, got, _), (_, other, _)) = A.Forest(x).nearest(x[[0, 7]], ids[[0, 7]], ids, 20, A.enough_of(len(x), 20))
    want = np.argsort(-(x[:3000] @ x[0]), kind="stable")[1:21]
    assert len(got) == len(other) == 20 and set(query) == {0} and 0 not in got and len(set(got) & set(want)) >= 18


def test_repeated_rows_are_one_row_of_a_block(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(8)], 0) for i in range(2000)]
    near = brute(rows)[40][0][0]
    rows += [rows[20]] * 1000 + [rows[33]] * 3 + [rows[near]] * 50
    tables, write = {}, A.written
    monkeypatch.setattr(A, "written", lambda df, label: tables.setdefault(label, write(df, label)))
    got, want = found(A.search(table(spark, rows))), brute(rows)
    assert tables["vectors"].count() == 2000 and set(got) == set(want) and all(len(g) == 20 for g in got.values())
    hits = [sum(min([i for i, _ in got[q]].count(i), [i for i, _ in w].count(i)) for i in {i for i, _ in w}) / 20 for q, w in want.items()]
    assert np.mean(hits) >= 0.9 and np.allclose([s for _, s in got[20]][:1], [s for _, s in want[20]][:1], rtol=1e-6)
    # each repeat is a candidate of its own
    assert max([i for i, _ in g].count(33) for g in got.values()) == 4 and [i for i, _ in got[40]] == [near] * 20


def test_scores_do_not_depend_on_their_company():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 64))
    ids, q = np.arange(400), rng.standard_normal((1, 64))
    alone = {}
    for i in range(0, 400, 7):
        ((_, (got,), (score,)),) = A.Forest(x[[i]]).nearest(q, np.array([-1]), ids[[i]], 1, 1)
        alone[got] = score
    ((_, got, score),) = A.Forest(x).nearest(q, np.array([-1]), ids, 400, 400)
    together = dict(zip(got.tolist(), score.tolist(), strict=True))
    for i, s in alone.items():
        in_order = 0.0
        for a, b in zip(x[i].tolist(), q[0].tolist(), strict=True):
            in_order += a * b
        assert together[i] == s == in_order


def test_blocks_agree_on_ties(spark, monkeypatch):
    """Copies of one vector that lie in different blocks tie, and go by their ids."""
    monkeypatch.setattr(A, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(6)
    same, q = ([float(x) for x in rng.standard_normal(64)] for _ in range(2))
    rows = [(1000 + 1000 * i + 1, same, 0) for i in range(300)] + [(20, q, 0)]
    got = found(A.search(table(spark, rows)))
    assert [i for i, _ in got[20]] == [1001 + 1000 * i for i in range(20)] and len({s for _, s in got[20]}) == 1


def test_strings_are_long_and_prefixes_nest():
    hashes = A.Hashes(65, 2)
    assert len(hashes.bits) == A.SYMBOLS and sum(hashes.bits) <= 63 and hashes.shifts[-1] == 0
    x = np.random.default_rng(7).standard_normal((50, 65)).astype(np.float32)
    a = hashes.strings(x, 1)
    assert (a == hashes.strings(x[:, :] * 2, 1)).all() and (a != hashes.strings(x, 0)).any() and (a >= 0).all()


def test_registered_query(spark):
    """The registered query against brute force over its whole table: recall, exact scores, ranks and the share searched."""
    from voxelake.llm.queries import op3_ann_forest

    for scale, least in (("sf0.001", 0.9), ("sf0.1", 0.9)):
        sf_dir = f"/root/testdata/{scale}"
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
        ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        got, hits = found(op3_ann_forest(spark, sf_dir)), []
        assert set(got) == {int(i) for i in ids if i % 20 == 0}
        for q, pairs in got.items():
            exact = x @ x[ids == q][0]
            order = [int(ids[i]) for i in np.lexsort((ids, -exact)) if ids[i] != q][:20]
            hits.append(len({i for i, _ in pairs} & set(order)) / 20)
            assert len(pairs) == 20 and pairs == sorted(pairs, key=lambda p: (-p[1], p[0]))
            assert np.allclose([s for _, s in pairs], [exact[ids == i][0] for i, _ in pairs], rtol=1e-12)
        assert np.mean(hits) >= least
    forest = A.Forest(x)
    shares = [len(c) / len(x) for c in forest.candidates(x[ids % 20 == 0], A.enough_of(len(x), 20))]
    assert np.mean(shares) < 0.3
