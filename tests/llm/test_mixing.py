import math
import re

from pyspark.sql import functions as F

from voxelake.llm import mixing as M


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water_fill(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: capped.get(s, left * weight[s] / free if free else 0.0) for s in names}
        over = [s for s in names if s not in capped and target[s] > cap * sizes[s] + 1e-9]
        if not over:
            return target
        capped |= {s: cap * sizes[s] for s in over}


def check(rows, df, **options):
    got = M.mix(df, **options).collect()
    sizes, of = {}, {}
    for i, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
        of[i] = (words(t), s)
    want = water_fill(sizes)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, *_ in rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        size, s = of[r.doc_id]
        assert r.size == size and r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * size and r.taken == size * r.copies and 0 <= r.copies <= 2
        taken[s] += r.taken
    return want, taken, got


def test_targets_are_met(documents, prose):
    rows = [(100 * j + i, prose(100 * j + i, 1 + (i * 37) % 200), "en", s) for j, s in enumerate(["b", "a", "é", "z", "Z", None]) for i in range(30 + 40 * (j == 0))]
    rows += [(9000, None, "en", "a"), (9001, "", "en", "a"), (9002, " \t\x0b\n", "en", "a"), (9003, prose(1, 20_000), "en", "b"), (None, "null id", "en", "z")]
    want, taken, got = check(rows, documents(rows))
    for s in want:
        assert abs(taken[s] - want[s]) <= max(10, 0.02 * want[s]), s
    assert sorted(map(str, got)) == sorted(map(str, M.mix(documents(rows[::-1])).collect()))


def dual_by_bisection(cells, target, cap=2.0):
    low, high = -200.0, math.log(cap) / min(t for t, w in cells if w)
    for _ in range(200):
        at = (low + high) / 2
        low, high = (at, high) if sum(w * min(cap, math.exp(at * t)) for t, w in cells) < target else (low, at)
    return high


def test_newton_solves_the_dual(spark):
    """Tilted, capped rates meet every source's target before rounding, with the variable that bisection finds."""
    of = {"a": [(0.5, 1000), (1.0, 2000), (2.0, 500)], None: [(0.25, 7), (0.9, 100_000)], "empty": [(1.0, 0)]}
    cells = spark.createDataFrame([(s, t, w) for s, c in of.items() for t, w in c], "__source string, __tilt double, __mass long")
    for part in (0.001, 0.3, 1.0, 1.6, 1.999, 2.0):
        target = {s: part * sum(w for _, w in c) for s, c in of.items()}
        df = spark.createDataFrame([(s, t) for s, t in target.items()], "__source string, target double")
        found = {r[0]: r[1] for r in M.balance(cells, df, 2.0).collect()}
        assert set(found) == set(of)
        for s, c in of.items():
            assert math.isclose(sum(w * min(2.0, math.exp(found[s] * t)) for t, w in c), target[s], rel_tol=1e-6)
            if target[s] and part < 2:
                assert math.isclose(found[s], dual_by_bisection(c, target[s]), rel_tol=1e-6, abs_tol=1e-9)


def test_registered_query(spark):
    """The registered query over its whole table: targets by repeated resharing, rates by bisection, sizes by a search."""
    from voxelake.llm.queries import op8_mixing

    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, None, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got, sizes, cells = op8_mixing(spark, sf_dir).collect(), {}, {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
        tilt = 8 / (8 + words(t).bit_length())
        cells.setdefault(s, {})[tilt] = cells.setdefault(s, {}).get(tilt, 0) + words(t)
    want, of = water_fill(sizes), {i: (words(t), s) for i, t, _, s in rows}
    assert sorted(r.doc_id for r in got) == sorted(of)
    taken, rates = dict.fromkeys(sizes, 0), {}
    for r in got:
        size, s = of[r.doc_id]
        dual = dual_by_bisection(list(cells[s].items()), want[s])
        assert r.size == size and r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9)
        assert math.isclose(r.rate, min(2.0, math.exp(dual * 8 / (8 + size.bit_length()))), rel_tol=1e-5)
        assert r.taken == r.copies * size <= 2 * size
        taken[s] += r.taken
        rates.setdefault(s, set()).add(round(r.rate, 6))
    for s in want:
        assert abs(taken[s] - want[s]) <= max(20, 0.02 * want[s]), s
        # documents of a source that is not capped differ in their rates
        assert len(rates[s]) > 1 or want[s] >= 2 * sizes[s] - 1e-6


def test_tilt_prefers_documents(documents, prose):
    rows = [(i, prose(i, 100), "en", "a") for i in range(400)]
    got = M.mix(documents(rows), tilt=F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(0.5)).collect()
    even, odd = (sum(r.taken for r in got if r.doc_id % 2 == k) for k in (0, 1))
    assert even > odd and abs(even + odd - 60_000) <= 200


def test_many_repeats(documents, prose, monkeypatch):
    monkeypatch.setattr(M, "REPEATS", 7)
    got = M.mix(documents([(7, prose(3, 50), "en", "a")] * 50 + [(8, prose(4, 50), "en", "b")] * 14)).collect()
    assert sorted(r.doc_id for r in got) == [7] * 50 + [8] * 14 and {r.nth for r in got if hasattr(r, "nth")} == set()


def test_repeats_empty_and_zero(documents, prose):
    rows = [(7, prose(3, 50), "en", "a")] * 30 + [(8, prose(4, 50), "en", "b")]
    got = M.mix(documents(rows)).collect()
    assert len(got) == 31 and len({r.copies for r in got if r.doc_id == 7}) == 1
    assert M.mix(documents([])).collect() == []
    assert [r.taken for r in M.mix(documents([(1, "", "en", "a"), (2, None, None, None)])).collect()] == [0, 0]


def test_apply(documents, prose):
    rows = [(i, prose(i, 40), "en", "ab"[i % 2]) for i in range(60)] + [(99, prose(9, 40), "en", None), (None, prose(9, 30), "en", None)]
    df = documents(rows)
    copies = {r.doc_id: r.copies for r in M.mix(df).collect()}
    out = M.apply_mix(df)
    assert out.columns == df.columns
    seen = {}
    for r in out.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {i: n for i, n in copies.items() if n}
