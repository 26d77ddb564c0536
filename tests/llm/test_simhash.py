import numpy as np
import pytest
import re

import xxhash

from voxelake.llm import simhash as S


def brute_fingerprint(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, close=3):
    """Least id reachable, by id, over all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= close:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints(prose):
    texts = ["", " \t\n", "One", "one two", "ONE two\x0bthree", "É İ ſ K", "a\x1cb c\x85d\xa0e f", *(prose(i, n) for i, n in enumerate((5, 100, 3000, 70_000)))]
    for text in texts:
        assert S.fingerprint(text) == brute_fingerprint(text)


def test_every_close_pair_shares_a_bucket():
    for level in (1, 2, 3):
        rng = np.random.default_rng(level)
        masks = S.bucket_masks(level, 3)
        assert len(masks) == 20**level and {64 - m.bit_count() for m in masks} <= ({32, 31, 33} if level == 1 else set(range(19)))
        if level < 3:
            for _ in range(100):
                flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
                assert any(m & flips == 0 for m in masks)


def test_bucket_stars():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 12, 300).astype(np.int64)
    edges = S.bucket_stars(values, 2)
    want = brute_components({int(v): int(v) for v in values}, 2)
    assert all(want[a] == want[b] for a, b in edges) and len(edges) == sum(v != r for v, r in want.items())


@pytest.mark.parametrize("hot", [1024, 8])
def test_near_duplicates(spark, documents, prose, hot):
    base = prose(0, 300).split()
    rows = [(i, prose(i, 60), "en", "a") for i in range(1, 40)]
    rows += [(100 + i, " ".join([*base[: 7 * i], "edit", *base[7 * i :]]), "en", "a") for i in range(40)]
    rows += [(200 + i, " ".join(base), "en", "a") for i in range(30)]
    rows += [(300, None, None, None), (301, "", "en", "a"), (302, " \n", "en", "a"), (303, "word", "en", "a"), (5, prose(5, 60), "en", "a")]
    got = S.near_duplicates(documents(rows), hot=hot).collect()
    prints = {i: brute_fingerprint(t) for i, t, _, _ in rows}
    want = brute_components(prints)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{prints[i]:016x}", want[i]) for i in prints}


def test_chains_and_dense_groups(spark):
    """Fingerprints made by hand: a long chain, and one dense group that is split at all levels."""
    chain = [(1 << i) - 1 for i in range(0, 63, 3)]
    rng = np.random.default_rng(5)
    dense = sorted({0x7ABC_0000_0000_0000 | int(x) for x in rng.integers(0, 1 << 9, 300)})
    values = {i: v for i, v in enumerate([*chain, *dense])}
    df = spark.createDataFrame([(v,) for v in values.values()], "fp long")
    roots = {r.a: r.root for r in S.components(S.links(df, hot=16)).collect()}
    want = brute_components({v: v for v in values.values()})
    assert {v: roots.get(v, v) for v in values.values()} == want


def test_empty_and_null_ids(documents):
    assert S.near_duplicates(documents([])).collect() == []
    rows = [(None, "a b c", "en", "a"), (None, "a b c", "en", "a"), (3, "something else entirely", "en", "a")]
    got = S.near_duplicates(documents(rows)).collect()
    assert sorted(str(r.component_id) for r in got) == ["3", "None", "None"]
    assert S.deduplicate(documents([*rows, (9, "a b c", "en", "a"), (3, "something else entirely", "en", "a")])).count() == 3


def test_rows_stay_or_go_with_their_own_component(documents, prose):
    a, b, c, d = (prose(i, 40) for i in range(4))
    rows = [(1, a, "en", "a"), (2, b, "en", "a"), (2, a, "de", "a"), (3, c, "en", "a"), (3, c, "en", "a"), (None, d, "en", "a"), (None, d, "en", "a"), (None, d, "fr", None), (None, a, "en", "a"), (None, c, "en", "a"), (None, None, None, None), (None, "", "en", "a")]
    got = [(r.doc_id, r.text or "") for r in S.deduplicate(documents(rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (3, c), (3, c), (None, d), (None, "")], key=str)
    assert S.deduplicate(documents(rows)).columns == documents(rows).columns and S.deduplicate(documents([])).count() == 0


def test_null_ids_do_not_keep_each_other(documents, prose):
    rows = [(None, prose(1, 40), "en", "a"), *((None, prose(2, 40), "en", "a") for _ in range(5)), (7, prose(2, 40), "en", "a")]
    assert sorted((r.doc_id or 0, r.text) for r in S.deduplicate(documents(rows)).collect()) == [(0, prose(1, 40)), (7, prose(2, 40))]


def test_hot_keys(spark, documents, prose, monkeypatch):
    """Copies, and the centre of their star, over the bound of hot keys give what they give below it."""
    from voxelake.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    base = prose(0, 300).split()
    rows = [(i, prose(1, 60), "en", "a") for i in range(60)] + [(100 + i, " ".join([*base[: 7 * i], "edit", *base[7 * i :]]), "en", "a") for i in range(40)] + [(None, None, None, None)] * 9
    got = S.near_duplicates(documents(rows), hot=8).collect()
    prints = {i: brute_fingerprint(t) for i, t, _, _ in rows if i is not None}
    want = {(i, f"{prints[i]:016x}", root) for i, root in brute_components(prints).items()} | {(None, "0" * 16, None)}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == want and len(got) == len(rows)


def test_join_facts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from voxelake.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 3 + [3] + [None] * 20 + [4])], "k long, i long")
    facts = spark.createDataFrame([(1, 50, "hot"), (2, 3, "cold"), (3, 1, None), (9, 0, "none")], "k long, n long, fact string")
    out = common.join_facts(rows, facts, ["k"], "n", F.col("i"))
    assert out.columns == ["k", "i", "fact"]
    of = {1: "hot", 2: "cold"}
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((r.k, r.i, of.get(r.k)) for r in rows.collect()), key=str)


def test_registered_query(spark):
    """The registered query over its whole table against fingerprints bit by bit and all pairs."""
    from voxelake.llm.queries import op2_simhash

    sf_dir = "/root/testdata/sf0.001"
    prints = {r.doc_id: brute_fingerprint(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute_components(prints)
    assert sorted(map(tuple, op2_simhash(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect())) == sorted((i, f"{p:016x}", want[i]) for i, p in prints.items())
