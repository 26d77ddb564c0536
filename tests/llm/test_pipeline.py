"""Every stage against a brute-force version on its own input."""

import hashlib
import os

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from voxelake.llm import bpe, langid, mixing, secret_scan
from voxelake.llm.queries import llm_catalogue

from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append({r.doc_id: r for r in docs.collect()} if name != "tokenize" else docs.collect())
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "tokenize":
            assert docs.columns == columns
    language, dedup, secret, mix, tokens = inputs
    assert set(dedup) == {i for i, r in language.items() if r.text and any(map(str.isalpha, r.text))}
    told = {r.doc_id: r.lang_pred for r in langid.identify(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert all(r.lang == told[i] for i, r in dedup.items())
    roots = brute_components({i: brute_fingerprint(r.text) for i, r in dedup.items()})
    assert set(secret) == {i for i, root in roots.items() if i == root}
    assert set(mix) == set(secret)
    for i, r in mix.items():
        spans = secret_scan.base_spans(secret[i].text)
        assert all(secret[i].text[a:e] not in r.text for a, _, e in spans) and r.n_chars == len(r.text)
        assert spans or r.text == secret[i].text or "[SECRET]" in r.text
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.read.parquet(f"{tmp_path}/secrets")).collect()}
    seen = {}
    for r in tokens:
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {i: n for i, n in copies.items() if n}
    library, texts = Tokenizer.from_file(bpe.default_tokenizer()), {r.doc_id: r.text for r in tokens}
    for r in docs.collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_clean(spark):
    import os

    from voxelake.llm import common

    df = common.written(spark.range(3), "kept")
    folder = common._PATHS[-1].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(folder)
    common.clean(spark)
    assert not os.path.isdir(folder)


def test_a_run_leaves_only_the_tables_of_its_stages(spark, documents, prose, tmp_path):
    from voxelake.llm import common

    documents([(i, prose(i, 30), "en" if i % 2 else "de", "ab"[i % 2]) for i in range(20)]).write.parquet(f"{tmp_path}/documents.parquet")
    common.clean(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common._PATHS) == sorted(n for n, _ in corpus_pipeline.STAGES[:-1])
    assert out.count() > 0
    common.clean(spark)


def test_shared_folder_is_asked_for(spark):
    """Off a local master nothing is written to a folder of one machine."""
    from types import SimpleNamespace

    from voxelake.llm import common

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        common.shared_dir(cluster)


def test_one_query_per_operator():
    names = list(llm_catalogue())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


@pytest.mark.parametrize("name", [n for n, (_, sql) in llm_catalogue().items() if sql])
def test_oracles(spark, name):
    import duckdb

    f, sql = llm_catalogue()[name]
    connection = duckdb.connect()
    for t in ("pages", "conversations"):
        connection.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = f(spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    result = connection.execute(sql)
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=str)


def test_odd_rows_and_empty_tables(spark, documents, prose, tmp_path):
    rows = [(i, prose(i, 30), "en" if i % 2 else "de", "a") for i in range(20)]
    rows += [(100, None, "en", "a"), (101, "", None, None), (102, "1 2 3", "en", "a"), (103, prose(3, 30), None, None), (103, prose(3, 30), None, None), (None, prose(5, 40), "en", None), (None, None, None, None), (104, "secret: " + "x1" * 50_000, "en", "b")]
    for name, given in (("odd", rows), ("empty", [])):
        documents(given).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in out} <= {i for i, *_ in given} - {100, 101, 102}
        assert bool(out) == bool(given)
