import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from voxelake.llm import bpe as B

PATH = B.default_tokenizer()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return B.PairIndexTokenizer(PATH)


ALPHABET = list("aAbeht1 '\n\t\r\x1c\x1f\x85\xa0 　sé9²½<|>!?_ 中😀\x00é'dllve") + ["<|endoftext|>", " \u200b", "  ", "the", " and", "aaaa"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=25))
def test_equals_the_library(library, own, parts):
    text = "".join(parts)
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode_batch([text]) == [want]
    assert own.decode(want) == library.decode(want, skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_decodes_any_ids(library, own, ids):
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_words_and_cache(library, own, prose, monkeypatch):
    monkeypatch.setattr(B, "CACHE_PIECES", 50)
    texts = ["a" * 5000, "ab" * 3000, "".join(random.Random(1).choices("abcdeé", k=20_000)), *(prose(i, 300) for i in range(20)), "", " "]
    for _ in range(2):
        assert own.encode_batch(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert own.encode_batch(texts[::-1])[::-1] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_round_trip(documents, library, prose, monkeypatch):
    rows = [(i, prose(i, 1 + 50 * i), "en", "a") for i in range(30)] + [(100, None, None, None), (101, "", "en", "a"), (102, "x<|endoftext|> y", "en", "a"), (102, "x<|endoftext|> y", "en", "a"), (None, "  two  spaces\n", None, None), (103, "word " * 300_000, "en", "a")]
    got = B.round_trip(documents(rows)).collect()
    texts = {i: t or "" for i, t, _, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert B.round_trip(documents([])).collect() == []


def test_columns(documents, library):
    df = documents([(1, "hello there", "en", "a"), (2, None, None, None)])
    ids = {r.doc_id: r.ids for r in B.encode(df).collect()}
    assert ids == {1: library.encode("hello there").ids, 2: []}
    assert {r.doc_id: r.text for r in B.decode(B.encode(df)).collect()} == {1: "hello there", 2: ""}


def test_files_of_other_kinds_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    B.check_kind(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": spec["model"] | {"type": "Unigram"}}, {"model": spec["model"] | {"ignore_merges": True}}):
        (tmp_path / "x.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            B.PairIndexTokenizer(str(tmp_path / "x.json"))


def test_registered_query(spark, library):
    """The registered query over its whole table against the library."""
    from voxelake.llm.queries import op10_bpe

    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op10_bpe(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        ids = library.encode(texts[i], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
