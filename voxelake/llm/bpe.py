"""Byte-level BPE by a pair occurrence index.

All distinct pre-tokens of a window of rows that are not yet known are encoded together. An index maps the rank of each
mergeable pair to all positions where that pair stands, in whatever pre-token. Active ranks are taken in ascending
order from a heap; each one's positions are merged from left to right, and the pairs that a merge makes with its
neighbours join the lists of their own ranks, which are always later ones, as a merged symbol is younger than its
parts. Entries that an earlier merge made stale are recognised by their symbols and skipped.

What pieces between spaces encode to stays in a cache of about `CACHE_PIECES` entries in the worker process; a full
one is emptied, which changes no result. Long pieces are not kept. Texts are encoded whole, in windows of rows.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import sys
import types
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CACHE_PIECES = 500_000
CACHE_CHARS = 64
#: Characters encoded together: more share the work on each rank, fewer hold less memory.
WINDOW_CHARS = 4_000_000
#: A pair's key is its left id shifted by so many bits, and its right id.
PAIR_SHIFT = 24
# fixed value: the pre-token pattern of this family of tokenizers
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the rest from 256 up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def check_kind(spec: dict) -> None:
    """Raise for a tokenizer file that asks for anything but byte-level BPE with `PATTERN`."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += ["model type"] * (model.get("type", "BPE") != "BPE") + ["normalizer"] * (spec.get("normalizer") is not None)
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        odd.append("pre_tokenizer")
    if (spec.get("decoder") or {}).get("type", "ByteLevel") != "ByteLevel":
        odd.append("decoder")
    odd += [f"added token {t['content']!r}" for t in spec["added_tokens"] if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if odd:
        raise ValueError("no byte-level BPE of the known kind: " + ", ".join(odd))


class _PairIndex:
    """Positions of every mergeable pair, by rank, over linked lists of symbols; `run` applies all merges.

    Lists of up to `FEW` positions, and pairs of two equal symbols, whose occurrences overlap, are merged one by one
    from left to right; longer lists of other pairs at once, as their occurrences cannot share a symbol.
    """

    FEW = 12

    def __init__(self, model: PairIndexTokenizer, symbols: np.ndarray, after: np.ndarray, before: np.ndarray):
        self.model, self.symbols, self.after, self.before = model, symbols, after, before
        self.lists: dict[int, list] = {}
        at = np.flatnonzero(after >= 0)
        self.active: list[int] = []
        self.add_many(at, self.ranks_of(symbols[at], symbols[at + 1]))

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it is never merged."""
        keys, wanted = self.model.keys, left << PAIR_SHIFT | right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, self.model.ranks[at], -1)

    def add(self, position: int, rank: int) -> None:
        found = self.lists.get(rank)
        if found is None:
            self.lists[rank] = [position]
            heapq.heappush(self.active, rank)
        else:
            found.append(position)

    def add_many(self, positions: np.ndarray, ranks: np.ndarray) -> None:
        mergeable = ranks >= 0
        positions, ranks = positions[mergeable], ranks[mergeable]
        if len(ranks) == 0:
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        starts = [0, *cuts.tolist()]
        ends = [*starts[1:], len(ranks)]
        whole, names = positions.tolist(), ranks[starts].tolist()
        for rank, a, e in zip(names, starts, ends, strict=True):
            found = self.lists.get(rank)
            if found is None:
                self.lists[rank] = whole[a:e]
                heapq.heappush(self.active, rank)
            else:
                found += whole[a:e]

    def run(self) -> None:
        made = self.model.made
        while self.active:
            rank = heapq.heappop(self.active)
            left, right, new = made[rank]
            positions = self.lists.pop(rank)
            if len(positions) <= self.FEW or left == right:
                self.merge_each(sorted(positions), left, right, new)
            else:
                self.merge_all(np.array(positions), left, right, new)

    def merge_each(self, positions: list[int], left: int, right: int, new: int) -> None:
        symbols, after, before = memoryview(self.symbols), memoryview(self.after), memoryview(self.before)
        rank, add = self.model.rank.get, self.add
        for p in positions:
            if symbols[p] != left:
                continue
            q = after[p]
            if q < 0 or symbols[q] != right:
                continue
            symbols[p], symbols[q] = new, -1
            n = after[p] = after[q]
            if n >= 0:
                before[n] = p
                if (r := rank(new << PAIR_SHIFT | symbols[n])) is not None:
                    add(p, r)
            if (b := before[p]) >= 0 and (r := rank(symbols[b] << PAIR_SHIFT | new)) is not None:
                add(b, r)

    def merge_all(self, p: np.ndarray, left: int, right: int, new: int) -> None:
        symbols, after, before = self.symbols, self.after, self.before
        p = p[symbols[p] == left]
        q = after[p]
        fits = (q >= 0) & (symbols[q] == right)
        p, q = p[fits], q[fits]
        symbols[p], symbols[q] = new, -1
        n = after[q]
        after[p] = n
        more = n >= 0
        before[n[more]] = p[more]
        b = before[p]
        less = b >= 0
        pp, nn, bb = p[more], n[more], b[less]
        fresh = np.full(len(bb), new)
        self.add_many(np.concatenate((pp, bb)), self.ranks_of(np.concatenate((np.full(len(pp), new), symbols[bb])), np.concatenate((symbols[nn], fresh))))


class PairIndexTokenizer:
    """A vocabulary and its merges, read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        check_kind(spec)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.first_ids = np.array([vocab[c] for c in letters], np.int64)
        pairs: dict[int, int] = {}
        self.made = []
        for left, right in merges:
            pairs.setdefault(vocab[left] << PAIR_SHIFT | vocab[right], len(self.made))
            self.made.append((vocab[left], vocab[right], vocab[left + right]))
        self.rank = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        back = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of = [b""] * size
        self.shared = list(range(size))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[str, tuple[int, ...]] = {}

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each pre-token, all encoded together through one pair index."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        ends = np.cumsum(lengths)
        symbols = self.first_ids[np.frombuffer(b"".join(coded), np.uint8)]
        after = np.arange(1, len(symbols) + 1)
        before = np.arange(-1, len(symbols) - 1)
        inside = lengths > 0
        after[ends[inside] - 1], before[(ends - lengths)[inside]] = -1, -1
        index = _PairIndex(self, symbols, after, before)
        index.run()
        alive = symbols >= 0
        kept = np.concatenate(([0], np.cumsum(alive)))
        ids, firsts, lasts = symbols[alive].tolist(), kept[ends - lengths].tolist(), kept[ends].tolist()
        shared = self.shared
        return [tuple([shared[i] for i in ids[a:e]]) for a, e in zip(firsts, lasts, strict=True)]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """`_encode` with the cycle collector off: it makes no cycles, and would walk the cache again and again."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; strings of added tokens are matched first, as the library does.

        Every space between two characters that are no white space starts a pre-token, whatever stands around it, so
        a text is cut there and what the pieces encode to is remembered; only pieces not seen before are split into
        pre-tokens. A text in which a space has white space beside it is split as a whole.
        """
        findall, added = self.pattern.findall, self.added
        split_texts: list[list] = []
        seen: set[str] = set()
        for text in texts:
            parts = self.split.split(text) if self.split and any(t in text for t in added) else [text]
            pieces = [part if part in added else part.split(" ") for part in parts if part]
            split_texts.append(pieces)
            for piece in pieces:
                if not isinstance(piece, str):
                    seen.update(piece)
        fresh = seen.difference(self.cache)
        odd = {x for x in fresh if not x or x[0].isspace() or x[-1].isspace()}
        cut = {x: findall(" " + x) for x in fresh - odd}
        whole: dict[int, list[str]] = {}
        for pieces in split_texts:
            for piece in pieces:
                if not isinstance(piece, str):
                    if len(piece) == 1 or not odd.isdisjoint(piece):
                        whole[id(piece)] = findall(" ".join(piece))
                    else:
                        whole[id(piece)] = findall(piece[0])
        words = list({w for tokens in chain(cut.values(), whole.values()) for w in tokens})
        known = dict(zip(words, self.encode_words(words), strict=True))
        if len(self.cache) + len(cut) > CACHE_PIECES:
            self.cache = {x: self.cache[x] for x in seen if x in self.cache}
        self.cache.update((x, tuple(chain.from_iterable(map(known.__getitem__, tokens)))) for x, tokens in cut.items())
        get, out = self.cache.__getitem__, []
        for pieces in split_texts:
            ids: list[int] = []
            for piece in pieces:
                if isinstance(piece, str):
                    ids.append(added[piece])
                    continue
                ids += chain.from_iterable(map(known.__getitem__, whole[id(piece)]))
                if len(piece) > 1 and odd.isdisjoint(piece):
                    ids += chain.from_iterable(map(get, islice(piece, 1, None)))
            out.append(ids)
        for x in cut:
            if len(x) > CACHE_CHARS:
                del self.cache[x]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; added tokens give their own strings."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def tokenizer(path: str) -> PairIndexTokenizer:
    """One tokenizer a worker process and path, kept under a module of its own so that later tasks find it."""
    held = sys.modules.setdefault("_voxelake_tokenizers", types.ModuleType("_voxelake_tokenizers"))
    if path not in held.__dict__:
        setattr(held, path, PairIndexTokenizer(path))
    return held.__dict__[path]


def windows(batches) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of consecutive rows with about `WINDOW_CHARS` characters in all, or of one longer row."""
    ids, texts, chars = [], [], 0
    for batch in batches:
        first = 0
        for i, text in enumerate(batch.column(1).to_pylist()):
            texts.append(text or "")
            chars += len(texts[-1])
            if chars >= WINDOW_CHARS:
                ids.append(batch.column(0).slice(first, i + 1 - first))
                yield pa.concat_arrays(ids), texts
                ids, texts, chars, first = [], [], 0, i + 1
        ids.append(batch.column(0).slice(first))
    if texts:
        yield pa.concat_arrays(ids), texts


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ids array<int>): a row per input row; null and empty texts have no ids."""
    path, kind = path or default_tokenizer(), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = tokenizer(path)
        for keys, texts in windows(batches):
            ids = model.encode_batch(texts)
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(``id_col``, text): null ids give the empty text."""
    path, kind = path or default_tokenizer(), encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        model = tokenizer(path)
        for batch in batches:
            out = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_tokens, ids_sha256, decoded_sha256): encode and decode each text in one pass over the rows.

    Null and empty texts have no tokens and decode to the empty text. Repeated rows give repeated results, an empty
    table gives none, and other columns are ignored.
    """
    path, kind = path or default_tokenizer(), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = tokenizer(path)
        names = list(map(str, range(len(model.bytes_of))))
        for keys, texts in windows(batches):
            rows = []
            for ids in model.encode_batch(texts):
                joined = ",".join(map(names.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
