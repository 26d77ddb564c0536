"""Secret scans: fixed patterns, then a guess-cost dynamic program over values in credential contexts.

Base spans come from three patterns (`BASE`). The method adds a span of kind ``guess`` for every value that stands
in a credential context (`CONTEXT`) and that an attacker would need at least 10 ** `MIN_LOG10_GUESSES` guesses for.
The number of guesses is that of the cheapest segmentation of the value into

* words: ranked common passwords, then English words (`wordlist`), forwards or backwards, with the variations of
  letter case and of signs that stand for letters (`LOOKALIKES`),
* dates: years and day-month-year forms with or without separators,
* repeats: a block of any length standing twice or more (one character: three times), anywhere in a repetition,
* keyboard walks: three or more neighbouring keys of a QWERTY keyboard, anywhere in a walk,
* brute-force spans: each character costs the size of its class.

Costs are decimal logarithms and add up. A block costs what its characters do by brute force, one or more a
character, so blocks that could matter below a threshold are no longer than it, and a value costs time in proportion
to its length, however long it is: the program stops where no segmentation can stay below the threshold any more. The
cost alone decides, whatever characters a value has: a word of prose in a context stays below the threshold because
it is a ranked word, and one that is not ranked (of another language, say) is a span like any other of its cost.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelake.llm.wordlist import PLAIN

# fixed values: patterns of the contract
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")),
)
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_-]?key|credentials?|auth(?:orization)?|bearer)"""
    r"""["']?(?:[ \t]*(?:=>|:=|[:=])[ \t]*|[ \t]+is[ \t]+|[ \t]+)["']?([^\s"'<>,;]{8,})""",
    re.I | re.A,
)
#: A lower-cased text with none of these has no match of the assign pattern, or of CONTEXT.
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
#: Characters at the end of a value in which the keyword of a context whose value stands behind it begins.
KEYWORD_REACH = 16
KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10_GUESSES = 10.0

# fixed values: common passwords and words of passwords, most used first
COMMON = """
123456 password 123456789 12345678 12345 qwerty 111111 1234567 dragon 123123 baseball abc123 football monkey letmein
shadow master 696969 mustang michael pussy superman 1234567890 batman trustno1 hunter2 ranger buster thomas tigger
robert soccer killer hockey george charlie andrew michelle love sunshine jessica pepper daniel access joshua maggie
starwars silver william dallas yankees 666666 hello amanda orange freedom computer nicole ginger summer hunter
princess merlin corvette ashley cookie biteme secret welcome admin login root user guest test default changeme
changeit example sample demo temp system server service account token passwd pass word key api private public
client internal local dev prod staging spring winter autumn january february march april june july august
september october november december monday tuesday wednesday thursday friday saturday sunday correct horse battery
staple placeholder insert your here none null undefined required optional
passphrase passcode credential credentials auth authorization bearer
""".split()
RANKS = {word: rank for rank, word in reversed(list(enumerate(COMMON + PLAIN, 1)))}
WORD_LENGTHS = sorted({len(w) for w in RANKS})

# fixed values: the rows of a US keyboard, plain and shifted, and how far each row is indented in half keys
ROWS = (("`1234567890-=", "~!@#$%^&*()_+", 0), ("qwertyuiop[]\\", "QWERTYUIOP{}|", 3), ("asdfghjkl;'", 'ASDFGHJKL:"', 4), ("zxcvbnm,./", "ZXCVBNM<>?", 5))
KEYS = {c: (2 * x + indent, y) for y, (plain, shifted, indent) in enumerate(ROWS) for row in (plain, shifted) for x, c in enumerate(row)}

# fixed values: signs that stand for letters; the first table and the second differ in what 1, | and ! stand for
LOOKALIKES = [str.maketrans("4@8(3691!|0$57+2", "aabceggiiiossttz"), str.maketrans("4@8(3691!|0$57+2", "aabcegglllossttz")]

#: (least and most characters, pattern, log10 guesses) of the forms of dates.
DATES = [
    (4, 4, re.compile(r"(?:19|20)\d\d", re.A), math.log10(200)),
    (8, 8, re.compile(r"(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])", re.A), math.log10(200 * 366)),
    (8, 8, re.compile(r"(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d", re.A), math.log10(200 * 366)),
    (8, 8, re.compile(r"(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:19|20)\d\d", re.A), math.log10(200 * 366)),
    (8, 10, re.compile(r"(?:19|20)\d\d[-/._]\d{1,2}[-/._]\d{1,2}", re.A), math.log10(200 * 366 * 4)),
    (8, 10, re.compile(r"\d{1,2}[-/._]\d{1,2}[-/._](?:19|20)\d\d", re.A), math.log10(200 * 366 * 4)),
]


def char_cost(c: str) -> float:
    """log10 of the size of a character's class."""
    if c.isascii():
        return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)
    return 2.0


class _Words:
    """Words that end at a position of a value."""

    def __init__(self, v: str):
        self.v = v
        low = v.lower() if v.isascii() else "".join(c.lower() if c.isascii() else c for c in v)
        self.forms = list(dict.fromkeys([low, *map(low.translate, LOOKALIKES)]))
        # changes[f][i]: characters before i that form f replaced
        self.changes = [[0, *accumulate(a != b for a, b in zip(low, form, strict=True))] for form in self.forms]

    def ending(self, j: int) -> Iterator[tuple[int, float]]:
        for n in WORD_LENGTHS:
            if n > j:
                break
            i = j - n
            for form, changes in zip(self.forms, self.changes, strict=True):
                word = form[i:j]
                for backwards, rank in ((0, RANKS.get(word)), (1, RANKS.get(word[::-1]))):
                    if rank:
                        upper = sum(map(str.isupper, self.v[i:j]))
                        plain = upper == 0 or upper == n or (upper == 1 and self.v[i].isupper())
                        variations = (min(upper, 1) if plain else upper) + changes[j] - changes[i] + backwards
                        yield i, math.log10(rank + 1) + math.log10(2) * variations


def _dates(v: str, j: int) -> Iterator[tuple[int, float]]:
    """Dates that end at a position of a value."""
    if v[j - 1].isdigit():
        for least, most, pattern, cost in DATES:
            for n in range(least, min(most, j) + 1):
                if pattern.fullmatch(v, j - n, j):
                    yield j - n, cost


class _Starts:
    """Starts of segments that end further on and cost ``base + log10(blocks)``, of which the cheapest is asked.

    An earlier start has more blocks, so it is worse for ever than a later one of no larger base; and as the blocks'
    ratio only falls, a start that an earlier one beats now stays beaten. Both kinds are dropped.
    """

    def __init__(self):
        self.held: list[tuple[int, float]] = []

    def add(self, start: int, base: float) -> None:
        while self.held and self.held[-1][1] >= base:
            self.held.pop()
        self.held.append((start, base))

    def least(self, end: int, block: int) -> float:
        kept, least = [], math.inf
        for start, base in self.held:
            if (cost := base + math.log10((end - start) // block)) < least:
                least = cost
                kept.append((start, base))
        self.held = kept
        return least


class _Repeats:
    """The cheapest way to end with a repeat, position by position."""

    def __init__(self, v: str, limit: float):
        self.v, self.limit = v, limit
        self.brute = [0.0, *accumulate(map(char_cost, v))]
        self.runs: dict[int, int] = {}
        self.starts: dict[tuple[int, int], _Starts] = {}

    def ending(self, j: int, best: list[float]) -> float:
        """The cost of v[:j] if a repeat ends it; ``best`` has the costs of all shorter prefixes."""
        v, least, at = self.v, math.inf, j - 1
        # no character costs less than one, so a block of ``limit`` characters is none below it
        for p in range(1, 1 + int(min(at, len(v) // 2, self.limit))):
            if v[at] != v[at - p]:
                if self.runs.pop(p, None) is not None:
                    for r in range(p):
                        self.starts.pop((p, r), None)
                continue
            # the run's first block begins here
            first = self.runs.setdefault(p, at - p)
            new = j - max(2 * p, 3)
            if new >= first and best[new] < self.limit:
                self.starts.setdefault((p, new % p), _Starts()).add(new, best[new])
            if held := self.starts.get((p, j % p)):
                least = min(least, self.brute[j] - self.brute[j - p] + held.least(j, p))
        return least


class _Walks:
    """The cheapest way to end with a keyboard walk, position by position."""

    TURN = math.log10(4)

    def __init__(self, v: str, limit: float):
        self.v, self.limit, self.starts, self.first, self.last, self.turns = v, limit, _Starts(), 0, None, []

    def ending(self, j: int, best: list[float]) -> float:
        a, b = (KEYS.get(c) for c in self.v[max(j - 2, 0) : j]) if j > 1 else (None, None)
        step = (b[0] - a[0], b[1] - a[1]) if a and b else None
        if step is None or step[1] not in (-1, 0, 1) or not 1 <= abs(step[0]) <= (2 if step[1] == 0 else 3):
            self.starts, self.first, self.last, self.turns = _Starts(), j - 1, None, []
            return math.inf
        # turns[i]: changes of direction up to the step from key i to the next of this walk
        self.turns.append((self.turns[-1] if self.turns else 0) + (self.last is not None and step != self.last))
        self.last, new = step, j - 3
        if new >= self.first and best[new] < self.limit:
            self.starts.add(new, best[new] - self.TURN * self.turns[new - self.first])
        return self.starts.least(j, 1) + math.log10(len(KEYS)) + self.TURN * (1 + self.turns[-1])


def log10_guesses(v: str, limit: float = MIN_LOG10_GUESSES) -> float:
    """Cost of the cheapest segmentation if that is below ``limit``, else infinity; 0 for the empty value.

    An infinite limit gives every cost, in time that grows with the square of the length.
    """
    words, repeats, walks = _Words(v), _Repeats(v, limit), _Walks(v, limit)
    best, hope = [0.0], 0
    reach = max(WORD_LENGTHS[-1], 10, 3, 0 if limit == math.inf else 2 * int(limit))
    for j in range(1, len(v) + 1):
        ends = [best[j - 1] + char_cost(v[j - 1]), repeats.ending(j, best), walks.ending(j, best)]
        ends += [best[i] + cost for i, cost in chain(words.ending(j), _dates(v, j)) if best[i] < limit]
        best.append(min(ends))
        if best[j] < limit:
            hope = j
        # costs of open repeats and walks only grow, so they end what has no hope within reach
        elif j - hope > reach and min(ends[1:3]) >= limit and all(s.least(j, p) >= limit for (p, _), s in repeats.starts.items()):
            return math.inf
    return best[-1] if best[-1] < limit else math.inf


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index into KINDS, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    low, out = text.lower(), []
    if any(hint in low for hint in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in BASE[0][1].finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in BASE[1][1].finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in BASE[2][1].finditer(text)]
    return sorted(out)


def guess_spans(text: str, threshold: float = MIN_LOG10_GUESSES) -> list[tuple[int, int, int]]:
    """Spans of values in credential contexts whose guess cost reaches the threshold.

    Contexts may overlap: the end of a value can be the keyword of the next one. No value inside another is looked at:
    it ends where that ends, so it is covered, or costs no more than what was refused.
    """
    low, out, at, done = text.lower(), [], 0, 0
    if not any(hint in low for hint in CONTEXT_HINTS):
        return out
    while m := CONTEXT.search(text, at):
        start, end = m.span(1)
        at = max(start, end - KEYWORD_REACH)
        if start < done:
            continue
        done = end
        quoted = end < len(text) and text[end] in "\"'" and text[start - 1] == text[end]
        # what ends a sentence or a markup is no part of a value, unless quotes say that it is
        value = m[1] if quoted else m[1].rstrip(".:!?)]}#&$%*")
        if len(value) >= 8 and log10_guesses(value, threshold) >= threshold:
            out.append((start, 3, start + len(value)))
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every run of overlapping spans replaced by one mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, _, end in sorted(spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:] if merged else text


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = MIN_LOG10_GUESSES) -> DataFrame:
    """(``id_col``, n_assign, n_access, n_hex, base_sha256, spans, n_guess, redacted): a row per input row.

    Null and empty texts have no span (the digest of the empty string). Every row is scanned by itself and whole,
    so repeated rows give repeated results, an empty table gives none, and other columns are ignored.
    ``redacted`` is null where nothing was found.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base, guess = base_spans(text), guess_spans(text, threshold)
                spans = sorted(base + guess)
                counts = [sum(1 for s in base if s[1] == k) for k in range(3)]
                sha = hashlib.sha256(digest(base).encode()).hexdigest()
                rows.append((*counts, sha, digest(spans), len(guess), redact(text, spans) if spans else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "redacted"],
            )

    schema = f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, redacted string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(scan, schema)


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", threshold: float = MIN_LOG10_GUESSES) -> DataFrame:
    """The rows with all their columns, every span that `scan_secrets` finds in the text replaced by a mark.

    The column of character counts, if there is one, follows the text where it changed, also from a null count. Null
    texts stay null and empty ones empty. Each row is treated by itself and whole, so repeated rows give repeated
    results and an empty table gives none; a mark that stands in a text already is text like any other.
    """
    counted = chars_col in docs.columns

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts, changed = batch.column(at).to_pylist(), {}
            for i, text in enumerate(texts):
                if text and (spans := base_spans(text) + guess_spans(text, threshold)):
                    texts[i] = redact(text, spans)
                    changed[i] = len(texts[i])
            if changed:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if counted:
                    chars = batch.schema.get_field_index(chars_col)
                    counts = [changed.get(i, n) for i, n in enumerate(batch.column(chars).to_pylist())]
                    batch = batch.set_column(chars, batch.schema.field(chars), pa.array(counts, batch.schema.field(chars).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
