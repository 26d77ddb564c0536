import hashlib
import math
import re

import pytest
from hypothesis import given, settings, strategies as st

from voxelake.llm import secret_scan as S

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


ROWS = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
SHIFTED = ["~!@#$%^&*()_+", "QWERTYUIOP{}|", 'ASDFGHJKL:"', "ZXCVBNM<>?"]
PLACES = {c: (2 * x + (0, 3, 4, 5)[y], y) for rows in (ROWS, SHIFTED) for y, row in enumerate(rows) for x, c in enumerate(row)}
SIGNS = {"4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "6": "g", "9": "g", "1": "il", "!": "il", "|": "il", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "2": "z"}
DATE_FORMS = [
    (r"(19|20)[0-9]{2}", 200),
    (r"(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])", 200 * 366),
    (r"(0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])(19|20)[0-9]{2}", 200 * 366),
    (r"(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])(19|20)[0-9]{2}", 200 * 366),
    (r"(19|20)[0-9]{2}[-/._][0-9]{1,2}[-/._][0-9]{1,2}", 200 * 366 * 4),
    (r"[0-9]{1,2}[-/._][0-9]{1,2}[-/._](19|20)[0-9]{2}", 200 * 366 * 4),
]


def character(c):
    return math.log10(10 if c in "0123456789" else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def whole(v):
    """The cheapest cost of a string as one segment, by the definitions alone; infinite if it is none but brute force."""
    costs = [sum(map(character, v))]
    # a word: each sign as itself or (all i, or all l) as a letter, either way round
    upper = sum(c.isupper() for c in v)
    case = min(upper, 1) if upper in (0, len(v)) or upper == 1 and v[0].isupper() else upper
    for pick in (None, 0, -1):
        word = "".join(SIGNS.get(c, c)[pick] if pick is not None else c for c in v.lower())
        for back in (0, 1):
            if rank := S.RANKS.get(word[::-1] if back else word):
                costs.append(math.log10(rank + 1) + math.log10(2) * (case + back + sum(a != b for a, b in zip(word, v.lower()))))  # noqa: B905
    costs += [math.log10(n) for form, n in DATE_FORMS if re.fullmatch(form, v)]
    for p in range(1, len(v) // 2 + 1):
        if len(v) % p == 0 and v == v[:p] * (len(v) // p) and len(v) >= 3:
            costs.append(sum(map(character, v[:p])) + math.log10(len(v) // p))
    if len(v) >= 3 and all(c in PLACES for c in v):
        steps = [(PLACES[b][0] - PLACES[a][0], PLACES[b][1] - PLACES[a][1]) for a, b in zip(v, v[1:])]  # noqa: B905
        if all(abs(y) <= 1 and 1 <= abs(x) <= (2 if y == 0 else 3) for x, y in steps):
            turns = 1 + sum(a != b for a, b in zip(steps, steps[1:]))  # noqa: B905
            costs.append(math.log10(len(PLACES) * len(v)) + turns * math.log10(4))
    return min(costs)


def brute_cost(v):
    """Cheapest of all segmentations into all substrings, none of which the code under test lists."""
    best = [0.0]
    for j in range(1, len(v) + 1):
        best.append(min(best[i] + whole(v[i:j]) for i in range(j)))
    return best[-1]


PIECES = ["password", "PassWord", "token", "secret", "api_key", "apikey", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGHIJKL0123", "deadbeef" * 4, "0123", "x", "é", "ſecret", "K", "\n", "qwerty", "2024"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12))
def test_base_spans(parts):
    text = "".join(parts)
    assert [(S.KINDS[k], a, e) for a, k, e in S.base_spans(text)] == brute_base(text)


VALUE_PIECES = ["a", "b", "1", "q", "w", "e", "xk7qz9", "ab", "aba", "Pass", "word", "p4ssw0rd", "drowssap", "1i1y", "2024", "12-3-1999", "1.12.2001", "!", "-", "é", "zaq1", "xsw2", "7410"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(VALUE_PIECES), max_size=9))
def test_guess_cost_is_minimal(parts):
    v = "".join(parts)
    want = brute_cost(v)
    assert S.log10_guesses(v, math.inf) == pytest.approx(want)
    # below the limit the cost is the same, and no value that reaches it is taken for a cheap one
    assert S.log10_guesses(v) == (pytest.approx(want) if want < S.MIN_LOG10_GUESSES else math.inf)


@settings(max_examples=200, deadline=None)
@given(st.text("aA1q2w3e!", max_size=24))
def test_guess_cost_is_minimal_over_a_small_alphabet(v):
    assert S.log10_guesses(v, math.inf) == pytest.approx(brute_cost(v))


def test_repeats_of_any_block_cost_little_more_than_the_block():
    once = S.log10_guesses("xk7qz9", math.inf)
    assert S.log10_guesses("xk7qz9" * 4) == pytest.approx(once + math.log10(4)) == pytest.approx(brute_cost("xk7qz9" * 4))
    block = "xK9#vQ2!mZ7pL"
    assert S.log10_guesses(block * 5, math.inf) == pytest.approx(brute_cost(block * 5))
    assert brute_cost(block * 5) <= sum(map(character, block)) + math.log10(5) + 1e-9
    assert S.log10_guesses("9xk7qz9xk7qz9xk7qz") < S.log10_guesses("9xk7qz8wv5jph4rt3m", math.inf)


def test_words_in_disguise():
    plain = S.log10_guesses("password")
    for v, more in (("drowssap", 1), ("p4ssword", 1), ("p@$$w0rd", 4), ("Password", 1)):
        assert plain < S.log10_guesses(v) <= plain + more * math.log10(2) + 1e-9, v


def test_costs_order_values():
    weak = ["password123", "qwertyuiop", "aaaaaaaaaaaa", "abcabcabc", "19991231", "letmein2024"]
    strong = ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "xK9#vQ2!mZ7pL"]
    assert max(map(S.log10_guesses, weak)) < S.MIN_LOG10_GUESSES < min(S.log10_guesses(v, math.inf) for v in strong)


def test_spans_are_kept_and_added(spark, documents):
    secret = 'the pwd is "zK93kdQx77LmPq" and token = abcdefgh'
    rows = [(1, secret, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "the token was lost and the passworn too", "en", "a"), (4, "the token was lost and the passworn too", "en", "a"), (5, "w " * 200_000 + "secret: q8Zr5TyUw2", "en", "a"), (None, "password=qwertyuiop", None, None)]
    got = {}
    for r in S.scan_secrets(documents(rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].n_assign == 1 and got[1][0].n_guess == 1 and "guess:12:26" in got[1][0].spans
    for i, text in ((1, secret), (2, ""), (3, ""), (5, rows[5][1])):
        base = ",".join(f"{k}:{a}:{e}" for k, a, e in brute_base(text))
        assert got[i][0].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[2][0].spans == "" and len(got[4]) == 2 and got[4][0].spans == "" and got[5][0].n_assign == 1 and got[None][0].n_assign == 1
    assert S.scan_secrets(documents([])).collect() == []


def test_redaction(documents):
    rows = [(1, "a token = abcdefgh1 b", "en", "a"), (2, None, None, None), (3, "clean", "en", "a")]
    got = {r.doc_id: r for r in S.redact_documents(documents(rows)).collect()}
    assert got[1].text == "a [SECRET] b" and got[1].n_chars == 12 and got[2].text is None and got[3].text == "clean"


def test_redaction_of_other_tables(spark):
    rows = [("pwd: xkqzvbnmwrtplkgh", 1), (None, None), ("", 2), ("pwd: xkqzvbnmwrtplkgh", 1)]
    df = spark.createDataFrame(rows, "text string, spans int")
    assert sorted(map(tuple, S.redact_documents(df).collect()), key=str) == sorted([("pwd: [SECRET]", 1), (None, None), ("", 2), ("pwd: [SECRET]", 1)], key=str)
    assert S.redact_documents(df.limit(0)).collect() == []


def test_registered_query(spark):
    """The registered query over its whole table: base columns against plain searches, added spans against the brute-force cost."""
    from voxelake.llm.queries import op1_secret_scan

    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op1_secret_scan(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        base = brute_base(texts[i])
        shown = ",".join(f"{k}:{a}:{e}" for k, a, e in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and set(shown.split(",")) <= {"", *r.spans.split(",")}
        for span in r.spans.split(",") if r.spans else []:
            kind, a, e = span.split(":")
            assert kind != "guess" or brute_cost(texts[i][int(a) : int(e)]) >= S.MIN_LOG10_GUESSES


def test_long_values_take_linear_time():
    import time

    began = time.time()
    S.log10_guesses("ab12" * 50_000)
    S.log10_guesses("qwe1" * 50_000)
    S.log10_guesses("a" * 100_000)
    assert S.log10_guesses("q7" * 30_000 + "".join(map(chr, range(0x4E00, 0x9000))) * 20) == math.inf
    assert time.time() - began < 60


def guessed(text):
    return [text[a:e] for a, _, e in S.guess_spans(text)]


@pytest.mark.parametrize(
    "text, value",
    [
        ("pwd: xkqzvbnmwrtplkgh", "xkqzvbnmwrtplkgh"),
        ("credentials: JBSWYDPEHPKPXPQR", "JBSWYDPEHPKPXPQR"),
        ("Credentials: Jbswydpehpkpxpqr.", "Jbswydpehpkpxpqr"),
        ("client secret: 'q#z!v@k$w%'", "q#z!v@k$w%"),
        ("the passcode is 830571629416", "830571629416"),
        ("auth bearer $%(@^&_+~!|{", "$%(@^&_+~!|{"),
    ],
)
def test_every_costly_value_is_found_whatever_its_characters(documents, text, value):
    assert guessed(text) == [value] and S.scan_secrets(documents([(1, text, "en", "a")])).first().n_guess == 1
    assert value not in S.redact_documents(documents([(1, text, "en", "a")])).first().text


def test_plain_words_in_contexts_are_no_secrets():
    for word in ("authentication", "requirements", "Expiration", "ingredient", "credentials:", "AUTHORIZATION", "password-protected", "username/password", "validation.", "12345678901234567890", "qwertyuiop"):
        assert guessed(f"the secret {word} and so on") == [], word


@pytest.mark.parametrize(
    "text",
    [
        "secret credentials: {}",
        "auth passphrase: {}",
        "token credentials {}",
        "bearer authorization := {}",
        "secret db.admin.credentials => '{}'",
        "auth credentials passphrase authorization {} and more",
        "secret x7Kq9vvR2mWt-token: {}",
    ],
)
def test_chained_keywords(documents, text):
    value = "Zq8vK2mX9pLw"
    text = text.format(value)
    assert guessed(text)[-1] == value and guessed(text)[:-1] in ([], ["x7Kq9vvR2mWt-token"])
    assert value not in S.redact_documents(documents([(1, text, "en", "a")])).first().text


def test_chained_keywords_take_linear_time():
    import time

    began = time.time()
    assert guessed("token credentials " * 20_000 + "Zq8vK2mX9pLw") == ["Zq8vK2mX9pLw"]
    assert guessed("pwd=" * 1_000 + " Zq8vK2mX9pLw") == ["Zq8vK2mX9pLw"] and len(guessed("pwd=" * 100_000 + " Zq8vK2mX9pLw")) == 2
    assert len(guessed("token=secret:" * 30_000 + " Zq8vK2mX9pLw")) == 2
    assert time.time() - began < 60


CHAIN = ["pwd", "token", "secret", "credentials", "auth", "passphrase", "api_key", "=", ":", " ", " is ", "=>", '"', "Zq8vK2", "x7", "aaaa", "qwerty", "#", ";", "\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(CHAIN), max_size=14))
def test_no_context_is_passed_over(parts):
    """The characters covered are those of all contexts, tried at every position one by one."""
    text, want = "".join(parts), set()
    for i in range(len(text)):
        if (m := S.CONTEXT.match(text, i)) and S.guess_spans(text[i : m.end() + 1])[:1]:
            a, _, e = S.guess_spans(text[i : m.end() + 1])[0]
            if i + a == m.start(1):
                want |= set(range(i + a, i + e))
    assert {n for a, _, e in S.guess_spans(text) for n in range(a, e)} >= want
