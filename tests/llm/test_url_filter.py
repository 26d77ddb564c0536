import hashlib
import random
import re

from pyspark.sql import functions as F

from voxelake.llm import url_filter as U
from voxelake.llm.queries import RULES


def brute(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, rule.name if rule else None, rule.verdict if rule else "block" if listed(host) else "allow"


URLS = [None, "", "no scheme", "http://", "http://A.ORG/x", "http://org", "http://org/", "http://a.example.org/en/12?x#y", "http://a.example.org/es/", "https://xexample.org/es/", "http://b.com/de/?q=://z/", "http://b.com/fr/é", "http://É.com#f/de/", "http://u?a/b", "x://y://z/w", "http://b.com/\n/de/", "http://com/de/"]


def test_verdicts(spark):
    rng = random.Random(3)
    urls = URLS + [f"https://h{rng.randrange(900)}.net/p{i}" for i in range(3000)] + ["https://hot.net/"] * 500
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumns({"host": F.lit(1), "key": F.lit(2), "listed": F.lit(3)})
    got = {r.page_id: tuple(r)[1:] for r in U.filter_urls(rows, RULES, lambda h: F.substring(F.md5(h), 1, 1).isin("0", "1", "2")).collect()}
    assert got == {i: brute(u, lambda h: hashlib.md5(h.encode()).hexdigest()[0] in "012") for i, u in enumerate(urls)}


def test_cascade_is_exact_with_bad_filters(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = U.build_cascade(keys, bits_per_key=3, hashes=2)
    assert len(cascade.levels) > 4
    assert keys.filter(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def test_lists_tables_and_bounds(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.net/"), (None, None)], "page_id long, url string")
    listed = spark.createDataFrame([("a.net",), ("unseen.net",), ("a.net",)], "host string")
    want = [(None, "allow"), (1, "block"), (2, "allow")]
    verdicts = lambda: sorted(((r.page_id, r.verdict) for r in U.filter_urls(rows, [], listed).collect()), key=str)
    assert verdicts() == sorted(want, key=str)
    monkeypatch.setattr(U, "MAX_FILTER_BITS", 12)
    assert verdicts() == sorted(want, key=str)
    assert U.filter_urls(rows.limit(0), RULES, listed).collect() == []


def test_shards_are_exact(spark, monkeypatch):
    """A universe beyond the bound is judged by several cascades, each within it."""
    monkeypatch.setattr(U, "MAX_FILTER_BITS", 700)
    urls = [f"https://h{i % 300}.net/" for i in range(900)] + ["https://hot.net/"] * 400 + [None]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = lambda host: F.substring(F.md5(host), 1, 1).isin("0", "1", "2", "3", "4")
    keys = rows.select(U.host_of(F.col("url")).alias("key")).distinct().select("key", listed(F.col("key")).alias("listed"))
    assert len(U.build_cascades(keys)) > 1
    got = {r.page_id: r.verdict for r in U.filter_urls(rows, [], listed).collect()}
    host = lambda u: u.split("/")[2] if u else ""
    assert got == {i: "block" if hashlib.md5(host(u).encode()).hexdigest()[0] in "01234" else "allow" for i, u in enumerate(urls)}
