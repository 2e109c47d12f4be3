import pytest

from segmill.llm.queries import URL_ENTRIES
from segmill.llm.url_filter import Entry, Trie, judge_urls, judge_urls_by_join

URLS = [
    None, "", "no scheme", "://", "http://", "http://COM", "http://com/", "http://a.com", "http://a.com/?x", "http://a.com/x#/en/", "http://Example.com/en/a", "http://example.com/en",
    "http://example.com/english/", "http://www.example.com/en/", "http://x.www.example.com/en/a?b", "http://notexample.com/en/", "http://a.net/es/", "http://a.net/fr/x", "http://net/fr/",
    "http://a.net/de/", "ftp://a.net:80/fr/", "http://İ.com/", "x://y://com/en/", "http://.com/", "http://a.com./", "http://a.com\n/x", "http://a.com/" + "p/" * 20_000,
]


def plain(url, entries, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([i for c in "?#" if (i := tail.find(c)) >= 0], default=len(tail))]
    fits = [e for e in entries if (host == e.host or host.endswith("." + e.host)) and path.startswith(e.path)]
    best = max(fits, key=lambda e: (e.host.count("."), len(e.path), e.verdict == "block"), default=None)
    return host, path, best and best.rule, best.verdict if best else default


MORE = [*URL_ENTRIES, Entry("a.com", "", "block"), Entry("com", "/x", "block"), Entry("com", "/p/p", "allow"), Entry("net", "/fr/", "allow"), Entry("x.www.example.com", "/en/a", "block")]


@pytest.mark.parametrize("entries", [URL_ENTRIES, MORE, []])
def test_against_plain_rules(spark, entries):
    rows = spark.createDataFrame([(i, u, "kept", "replaced") for i, u in enumerate([*URLS, URLS[6]])], "page_id long, url string, html string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(rows, entries).collect()}
    assert got == {i: plain(u, entries) for i, u in enumerate([*URLS, URLS[6]])}
    assert judge_urls(rows, entries).columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"]
    assert judge_urls(rows.limit(0), entries).count() == 0


def test_longest_wins():
    trie = Trie([Entry("a.b", "/x/", "block"), Entry("b", "/x/yy", "allow"), Entry("b", "/x/y", "block")])
    assert trie.match("a.b", "/x/yy").host == "a.b"
    assert trie.match("c.b", "/x/yyy/z").path == "/x/yy"
    assert trie.match("c.b", "/x/yz").path == "/x/y"
    assert trie.match("cb", "/x/yz") is None


@pytest.mark.parametrize("entries", [URL_ENTRIES, MORE])
def test_long_lists_are_joined(spark, monkeypatch, entries):
    monkeypatch.setattr("segmill.llm.url_filter.MAX_ENTRIES", 4)
    rows = spark.createDataFrame([(i, u, "kept", "replaced") for i, u in enumerate([*URLS, URLS[6]])], "page_id long, url string, html string, verdict string")
    got = judge_urls(rows, entries)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {i: plain(u, entries) for i, u in enumerate([*URLS, URLS[6]])}
    assert got.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"] and judge_urls(rows.limit(0), entries).count() == 0


def test_more_entries_than_a_trie_takes(spark):
    entries = [Entry(f"h{i}.org", "/a/" if i % 2 else "/", "block" if i % 3 else "allow") for i in range(310_000)]
    urls = [f"http://x.h{i}.org/a/b" for i in range(0, 320_000, 997)]
    by_host = {e.host: e for e in entries}
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(rows, entries).collect()}
    hits = {i: by_host.get(u.split("/")[2][2:]) for i, u in enumerate(urls)}
    assert got == {i: (e.rule, e.verdict) if e else (None, "allow") for i, e in hits.items()}


@pytest.mark.parametrize("most", [4, 300_000])
def test_columns_of_clashing_names(spark, monkeypatch, most):
    """Names ignore case; results replace columns of theirs, all others are kept."""
    monkeypatch.setattr("segmill.llm.url_filter.MAX_ENTRIES", most)
    rows = spark.createDataFrame([(i, u, 1, "h", "r", "e", "k", "n") for i, u in enumerate(URLS)], "page_id long, url string, Verdict int, Host string, RULE string, segmill_entry string, Segmill_URL string, segmill_rows string")
    got = judge_urls(rows, URL_ENTRIES)
    assert got.columns == ["page_id", "url", "segmill_entry", "Segmill_URL", "segmill_rows", "host", "path", "rule", "verdict"]
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {i: plain(u, URL_ENTRIES) for i, u in enumerate(URLS)}
    assert {(r.segmill_entry, r.Segmill_URL, r.segmill_rows) for r in got.collect()} == {("e", "k", "n")}


def test_hot_keys_of_the_join(spark, monkeypatch):
    """Many rows of one URL, of one host ending and of none."""
    monkeypatch.setattr("segmill.llm.common.HOT_KEYS", 5)
    urls = ["http://a.com/"] * 40 + [None] * 30 + [f"http://h{i}.com/x" for i in range(40)] + ["http://b.net/es/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    entries = spark.createDataFrame([(e.host, e.path, e.verdict) for e in MORE], "host string, path string, verdict string")
    got = judge_urls_by_join(rows, entries)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {i: plain(u, MORE) for i, u in enumerate(urls)}
