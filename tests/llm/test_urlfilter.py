import re
import tempfile

import pytest

from grove.llm import urlfilter as U
from grove.llm.queries import URL_RULES

URLS = [None, "", "no scheme", "http://", "http://ORG/", "https://a.example.org/es/x?q", "http://example.org/en/12#f",
        "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/de/y", "http://com/fr/", "http://com",
        "http://com?x=/fr/", "http://com/FR/", "ftp://net.com/de", "a://b://c/d", "http://xn--é.com/de/\U0001F600",
        "http://user@spam.example.net:80/p", "http://.com/de/", "http://com/de/\nfr/", "http://org/" + "p" * 50_000]


def brute(url, entries):
    host, path = U.split_url(url)
    fit = [(len(h) + len(p), len(h), v == "block", h + p) for h, p, v in entries
           if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((None, "allow") if not fit else (max(fit)[3], ("allow", "block")[max(fit)[2]])))


def frames(spark, urls, entries):
    pages = spark.createDataFrame([(i, u, "e", "e") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    return pages, spark.createDataFrame(entries, "host string, path string, verdict string")


def judged(df):
    return [(r.host, r.path, r.rule, r.verdict) for r in sorted(df.collect(), key=lambda r: r.page_id)]


MORE = URL_RULES + [("com", "/fr/", "block"), ("com", "/fr/", "allow"), ("A.example.ORG", "/es/", "allow"), ("net", "", "block"),
                    ("example.net:80", "/", "allow")]


@pytest.mark.parametrize("entries", [URL_RULES, MORE, []])
@pytest.mark.parametrize("block_bytes", [U.BLOCK_BYTES, 120])
def test_against_brute_force(spark, entries, block_bytes):
    # one verdict for an entry named with several: block
    want_entries = [(h.lower(), p, "block" if (h, p, "block") in entries else v) for h, p, v in entries]
    pages, e = frames(spark, URLS + URLS[3:8], entries)
    assert judged(U.judge_urls(pages, e, block_bytes=block_bytes)) == [brute(u, want_entries) for u in URLS + URLS[3:8]]


def thin(rows, least):
    """Addresses whose pages all have few words outside tags."""
    most = {}
    for url, html, *_ in rows:
        host, path = U.split_url(url)
        if host:
            n = len(re.sub("<[^>]*>", " ", html or "").encode().split())
            most[host, path] = max(most.get((host, path), 0), n)
    return {k for k, n in most.items() if n < least}


def test_thin_pages_are_listed(spark):
    """Null, empty, upper-case and very long urls and texts, addresses with several pages."""
    rows = [(u, "<p>one <b>two</b>" if i % 2 else "<p>" + "word " * 9) for i, u in enumerate(URLS)]
    rows += [("http://A.com/x?1", "few"), ("http://a.com/x?2", "a b c d e f"), ("http://a.com/y", None), ("http://a.com/y", "<br>"),
             ("http://b.com/z", "<" * 20 + "w " * 50_000), ("http://c.com", "<a href='many words in a tag only'>"),
             ("http://d.com/\u0085é", "no\u0085break no\u2003break")] * 2
    want = thin(rows, 5)
    pages = spark.createDataFrame([(i, u, h, "e", "e", "e", "e") for i, (u, h) in enumerate(rows)],
                                  "page_id long, url string, html string, host string, path string, words string, verdict string")
    got = [tuple(r) for r in U.thin_pages(pages, 5).collect()]
    assert sorted(got) == sorted((h, p, "block") for h, p in want) and ("a.com", "/y") in want and ("a.com", "/x") not in want
    judged_ = {r.page_id: r for r in U.judge_urls(pages, frames(spark, [], [])[1], U.thin_pages(pages, 5), block_bytes=200).collect()}
    assert judged_[0].words == "e" and len(judged_) == len(rows)
    whole_hosts = {h for h, p in want if not p}
    for i, (u, _) in enumerate(rows):
        h, p = U.split_url(u)
        block = (h, p) in want or any(h == x or h.endswith("." + x) for x in whole_hosts)
        assert (judged_[i].host, judged_[i].path, judged_[i].rule, judged_[i].verdict) == (h, p, None, "block" if block else "allow")


def test_no_pages_list_nothing(spark):
    assert U.thin_pages(spark.createDataFrame([], "url string, html string")).count() == 0


def test_list_is_asked_where_no_rule_fits(spark):
    pages, rules = frames(spark, URLS, URL_RULES)
    listed = spark.createDataFrame([("example.net:80", "", "block"), ("org", "", "block")], "host string, path string, verdict string")
    got = judged(U.judge_urls(pages, rules, listed))
    assert got[17] == ("user@spam.example.net:80", "/p", None, "block")
    assert got[4] == ("org", "/", "org/", "allow")


def test_collisions_are_settled_by_the_strings(monkeypatch):
    """Every key hashes alike: only the stored strings tell entries apart."""
    import xxhash
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: 7)
    with tempfile.NamedTemporaryFile() as f:
        f.write(U.build(MORE))
        f.flush()
        a = U.DigestArray(f.name)
        assert len(a.keys) == len({(h.lower(), p) for h, p, _ in MORE})
        found = a.judge(["example.org", "zzz.net", "example.info"], ["/es/", "/x", "/"])
    assert found == [("example.org", "/es/", 1), ("net", "", 1), None]


def test_keys_are_sorted_and_mapped():
    import numpy as np
    with tempfile.NamedTemporaryFile() as f:
        f.write(U.build((f"h{i}.com", f"/{i}", "block") for i in range(5000)))
        f.flush()
        a = U.DigestArray(f.name)
        assert isinstance(a.keys, np.memmap) and (np.diff(a.keys.astype(object)) >= 0).all()
        assert a.judge(["x.h77.com", "h77.com"], ["/77", "/78"])[0] == ("h77.com", "/77", 1)


def test_bad_verdict_and_empty(spark):
    with pytest.raises(ValueError):
        U.build([("a", "/", "maybe")])
    pages, rules = frames(spark, [], URL_RULES)
    assert U.judge_urls(pages, rules).count() == 0
