"""op3: parsing and rules against a plain version; mining on planted combinations."""

import itertools
import random
from collections import Counter

import duckdb

from lodestone.llm import urlfilter
from lodestone.llm.queries import op3_url_filter
from tests.conftest import DATA


def plain(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, stops: s[: min([s.find(c) for c in stops if c in s] or [len(s)])]
    host = cut(rest, "/?#")
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, cut(rest[len(host) :], "?#")


def rule(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://Example.COM/en/x?y#z", "http://WWW.example.com/en/", "http://m.www.example.com/en/a", "http://a.b.net/es/q", "http://net/fr/", "http://net/frx/",
    "http://notexample.com/en/", "ftp://x.org#frag/en", "http://x.com?/en/", "x://y://z.net/es/", "http://É.NET/es/", "http://a\nb.net/fr/\n", "http://xcom/", "http://com/",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "t", "r") for i, u in enumerate(URLS)], "page_id long, url string, tokens string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in urlfilter.judge_urls(pages, labels).collect():
        host, path = plain(URLS[r.page_id])
        assert (r.host, r.path) == (host, path), URLS[r.page_id]
        want, verdict = rule(host, path)
        assert (r.rule, r.verdict) == (want, verdict or "allow"), URLS[r.page_id]


def test_whole_table_base(spark):
    rows = {r.page_id: r for r in op3_url_filter(spark, DATA).collect()}
    urls = dict(duckdb.sql(f"select page_id, url from '{DATA}/pages.parquet'").fetchall())
    assert rows.keys() == urls.keys()
    for i, url in urls.items():
        host, path = plain(url)
        want, verdict = rule(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, want)
        assert rows[i].verdict == verdict if want else rows[i].verdict in ("allow", "block")


def brute_rules(baskets, support, confidence, lift, least=urlfilter.LEAST):
    n = len(baskets)
    support = max(support, least / n)
    bad = sum(b for _, b in baskets) / n
    counts, hits = Counter(), Counter()
    for tokens, b in baskets:
        for size in range(1, len(tokens) + 1):
            for c in itertools.combinations(tokens, size):
                counts[c] += 1
                hits[c] += b
    found = [frozenset(c) for c in counts if hits[c] / n >= support and hits[c] / counts[c] >= confidence and urlfilter.lower_end(hits[c], counts[c]) >= lift * bad]
    return {r for r in found if not any(o < r for o in found)}


def test_mined_rules_are_those_of_brute_force(spark):
    rows = [(f"http://{h}.org/{p}/1?{q}=1", (p == "win" and q == "ref") or (h == "spam" and i % 4 > 0)) for i in range(40) for h in ("a", "b", "spam") for p in ("win", "news") for q in ("ref", "id")]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    got = set(urlfilter.mine_rules(df, 0.02, 0.7, 1.2))
    assert got and got == brute_rules([(urlfilter.url_tokens(u), b) for u, b in rows], 0.02, 0.7, 1.2)
    holds = urlfilter.matcher(sorted(got, key=sorted))
    for u, _ in rows:
        tokens = urlfilter.url_tokens(u)
        assert holds(tokens) == any(r <= set(tokens) for r in got)


def test_one_bad_host_of_many_and_no_rules_from_chance(spark):
    """A host with a thousandth of the labelled URLs becomes a rule; chance makes none."""
    rnd = random.Random(3)
    chance = [(f"http://h{i % 400}.org/{i % 7}/x{i % 11}", rnd.random() < 0.25) for i in range(20000)]
    assert urlfilter.mine_rules(spark.createDataFrame(chance, "url string, bad boolean")) == []
    bad = [("http://evil.org/6/x1", True)] * 20 + [("http://rare.org/6/x1", True)] * 4
    assert urlfilter.mine_rules(spark.createDataFrame(chance + bad, "url string, bad boolean")) == [frozenset(["d:evil.org"])]


def test_labels_block_and_odd_tables(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.org/{'casino' if i % 2 else 'news'}/{i}") for i in range(60)] + [(None, None), (5, "http://h1.org/casino/5")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in range(40)] + [(None, 0, 1), (99, None, None)], "doc_id long, quality int, toxic int")
    rows = urlfilter.judge_urls(pages, labels).collect()
    assert len(rows) == 62 and all((r.verdict == "block") == ("casino" in r.path) for r in rows)
    assert urlfilter.judge_urls(pages.limit(0), labels).count() == 0
