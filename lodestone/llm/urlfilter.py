"""URL verdicts: host rules first, then association rules mined by FP-growth.

Host rules are given; the longest that fits wins. For all other URLs Spark's FP-growth
mines token combinations of labelled URLs together with a token for bad ones. Combinations
that imply the bad token with enough support and confidence become rules, those whose
subset does as well are pruned, and a URL is blocked if its tokens hold a rule's. Rules are
found by an inverted index from each rule's rarest token.

The support is low, so that a single bad host becomes a rule in a large table too; what
keeps chance out is the lower end of the confidence's interval (Wilson, 3 standard errors),
which must exceed the share of bad URLs by the lift.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: A rule needs ``LEAST`` bad URLs and a share of ``SUPPORT`` of all labelled ones. The share
#: bounds the number of combinations, whatever the number of rows.
BAD, SUPPORT, LEAST, CONFIDENCE, LIFT, Z = "=bad", 0.0005, 5, 0.6, 1.2, 3.0
_URL = r"^[\s\S]*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


_parse = re.compile(r"(?s)^(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?")


def url_tokens(url: str | None) -> list[str]:
    """Distinct tokens: scheme, domain, its end and its other labels, path segments with
    digits folded, and names of query parameters."""
    m = _parse.match(url or "")
    if not m:
        return []
    labels = m[2].lower().split(".")
    out = [f"s:{m[1].lower()}", f"t:{labels[-1]}", f"d:{'.'.join(labels[-2:])}", *(f"h:{x}" for x in labels[:-2])]
    out += [f"p:{re.sub('[0-9]+', '0', x)}" for x in m[3].split("/") if x]
    out += [f"q:{x.partition('=')[0]}" for x in (m[4] or "").split("&") if x]
    return sorted(set(out))


def _tokens(urls: DataFrame, *carry: str) -> DataFrame:
    kinds = dict(urls.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = pa.array([url_tokens(u) for u in b.column("url").to_pylist()], pa.list_(pa.string()))
            yield pa.record_batch([*(b.column(c) for c in carry), tokens], names=[*carry, "tokens"])

    return urls.select("url", *carry).mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in carry), "tokens array<string>"]))


def lower_end(hits: int, n: int) -> float:
    """The lower end of Wilson's interval for hits of n."""
    p = hits / n
    return (p + Z * Z / (2 * n) - Z * math.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def mine_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, least: int = LEAST) -> list[frozenset[str]]:
    """Token sets that imply a bad URL, from ``labelled(url, bad boolean)``.

    Their number is bounded by the combinations that reach the support, not by the rows."""
    from pyspark.ml.fpm import FPGrowth

    baskets = _tokens(labelled, "bad").select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    baskets = materialize(baskets, "baskets")
    n, bad = baskets.agg(F.count("*"), F.count(F.when(F.array_contains("items", BAD), 1))).first()
    least = max(least, math.ceil(support * n))
    if bad < least:
        return []
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=confidence).fit(baskets)
    found = []
    for r in model.associationRules.where(F.element_at("consequent", 1) == BAD).select("antecedent", "support", "confidence").toLocalIterator():
        hits = round(r.support * n)
        if lower_end(hits, round(hits / r.confidence)) >= lift * (bad / n):
            found.append(r.antecedent)
    rules = sorted(map(frozenset, found), key=lambda r: (len(r), sorted(r)))
    kept: list[frozenset[str]] = []
    for r in rules:
        if not any(k <= r for k in kept):
            kept.append(r)
    return kept


def matcher(rules: list[frozenset[str]]):
    """Whether a token list holds a rule, by an index from one token of each rule."""
    uses: dict[str, int] = {}
    for r in rules:
        for t in r:
            uses[t] = uses.get(t, 0) + 1
    index: dict[str, list[frozenset[str]]] = {}
    for r in rules:
        index.setdefault(min(r, key=lambda t: (uses[t], t)), []).append(r)

    def holds(tokens: list[str]) -> bool:
        own = set(tokens)
        return any(r <= own for t in tokens for r in index.get(t, ()))

    return holds


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages(page_id, url, ...)``.

    A page is labelled by the row of ``labels(doc_id, quality, toxic)`` with its id, bad if
    any of its labels has quality 0 or toxic 1. Null or malformed URLs have an empty host
    and path and no tokens: no rule fits, the method allows them. Repeated pages and null
    ids are judged row by row. Without labels the method allows all. Further columns are
    ignored; an empty table gives an empty result.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.coalesce(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)), F.lit(False)).alias("bad"))
    holds = matcher(mine_rules(pages.join(bad, "page_id").select("url", "bad")))
    fields = ["page_id", "url", "blocked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [holds(url_tokens(u)) for u in b.column("url").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(hit, pa.bool_())], names=fields)

    rows = pages.mapInArrow(run, "page_id long, url string, blocked boolean")
    rows = rows.select("page_id", "blocked", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", "blocked", rule.alias("rule"), verdict.alias("v"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("v", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
