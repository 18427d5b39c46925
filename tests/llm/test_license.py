"""op5: base places by a plain scan, labels by a plain vote over all template positions."""

import re
from collections import defaultdict

import duckdb
import pytest

from lodestone.llm import license
from lodestone.llm.queries import op5_license_scan, oracle_sql
from tests.conftest import DATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text, templates=license.TEMPLATES, k=license.K):
    words = words_of(text)
    places, labels = [], set()
    for phrase, label in license.PHRASES:
        p = phrase.split()
        own = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    base, share = ",".join(sorted(labels)), 0.0
    for label, template in templates:
        t = template.split()
        at = defaultdict(set)
        for i in range(len(words) - k + 1):
            for j in range(len(t) - k + 1):
                if words[i : i + k] == t[j : j + k]:
                    at[i - j].add(j)
        span, last = set(), None
        for d in [*sorted(at), None]:
            if d is None or (last is not None and d - last > license.SLACK):
                covered = {x for j in span for x in range(j, j + k)}
                share = max(share, len(covered) / len(t))
                if len(covered) / len(t) >= license.COVER:
                    labels.add(label)
                span = set()
            if d is not None:
                span |= at[d]
                last = d
    score = 1.0 if places else share
    return len(words), len(places), min(places, default=None), max(places, default=None), base, ",".join(sorted(labels)), score


def check(rows, texts):
    for r in rows:
        want = plain(texts[r.doc_id])
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
        assert got[:6] == want[:6] and got[6] == pytest.approx(want[6]), r.doc_id


MIT = license.TEMPLATES[1][1]
TEXTS = [
    None, "", "Under the MIT License", "under the\nmit, license under the mit license", "Apache License, Version 2.0", "cc-by-nc 4 cc by\tnc", MIT.upper(),
    MIT.replace("obtaining a copy", "who obtains copies"), " ".join(MIT.split()[:10]), "x " * 3000 + MIT + " y" * 3000, "under the é mit license", "undér the mit license", "gnu " * 50,
    "This work is licensed under the GNU General Public License, version 3. " * 3,
]


def test_texts(spark):
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(TEXTS)], "doc_id long, text string, label string, score double")
    check(license.scan_licenses(df).collect(), dict(enumerate(TEXTS)))


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op5_license_scan(spark, DATA).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_repeated_and_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "under the mit license"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.labels) for r in license.scan_licenses(df).collect()) == [(False, ""), (False, ""), (True, "mit")]
    assert license.scan_licenses(df.limit(0)).count() == 0


CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
GPL = "This work is licensed under the GNU {}General Public License, version {}."
APACHE, LONG, BSD = (license.TEMPLATES[i][1] for i in (3, 7, 8))
NOTICES = [
    (CC.format(""), ""), (CC.format("-ShareAlike"), ""), (CC.format("-NonCommercial"), "cc-by-nc"), (CC.format("-Non-Commercial"), "cc-by-nc"), (CC.format("-NonCommercial").replace("4.0", "3.0"), "cc-by-nc"),
    (GPL.format("", 2), ""), (GPL.format("", 3), "gpl-3"), (GPL.format("Lesser ", 3), ""), (GPL.format("Affero ", 3), ""),
    (MIT, "mit"), (MIT.replace("deal in", "deal with"), ""), (APACHE, "apache-2"), (APACHE.replace("2 0", "1.1"), ""), (APACHE.replace("http www apache org licenses license", "https www mozilla org licenses license"), ""),
    (BSD, "bsd"), (BSD + " 1. ... 2. ...", "bsd"),
    (LONG.replace("version 3", "version 2"), ""), (LONG.replace("gnu general", "gnu lesser general"), ""), (LONG.replace("redistribute it", "pass it on"), "gpl-3"),
]


def test_deciding_words(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    rows = license.scan_licenses(df).collect()
    assert {r.doc_id: r.labels for r in rows} == {i: label for i, (_, label) in enumerate(NOTICES)}
    sql = f"create view documents as select * from (values {', '.join(f'({i}, $${t}$$)' for i, (t, _) in enumerate(NOTICES))}) v(doc_id, text)"
    base = duckdb.connect()
    base.execute(sql)
    got = base.sql(f"select doc_id, labels, round(score, 9) from ({oracle_sql()['op5_license_scan']}) order by doc_id").fetchall()
    assert got == [(r.doc_id, r.labels, round(r.score, 9)) for r in sorted(rows)]
