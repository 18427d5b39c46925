"""Sparse lists and weights are made without a shuffle of pairs or postings."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lodestone.operators import index, retrieve


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sparse_top_equals_the_top_of_all_scores(spark):
    rnd = random.Random(1)
    text = lambda n: " ".join(rnd.choices("abcdefghijklmnop", k=n))
    rows = [(i, text(rnd.randrange(12))) for i in range(300)] + [(5, "a b c"), (5, "a"), (None, "a b"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(q, text(4)) for q in range(520)] + [(3, "a z"), (None, "b c"), (999, "zz")], "qid long, text string")
    terms = retrieve.query_terms(asked, "qid", "text")
    posted = index.postings(docs, "doc_id", "text")
    want = sorted(map(repr, retrieve.top(retrieve.sparse_scores(posted, terms), 7).select("qid", "doc_id", "score", "rk").collect()))
    got = retrieve.sparse_top(retrieve.document_terms(docs, "doc_id", "text"), terms, 7)
    assert sorted(map(repr, got.select("qid", "doc_id", "score", "rk").collect())) == want
    got = retrieve.sparse_top(retrieve.posted_terms(posted, terms), terms, 7)
    assert sorted(map(repr, got.select("qid", "doc_id", "score", "rk").collect())) == want
    assert retrieve.sparse_top(posted.groupBy("doc_id").agg(F.collect_list("term").alias("terms")), terms.limit(0), 7).count() == 0


def test_terms_are_counted_where_the_text_is(spark):
    rows = [(1, "a a b"), (2, "a c"), (2, "c c"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = index.term_counts(docs, "doc_id", "text")
    assert {tuple(r) for r in counts.select("term", "doc_id", "tf").collect()} == {("a", 1, 2), ("b", 1, 1), ("a", 2, 1), ("c", 2, 3)}
    assert "hashpartitioning(doc_id" in _plan(counts) and ", term#" not in _plan(counts).split("hashpartitioning(")[1].split(")")[0]
    df, tf = Counter(a=2, b=1, c=1), {("a", 1): 2, ("b", 1): 1, ("a", 2): 1, ("c", 2): 3}
    got = {(r.term, r.doc_id): r.w for r in index.weighted_postings(docs, "doc_id", "text").collect()}
    assert got == {k: round((1 + math.log(n)) * math.log(3 / df[k[0]]), 6) for k, n in tf.items()}
