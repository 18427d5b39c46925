"""op7 against all windows of all texts."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from lodestone.llm import decontam
from lodestone.llm.queries import op7_decontamination
from tests.conftest import DATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def grams(words, n):
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(docs, items, k=5, least=0.8):
    out = {}
    for d, text in docs:
        words = words_of(text)
        for i, item in items:
            own = words_of(item)
            if i is None or not own or not words:
                continue
            n, w = min(k, len(own)), len(own)
            target = grams(own, n)
            starts = range(max(1, len(words) - w + 1))
            best = None
            for s in starts:
                g = grams(words[s : s + w], n)
                if g and sum((g & target).values()) >= least * sum(target.values()):
                    x = similarity(g, target)
                    if x >= least and (best is None or x > best[0]):
                        best = (x, s)
            if best:
                out[d, i] = (round(best[0], 9), best[1])
    return out


def found(df):
    return {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in df.collect()}


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = found(op7_decontamination(spark, DATA))
    assert got and got == brute(docs, items)


def test_edited_passages(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=n))) for i, n in enumerate((60, 40, 90, 12, 5, 3, 1))]
    docs = []
    for d in range(60):
        own = items[d % 5][1].split()
        for _ in range(d // 5 % 3):
            own[rnd.randrange(len(own))] = "edited"
        if d % 4 == 0:
            del own[rnd.randrange(len(own))]
        docs.append((d, " ".join(rnd.choices(vocabulary, k=30) + own + rnd.choices(vocabulary, k=30))))
    docs += [(100, items[0][1].upper().replace(" ", ", ")), (101, items[5][1]), (102, " ".join([items[3][1]] * 40)), (103, None), (104, "")]
    spark_docs = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, similarity int")
    spark_items = spark.createDataFrame([*items, (None, "w1"), (50, None), (51, "--")], "item_id long, text string")
    got = found(decontam.contamination(spark_docs, spark_items))
    want = brute(docs, items)
    missed = {p for p in want if p not in got}
    assert not missed and got == want
    kept = {r.doc_id for r in decontam.drop_contaminated(spark_docs, spark_items).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.drop_contaminated(spark_docs, spark_items).columns == spark_docs.columns


def test_items_in_blocks_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d e f", "b c d e f g", "x"])], "item_id long, text string")
    whole = found(decontam.contamination(docs, items))
    monkeypatch.setattr(decontam, "ITEM_BYTES", 1)
    assert found(decontam.contamination(docs, items)) == whole and len(whole) == 3
    assert decontam.contamination(docs.limit(0), items).count() == 0
    assert decontam.contamination(docs, items.limit(0)).count() == 0
    assert decontam.drop_contaminated(docs, items.limit(0)).count() == 2


def test_repeated_words_in_a_long_item(spark):
    rnd = random.Random(7)
    item = [f"w{i}" for i in range(300)]
    docs, near = [], []
    for d in range(12):
        at = rnd.randrange(20, 250)
        docs.append((d, " ".join(rnd.choices(item, k=40) + item[:at] + ["mask"] * 28 + item[at + 28 :] + rnd.choices(item, k=40))))
    for d in range(12, 24):  # few words, so that counts decide
        near.append((d, " ".join(rnd.choices("abc", k=20)) + " x " + " ".join(rnd.choices("ab", k=12))))
    items = [(0, " ".join(item)), (1, "a b a b a b a b a b a b"), (2, "c"), (3, "a a a a a a a a"), (4, near[0][1])]
    got = found(decontam.contamination(spark.createDataFrame(docs + near, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs + near, items) and {(d, 0) for d in range(12)} <= got.keys()


@pytest.mark.parametrize("together", [1 << 20, 40, 1])
def test_shared_phrases_and_long_texts_in_small_groups(monkeypatch, together):
    """Shingles that every item holds, one text that holds them very often, tiny groups."""
    monkeypatch.setattr(decontam, "TOGETHER", together)
    rnd = random.Random(11)
    phrase = "choose the best answer to the question below and explain"
    items = [(i, " ".join([phrase, *(f"t{rnd.randrange(60)}" for _ in range(rnd.randrange(1, 30))), phrase])) for i in range(30)]
    items += [(30, phrase), (31, " ".join([phrase] * 4)), (32, items[3][1])]
    docs = [(0, " ".join([phrase] * 60)), (1, " and ".join(t for _, t in items)), (2, items[5][1] + " t1"), (3, phrase), (4, " ".join(f"t{rnd.randrange(60)}" for _ in range(300)))]
    block = decontam.Benchmark(items, decontam.K, decontam.SIMILARITY)
    got = {(docs[r][0], block.ids[i]): (round(x, 9), at) for r, i, x, at in block.matches(pa.array([t for _, t in docs]))}
    assert got == brute(docs, items) and len(got) > 30
