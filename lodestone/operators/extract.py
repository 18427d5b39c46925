"""Entities and facts of chunks ``(chunk_id, doc_id, ord, text)``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ENTITY_PATTERN, SENTENCE_END, WHITE_SPACE, strip

#: Rows whose texts are Python objects at a time, and entities that a task holds before it passes them on.
SLICE, HELD = 256, 50_000


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once: inside a lambda, what is written twice is made
    twice, and what does not depend on the element is made for each."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mentions(text: Column | str) -> Column:
    """Distinct capitalised words in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY_PATTERN), 0))


def heuristic_extraction(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``entities`` and ``facts(idx, fact, triplets)``: a fact is a sentence,
    its triplet links its first capitalised word to its last."""
    triplet = lambda own: F.when(
        F.size(own) > 0, F.array(F.struct(F.element_at(own, 1).alias("head"), F.lit("mentioned with").alias("rel"), F.element_at(own, -1).alias("tail")))
    ).otherwise(F.array().cast("array<struct<head:string,rel:string,tail:string>>"))
    fact = lambda x, i: F.struct(i.alias("idx"), strip(x).alias("fact"), _once(F.regexp_extract_all(x, F.lit(ENTITY_PATTERN), 0), triplet).alias("triplets"))
    facts = F.filter(F.transform(F.split("text", SENTENCE_END), fact), lambda f: f["fact"] != "")
    return chunks.withColumn("entities", mentions("text")).withColumn("facts", facts)


def extraction_violations(extracted: DataFrame) -> DataFrame:
    """One row per broken rule: no entity, no fact, a blank entity, an incomplete triplet."""
    hole = lambda t: (F.coalesce(t["head"], F.lit("")) == "") | (F.coalesce(t["rel"], F.lit("")) == "") | (F.coalesce(t["tail"], F.lit("")) == "")
    rules = {
        "no_entities": F.coalesce(F.size("entities"), F.lit(0)) <= 0,
        "no_facts": F.coalesce(F.size("facts"), F.lit(0)) <= 0,
        "blank_entity": F.exists("entities", lambda e: strip(F.coalesce(e, F.lit(""))) == ""),
        "bad_triplet": F.exists("facts", lambda f: F.exists(f["triplets"], hole)),
    }
    broken = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items())), lambda x: x.isNotNull())
    return extracted.select("chunk_id", F.explode(broken).alias("rule"))


def contained_entities(fact: Column, entities: Column) -> Column:
    """The entities that stand in a fact, case aside, in their order. The fact is lower-cased
    once and not for each entity: a long paragraph has very many of both."""
    return _once(F.lower(fact), lambda low: F.filter(entities, lambda e: F.contains(low, F.lower(e))))


def triplet_entities(triplets: Column, entities: Column) -> Column:
    """Heads and tails that are entities, letter by letter."""
    ends = F.flatten(F.transform(triplets, lambda t: F.array(t["head"], t["tail"])))
    return F.array_distinct(F.filter(ends, lambda e: F.array_contains(entities, e)))


def facts(extracted: DataFrame) -> DataFrame:
    """``(fact_id, chunk_id, doc_id, ord, idx, text, triplets, entities)``: each fact with the
    entities bound to it, by substring and then by triplet. The binding happens inside the
    chunk's row, so there is no join."""
    rows = extracted.select("chunk_id", "doc_id", "ord", "entities", F.explode("facts").alias("f"))
    bound = F.array_distinct(F.concat(contained_entities(F.col("f.fact"), F.col("entities")), triplet_entities(F.col("f.triplets"), F.col("entities"))))
    return rows.select(
        F.concat("chunk_id", F.lit("_fact_"), F.col("f.idx").cast("string")).alias("fact_id"), "chunk_id", "doc_id", "ord", F.col("f.idx").alias("idx"), F.col("f.fact").alias("text"), F.col("f.triplets").alias("triplets"), bound.alias("entities")
    )


def unbound_facts(found: DataFrame) -> DataFrame:
    return found.where(F.size("entities") == 0)


def fact_entities(found: DataFrame) -> DataFrame:
    """One row per fact and entity bound to it; facts without any fall out."""
    return found.select("*", F.explode("entities").alias("entity")).drop("entities", "triplets")


def heuristic_facts(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, doc_id, ord, idx, text, entities)``: what ``facts`` makes of
    ``heuristic_extraction``, of facts with entities, in one pass over a text: lambdas are not
    compiled by Spark and look for the mentions of a chunk anew for each use. Mentions are ASCII
    letters, and head and tail of a triplet stand in their fact, so that the substring decides."""
    names = ["chunk_id", "doc_id", "ord"]
    types = dict(chunks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, end = re.compile(ENTITY_PATTERN), re.compile(SENTENCE_END)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                b = batch.slice(start, SLICE)
                at, idx, said, offsets, bound = [], [], [], [0], []
                for row, text in enumerate(b.column("text").to_pylist()):
                    found = name.findall(text) if text else None
                    if not found:
                        continue
                    own = [(e, e.lower()) for e in dict.fromkeys(found)]
                    for i, fact in enumerate(end.split(text)):
                        low = fact.lower()
                        held = [e for e, x in own if x in low]
                        if held:
                            at.append(row)
                            idx.append(i)
                            said.append(fact.strip(WHITE_SPACE))
                            bound += held
                            offsets.append(len(bound))
                rows = pa.array(at, pa.int64())
                ents = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bound, pa.string()))
                yield pa.record_batch([*(b.column(c).take(rows) for c in names), pa.array(idx, pa.int32()), pa.array(said, pa.string()), ents], names=[*names, "idx", "text", "entities"])

    fields = ", ".join(f"{c} {types[c]}" for c in names)
    return chunks.select(*names, "text").mapInArrow(run, f"{fields}, idx int, text string, entities array<string>")


def first_mentions(chunks: DataFrame, chars: int) -> DataFrame:
    """``(doc_id, ord, chunk_text, pos, entity)``: of each task the first mention of each entity,
    with the first ``chars`` of its chunk. All that ``graph.entity_nodes`` needs of the heuristic's
    mentions, so that neither all mentions nor their texts are sorted and shuffled."""
    types = dict(chunks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first = re.compile(ENTITY_PATTERN), {}

        def passed() -> pa.RecordBatch:
            rows = list(first.values())
            docs, ords = (pa.array([r[0][i][1] for r in rows], t) for i, t in enumerate(kinds))
            rest = pa.array([r[2] for r in rows], pa.string()), pa.array([r[0][2] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())
            first.clear()
            return pa.record_batch([docs, ords, *rest], names=["doc_id", "ord", "chunk_text", "pos", "entity"])

        kinds = None
        for batch in batches:
            kinds = batch.column("doc_id").type, batch.column("ord").type
            for start in range(0, batch.num_rows, SLICE):
                b = batch.slice(start, SLICE)
                # as in Spark's structs, a null comes before all values
                places = zip(*([(x is not None, x) for x in b.column(c).to_pylist()] for c in ("doc_id", "ord")), strict=True)
                for place, text in zip(places, b.column("text").to_pylist(), strict=True):
                    for pos, e in enumerate(dict.fromkeys(name.findall(text) if text else ())):
                        key, at = e.lower(), (*place, pos)
                        if key not in first or at < first[key][0]:
                            first[key] = at, e, text[:chars]
                if len(first) >= HELD:
                    yield passed()
        if first:
            yield passed()

    fields = f"doc_id {types['doc_id']}, ord {types['ord']}, chunk_text string, pos int, entity string"
    return chunks.select("doc_id", "ord", "text").mapInArrow(run, fields)


def bound_entities(found: DataFrame) -> DataFrame:
    """``fact_entities`` of ``heuristic_facts``."""
    fact = F.concat("chunk_id", F.lit("_fact_"), F.col("idx").cast("string")).alias("fact_id")
    return found.select(fact, "chunk_id", "doc_id", "ord", "idx", "text", F.explode("entities").alias("entity"))
