"""Model-backed counterparts of the deterministic defaults.

``model`` is anything with ``complete(rows, prompt, out)``, such as ``HttpModel``. Answers
are written once before they are read, so a model is asked once per row; an answer that
breaks its contract raises an error that names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import providers as P
from ..functions.text import json_object, strip
from ..sources.store import materialize
from .extract import extraction_violations
from .intent import validated_intent
from .rank import checked_scores

ANSWER = "entities array<string>, facts array<struct<fact:string,triplets:array<array<string>>>>"


def _asked(model, rows: DataFrame, prompt: Column, tag: str) -> DataFrame:
    return materialize(model.complete(rows, prompt, "response"), tag)


def model_intent(model):
    """A classifier of ``questions(qid, text)`` in the place of the heuristic one."""

    def classify(questions: DataFrame) -> DataFrame:
        rows = _asked(model, questions, P.intent_prompt(F.col("text")), "intent").withColumn("answer", json_object("response"))
        return validated_intent(rows, "answer").drop("response", "answer")

    return classify


def model_extraction(model, strict: bool = True):
    """An extractor of ``chunks(chunk_id, ..., text)``; facts and triplets become structs.

    ``strict`` raises on the first broken rule of ``extraction_violations``."""

    def extract(chunks: DataFrame) -> DataFrame:
        rows = _asked(model, chunks, P.extraction_prompt(F.col("text")), "extraction")
        said = F.from_json(json_object("response"), ANSWER)
        whole = lambda t: F.size(t) >= 3
        triplets = lambda f: F.transform(F.filter(F.coalesce(f["triplets"], F.array().cast("array<array<string>>")), whole), lambda t: F.struct(t[0].alias("head"), t[1].alias("rel"), t[2].alias("tail")))
        facts = F.transform(F.col("a.facts"), lambda f, i: F.struct(i.alias("idx"), strip(f["fact"]).alias("fact"), triplets(f).alias("triplets")))
        entities = F.array_distinct(F.filter(F.transform(F.col("a.entities"), strip), lambda e: e != ""))
        out = rows.withColumn("a", said).select(*chunks.columns, entities.alias("entities"), F.filter(facts, lambda f: f["fact"] != "").alias("facts"))
        if strict and (first := extraction_violations(out).first()):
            raise ValueError(f"{first.chunk_id}: {first.rule}")
        return out

    return extract


def model_types(model, entities: DataFrame, cache: DataFrame, labels: tuple[str, ...], chars: int = 220) -> DataFrame:
    """``(id, canonical, text, label)``: only entities without an allowed cached label are
    asked about, each once. The new labels can be added to the cache."""
    known = cache.where(F.col("label").isin(*labels)).select("canonical", "label")
    misses = entities.join(known, "canonical", "left_anti")
    rows = _asked(model, misses, P.typing_prompt(F.col("text"), F.substring("context", 1, chars), labels), "types")
    label = F.upper(strip(F.get_json_object(json_object("response"), "$.type")))
    bad = F.raise_error(F.concat(F.lit("not an allowed type: "), F.coalesce("response", F.lit("none")))).cast("string")
    fresh = rows.select("id", "canonical", "text", F.when(label.isin(*labels), label).otherwise(bad).alias("label"))
    return entities.join(known, "canonical").select("id", "canonical", "text", "label").unionByName(fresh)


def model_scores(model):
    """Scores of ``props(qid, id)`` in the place of token overlap."""

    def score(props: DataFrame, questions: DataFrame, texts: DataFrame, chars: int = 420) -> DataFrame:
        rows = props.select("qid", "id").join(texts.select("id", F.substring("text", 1, chars).alias("statement")), "id").join(questions.select("qid", "text"), "qid")
        rows = _asked(model, rows, P.anchor_prompt(F.col("text"), F.col("statement")), "scores")
        return checked_scores(rows, "response").select("qid", "id", "s_sem")

    return score


def model_answers(model):
    """``(qid, answer)`` of ``prompts(qid, prompt)``."""

    def answer(prompts: DataFrame) -> DataFrame:
        return _asked(model, prompts, F.col("prompt"), "answers").select("qid", strip("response").alias("answer"))

    return answer

