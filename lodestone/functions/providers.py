"""Model providers: what the engine asks of models, behind one small interface.

The defaults are deterministic and need no network. ``HttpModel`` sends prompts to a
completion endpoint from the executors, one connection per task, and its transport can be
replaced in tests.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION = 64


def hash_embeddings(rows: DataFrame, key: str, text: str, dim: int = DIMENSION) -> DataFrame:
    """``(key, vec)``: signed counts of hashed tokens, of unit length where there are any."""
    import re

    word = re.compile("[a-z0-9]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, dim))
            for i, t in enumerate(b.column("text").to_pylist()):
                for w in word.findall((t or "").lower()):
                    h = zlib.crc32(w.encode())
                    out[i, h % dim] += 1 if h >> 31 else -1
            length = np.sqrt((out**2).sum(axis=1, keepdims=True))
            out = (out / np.where(length == 0, 1, length)).astype(np.float32)
            at = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dim)
            yield pa.record_batch([b.column("key"), pa.ListArray.from_arrays(at, pa.array(out.ravel()))], names=[key, "vec"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"{key} {kind}, vec array<float>")


def post_json(url: str, body: dict, timeout: float) -> dict:
    from urllib.request import Request, urlopen

    data = json.dumps(body).encode()
    with urlopen(Request(url, data, {"Content-Type": "application/json"}), timeout=timeout) as answer:  # noqa: S310
        return json.load(answer)


@dataclass(frozen=True)
class HttpModel:
    """A completion endpoint that takes model, prompt and options and answers ``response``."""

    url: str
    model: str
    temperature: float = 0.0
    max_tokens: int = 120
    timeout: float = 60.0
    transport: Callable[[str, dict, float], dict] = post_json

    def complete(self, rows: DataFrame, prompt: Column, out: str = "response") -> DataFrame:
        """``rows`` with the model's answers. The result should be stored before it is used
        twice: a plan that reads it twice asks the model twice."""
        asked = rows.withColumn("_prompt", prompt)
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` string"])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                body = {"model": self.model, "stream": False, "options": {"temperature": self.temperature, "num_predict": self.max_tokens}}
                answers = [self.transport(self.url, body | {"prompt": p}, self.timeout).get("response") for p in frame.pop("_prompt")]
                yield frame.assign(**{out: answers})

        return asked.mapInPandas(run, schema)


def intent_prompt(text: Column) -> Column:
    return F.concat(
        F.lit('Say how the facts behind this question combine and what it asks for. Reply with JSON only: {"topology": "Sequential" or "Parallel", "semantic": "HUM", "LOC" or "OTHER"}.\nQuestion: '), text
    )


def extraction_prompt(text: Column) -> Column:
    return F.concat(
        F.lit('List the named entities of this passage and its facts as plain sentences. Reply with JSON only: {"entities": [string], "facts": [{"fact": string, "triplets": [[head, relation, tail]]}]}. Keep names and numbers as written.\nPassage: '), text
    )


def typing_prompt(entity: Column, context: Column, labels: tuple[str, ...]) -> Column:
    return F.concat(F.lit(f'Which of {", ".join(labels)} is this entity? Reply with JSON only: {{"type": label}}.\nEntity: '), entity, F.lit("\nContext: "), context)


def anchor_prompt(query: Column, proposition: Column) -> Column:
    return F.concat(F.lit("How much does this statement help to answer the question? Reply with one number from 0 to 1 and nothing else.\nQuestion: "), query, F.lit("\nStatement: "), proposition)
