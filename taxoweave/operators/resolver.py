"""Requests to an external matcher, its answers, and an offline matcher with the same interface."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity

ANSWER = "matches array<struct<input_name:string,input_id:string,index:int,match_id:string,matched_id:string,match_name:string,confidence:string,reasoning:string>>"


class Matcher(Protocol):
    """Answers one request with text that holds a JSON object with ``matches``."""

    def __call__(self, prompt: str) -> str: ...


def prompts(batched: DataFrame, refs: DataFrame, by: list[str], most: int = 100) -> DataFrame:
    """One prompt for each batch: its inputs and the first references of its branch, a line each.

    batched: by, ord, name; refs: the branch columns of ``by`` if any, ord, id, name."""
    lines = F.array_sort(F.collect_list(F.struct("ord", "name")))
    inputs = batched.groupBy(*by).agg(lines.alias("l"), F.count("*").alias("n"))
    inputs = inputs.withColumn("inputs", F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["name"])), "\n")).drop("l")
    shared = [c for c in by if c in refs.columns]
    if "place" in refs.columns:
        first = refs.where(F.col("place") <= most)
    elif shared:  # cut before they are listed
        first = refs.withColumn("__n", F.row_number().over(Window.partitionBy(*shared).orderBy("ord", "id", "name"))).where(F.col("__n") <= most)
    else:
        first = refs.orderBy("ord", "id", "name").limit(most)
    listed = first.groupBy(*shared).agg(F.array_sort(F.collect_list(F.struct("ord", "id", "name"))).alias("r"))
    listed = listed.select(*shared, F.array_join(F.transform(F.slice("r", 1, most), lambda x: F.concat(F.lit("ID: "), x["id"], F.lit(", Name: "), x["name"])), "\n").alias("refs"))
    rows = inputs.join(listed, shared, "left") if shared else inputs.crossJoin(listed)  # one row of references
    ask = F.lit('Answer with JSON only: {"matches": [{"index": 1, "matched_id": "id or null", "confidence": 0.0}]}')
    return rows.select(*by, "n", F.concat(F.lit("Match these categories:\n"), F.col("inputs"), F.lit("\n\nwith these:\n"), F.coalesce("refs", F.lit("")), F.lit("\n\n"), ask).alias("prompt"))


def json_of(answer: Column) -> Column:
    """The fenced block if there is one, else from the first brace to the last."""
    fenced = F.regexp_extract(answer, r"(?s)```json\s*(.*?)```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(answer, r"(?s)\{.*\}", 0))


def parsed(answers: DataFrame, column: str = "answer") -> DataFrame:
    """answers with pos and the fields of each match; a broken answer has none."""
    matches = F.from_json(json_of(F.col(column)), ANSWER)["matches"]
    return answers.withColumn("__m", F.explode(F.coalesce(F.transform(matches, lambda x, i: F.struct(i.alias("pos"), x.alias("m"))), F.array().cast("array<struct<pos:int,m:struct<input_name:string,input_id:string,index:int,match_id:string,matched_id:string,match_name:string,confidence:string,reasoning:string>>>")))).select(*[c for c in answers.columns if c != column], "__m.pos", "__m.m.*").withColumn("confidence", similarity.confidence(F.col("confidence")))


def missing_fields(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Per answer: matches, and how many lack a name, an id, a confidence or a reason."""
    m = F.from_json(json_of(F.col(column)), ANSWER)["matches"]
    lacks = F.filter(m, lambda x: x["input_name"].isNull() | x["match_id"].isNull() | x["match_name"].isNull() | x["confidence"].isNull() | x["reasoning"].isNull())
    return answers.withColumn("matches", F.coalesce(F.size(m), F.lit(0))).withColumn("incomplete", F.coalesce(F.size(lacks), F.lit(0)))


def by_index(batch: DataFrame, answers: DataFrame, refs: DataFrame) -> DataFrame:
    """Rows of batches (batch_id, pos from 1, input) with the answer of their number; the last of
    several counts, numbers outside the batch don't, and rows without an answer need review."""
    last = answers.where("index >= 1").groupBy("batch_id", "index").agg(F.max_by(F.struct("matched_id", "confidence"), "pos").alias("a")).select("batch_id", F.col("index").alias("pos"), "a.*")
    names = refs.select(F.col("id").alias("matched_id"), F.col("name").alias("match_name"))
    rows = batch.join(last, ["batch_id", "pos"], "left").join(names, "matched_id", "left")
    return rows.select("batch_id", "pos", "input", F.col("matched_id").alias("match_id"), "match_name", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("confidence").isNull(), "missing").otherwise("batch").alias("processing_method")).withColumns(review_flags(F.col("confidence")))


def by_id(batch: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of a batch (input_id, ...) with the last answer that names their id."""
    last = answers.where("input_id is not null").groupBy("input_id").agg(F.max_by(F.struct("match_id", "match_name", "confidence", "reasoning"), "pos").alias("a")).select("input_id", "a.*")
    return batch.join(last, "input_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def review_flags(confidence: Column) -> dict[str, Column]:
    return {"is_exact_match": confidence >= 0.95, "needs_review": confidence < 0.7}


def resolve(requests: DataFrame, matcher: Callable[[str], str], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """requests (with prompt) with answer and error. Each partition asks by itself; a request is
    tried ``tries`` times, and one that fails gives a row with its error instead of ending the task."""
    keep = [f for f in requests.schema if f.name != "prompt"]

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            answers, errors = [], []
            for prompt in pdf["prompt"]:
                answer, error = None, None
                for k in range(tries):
                    try:
                        answer, error = matcher(prompt), None
                        break
                    except Exception as e:  # the service's own errors
                        error = str(e)
                        if k + 1 < tries:
                            time.sleep(wait)
                answers.append(answer), errors.append(error)
            yield pdf.drop(columns="prompt").assign(answer=answers, error=errors)

    columns = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["answer string", "error string"])
    return requests.mapInPandas(run, columns)


def offline(candidates: DataFrame, least: float = 0.0) -> DataFrame:
    """The answer without a service: each input's best candidate, its score as confidence."""
    best = candidates.groupBy("input").agg(F.min(F.struct((-F.col("score")).alias("s"), "ref_ord", "ref")).alias("b"))
    return best.select("input", F.col("b.ref").alias("match_name"), similarity.confidence(-F.col("b.s")).alias("confidence")).where(F.col("confidence") >= least)
