"""python -m taxoweave.cli MODE INPUT REFERENCE OUTPUT"""

from __future__ import annotations

import argparse
import importlib
import time
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark import Accumulator
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT
from .operators import report, tree
from .plans import pipelines
from .sources import taxonomy


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Align the categories of an input taxonomy with a reference.")
    p.add_argument("mode", choices=["flat", "hierarchical", "automatic"])
    p.add_argument("input")
    p.add_argument("reference")
    p.add_argument("output", help="folder of the result document")
    p.add_argument("--confidence", type=float, default=DEFAULT.confidence)
    p.add_argument("--batch-size", type=int, default=DEFAULT.batch_size)
    p.add_argument("--candidates", type=int, default=DEFAULT.candidates)
    p.add_argument("--compat", action="store_true", help="reproduce the documented oddities")
    p.add_argument("--summary", help="folder of the summary")
    p.add_argument("--tree", help="folder of the input tree")
    p.add_argument("--unmatched", help="folder of a document of what is left over")
    p.add_argument("--matcher", help="module:function that answers a prompt with text; without it, matches are looked up offline")
    p.add_argument("--benchmark", type=int, default=1, help="runs to time")
    return p


def matcher(name: str) -> Callable[[str], str]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def counted(answer: Callable[[str], str], asked: Accumulator) -> Callable[[str], str]:
    def ask(prompt: str) -> str:
        asked.add(1)
        return answer(prompt)

    return ask


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    if not 0 <= a.confidence <= 1:
        raise SystemExit("--confidence lies between 0 and 1")
    spark = SparkSession.builder.getOrCreate()
    settings = replace(DEFAULT, confidence=a.confidence, batch_size=a.batch_size, candidates=a.candidates, compat=a.compat)
    read = lambda p: taxonomy.read_json(spark, p) if a.compat else taxonomy.read_json(spark, p).drop("id_is_text")
    inputs, refs = read(a.input), taxonomy.required(read(a.reference))
    asked = spark.sparkContext.accumulator(0)
    answer = None if a.matcher is None else counted(matcher(a.matcher), asked)
    for run in range(a.benchmark):
        began, before = time.time(), asked.value
        found = getattr(pipelines, a.mode)(inputs, refs, settings, answer)
        if a.mode == "hierarchical":
            found = found.join(inputs.select(F.col("id").alias("input_id"), "ord"), "input_id")
        for missing in ("reasoning",):
            if missing not in found.columns:
                found = found.withColumn(missing, F.col("processing_method"))
        found = found.persist()  # the document reads it several times
        found.count()
        took, calls = time.time() - began, asked.value - before
        if a.mode == "hierarchical":
            document = report.hierarchical_document(found, calls, took, datetime.now().isoformat())
        else:
            document = report.document(found, inputs, settings, refs.count(), calls, took, datetime.now().isoformat())
        taxonomy.write_document(document, a.output)
        print(f"run {run + 1}: {took:.2f} s")
    if a.summary:
        said = report.hierarchical_summary(document, settings.batch_size) if a.mode == "hierarchical" else report.summary(document)
        said.coalesce(1).write.mode("overwrite").text(a.summary)
    if a.unmatched and a.mode != "hierarchical":
        taxonomy.write_document(report.unmatched_only(document), a.unmatched)
    if a.tree:
        tree.build(inputs).select("id", "name", "path", "parent_id", "is_leaf", "children_count", "full_path").coalesce(1).write.mode("overwrite").json(a.tree)


if __name__ == "__main__":
    main()
