"""The corpus pipeline: documents pass through five stages, each written and read again before the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from atomweave.llm import registry
from atomweave.llm.common import scratch
from atomweave.session import remove, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = registry.STAGES

#: No stage's result can be said in SQL as a whole (a trained model decides the first); tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what each keeps is written to the shared folder as Parquet and read by the next.
    What a stage wrote on its way, and its predecessor's rows, are removed once its own rows are written."""
    path = f"{shared_folder(spark)}/atomweave/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        here = f"{path}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            remove(spark, before)
        before = here
    return docs
