from __future__ import annotations

import pytest

from tests.llm.data import DOCS, ODD, SCHEMA


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(DOCS)


@pytest.fixture(scope="session")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = "spans blob copy copies shard slot component_id sequence_id tree n_tokens a v u _text nid fingerprint score"
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).select("*", *[F.lit("x").alias(n) for n in names.split()])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
