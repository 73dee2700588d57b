import pytest

from reachlens.llm.queries import prepare


@pytest.fixture(autouse=True)
def workers(spark):
    prepare(spark)


@pytest.fixture
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
