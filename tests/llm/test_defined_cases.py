"""All queries over empty tables, and over tables with null rows, repeated rows and columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from lodestone import llm

TABLES = ("documents", "chunks", "chunk_vectors", "size_limits", "glossary")
CLASHING = ("cls", "key", "label", "n", "group_doc_id", "scope", "rank", "a", "b", "node", "titles", "digest", "salt", "w", "entity", "pivot", "payload")
QUERIES = llm.queries()


def written(spark, sf, root, change):
    for t in TABLES:
        change(spark.read.parquet(f"{sf}/{t}.parquet")).write.parquet(f"{root}/{t}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    return written(spark, sf, tmp_path_factory.mktemp("empty"), lambda d: d.limit(0))


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    def change(d):
        few = d.limit(60)
        void = d.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in d.schema])
        return few.unionByName(few.limit(10)).unionByName(void).unionByName(void).withColumns({c: F.lit("x") for c in CLASHING})

    return written(spark, sf, tmp_path_factory.mktemp("odd"), change)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(name, spark, empty):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(name, spark, odd):
    df = QUERIES[name](spark, odd)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
