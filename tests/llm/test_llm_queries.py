"""The registered queries and the pipeline at the smallest scale."""

import os

import corpus_pipeline
import pytest
from check_queries import compare, connect, entry
from fixtures import documents, near_texts, odd_texts

from treeledger.llm import queries

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), SF, name) is None


@data
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_has_a_row_for_each_of_its_table(spark, name):
    table = "pages" if name == "op10_page_text" else "documents"
    assert entry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline_against_its_parts(spark, tmp_path):
    import random

    from test_benchmark import direct as benchmark_hits
    from test_near_duplicates import direct_classes, direct_print
    from test_secrets_and_repetition import direct as quality, plain_base

    from treeledger.llm.repetition import Rules
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(14))
    texts = [t for t in odd_texts() if t is None or len(t) < 3000] + near_texts(rng, 8)
    texts += [f"{t} password = {'ab12' * 5}" for t in near_texts(rng, 3)] + [f"{passage} {t}" for t in near_texts(rng, 2)]
    docs = documents(spark, texts, slot="mine", _fingerprint=3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    rows = [r for r in docs.collect() if quality(r.text, Rules())[-1]]
    classes = direct_classes([direct_print(r.text) for r in rows])
    leaders = {}
    for r, c in zip(rows, classes):
        if c not in leaders or (r.doc_id is not None and (leaders[c].doc_id is None or r.doc_id < leaders[c].doc_id)):
            leaders[c] = r
    left = [r for r in leaders.values() if not benchmark_hits(r.text, [(5, passage)], 10)[1]]
    assert 0 < len(left) < len(leaders) < len(rows)

    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == docs.columns
    masked = current.collect()
    assert sorted(r.doc_id for r in masked) == sorted(r.doc_id for r in left)
    assert any("[SECRET]" in r.text for r in masked)
    for r in masked:
        assert not plain_base(r.text) and r.n_chars == len(r.text)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in packed) == sorted((r.doc_id, len(r.text.split())) for r in masked)
