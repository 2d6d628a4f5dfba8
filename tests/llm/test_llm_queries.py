import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sheaf.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    numbers = [int(name[2:].split("_")[0]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 11))
    assert set(QUERIES) < set(entry.queries()) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = sorted(want.columns)
    assert sorted(map(str, got[key].itertuples(index=False, name=None))) == sorted(map(str, want[key].itertuples(index=False, name=None)))


CONTRACT = {
    "op1": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2": "doc_id held_out score predicted",
    "op4": "doc_id keep_id group_size kept text_sha256",
    "op6": "doc_id n_shingles component_id kept",
    "op7": "doc_id piece start length ids_crc32 sequence_id offset",
    "op8": "doc_id held_out lang_pred score",
    "op9": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op10": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    out = QUERIES[name](spark, FOLDER)
    assert set(CONTRACT.get(name.split("_")[0], "doc_id").split()) <= set(out.columns)
    assert out.count() >= 200


def test_pipeline(spark):
    """Every stage keeps the columns of documents and only rows of its predecessor."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, before = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER)
        assert after.columns == names
        assert after.join(before, "doc_id", "left_anti").count() == 0
        assert 0.5 * before.count() <= after.count() <= before.count()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER)
    assert packed.select("doc_id").distinct().count() == before.count()
    assert corpus_pipeline.run(spark, FOLDER).count() == packed.count()


def test_pipeline_on_odd_rows(spark, odd_extended, none):
    for frame in (odd_extended, none):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, FOLDER).count() <= max(frame.count() * 200, 0)
