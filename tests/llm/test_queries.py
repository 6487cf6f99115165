"""The registered queries against their SQL, and the pipeline's stages."""

import pytest

import corpus_pipeline
from ridgeline.llm import queries
from tests.compare import same
from tests.llm import frames


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(name, spark, folder, duck):
    same(queries.QUERIES[name](spark, folder), duck, queries.ORACLE_SQL[name])


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").dropDuplicates(["doc_id"])
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder).cache()
        assert after.columns == docs.columns
        assert 0 < after.count() <= before.count()
        assert after.join(docs, docs.columns, "left_semi").count() == after.count()
        before = after
    left = {r.doc_id for r in before.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert not any(labels[i].quality == 0 for i in left if i in labels)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left


def test_pipeline_takes_odd_rows(spark, folder):
    for docs in (frames.docs(spark), frames.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, folder)
            assert got.columns == docs.columns
            got.count()


def test_pipeline_keeps_texts_that_share_an_id(spark, folder):
    """Near duplicates: rows of one id and other texts are other documents; repeated rows are one."""
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"]
    a, b, c = frames.PROSE, " ".join(f"b{k}" for k in range(40)), " ".join(f"c{k}" for k in range(40))
    rows = [(1, a, "u"), (1, b, "u"), (2, b, "u"), (3, c, "u"), (3, c, "t"), (3, c, "t"), (None, c + " tail", "u"), (4, None, "u"), (4, None, "u"), (5, "", "u")]
    docs = spark.createDataFrame([(i, t, "en", s, 1, {"k": "v"}) for i, t, s in rows], "doc_id long, text string, lang string, source string, Document int, extra map<string,string>")
    got = sorted(((r.doc_id, r.text, r.source) for r in stage(spark, docs, folder).collect()), key=str)
    assert got == sorted([(1, a, "u"), (1, b, "u"), (None, c + " tail", "u"), (4, None, "u"), (5, "", "u")], key=str)


def test_pipeline_leaks_by_row(spark, tmp_path):
    stage = dict(corpus_pipeline.STAGES)["benchmark_decontamination"]
    spark.createDataFrame([(1, frames.PROSE)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "x " + frames.PROSE), (1, "clean"), (None, frames.PROSE), (None, "clean too"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in stage(spark, docs, f"file://{tmp_path}").collect()), key=str)
    assert got == sorted([(1, "clean"), (None, "clean too"), (2, None), (3, "")], key=str)


def test_chat_query_has_problems_and_levels(spark, folder):
    """What the SQL is compared on isn't empty of the method: every problem, levels beyond 1, every state."""
    rows = queries.QUERIES["op6_chat_format"](spark, folder).collect()
    assert {r.problems for r in rows} >= {"", "missing limit", "chars is no integer", "unknown tool", "malformed"}
    assert {0, 1, 2, 3} <= {r.level for r in rows} and {r.state for r in rows} >= {"linked", "open", "other"}
    assert len(rows) == len(spark.read.parquet(f"{folder}/conversations.parquet").where("role <> 'assistant' or role is null").collect()) + sum(r.state in ("orphan", "extra") for r in rows)
