"""The pipeline's stages, each on its own input, and the whole run against its stages."""

import collections

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline", exc_type=ModuleNotFoundError)

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, docs, FOLDER).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_order_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram jaccard join", "secret scans", "mixing sources to target weights", "packing"]
    assert all(a.schema == b.schema for a, b in steps[:-1])


def test_quality_drops_what_the_rules_reject(steps):
    from paperloom.llm.quality_rules import quality_rules

    before, after = steps[0]
    kept = {r.doc_id for r in quality_rules(before).filter("kept").collect()}
    assert rows(after) == rows(before.filter(F.col("doc_id").isin(*kept)))


def test_one_of_each_component_stays(steps):
    from paperloom.llm.ngram_join import jaccard_components

    before, after = steps[1]
    found = jaccard_components(before).collect()
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in found} and after.count() == len({r.component_id for r in found})


def test_secrets_go(steps):
    from paperloom.llm.secret_scan import all_spans

    before, after = steps[2]
    assert before.count() == after.count()
    assert all(not all_spans(r.text) for r in after.collect()) and after.filter(F.length("text") != F.col("n_chars")).isEmpty()
    clean = {r.doc_id: r.text for r in before.collect() if not all_spans(r.text)}
    assert {r.doc_id: r.text for r in after.collect() if r.doc_id in clean} == clean


def test_mixing_repeats_as_taken(steps):
    from paperloom.llm.mixing import mix_to_weights

    before, after = steps[3]
    want = {r.doc_id: r.copies for r in mix_to_weights(before).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == want


def test_whole_run(spark, steps):
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows(corpus_pipeline.run(spark, FOLDER).select(*keys)) == rows(steps[-1][1].select(*keys))


def test_odd_tables_pass_through(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some text that is long enough to have ten words in it", "en", None, 5), (3, "x " * 30, "en", "a", 1)], schema)
    for df in (odd, odd.limit(0)):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, df, FOLDER)
            assert out.count() >= 0 and (name == "packing" or out.columns == odd.columns)
