"""The registered queries against SQL, and each stage of the pipeline against brute force, on the smallest tables."""

from collections import Counter

import corpus_pipeline
import oracle
import pytest
from docaudit.llm import queries, quality, source_mixing
from docaudit.llm.common import held_out
from pyspark.sql import functions as F
from test_copies import brute_components, brute_lines

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_against_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(FOLDER), FOLDER, queries.RUNS[name], queries.SQL[name]) is None


def test_queries_have_a_row_per_document(spark):
    ids = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    for name in ("op2_ngram_join", "op5_toxicity", "op9_quality", "op10_pseudonyms"):
        assert Counter(r.doc_id for r in queries.RUNS[name](spark, FOLDER).select("doc_id").collect()) == Counter(ids), name


def test_stages(spark, tmp_path):
    names = ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], FOLDER).write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(t.columns == columns for t in tables[:5])
    raw, good, lined, single, mixed, pieces = ([tuple(r) for r in t.select("doc_id", *([] if i == 5 else ["text"])).collect()] for i, t in enumerate(tables))
    model = quality.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), held_out(F.col("k"), 5, 0))
    kept = {r.doc_id for r in quality.score(docs, model).filter("score >= 0.3").collect()}
    assert {i for i, _ in good} == kept and dict(good).items() <= dict(raw).items()
    assert sorted(lined) == sorted(brute_lines(good, "none", 10))
    assert all(r.n_chars == len(r.text) for r in tables[2].collect())
    assert sorted(i for i, _ in single) == sorted(k for _, k, n, c in brute_components(lined, 80) if c == k)
    plan = {r.doc_id: r.copies for r in source_mixing.mixing_plan(tables[3]).collect()}
    assert Counter(i for i, _ in mixed) == Counter({i: n for i, n in plan.items() if n})
    assert {i for (i,) in pieces} == {i for i, _ in mixed} and tables[5].filter("NOT round_trip").isEmpty()


def test_one_row_of_a_repeated_id_goes_alone(spark, docs):
    x, y = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    rows = [(3, x), (7, x), (7, y), (9, y), (11, None), (11, x), (None, x)]
    left = corpus_pipeline.keep_one_of_each(spark, docs(rows), FOLDER)
    assert left.columns == docs(rows).columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(3, x), (7, y), (11, None), (None, x)])


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_stages_with_odd_rows_and_names(spark, docs):
    """Stages but the last keep columns of any name; empty tables, nulls, repeated rows and ids with several texts go through."""
    rows = [(1, "a b c d e f"), (2, None), (3, ""), (None, "x y z"), (4, "long " * 5000), (4, "other"), (5, "same"), (5, "same"), (5, "same")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (rows, []):
            df = docs(some)
            out = stage(spark, df, FOLDER)
            assert out.columns == df.columns, name
            assert {(r.doc_id, r.text) for r in out.collect()} <= set(some), name


def test_mix_takes_what_the_plan_says(docs):
    """Also where rows repeat: their copies come together, whichever of them they fall on."""
    rows = [(i % 40, f"{'w ' * (i % 7)}t{i % 25}", "abc"[i % 3]) for i in range(200)] + [(None, "x y", None), (3, None, "a"), (3, None, "a")]
    df = docs(rows).repartition(3)
    want = Counter()
    text = Counter()
    for r in source_mixing.mixing_plan(df).collect():
        want[r.doc_id, r.source] += r.copies
    for r in source_mixing.mix(df).collect():
        text[r.doc_id, r.source] += 1
    assert text == Counter({k: n for k, n in want.items() if n})
