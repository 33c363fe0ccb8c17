"""The registered queries against their SQL, and the pipeline against its stages' plain versions."""

import duckdb
import plain
import pytest

import corpus_pipeline
from newsloom.llm import queries

TABLES = "documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == sorted((tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()), key=repr)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    quality, dedup, clean, mix, ids = (f for _, f in corpus_pipeline.STAGES)
    assert len(names) == 5
    good = quality(spark, docs, sf_dir)
    rows = {r["doc_id"]: r["text"] for r in good.collect()}
    assert good.columns == docs.columns and all(plain.quality_counts(t)[0] >= 50 for t in rows.values())
    one = dedup(spark, good, sf_dir)
    groups = plain.components({d: plain.fingerprint(t) for d, t in rows.items()})
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(groups.values()))
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    left = clean(spark, one, sf_dir)
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in one.collect() if not plain.contamination(r["text"], items)[4]}
    mixed = mix(spark, left, sf_dir)
    assert mixed.columns == docs.columns
    out = ids(spark, mixed, sf_dir)
    assert out.count() == mixed.count() == corpus_pipeline.run(spark, sf_dir).count()


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, clashing columns, labels of nothing; and tables without rows."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(80))
    rows = [(1, text(1), "en", "a"), (1, text(1), "en", "a"), (1, text(2), "en", None), (None, text(3), None, None), (None, text(3), None, None), (None, None, None, None), (4, "", "en", "a"), (5, text(5), "en", "b"), (6, text(6) + " " + text(7), "en", "b")]
    docs = spark.createDataFrame([(*r, "own", "own") for r in rows], "doc_id long, text string, lang string, source string, _key string, start string")
    labels = spark.createDataFrame([(None, None), (1, 1), (77, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, text(7)), (None, None)], "item_id long, text string")
    for name, cut in (("odd", 100), ("empty", 0)):
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
            df.limit(cut).coalesce(1).write.parquet(str(tmp_path / name / f"{table}.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert (len(got) > 0) == (cut > 0)
        if cut:
            # one row of each group stays; the contaminated one goes; shares take each of the rest twice at most
            assert {r["doc_id"] for r in got} <= {None, 1, 5} and all(r["n_tokens"] > 80 for r in got)
