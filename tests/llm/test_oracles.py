"""Training-data queries against their oracle SQL, on the smallest tables; and the pipeline against its stages' rules."""

import duckdb
import pytest

from loomwright.llm.oracle import ORACLE
from loomwright.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, sf)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cur.fetchall()), key=str)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        path = f"{corpus_pipeline.shared_dir(spark)}/test-{name.replace(' ', '-')}-{len(seen)}-{id(out)}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
        if name != "BPE":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    quality, lines, near, mixture, encoded = seen
    assert 0 < near.count() <= lines.count() == quality.count() < 200
    assert near.count() == near.select("doc_id").distinct().count()
    texts = near.select("text").where("text <> ''")
    assert texts.count() == texts.distinct().count()
    assert {r.doc_id for r in mixture.select("doc_id").collect()} <= {r.doc_id for r in near.select("doc_id").collect()}
    assert encoded.count() == mixture.count() and encoded.where("n_tokens IS NULL").count() == 0


def test_pipeline_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(60))
    rows = [(2, text), (2, text), (1, text), (None, text), (None, "by itself"), (None, "by itself"), (3, "alone"), (3, "alone"), (3, "other"), (4, ""), (4, ""), (5, None), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, text), (None, "by itself"), (3, "alone"), (3, "other"), (4, ""), (5, None), (None, None)], key=str)
