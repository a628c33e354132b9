"""The registry, its SQL, the pipeline, and life without this subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
import corpus_pipeline
from test_near_copies import groups
from wakeline.llm import decontaminate, queries

D = "/root/testdata/sf0.01"
ROOT = Path(__spark_entry__.__file__).parent


def test_one_query_for_each_operator():
    names = list(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries() and set(queries.SQL) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    got, expected = queries.QUERIES[name](spark, D).toPandas(), con.sql(queries.SQL[name]).df()
    key = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(expected.columns) and key(got) == key(expected)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, D)
        assert k == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.toPandas())
    good, one, clean, mixed, sharded = kept
    labels = pd.read_parquet(f"{D}/labels.parquet")
    assert (good.merge(labels, on="doc_id").quality == 1).mean() > 0.97
    texts = pd.Series(good.text.values, index=good.doc_id)
    assert sorted(one.doc_id) == sorted(set(groups(texts.to_dict()).values()))
    bench = [decontaminate.words_of(t) for t in pd.read_parquet(f"{D}/benchmark.parquet").text]
    holds = lambda t: any(b" " + b" ".join(w) + b" " in b" " + b" ".join(decontaminate.words_of(t)) + b" " for w in bench)
    dirty = {r.doc_id for r in one.itertuples() if holds(r.text)}
    assert dirty and not dirty & set(clean.doc_id) and len(one) - len(clean) - len(dirty) <= 2
    size = lambda d: d.text.str.encode("utf-8").map(lambda b: len(b.split()))
    assert set(mixed.doc_id) <= set(clean.doc_id) and mixed.doc_id.value_counts().max() <= 3 and size(mixed).sum() == pytest.approx(size(clean).sum(), rel=0.05)
    assert len(sharded) == len(mixed) and sharded.shard.between(0, 7).all()
    assert sorted(corpus_pipeline.run(spark, D).toPandas().doc_id) == sorted(sharded.doc_id)


def test_the_rest_works_without_this_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "wakeline", tmp_path / "wakeline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op1_') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1", **{k: v for k, v in __import__("os").environ.items() if k not in ("PYTHONPATH",)}})
