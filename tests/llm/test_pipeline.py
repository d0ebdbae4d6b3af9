"""The pipeline against brute force, the registered SQL, and the entry without this package."""

import importlib
import re
import sys

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tidewatch.llm import queries

from .test_copies import plain_components, plain_fingerprint, words
from .test_matching import plain_contamination

FOLDER = "/root/testdata/sf0.001"


def documents():
    near = words(400, "n").split()
    rows = [(k, words(30 + k, k)) for k in range(20)]
    rows += [(30, words(35, 5)), (31, words(35, 5).replace(" ", "  \n")), (32, " ".join(near)),
             (33, " ".join([*near[:399], "edited"])), (34, "clean " + words(12, "bench") + " end"),
             (35, None), (36, "12 34"), (37, words(5000, "long"))]
    return rows


def test_every_stage_against_brute_force(spark, tmp_path):
    items = [(1, words(12, "bench"))]
    rows = documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = {i: t for i, t in rows if t and re.search(r"[^\W\d_]", t)}
    normal = {}
    for i in sorted(left):
        normal.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
    after_exact = {i: left[i] for i in normal.values()}
    fps = {}
    for i in sorted(after_exact):
        fps.setdefault(plain_fingerprint(after_exact[i]), i)
    label = plain_components(fps)
    after_near = {i: t for i, t in after_exact.items() if label[plain_fingerprint(t)] == i}
    dirty = {r[0] for r in plain_contamination(after_near.items(), items) if r[-1]}
    after_clean = {i: t for i, t in after_near.items() if i not in dirty}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES, (left, after_exact, after_near, after_clean)):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert {r.doc_id: r.text for r in docs.collect()} == expected, name
    assert len(left) > len(after_exact) > len(after_near) > len(after_clean) > 15

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in after_clean.items()}
    assert {r.doc_id: r.doc_tokens for r in packed} == sizes
    assert sum(r.length for r in packed) == sum(sizes.values())


def test_stages_take_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_says_the_same(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        duck.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = duck.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == expected


def test_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(1 for q in names if q.startswith(f"op{n}_")) == 1
    assert "pipeline" in names


def test_entry_without_the_subpackage(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(__spark_entry__, "find_spec",
                        lambda name, *a: None if name == "tidewatch.llm" else real(name, *a))
    names = __spark_entry__.queries()
    assert not any(q == "pipeline" or re.match(r"op\d+_", q) for q in names) and len(names) > 100
    assert not set(__spark_entry__.oracle_sql()) & set(queries.SQL)


def test_nothing_else_imports_this_package():
    from pathlib import Path

    home = Path(__spark_entry__.__file__).parent
    for file in [*home.glob("tidewatch/**/*.py"), *home.glob("registry/*.py"), home / "bench.py"]:
        if "llm" not in file.parts:
            assert "tidewatch.llm" not in file.read_text(), file
    assert sys.modules
