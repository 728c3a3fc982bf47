"""The pipeline's stages, one after the other, against brute force."""

import hashlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shelfcast.llm import bpe, mixing, simhash
from tests.conftest import SF_SMALL
from tests.llm.cases import ODD, documents
from tests.llm.test_dedup import brute_components, brute_fingerprint, brute_repeats


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], SF_SMALL).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    assert all(d.columns == columns for d in seen[:-1])
    start, spoken, single, cut, mixed, ids = seen
    assert spoken.count() == start.where(F.col("text").rlike("\\p{L}")).count()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in spoken.collect()}
    root = brute_components(list(fps.values()), 4)
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert sorted(r.doc_id for r in single.collect()) == sorted(least.values())
    want = brute_repeats([(r.doc_id, r.text) for r in single.collect()], 20)
    got = [(r.doc_id, r.text) for r in cut.collect()]
    assert sorted((eval(w)[0], eval(w)[3]) for w in want) == sorted((i, " ".join(x.decode() for x in t.encode().split())) for i, t in got)
    taken = mixing.mix_sources(cut).agg(F.sum("taken")).first()[0]
    assert mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == taken
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    lib.no_truncation()
    lib.no_padding()
    texts = sorted((r.doc_id, r.text) for r in mixed.collect())
    rows = sorted((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in ids.collect())
    own = []
    for i, t in texts:
        e = lib.encode(t, add_special_tokens=False).ids
        own.append((i, np.array(e, "<u4").tobytes(), hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert rows == sorted(own)


def test_stages_stand_odd_rows(spark, tmp_path):
    for k, rows in enumerate((ODD, [])):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / f"{k}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
        assert docs.count() == 0 or rows


def test_registered(spark):
    import __spark_entry__ as E

    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert "op10_quality_cascade" in E.oracle_sql() and simhash.PIVOTS
