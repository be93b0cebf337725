import re

import corpus_pipeline
from spatialrank.llm import decontaminate

from .test_line_dedup import brute as brute_lines
from .test_partenum import brute as brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_join", "decontaminate", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r.text for r in docs.collect()}

    larger = "/root/testdata/sf0.01"
    kept = stage["toxicity"](spark, spark.read.parquet(f"{larger}/documents.parquet"), larger)
    assert kept.columns == docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    clean, toxic = [i for i, t in labels.items() if not t], [i for i, t in labels.items() if t]
    assert sum(i not in left for i in clean) <= 0.01 * len(clean) and sum(i in left for i in toxic) <= 0.3 * len(toxic)

    cut = stage["line_dedup"](spark, docs, SF)
    want = {i: t for i, (_, gone, t) in brute_lines([(k, v) for k, v in before.items()]).items() if not gone or re.search(r"[^\s]", t)}
    rows = cut.collect()
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id])

    first = stage["near_join"](spark, docs, SF)
    assert first.columns == docs.columns and sorted(r.doc_id for r in first.collect()) == sorted(k for k, _, c in brute_groups(list(before.items())) if k == c)

    clean = stage["decontaminate"](spark, docs, SF)
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in clean.collect()}
    whole = {k for k, t in before.items() if any(i in decontaminate.normal(t) for i in items)}
    assert clean.columns == docs.columns and not left & whole and len(before) - len(left) <= len(whole) + 3


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
