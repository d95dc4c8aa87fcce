"""The pipeline against the plain operators, stage by stage."""

import pathlib
import zlib

import brute
import corpus_pipeline as cp
import numpy as np
import public_tokenizers
from llm_data import SMALL
from tokenizers import Tokenizer

from tiergraph.llm import jaccard, packing, quality, secrets
from tiergraph.llm.tables import shared_folder


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in cp.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality.quality_rules(docs).where("kept").collect()}
    assert good <= {i for i, t in rows.items() if brute.base_counts(t)[0] >= 50}
    kept = [(i, t) for i, t in rows.items() if i in good]
    kept = [(i, t) for i, t in kept if brute.components(kept)[i][1] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hits = brute.hits([t for _, t in kept], items)
    kept = [x for x, h in zip(kept, hits, strict=True) if not h[4]]
    model = secrets.trained()
    clean = [(i, secrets._masked(t, secrets.all_spans(t, model, False)[1], "[SECRET]")) for i, t in kept]
    assert all(not brute.base_spans(t) for _, t in clean)
    vocabulary = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, t in clean:
        ids = np.array(vocabulary.encode(t, add_special_tokens=False).ids + [0], dtype="<u4")
        want |= {(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))}
    got = cp.run(spark, SMALL).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_columns_stay(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, SMALL).schema.names == docs.columns
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_odd_documents(spark, odd):
    """Null ids, repeated rows, shared ids, clashing columns, empty and very long texts go through all stages."""
    docs = odd
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == odd.columns
    left = docs.select("doc_id", "text").collect()
    assert len({(r["doc_id"], r["text"]) for r in left}) == len(left)
    packed = cp.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id", "piece").distinct().count() == packed.count() >= len(left)


def test_stages_leave_no_copies(spark):
    """A stage stores no copy of the texts, and near duplicates leave one small table."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    folder = pathlib.Path(shared_folder(spark)) / "tiergraph" / spark.sparkContext.applicationId
    before = {p.name for p in folder.glob("*")}
    kept = cp.quality_rules(spark, docs, SMALL)
    assert {p.name for p in folder.glob("*")} == before
    left = cp.ngram_jaccard_join(spark, kept, SMALL)
    assert [p.name.split("-")[0] for p in folder.glob("*") if p.name not in before] == ["other"]
    assert 0 < left.count() < kept.count() < docs.count()


def test_rows_that_a_bitmap_lets_through(spark, monkeypatch):
    """Rows whose slot is that of a dropped row stay, though the bitmap does not tell them apart."""
    rows = [(i, f"{i // 2 if i < 40 else i} a text of its own with a number") for i in range(200)]
    docs = spark.createDataFrame([*rows, *rows[100:110]], "doc_id bigint, text string")
    want = [i for i in range(200) if i >= 40 or i % 2 == 0]
    for bits in (4, 18):
        monkeypatch.setattr(jaccard, "LEAST_BITS", bits)
        monkeypatch.setattr(jaccard, "MOST_BITS", bits)
        assert sorted(r["doc_id"] for r in jaccard.one_of_each(docs).collect()) == want
