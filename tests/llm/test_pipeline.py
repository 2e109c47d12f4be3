"""The pipeline against a plain version of its stages."""

import threading
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from plain_models import Language, Toxicity, fingerprint, in_fold
from tokenizers import Tokenizer

import corpus_pipeline
from segmill.llm import common


def test_stages(spark):
    """All stages in plain code that uses nothing of the library."""
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    texts, langs = {r.doc_id: r.text for r in rows}, {r.doc_id: r.lang for r in rows}
    marks = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r.toxic in (0, 1) and in_fold(r.doc_id, 5):
            marks[r.doc_id] = max(r.toxic, marks.get(r.doc_id, 0))
    toxic = Toxicity(sorted({(m, texts[d].lower()) for d, m in marks.items() if d in texts}))
    left = {d: t for d, t in texts.items() if toxic.score(t) < 0.5}
    assert len(left) < len(texts)
    model = Language([(langs[d], t) for d, t in left.items() if langs[d] is not None and in_fold(d, 4) != 2])
    left = {d: t for d, t in left.items() if model.share(t) >= 0.5}
    fps = {d: fingerprint(t) for d, t in left.items()}
    parent = {d: d for d in left}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in left:
        for b in left:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    left = {d: t for d, t in left.items() if find(d) == d}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for d, t in left.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want |= {(d, i, len(ids[i : i + 2048]), zlib.crc32(np.array(ids[i : i + 2048], "<u4").tobytes())) for i in range(0, len(ids), 2048)}
    got = corpus_pipeline.run(spark, sf)
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in got.collect()} == want


def test_stages_take_odd_rows(spark, make_docs, sf):
    rows = [(None, None), (1, None), (2, ""), (3, "..."), (4, "the and of " * 9000), (5, "the and of it"), (5, "the and of it"), (6, "the and of it")]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(1, None, None, None, None)], docs.schema).select(*docs.columns)
    for part in (docs.limit(0), docs.withColumn("doc_id", F.col("doc_id") + 10).unionByName(make_docs(rows).select(*docs.columns)), extra):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            part = stage(spark, part, sf)
            if i < 3:
                assert part.columns == docs.columns
        assert part.where("doc_id < 4").count() == 0


def test_pipelines_of_two_threads_keep_apart(spark, sf, tmp_path):
    """Each has its own folder; the one that ends first deletes nothing of the other's."""
    want = sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect()))
    inside = threading.Barrier(2)

    def folders(_):
        with common.scratch(spark) as folder:
            inside.wait(60)
            path = common.new_folder(spark, "x")
            inside.wait(60)
            return folder, path

    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(folders, range(2)))
        assert all(path.startswith(folder) for folder, path in found) and found[0][0] != found[1][0]
        runs = list(pool.map(lambda _: corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect(), range(2)))
    assert [sorted(map(tuple, r)) for r in runs] == [want, want] and not common._scratch.get()
