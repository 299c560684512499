"""The pipeline's stages, each held against brute force over its own input, on the smallest tables."""

import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from symspark.llm import knn_quality, line_dedup

FOLDER = "/root/testdata/sf0.001"


def words(text, pattern):
    return re.findall(pattern, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, now = docs.columns, docs
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        found = stage(spark, now, FOLDER)
        now = spark.createDataFrame(found.collect(), found.schema)
        after = {r.doc_id: r.text for r in now.collect()}
        texts[name] = (before, after)
        assert now.columns[: len(columns)] == columns and now.count() == len(after)

    before, after = texts["quality"]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = knn_quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet").where(~held))
    ids = sorted(before)
    scores = model.score(knn_quality._matrix(pa.array([before[i] for i in ids], type=pa.string())))
    assert set(after) == {i for i, s in zip(ids, scores, strict=True) if s >= 0.5} and 0 < len(after) < len(before)

    before, after = texts["lines"]
    want = line_dedup.brute_force(list(before.items()))
    assert {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in after.items()} == {i: w[2] for i, w in want.items()}

    before, after = texts["near_copies"]
    sets = {}
    for i, t in before.items():
        w = words(t, r"[^\x20\x09-\x0d]+")
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert set(after) == {i for i in sets if find(i) == i}

    before, after = texts["leaks"]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(r.text, pattern)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def leaks(text):
        w = words(text, pattern)
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    assert set(after) == {i for i, t in before.items() if not leaks(t)}

    before, after = texts["mixture"]
    assert after == before and len({r.position for r in now.collect()}) == len(after)
