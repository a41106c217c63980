"""The whole pipeline on small tables, held against a brute-force version of each stage."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ratelens.llm import classifier, simhash, tokens
from test_near_duplicates import _dedup, _joined

pytest.importorskip("public_tokenizers")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, fp string, component_id string, ids string"


def _write(spark, folder, documents, labels, benchmark):
    rows = [(i, t, "en", "s", None if t is None else len(t), 5, "own", "own", "own") for i, t in documents]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def _tables(rng):
    """Sentences of few stop words are bad ones; copies, near copies, repeated lines, benchmark passages."""
    words = [f"w{i}" for i in range(3000)]
    good = lambda n: " ".join(rng.choice(["the", "of", "and", "to", "in"]) if i % 3 == 0 else rng.choice(words) for i in range(n)) + "."
    bad = lambda n: " | ".join("#%$ " + rng.choice(words).upper() for _ in range(n))
    item = " ".join(rng.choice(words) for _ in range(14))
    documents, labels = [], []
    for i in range(160):
        low = i % 4 == 0
        documents.append((i, bad(60) if low else "\n".join(good(30) for _ in range(3))))
        labels.append((i, int(not low), 0))
    for i in range(160, 170):  # near copies: two words of one line differ, and lines that others have
        lines = documents[i - 159][1].split("\n") if (i - 159) % 4 else [good(40)] * 2
        documents.append((i, "\n".join([*lines[:2], good(60)])))
    base = good(120).split(" ")
    for i in range(170, 176):
        w = list(base)
        w[rng.randrange(120)] = "changed"
        w[rng.randrange(120)] = f"v{i}"
        documents.append((i, " ".join(w)))
    documents += [(176, good(30) + " " + item + " " + good(30)), (177, item.upper()), (178, None), (179, ""), (3, good(50)), (None, good(50)), (None, good(50)), (5, documents[5][1])]
    return documents, labels, [(1, item), (2, None), (3, "")]


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    documents, labels, benchmark = _tables(rng)
    _write(spark, tmp_path, documents, labels, benchmark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def stage(i, df):
        out = corpus_pipeline.STAGES[i][1](spark, df, str(tmp_path))
        assert i == 4 or out.dtypes == df.dtypes
        out.write.parquet(f"{tmp_path}/out-{i}")
        return spark.read.parquet(f"{tmp_path}/out-{i}")

    text_of = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text is not None, r.text or "") for r in df.collect())
    model = classifier.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    import numpy as np

    score = lambda t: model.score(np.array([classifier.features(t)], float))[0]
    kept = stage(0, docs)
    want = [(i, t) for i, t in documents if score(t) >= 0.5]
    assert text_of(kept) == sorted((i is None, i or 0, t is not None, t or "") for i, t in want)
    assert 100 < len(want) < 150 and not {i for i, _ in want} & set(range(0, 160, 4))

    lines = stage(1, kept)
    # Rows of one id are ordered by a hash of their texts.
    hashed = {r.text: r.h for r in kept.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    clean = _dedup([(k, t) for k, (_, t) in enumerate(order)])
    assert text_of(lines) == sorted((i is None, i or 0, t is not None, clean[k][0] or "") for k, (i, t) in enumerate(order))
    assert all(r.n_lines == 5 and (r.text is None or r.n_chars == len(r.text)) for r in lines.collect())

    near = stage(2, lines)
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    label = _joined([simhash.fingerprints(t, simhash.LOOSE) for _, t in rows], simhash.LOOSE)
    least = defaultdict(list)
    for (i, t), c in zip(rows, label):
        least[c].append((i is None, i or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near.collect()) == sorted(map(min, least.values()))
    assert len(least) < len(rows) - 5

    clear = stage(3, near)
    assert {r.doc_id for r in near.collect()} - {r.doc_id for r in clear.collect()} == {176, 177}

    packed = stage(4, clear).collect()
    encode = tokens.Encoder.of(tokens.default_path()).encode
    want = sorted(np.frombuffer(encode(r.text), "<u4").tolist() + [1] for r in clear.collect())
    pieces = defaultdict(list)
    for r in packed:
        pieces[r.sequence_id].append((r.offset, r.length))
    for p in pieces.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(list(r.ids) for r in packed) == want  # no document here is longer than a sequence
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, packed))


def test_pipeline_of_nothing(spark, tmp_path):
    _write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
