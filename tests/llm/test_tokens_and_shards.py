import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.llm import orc_ids, packing, sharding, tokens
from ratelens.llm.common import new_path

pytest.importorskip("public_tokenizers")
TEXTS = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "a\n  b c", "don't it's we'll 'twas", "x!! (y) z... #### $9.99", "Ünter é ñ ß", "a×b÷c", "日本語 текст", "a\tb\r\nc", "tail \n",
    "a b c", "a\x1cb", "a\x85b", "zero​width", "<|endoftext|> x", "snake_case 12ab", "end.\nStart, of; lines!\nLast", "é combining", "🙂 x🙂", "A" * 400 + "!!",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library, monkeypatch):
    rng = random.Random(0)
    parts = ["word", "Other", "Über", "x1", "don't", "a,", "(b)", " ", "  ", "\n", "\n\n", "\t", "...", "_", "'s", "é", "漢", " ", "10%"]
    texts = TEXTS + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(40))) for _ in range(400)]
    want = [np.array(library(t), "<u4").tobytes() for t in texts]
    assert tokens.Encoder(tokens.default_path()).encode_many(texts) == want
    assert 50256 in library("<|endoftext|> x") and np.array([50256], "<u4").tobytes() not in tokens.Encoder(tokens.default_path(), special_as_text=True).encode("<|endoftext|> x")
    monkeypatch.setattr(tokens, "PIECES", 8)
    monkeypatch.setattr(tokens, "PIECE_CHARS", 3)
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 20)
    e = tokens.Encoder(tokens.default_path())
    assert e.encode_many(texts) == want and e.encode_many(texts) == want and len(e.spaced) <= 8


def test_each_different_word_is_looked_up_once(library):
    class Counting(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    regular = ["one two, two\nthree one\ntwo " * 50 + "end", "één twee\ntwee", "one"] * 5
    # Among them texts that turn out odd only by their words.
    odd = ["one  two", "one \n two", "two\n two", "é\u2003one", "one\xa0two\n", "één \n\n"]
    e = tokens.Encoder(tokens.default_path())
    e.plain, e.spaced = Counting(), Counting()
    assert e.encode_many(regular) == [np.array(library(t), "<u4").tobytes() for t in regular]
    assert e.plain.asked + e.spaced.asked < 50
    assert e.encode_many(regular + odd) == [np.array(library(t), "<u4").tobytes() for t in regular + odd]


def test_orc_round_trip(spark, library):
    docs = spark.createDataFrame([(97 * i % 29, t, 1) for i, t in enumerate(TEXTS)] + [(5, "again", 1), (None, "none", 1)], "doc_id long, text string, ids int").repartition(4)
    path = new_path(spark, "ids")
    orc_ids.write_ids(docs, path)
    rows = orc_ids.read_ids(spark, path).collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0), [*library(r.text), 2]) for r in docs.collect())
    assert sorted(((r.doc_id is not None, r.doc_id or 0), list(r.ids)) for r in rows) == want
    at = 0
    for r in sorted(orc_ids.read_index(spark, path).collect(), key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    index = {(r.doc_id, r.ids_crc32) for r in orc_ids.read_index(spark, path).collect()}
    assert index == {(r.doc_id, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows}
    # The index follows the files: start is where a row's ids lie in them, laid end to end.
    laid = [i for r in sorted(rows, key=lambda r: (r.part, r.row)) for i in r.ids]
    for r in orc_ids.read_index(spark, path).collect():
        assert zlib.crc32(np.array(laid[r.start : r.start + r.n_tokens], "<u4").tobytes()) == r.ids_crc32
    starts = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(orc_ids.read_index(spark, path).collect(), key=lambda r: r.start)]
    assert starts == sorted(starts)
    plan = orc_ids.read_ids(spark, path).where("doc_id = 5")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan and orc_ids.read_ids(spark, path).where("doc_id = 5").count() == 2


def test_orc_files_have_what_is_promised(spark):
    """Footers: run-length integers, a row index and a Bloom filter on doc_id, stripes that prune."""
    docs = spark.range(30000).selectExpr("id as doc_id", "concat('word ', id) as text")
    path = new_path(spark, "ids")
    orc_ids.write_ids(docs, path, partitions=2)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = [f.getPath() for f in folder.getFileSystem(conf).listStatus(folder) if f.getPath().getName().endswith(".orc")]
    assert len(files) == 2
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == orc_ids.ROW_INDEX_ROWS and reader.getCompressionKind().toString() == "ZSTD"
        stripe = reader.getStripes().get(0)
        rows = reader.rows()
        footer = rows.readStripeFooter(stripe)
        kinds = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
        encodings = [c.getKind().toString() for c in footer.getColumnsList()]
        rows.close()
        assert (1, "BLOOM_FILTER_UTF8") in kinds and (1, "ROW_INDEX") in kinds
        assert encodings[1] == "DIRECT_V2" and "DIRECT_V2" in encodings[3:]


def test_orc_of_nothing(spark):
    path = new_path(spark, "ids")
    orc_ids.write_ids(spark.createDataFrame([], "doc_id long, text string"), path)
    assert orc_ids.read_index(spark, path).count() == 0


def _first_fit(sizes, capacity):
    room, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), None)
        if b is None:
            room.append(capacity)
            b = len(room) - 1
        out[i] = (b, capacity - room[b])
        room[b] -= sizes[i]
    return out


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, rng.choice([5, 50, 100])) for _ in range(rng.randint(1, 300))]
    where, offset = packing.first_fit_decreasing(np.array(sizes), 100)
    assert list(zip(where.tolist(), offset.tolist())) == _first_fit(sizes, 100)


def test_packing(spark, library):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("of the house river walk".split()) for _ in range(rng.randint(0, 400))) for _ in range(80)] + ["same text"] * 20
    docs = spark.createDataFrame([(i if i % 7 else None, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = packing.pack(docs, length=128, group=40).collect()
    ids = {i: [*library(t), 1] for i, t in enumerate(texts) if i % 7}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for d, want in ids.items():
        assert [x for r in sorted(by_doc[d], key=lambda r: r.start) for x in r.ids] == want and by_doc[d][0].doc_tokens == len(want)
    assert sum(r.length for r in by_doc[None]) == sum(len(library(t)) + 1 for i, t in enumerate(texts) if i % 7 == 0)
    for p in by_seq.values():
        at = 0
        for r in sorted(p, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    assert len(by_seq) * 128 < 1.1 * sum(r.length for r in rows) + 4 * 128
    assert packing.pack(docs.limit(0)).count() == 0


def _check(rows, docs, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text_crc32) for r in rows) == sorted((d is None, d or 0, zlib.crc32((t or "").encode())) for d, t in docs)
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(0 <= r.shard < shards for r in rows)
    load = [sum(r.size for r in rows if r.shard == s) for s in range(shards)]
    return max(load) - min(load)


def test_shards(spark):
    rng = random.Random(0)
    texts = ["x" * rng.randint(0, 300) + str(rng.random()) for _ in range(900)]
    texts += [f"copy {i} " + "y" * rng.randint(10, 200) for i in range(40) for _ in range(rng.randint(2, 9))] + ["hot text " * 5] * 600 + [None, "", "", None]
    docs = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, shard int").repartition(5)
    rows = sharding.shard_documents(df, 8).collect()
    assert _check(rows, docs, 8) <= 64
    where = defaultdict(set)
    for r in rows:
        where[r.text_key].add(r.shard)
    n = defaultdict(int)
    for r in rows:
        n[r.text_key] += 1
    hot = max(n, key=n.get)
    assert all(len(where[k]) == 1 for k in n if k != hot)
    share = sum(r.size for r in rows) / 8
    assert len(where[hot]) <= n[hot] * 61 / share + 3
    again = sharding.shard_documents(df.repartition(3), 8).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_shards_edges(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0
    one = [(i, "all the same") for i in range(100)]
    assert _check(sharding.shard_documents(spark.createDataFrame(one, "doc_id long, text string"), 4).collect(), one, 4) <= 4 * 28
    odd = [(None, "a"), (None, "a"), (1, None), (1, None), (1, "b" * 5000), (2, "c")]
    _check(sharding.shard_documents(spark.createDataFrame(odd, "doc_id long, text string"), 4).collect(), odd, 4)


def test_large_documents_fill_evenly(spark):
    rng = random.Random(5)
    docs = [(i, str(i) + "z" * rng.choice([5, 50, 4000])) for i in range(400)]
    rows = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), 5)
    assert _check(rows.collect(), docs, 5) <= 400
    assert rows.agg(F.count_distinct("shard")).first()[0] == 5
