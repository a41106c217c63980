"""Packing token sequences: first-fit decreasing in randomised groups.

Documents are cut into pieces of a whole sequence and a rest. Pieces are dealt to groups by a hash,
in groups of bounded expected size (by a bound on the number of pieces), and each group packs its own by first-fit decreasing: bins are
the leaves of a tournament tree that holds the largest free room below each node, so the first bin
with room for a piece is found in log time. Groups know nothing of each other.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.llm.common import give_back, slices
from ratelens.llm.tokens import Encoder, default_path, lists

LENGTH = 2048
#: Pieces in a group, about.
GROUP = 2048


def first_fit_decreasing(sizes: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; sizes 1 to capacity. Longest first, ties in the given order."""
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, at = int(sizes[i]), 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        where[i], offset[i] = at - leaves, capacity - tree[at]
        tree[at] -= size
        at //= 2
        while at:
            left, right = tree[2 * at], tree[2 * at + 1]
            most = left if left >= right else right
            if tree[at] == most:
                break
            tree[at] = most
            at //= 2
    return where, offset


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 1, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, salt and, if asked
    for, ids. Null and empty texts have one piece, the end id."""
    path = tokenizer or default_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = Encoder.of(path)
        for b in slices(batches):
            rows, parts = [], []
            for d, ids in zip(b.column(0).to_pylist(), encoder.encode_many(b.column(1).to_pylist())):
                ids += end
                salt = zlib.crc32(ids)
                for s in range(0, len(ids), 4 * length):
                    p = ids[s : s + 4 * length]
                    rows.append((d, s // 4, len(p) // 4, zlib.crc32(p), len(ids) // 4, salt))
                    parts.append(p)
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(cols + ([lists(parts)] if with_ids else []), names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt", *["ids"] * with_ids]
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ", ".join(f"{c} {'array<int>' if c == 'ids' else 'long'}" for c in names))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 1, length: int = LENGTH, group: int = GROUP, with_ids: bool = True) -> DataFrame:
    """pieces() placed: sequence_id and offset (gapless from 0 in each sequence). Each id of each
    row of docs lies in one piece. Groups are dealt by a hash of the id, the text's ids and the
    start, so copies of one text under different ids spread."""
    found = pieces(docs, doc_id, text, tokenizer, end_id, length, with_ids)
    # A token has a byte at least, so these are as many pieces or more.
    most = docs.agg(F.count("*") + F.coalesce(F.floor(F.sum(F.octet_length(text)) / F.lit(length)), F.lit(0))).first()[0]
    groups = max(1, -(-most // group))
    dealt = found.withColumn("bunch", F.pmod(F.xxhash64("doc_id", "salt", "start"), F.lit(groups)))
    out = T.StructType([*(f for f in dealt.schema if f.name not in ("salt", "bunch")), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(key, t):
        if Encoder._made:  # this worker's tables of the stage before
            Encoder._made.clear()
            give_back()
        t = t.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        where, offset = first_fit_decreasing(t["length"].to_numpy(), length)
        t = t.drop_columns(["salt", "bunch"])
        return t.append_column("sequence_id", pa.array((key[0].as_py() << 32) + where)).append_column("offset", pa.array(offset))

    return dealt.groupBy("bunch").applyInArrow(run, out)
