"""SimHash near-duplicates: fingerprints linked by anchor-point covering.

A fingerprint has one or two words of 64 bits. Blocks of the first word are covered by a perfect
Hamming code, of covering radius 1: a fingerprint has in each block one home anchor, the code word
within radius 1, and is replicated to the anchors within 1 + `within` bits. Two fingerprints that
differ by at most `within` bits in a block meet: one's home is among the other's anchors. So links
of up to blocks * (within + 1) - 1 differing bits are all found by comparing replicas with homes,
anchor by anchor. Of each two homes only the one that comes later in a fixed order of the code words
gets the other's replica, which halves them.

CLOSE has two blocks, the (31,26) code and links of 3 bits: 2^27 anchors, 17 replicas or so. LOOSE
has four blocks, the (15,11) code and links of 11 bits of the first word and 22 of both: 2^13
anchors and 74 replicas or so. It finds texts whose five-word shingles are similar to 0.8 or more
(expected: 19.5 of 128 bits at 0.8).

Anchors that hold many different fingerprints are dealt in cells: chunks of homes against parts of
the replicas. From each cell only a spanning forest of its links is emitted, so the output grows
with the fingerprints and not with their pairs, and no link between components is lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.llm.common import append, cut, fields, give_back, slices, small
from ratelens.llm.components import connected_components

#: Homes of one anchor that a single cell holds, about.
CHUNK = 4096


@dataclass(frozen=True)
class Setting:
    """Words of a shingle, words of 64 bits of a fingerprint, bits of a block's code, bits by which
    links may differ in a block that finds them, in the first word and in all."""

    shingle: int
    parts: int
    code: int
    within: int
    first: int
    total: int

    def __post_init__(self):
        blocks = 64 // (self.code + 1)
        if self.code not in (15, 31) or not 0 <= self.first < blocks * (self.within + 1):
            raise ValueError("the blocks don't cover so many bits")


CLOSE, LOOSE = Setting(3, 1, 31, 1, 3, 3), Setting(5, 2, 15, 2, 11, 22)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; fewer words than a shingle are one
    shingle; no words (or null) have none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(w) - words] + 1)).tolist()
    return np.fromiter((h(joined[s:e], 42) for s, e in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts))


def _votes(hashes: np.ndarray) -> np.ndarray:
    over = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        over += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return over


def _mixed(h: np.ndarray) -> np.ndarray:
    """Other 64 bits of each hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(text: str | None, setting: Setting = CLOSE) -> list[int]:
    """Unsigned words. A bit is 1 if set in over half of the shingles' hashes; no words give 0. In
    settings of two words a tie has the bit of the least hash, lest few shingles favour zeros."""
    hashes = shingle_hashes(text, setting.shingle)
    out = []
    for part in range(setting.parts):
        h = hashes if not part else _mixed(hashes)
        votes = 2 * _votes(h)
        if setting.parts > 1 and len(h):
            votes += np.unpackbits(h[np.argmin(hashes) :][:1].view(np.uint8), bitorder="little")
        out.append(int(np.packbits(votes > len(h), bitorder="little").view(np.uint64)[0]))
    return out


def fingerprint(text: str | None) -> int:
    return fingerprints(text)[0]


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None, setting: Setting = CLOSE) -> DataFrame:
    """docs' columns `keep` (all by default) and the fingerprint as signed longs fp and, in settings
    of two words, fp2. Columns of these names are replaced."""
    names = ["fp", "fp2"][: setting.parts]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]

    def run(batches):
        for b in slices(batches):
            fps = np.array([fingerprints(t, setting) for t in b.column(b.schema.get_field_index(text)).to_pylist()], np.uint64).reshape(-1, setting.parts)
            yield append(b, keep, {c: pa.array(np.ascontiguousarray(fps[:, i]).view(np.int64)) for i, c in enumerate(names)})

    need = list(dict.fromkeys([*keep, text]))
    return docs.select(*need).mapInArrow(run, T.StructType([*fields(docs, keep), *(T.StructField(c, T.LongType()) for c in names)]))


def _syndrome(x: np.ndarray, code: int) -> np.ndarray:
    """The position (1 to code; 0: none) by which x is off a code word."""
    s = np.zeros(len(x), np.int64)
    for j in range(code.bit_length()):
        m = sum(1 << (p - 1) for p in range(1, code + 1) if p >> j & 1)
        s |= (np.bitwise_count(x & m).astype(np.int64) & 1) << j
    return s


def _patterns(code: int, weight: int) -> list[np.ndarray]:
    """For each syndrome the errors of at most so many bits that have it."""
    out: list[list[int]] = [[] for _ in range(code + 1)]
    for n in range(weight + 1):
        for places in combinations(range(1, code + 1), n):
            s = e = 0
            for p in places:
                s ^= p
                e |= 1 << (p - 1)
            out[s].append(e)
    return [np.array(x, np.int64) for x in out]


def _blocks(fp: np.ndarray, code: int) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [(u >> np.uint64(i) & np.uint64((1 << code) - 1)).astype(np.int64) for i in range(0, 64, code + 1)]


def _order(word: np.ndarray) -> np.ndarray:
    """Where a code word comes in the fixed order; different words differ."""
    return word * np.int64(0x9E3779B1) & np.int64((1 << 31) - 1)


def home_anchors(fp: np.ndarray, code: int = 31) -> np.ndarray:
    """(blocks, n): for each block the code word within one bit, the block's number above it."""
    out = []
    for i, x in enumerate(_blocks(fp, code)):
        s = _syndrome(x, code)
        out.append(x ^ np.where(s > 0, np.int64(1) << np.maximum(s - 1, 0), 0) | (i << code))
    return np.stack(out)


def near_anchors(fp: np.ndarray, code: int = 31, within: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, index into fp): of each block the code words within 1 + within bits that don't come
    before the home."""
    out, idx = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    home = home_anchors(fp, code)
    low = np.int64((1 << code) - 1)
    patterns = _patterns(code, 1 + within)
    for i, x in enumerate(_blocks(fp, code)):
        s = _syndrome(x, code)
        for v, errors in enumerate(patterns):
            row = np.flatnonzero(s == v)
            words = x[row][:, None] ^ errors[None, :]
            later = _order(words) >= _order(home[i, row] & low)[:, None]
            out.append(words[later] | (i << code))
            idx.append(np.repeat(row, later.sum(axis=1)))
    return np.concatenate(out), np.concatenate(idx)


def forest(homes: np.ndarray, others: np.ndarray, setting: Setting = CLOSE) -> np.ndarray:
    """Pairs (rows of homes or others) that join what links between homes and others join, fewer
    than their number. Both have a column for each word; the result has those of both ends."""
    found = [np.zeros((0, 2 * homes.shape[1]), np.int64)]
    h = homes.view(np.uint64)
    step = max(64, (1 << 20) // len(homes))
    for i in range(0, len(others), step):
        part = others[i : i + step]
        o = part.view(np.uint64)
        d = np.bitwise_count(h[:, :1] ^ o[None, :, 0])
        a, b = np.nonzero(d <= setting.first)
        bits = d[a, b].astype(np.int64)
        for j in range(1, homes.shape[1]):
            bits += np.bitwise_count(h[a, j] ^ o[b, j])
        ok = (bits <= setting.total) & (bits > 0)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        none = len(homes)
        label = np.arange(none)
        while True:
            of_part = np.full(len(part), none)
            np.minimum.at(of_part, b, label[a])
            new = label.copy()
            np.minimum.at(new, a, of_part[b])
            if (new == label).all():
                break
            label = new
        a, b = np.flatnonzero(label != np.arange(none)), np.flatnonzero(of_part < none)
        found += [np.hstack((homes[a], homes[label[a]])), np.hstack((part[b], homes[of_part[b]]))]
    return np.concatenate(found)


def _compare(setting: Setting):
    names = [f"{e}{i}" for e in ("s", "d") for i in range(setting.parts)]

    def run(batches):
        current, homes = None, None
        for b in batches:
            at, cell, kind = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fps = np.stack([b.column(3 + i).to_numpy(zero_copy_only=False) for i in range(setting.parts)], axis=1)
            if not len(at):
                continue
            edge = np.concatenate(([0], np.flatnonzero((at[1:] != at[:-1]) | (cell[1:] != cell[:-1])) + 1, [len(at)])).tolist()
            found = [np.zeros((0, 2 * setting.parts), np.int64)]
            for s, e in zip(edge, edge[1:]):
                if (at[s], cell[s]) != current:
                    current, homes = (at[s], cell[s]), fps[:0]
                n = s + int(np.count_nonzero(kind[s:e] == 0))
                if n > s:
                    homes = np.concatenate((homes, fps[s:n]))
                if e > n and len(homes):
                    found.append(forest(homes, np.ascontiguousarray(fps[n:e]), setting))
            x = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(len(names))], names=names)
        give_back()

    return run, ", ".join(f"{c} long" for c in names)


def _node(*words: str) -> F.Column:
    """One word as it is, two as hexadecimal digits."""
    return F.col(words[0]) if len(words) == 1 else F.concat(*[F.lpad(F.hex(w), 16, "0") for w in words])


def links(fps: DataFrame, setting: Setting = CLOSE, chunk: int = CHUNK) -> DataFrame:
    """fps (fp and, in settings of two words, fp2: longs), each value once -> edges (src, dst) that
    join exactly what links join. Ends are fp, or both words as 32 hexadecimal digits."""
    names = ["fp", "fp2"][: setting.parts]
    schema = "anchor long, " + ", ".join(f"{c} long" for c in names)

    def deal(find):
        def run(batches):
            for b in batches:
                columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(setting.parts)]
                anchors, rows = find(columns[0])
                yield pa.RecordBatch.from_arrays([pa.array(anchors), *(pa.array(c[rows]) for c in columns)], names=["anchor", *names])
            give_back()

        return fps.select(*names).mapInArrow(run, schema)

    def home(f):
        found = home_anchors(f, setting.code)
        return found.ravel(), np.tile(np.arange(len(f)), len(found))

    homes = deal(home)
    # Anchors of more homes than a cell takes: one in `chunk` fingerprints and block at most.
    hot = cut(homes.groupBy("anchor").agg(F.count("*").alias("h")).where(F.col("h") > chunk).select(F.col("anchor").alias("of"), F.ceil(F.col("h") / chunk).cast("int").alias("c")))

    def sides(df: DataFrame, kind: int) -> DataFrame:
        c, own = F.coalesce("c", F.lit(1)), F.pmod(F.xxhash64(*names), F.coalesce("c", F.lit(1))).cast("int")
        place = F.explode(F.transform(F.sequence(F.lit(0), c - 1), lambda i: (own * c + i if kind == 0 else i * c + own).cast("int")))
        return df.join(small(hot), F.col("anchor") == F.col("of"), "left").select("anchor", place.alias("cell"), F.lit(kind).alias("kind"), *names)

    run, out = _compare(setting)
    near = deal(lambda f: near_anchors(f, setting.code, setting.within))
    met = sides(homes, 0).union(sides(near, 1)).repartition("anchor", "cell").sortWithinPartitions("anchor", "cell", "kind")
    ends = [[f"{e}{i}" for i in range(setting.parts)] for e in ("s", "d")]
    return met.mapInArrow(run, out).select(_node(*ends[0]).alias("src"), _node(*ends[1]).alias("dst"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", setting: Setting = CLOSE) -> DataFrame:
    """(doc_id, fp, .., component_id): component_id is the least doc_id reachable over links, itself
    included. One row for each row of docs. Null and empty texts have fingerprint 0 and are linked
    like any other; repeated ids have a row each; a component whose ids are all null has null;
    an empty table gives no rows; further columns are not looked at."""
    names = ["fp", "fp2"][: setting.parts]
    rows = cut(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"], setting=setting))
    first = cut(rows.groupBy(*names).agg(F.min("doc_id").alias("least")))
    root = connected_components(links(first.select(*names), setting))
    of = first.withColumn("own", _node(*names)).join(root, F.col("own") == F.col("node"), "left").select(*names, "least", F.coalesce("root", "own").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(least, "root").select(*names, "component_id")
    return rows.join(small(cut(named)), names).select("doc_id", *names, "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", setting: Setting = LOOSE) -> DataFrame:
    """docs with one row of each component: the one of least id, rows without an id last, then by a
    hash of the text. Rows that merely share an id are told apart. All columns stay as they are."""
    if docs.groupBy(doc_id).count().where(F.col(doc_id).isNull() | (F.col("count") > 1)).limit(1).count() == 0:
        found = near_duplicates(docs, doc_id, text, setting)
        gone = cut(found.where("component_id < doc_id").select(F.col("doc_id").alias("__gone")))
        return docs.join(small(gone), docs[doc_id] == F.col("__gone"), "left_anti")
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = near_duplicates(rows, "__row", text, setting).select(F.col("doc_id").alias("__gone"), "component_id")
    rank = F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.xxhash64(text), F.col("__row"))
    ranked = found.join(rows.select("__row", rank.alias("rank")), F.col("__gone") == F.col("__row"))
    first = ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col("rank.__row").alias("__first"))
    gone = cut(found.join(first, F.col("__gone") == F.col("__first"), "left_anti").select("__gone"))
    return rows.join(small(gone), F.col("__row") == F.col("__gone"), "left_anti").drop("__row")
