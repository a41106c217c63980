"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item is cut into windows of ten words (an item of fewer words is one window), each
window into five-word shingles. The shingles are ordered by rarity, their document frequency over
the whole corpus. Since a window must be contained in full, its necessary prefix is its single
rarest shingle: documents are joined to windows on that shingle alone, the shingle's place bounds
where the window must begin and end inside the document (position and length bounds), and the ten
words are then compared one by one.

The benchmark is the stated query set. It is worked off in blocks of bounded size, each broadcast
as an index; the corpus is only ever read through, never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.llm.common import append, cut, fields, slices

WINDOW, SHINGLE = 10, 5
#: Bytes of benchmark text in one block, the bound of what is broadcast.
BLOCK_BYTES = 4 << 20
#: Words of an item that go in one part of a block.
PART_WORDS = 1 << 16
#: Lower case for A-Z; every byte outside [0-9a-z] and UTF-8 sequences to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PRIME, _BLOOM = 0x9E3779B97F4A7C15, 22

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)
_TYPE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("runs", pa.list_(pa.list_(pa.int64())))])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _rolling(ids: np.ndarray, k: int) -> np.ndarray:
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(_PRIME) + ids[j : j + n].astype(np.uint64) + np.uint64(1)
    return h ^ (h >> np.uint64(29))


class Index:
    """Windows of a block of items and the shingles by which documents find them."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words_of(text)]
            size = min(WINDOW, len(w))
            for i in range(len(w) - size + 1 if w else 0):
                owners[tuple(w[i : i + size])].add(item)
        windows = sorted(owners)
        self.owners = [sorted(x for x in owners[w] if x is not None) for w in windows]
        self.length = np.array([len(w) for w in windows], np.int64)
        self.words = np.zeros((len(windows), WINDOW), np.int64)
        for i, w in enumerate(windows):
            self.words[i, : len(w)] = w
        #: Shingle length -> (sorted hashes, for each window its shingles' places among them).
        self.shingles: dict[int, np.ndarray] = {}
        self.places: list[tuple[int, np.ndarray]] = []
        by_k = defaultdict(list)
        for i, w in enumerate(windows):
            k = min(SHINGLE, len(w))
            by_k[k].append((i, _rolling(np.array(w, np.int64), k)))
        self.places = [(0, np.zeros(0, np.int64))] * len(windows)
        for k, found in by_k.items():
            self.shingles[k] = np.unique(np.concatenate([h for _, h in found]))
            for i, h in found:
                self.places[i] = (k, np.searchsorted(self.shingles[k], h))
        self._filters()

    def _filters(self) -> None:
        self.filters = {}
        for k, h in self.shingles.items():
            self.filters[k] = np.zeros(1 << _BLOOM, bool)
            self.filters[k][(h >> np.uint64(64 - _BLOOM)).astype(np.int64)] = True

    def find(self, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a shingle of length k may begin, and the shingle's place."""
        h = _rolling(ids, k)
        at = np.flatnonzero(self.filters[k][(h >> np.uint64(64 - _BLOOM)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.shingles[k], h[at]), len(self.shingles[k]) - 1)
        ok = self.shingles[k][place] == h[at]
        return at[ok], place[ok]

    def with_prefixes(self, frequency: dict[int, np.ndarray]) -> "Index":
        """Keeps of every window only its rarest shingle (ties: the least hash)."""
        kept: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for i, (k, places) in enumerate(self.places):
            best = min(range(len(places)), key=lambda o: (frequency[k][places[o]], places[o], o))
            kept[k][int(places[best])].append((i, best))
        self.prefix = {}
        for k, by_place in kept.items():
            order = sorted(by_place)
            self.shingles[k] = self.shingles[k][order]
            count = np.array([len(by_place[p]) for p in order])
            flat = np.array([x for p in order for x in by_place[p]], np.int64)
            self.prefix[k] = (np.concatenate(([0], np.cumsum(count))), flat[:, 0], flat[:, 1])
        self.places = []
        self._filters()
        return self

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts, 0 for other words and one 0 after each text; where texts begin."""
        words, begin = [], [0]
        for t in texts:
            words += words_of(t)
            words.append(b"")
            begin.append(len(words))
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words)), np.array(begin)

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of every occurrence of a window in ids."""
        starts, windows = [], []
        for k, (begin, window, offset) in self.prefix.items():
            at, place = self.find(k, ids)
            n = begin[place + 1] - begin[place]
            row = np.repeat(np.arange(len(at)), n)
            entry = np.repeat(begin[place] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(at) else np.zeros(0, np.int64)
            w = window[entry]
            s = at[row] - offset[entry]
            ok = (s >= 0) & (s + self.length[w] <= len(ids))
            s, w = s[ok], w[ok]
            for i in range(0, len(s), 65536):
                a, b = s[i : i + 65536], w[i : i + 65536]
                place = a[:, None] + np.arange(WINDOW)[None, :]
                same = (ids[np.minimum(place, len(ids) - 1)] == self.words[b]) | (np.arange(WINDOW)[None, :] >= self.length[b][:, None])
                same = same.all(axis=1)
                starts.append(a[same])
                windows.append(b[same])
        none = np.zeros(0, np.int64)
        return np.concatenate(starts or [none]), np.concatenate(windows or [none])


def _frequencies(docs: DataFrame, text: str, index: Index) -> dict[int, np.ndarray]:
    """In how many documents of the corpus each shingle of the block occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        x = shared.value
        count = {k: np.zeros(len(h), np.int64) for k, h in x.shingles.items()}
        for b in slices(batches):
            ids, begin = x.ids(b.column(0).to_pylist())
            for k in count:
                at, place = x.find(k, ids)
                doc = np.searchsorted(begin, at, "right")
                seen = np.unique(doc * len(x.shingles[k]) + place)
                count[k] += np.bincount(seen % len(x.shingles[k]), minlength=len(count[k]))
        for k, c in count.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(c[at])], names=["k", "place", "n"])

    out = {k: np.zeros(len(h), np.int64) for k, h in index.shingles.items()}
    for r in docs.select(text).mapInArrow(run, "k long, place long, n long").groupBy("k", "place").agg(F.sum("n").alias("n")).collect():
        out[r.k][r.place] = r.n
    shared.unpersist()
    return out


def _parts(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, text) of different items, those of more than PART_WORDS words cut into parts that
    overlap by WINDOW - 1 words, so that each window lies in one."""

    def run(batches):
        for b in slices(batches, 64):
            items, parts = [], []
            for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(t) > PART_WORDS:
                    w = words_of(t)
                    found = [b" ".join(w[i : i + PART_WORDS + WINDOW - 1]).decode("utf-8", "surrogatepass") for i in range(0, max(1, len(w) - WINDOW + 1), PART_WORDS)]
                else:
                    found = [t]
                items += [item] * len(found)
                parts += found
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(parts, pa.string())], names=["item", "text"])

    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null")
    return cut(rows.mapInArrow(run, "item string, text string").distinct())


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int):
    """The items in blocks of about `limit` bytes of text, one at a time on the driver. Repeats go and
    long items are cut first, so that a hash splits what is left."""
    b = _parts(benchmark, item_id, text)
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // limit) or 1
    for i in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield [(r.item, r.text) for r in part.collect()]


def _mark(docs: DataFrame, text: str, keep: list[str], out: str, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    again = out in docs.columns

    def run(batches):
        x = shared.value
        for b in slices(batches):
            ids, begin = x.ids(b.column(b.schema.get_field_index(text)).to_pylist())
            start, window = x.occurrences(ids)
            doc = np.searchsorted(begin, start, "right") - 1
            edge = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + x.length[window], -1)
            items = defaultdict(set)
            for d, w in set(zip(doc.tolist(), window.tolist())):
                items[d].update(x.owners[w])
            if again:
                for d, old in enumerate(b.column(b.schema.get_field_index(out)).to_pylist()):
                    if old["items"]:
                        items[d].update(old["items"])
                    for s, e in old["runs"]:
                        edge[begin[d] + s] += 1
                        edge[begin[d] + e] -= 1
            hit = np.cumsum(edge)[:-1] > 0
            change = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
            runs = defaultdict(list)
            first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
            for d, s, e in zip((np.searchsorted(begin, first, "right") - 1).tolist(), first.tolist(), last.tolist()):
                runs[d].append([s - int(begin[d]), e - int(begin[d])])
            found = [
                {"n_words": n - 1, "n_hit": sum(e - s for s, e in runs[d]), "items": sorted(items[d]), "runs": runs[d]}
                for d, n in enumerate(np.diff(begin).tolist())
            ]
            yield append(b, keep, {out: pa.array(found, _TYPE)})

    need = list(dict.fromkeys([*keep, text, *([out] if again else [])]))
    return docs.select(*need).mapInArrow(run, T.StructType([*fields(docs, keep), T.StructField(out, RESULT)]))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    keep: list[str] | None = None, out: str = "decontamination", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs' columns `keep` (all by default) and a struct `out`: n_words, n_hit (words inside any
    occurrence of a window), items (ids as strings, sorted, whose windows occur) and runs (from,
    to) of hit words. A column of the name `out` is replaced. Null and empty texts have no words;
    null or wordless items have no windows; items with a null id hit words but aren't listed;
    an empty benchmark marks nothing. One row for each row of docs."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    need = list(dict.fromkeys([*keep, text]))
    base, result = docs.select(*need), None
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        index = Index(block)
        if not index.owners and result is not None:
            continue
        index.with_prefixes(_frequencies(base, text, index))
        result = _mark(base if result is None else result, text, need, out, index)
    return result.select(*keep, out)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without those in which a window of the benchmark occurs; all columns stay."""
    out = "__decontamination"
    return find_contamination(docs, benchmark, text, out=out).where(F.col(f"{out}.n_hit") == 0).select(*docs.columns)
