"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: round after round, each feature in turn gets one shallow tree on the current
residuals, whose leaves are added to that feature's lookup table over its bins; then the same for
the pairs of features that explain most of what is left. A document's score is the logistic of the
sum of its bins' entries, so scoring is vectorised table additions.

The fit takes a bounded sample of labelled rows (`max_rows`), chosen by a hash over all of them;
everything else reads all rows and whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.llm.common import append, fields, slices

#: Labelled rows that the fit takes at most, about: the fraction that this is of all eligible ones
#: is applied to a hash of doc_id.
MAX_ROWS = 12_000
# Frequent function words of the four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that be it for was on are as with by at from this have not or an "
    "de la que el en y los del se las por un para con no una su al lo como "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "le les et des est une du dans qui pour pas au sur ne par plus avec".split()
)
_SYMBOLS = "#*$%&|<>"
_END = re.compile(r"[.!?]\s")
FEATURES = (
    "log_words", "mean_word", "upper", "symbols", "digits", "bars", "exclaim", "commas", "stops",
    "distinct_words", "distinct_lines", "repeat_windows", "long_words", "words_per_line", "sentence",
    "non_ascii", "ends_well", "letters", "top_word", "adjacent",
)


def features(text: str | None) -> list[float]:
    """FEATURES of one whole text; null as empty."""
    t = text or ""
    w = t.split()
    n, c = len(w), max(len(t), 1)
    m = max(n, 1)
    lower = t.lower()
    lw = lower.split()
    lines = [x for x in t.split("\n") if x and not x.isspace()]
    count: dict[str, int] = {}
    for x in lw:
        count[x] = count.get(x, 0) + 1
    k = 4
    windows = n - k + 1
    distinct = len(set(zip(*(lw[i:] for i in range(k))))) if windows > 0 else 0
    letters = sum(map(len, re.findall(r"[^\W\d_]+", t)))
    upper = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", t)))
    return [
        np.log1p(n),
        sum(map(len, w)) / m,
        upper / max(letters, 1),
        sum(map(t.count, _SYMBOLS)) / m,
        sum(map(len, re.findall(r"\d+", t))) / c,
        t.count("|") / m,
        t.count("!") / m,
        t.count(",") / m,
        sum(count.get(x, 0) for x in STOP_WORDS) / m,
        len(count) / m**0.8,
        len(set(lines)) / max(len(lines), 1),
        1 - distinct / windows if windows > 0 else 0.0,
        sum(1 for x in count if len(x) > 25) / m,
        n / max(len(lines), 1),
        n / (1 + len(_END.findall(t))),
        1 - len(t.encode("ascii", "ignore")) / c,
        float(t.rstrip()[-1:] in (".", "!", "?", '"')),
        letters / c,
        max(count.values(), default=0) / m,
        sum(map(eq, lw, lw[1:])) / m,
    ]


@dataclass
class Model:
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0
    coarse: int = 1

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            z += t[b[:, i] // self.coarse, b[:, j] // self.coarse]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _leaves(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """A tree over ordered bins with gradients g and weights h: each bin's leaf value."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, left: int) -> None:
        G, H = g[a:b].sum(), h[a:b].sum()
        if left and b - a > 1:
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
            i = int(np.argmax(gain))
            if gain[i] > 1e-9:
                grow(a, a + i + 1, left - 1)
                grow(a + i + 1, b, left - 1)
                return
        out[a:b] = G / (H + ridge)

    grow(0, len(g), depth)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 60, rate: float = 0.2, pairs: int = 6, depth: int = 2, ridge: float = 2.0) -> Model:
    """x (rows, features), y 0 or 1. Without rows, or with one class only, the score is a constant:
    0.5 without rows."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = Model(cuts, [np.zeros(len(c) + 1) for c in cuts], coarse=max(1, bins // 8))
    if not len(x):
        return model
    p = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(p / (1 - p)))
    b = model.bins(x)
    z = np.full(len(x), model.intercept)

    def residual():
        q = 1 / (1 + np.exp(-z))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            if len(t) == 1:
                continue
            g, h = residual()
            step = rate * _leaves(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), depth, ridge)
            t += step
            z += step[b[:, j]]
    size = [-(-len(t) // model.coarse) for t in model.tables]
    c = b // model.coarse
    g, h = residual()
    gain = {}
    for i in range(len(size)):
        for j in range(i):
            cell = c[:, i] * size[j] + c[:, j]
            G, H = np.bincount(cell, g, size[i] * size[j]), np.bincount(cell, h, size[i] * size[j])
            gain[i, j] = float((G**2 / (H + ridge)).sum())
    model.pairs = sorted(gain, key=gain.get, reverse=True)[:pairs]
    model.pair_tables = [np.zeros((size[i], size[j])) for i, j in model.pairs]
    for _ in range(rounds // 2):
        for (i, j), t in zip(model.pairs, model.pair_tables):
            g, h = residual()
            cell = c[:, i] * size[j] + c[:, j]
            G, H = (np.bincount(cell, v, t.size).reshape(t.shape) for v in (g, h))
            # A split on one feature, then on the other within each half.
            best, step = -1.0, np.zeros_like(t)
            for k in range(1, size[i]):
                s = np.concatenate([np.repeat(_leaves(G[a:e].sum(0), H[a:e].sum(0), 1, ridge)[None, :], e - a, 0) for a, e in ((0, k), (k, size[i]))])
                now = float((G * s).sum())
                if now > best:
                    best, step = now, s
            t += rate * step
            z += rate * step[c[:, i], c[:, j]]
    return model


def _hash(doc_id: str) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string"))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of labelled rows whose crc32(doc_id) mod 3 isn't 1, about max_rows at
    most. Rows without a doc_id or a label teach nothing."""
    own = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y")).where("__id is not null and __y is not null and crc32(cast(__id as string)) % 3 <> 1").distinct()
    n = own.count()
    if n > max_rows:
        own = own.where(F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * (max_rows / n)))
    own = F.broadcast(own)  # about max_rows rows of two numbers
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(own, "__id")

    def run(batches):
        for b in slices(batches):
            x = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    found = rows.select("__text", "__y").mapInArrow(run, "x array<double>, y int").toPandas()
    x = np.array(found.x.tolist(), float).reshape(-1, len(FEATURES))
    y = found.y.to_numpy(float)
    order = np.lexsort([y, *x.T])  # whatever order the rows came in
    return x[order], y[order]


def with_score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """docs' columns `keep` (all by default) and the score of each whole text, 0 to 1; null as
    empty. A column of the output's name is replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches):
            x = np.array([features(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()], float).reshape(-1, len(FEATURES))
            yield append(b, keep, {out: pa.array(shared.value.score(x))})

    need = list(dict.fromkeys([*keep, text]))
    return docs.select(*need).mapInArrow(run, T.StructType([*fields(docs, keep), T.StructField(out, T.DoubleType())]))


def train(docs: DataFrame, labels: DataFrame, **columns) -> Model:
    return fit(*training_rows(docs, labels, **columns))


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns, score, held_out (null doc_id: false) and predicted (score >= 0.5)."""
    scored = with_score(docs, train(docs, labels, doc_id=doc_id, text=text), text, keep)
    return scored.withColumns({"held_out": F.coalesce(_hash(doc_id) % 3 == 1, F.lit(False)), "predicted": (F.col("score") >= 0.5).cast("int")})


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier doesn't reject; all columns stay."""
    model = train(docs, labels)
    return with_score(docs, model, out="__score").where("__score >= 0.5").select(*docs.columns)
