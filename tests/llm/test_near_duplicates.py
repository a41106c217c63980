import random
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from ratelens.llm import line_dedup, simhash
from ratelens.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def _fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "A b C d", "x y z　w", "É é É", "word " * 30000, "a\x1cb c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _fingerprint(text)


@pytest.mark.parametrize("setting", [simhash.CLOSE, simhash.LOOSE])
def test_anchors_cover(setting):
    rng = np.random.default_rng(0)
    x = rng.integers(-(2**63), 2**63 - 1, 300)
    code, within = setting.code, setting.within

    def anchors(v):
        a, i = simhash.near_anchors(v, code, within)
        near = [set() for _ in v]
        for p, q in zip(a.tolist(), i.tolist()):
            near[q].add(p)
        return simhash.home_anchors(v, code), near

    home, near = anchors(x)
    low = x.view(np.uint64) & np.uint64(2**code - 1)
    assert (np.bitwise_count((home[0] & (2**code - 1)).view(np.uint64) ^ low) <= 1).all()
    for flips in range(1, setting.first + 1):
        y = x.copy()
        for r in range(len(y)):
            for b in rng.choice(64, flips, replace=False):
                y[r] ^= np.int64(np.uint64(1 << int(b)).view(np.int64))
        home2, near2 = anchors(y)
        assert max(map(len, near2)) <= {15: 4 * 36, 31: 2 * 16}[code]
        assert all(set(home[:, r].tolist()) & near2[r] or set(home2[:, r].tolist()) & near[r] for r in range(len(y)))


def test_settings_that_are_not_covered():
    for bad in ((3, 1, 31, 1, 4, 4), (5, 2, 15, 2, 12, 22), (5, 2, 7, 1, 3, 3)):
        with pytest.raises(ValueError):
            simhash.Setting(*bad)


def _components(fps, threshold=3):
    label = list(range(len(fps)))
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None, :]) <= threshold
    while True:
        new = np.where(near, np.array(label)[None, :], len(fps)).min(axis=1).tolist()
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("chunk", [3, 512])
def test_links_join_what_all_pairs_join(spark, chunk):
    rng = random.Random(chunk)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for seed in list(fps)[:6]:
        for _ in range(40):  # clusters and chains around a seed
            seed ^= 1 << rng.randrange(64)
            fps.add(seed)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), chunk=chunk)
    root = {r.node: r.root for r in connected_components(edges).collect()}
    want, got = _components(fps), [root.get(f, f) for f in signed]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))
    assert edges.count() < 34 * len(fps)


def _joined(rows, setting):
    """Brute force over rows of words: the least row that links reach from each."""
    n = len(rows)
    x = np.array(rows, np.uint64).reshape(n, -1)
    d = np.bitwise_count(x[:, None, :] ^ x[None, :, :]).astype(int)
    near = (d[:, :, 0] <= setting.first) & (d.sum(axis=2) <= setting.total)
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


@pytest.mark.parametrize("chunk", [2, 4096])
def test_links_of_two_words(spark, chunk):
    rng = random.Random(chunk)
    rows = {(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(120)}
    for a, b in list(rows)[:8]:
        for _ in range(25):
            for _ in range(rng.randrange(1, 16)):
                a ^= 1 << rng.randrange(64)
            for _ in range(rng.randrange(1, 16)):
                b ^= 1 << rng.randrange(64)
            rows.add((a, b))
    rows = sorted(rows)
    signed = [tuple(f - (1 << 64) if f >> 63 else f for f in r) for r in rows]
    edges = simhash.links(spark.createDataFrame(signed, "fp long, fp2 long"), simhash.LOOSE, chunk)
    root = {r.node: r.root for r in connected_components(edges).collect()}
    own = [f"{a:016X}{b:016X}" for a, b in rows]
    want, got = _joined(rows, simhash.LOOSE), [root.get(f, f) for f in own]
    assert 1 < len(set(want)) < len(rows)
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def _near_texts(rng):
    """Texts, and copies with some words changed, left out or put in."""
    texts = [None, "", " \n", "One two", "one  TWO", "one two three", "a b c d e f", "g h i j k l"]
    for _ in range(10):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 20, 60, 150, 400]))]
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, len(w) // 25])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["new"], [w[at], "more"]])
            texts.append(rng.choice([" ", "\n"]).join(w))
    return texts


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(5)
    texts = _near_texts(rng)
    ids = rng.sample(range(1000), len(texts))
    df = docs_of(spark, texts, ids).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    label = _joined([simhash.fingerprints(t, simhash.LOOSE) for t in texts], simhash.LOOSE)
    least = {}
    for c, i in zip(label, ids):
        least[c] = min(least.get(c, i), i)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_similar_texts_are_linked_and_others_are_not():
    """Recall over pairs of five-word Jaccard 0.85 to 1, and none of unrelated or half-shared texts."""
    rng = random.Random(9)
    caught = pairs = 0

    def far(s, t):
        d = [int(a ^ b).bit_count() for a, b in zip(simhash.fingerprints(s, simhash.LOOSE), simhash.fingerprints(t, simhash.LOOSE))]
        return d[0] > simhash.LOOSE.first or sum(d) > simhash.LOOSE.total

    for _ in range(300):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([80, 200, 500]))]
        v = list(w)
        for _ in range(max(1, len(v) // 70)):
            v[rng.randrange(len(v))] = "changed"
        pairs += 1
        caught += not far(" ".join(w), " ".join(v))
        other = [f"w{rng.randrange(5000)}" for _ in range(len(w))]
        assert far(" ".join(w), " ".join(other))
        assert far(" ".join(w), " ".join(w[: len(w) // 2] + other[len(w) // 2 :]))
    assert caught >= 0.85 * pairs


def test_rows_of_one_id_are_told_apart(spark):
    """Neither a repeated nor a missing id takes a row with it that isn't a copy."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    df = docs_of(spark, [a, b, b, c, None, c, a], [7, 7, 9, None, None, None, 3])
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.keep_one(df).collect())
    assert kept == [(False, 3, a), (False, 7, b), (True, 0, ""), (True, 0, c)]


def test_near_duplicates(spark):
    rng = random.Random(1)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(120)) for _ in range(12)]
    texts = base + [b.replace(b.split()[5], "changed", 1) for b in base] + base[:3] * 4 + [None, "", None]
    ids = rng.sample(range(1000), len(texts))
    rows = simhash.near_duplicates(docs_of(spark, texts, ids)).collect()
    fps = [_fingerprint(t) for t in texts]
    label = _components(fps)
    least = {}
    for c, i in zip(label, ids):
        least[c] = min(least.get(c, i), i)
    assert {(r.doc_id, r.component_id, r.fp % 2**64) for r in rows} == {(i, least[c], f) for i, c, f in zip(ids, label, fps)}
    kept = simhash.keep_one(docs_of(spark, texts, ids), setting=simhash.CLOSE)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_near_duplicates_edges(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    rows = simhash.near_duplicates(docs_of(spark, ["a b c d", "a b c d", "p q r s t"], [None, None, None])).collect()
    assert len(rows) == 3 and all(r.component_id is None for r in rows)
    assert simhash.keep_one(docs_of(spark, ["a b c d", "a b c d", "x y z", None], [4, 4, 9, None])).count() == 3
    assert simhash.keep_one(docs_of(spark, [])).count() == 0
    clash = docs_of(spark, ["a b c", "a b c"]).selectExpr("*", "1 as fp", "2 as component_id", "3 as node", "4 as root", "5 as fp2", "6 as own")
    assert simhash.keep_one(clash).count() == 1


def _dedup(rows):
    """Brute force over (doc_id, text), in order: texts and counts."""
    seen, out = [], {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[d] = (None, 0, 0)
            continue
        kept = []
        for line in text.split("\n"):
            w = line.replace("\t", " ").replace("\r", " ").replace("\f", " ").split(" ")
            w = [x for x in w if x]
            s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
            if not s or not any(5 * len(s & t) >= 4 * len(s | t) for t in seen):
                kept.append(line)
            if s:
                seen.append(s)
        n = len(text.split("\n"))
        out[d] = ("\n".join(kept), n, n - len(kept))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    pool = [[rng.choice(words) for _ in range(rng.choice([1, 4, 5, 6, 9, 14, 30, 60]))] for _ in range(25)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(0, 7)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(words)
            lines.append(rng.choice([" ", " ", "  ", "\t"]).join(w))
        rows.append((d, "\n".join(lines)))
    # Repeated shingles, other orders of equal sets, and lines that hold another of four fifths of their length.
    loop = " ".join(words[:6] * 4)
    rows += [(70, loop), (71, " ".join(words[1:6] + words[:6] * 3)), (72, " ".join(words[:24])), (73, " ".join(words[:20])), (74, " ".join(words[2:22]) + "\f" + words[30])]
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, " " + " ".join(words[:6]) + " ")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_removed long").repartition(5)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()}
    assert got == _dedup(rows)


def test_salted_tokens_give_the_same_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 2)
    monkeypatch.setattr(line_dedup, "SALTS", 3)
    test_lines_equal_brute_force(spark, 11)


def test_lines_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(empty).count() == 0
    line = "one two three four five six seven"
    df = spark.createDataFrame([(None, line), (1, line), (1, line), (2, line + "\n" + line), (2, "short\n" + line)], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(df).collect()))
    assert rows == [(0, line), (1, ""), (1, ""), (2, ""), (2, "short")]
    df = spark.createDataFrame([(7, "read more here now\nread  more here now\n\n"), (8, "\tread more here now\nread more"), (9, line), (9, line)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(df).collect()))
    assert rows == [(7, "read more here now\n\n", 1), (8, "read more", 1), (9, "", 1), (9, line, 0)]
    long = " ".join(f"t{i}" for i in range(30000))
    df = spark.createDataFrame([(1, long), (2, long + " end")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(df).collect()} == {1: 0, 2: 1}


def test_line_dedup_is_native(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    plan = line_dedup.dedup_lines(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_screen_interprets_only_ranks(spark):
    """Lambdas are interpreted: but for each word's rank, the screen's arrays are compiled, with each bound once."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j k"), (3, "q r s t u v w x y z")], "__d long, text string")
    found = line_dedup._screened(line_dedup._lines(docs, ["__d"]), ["__d"], *line_dedup.word_rarity(docs))
    assert sorted(r["__d"] for r in found.collect()) == [1, 2]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction") == 1


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    root = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert Counter(root.values()) == {0: 61, 100: 40}
