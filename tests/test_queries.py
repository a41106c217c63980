"""Every registered query of the core runs on the smoke tables and equals its SQL."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from ratelens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) if not isinstance(x, (int, float)) else (False, "", x) for x in row)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(map(_plain, r)) for r in df.select(*cols).collect()), key=_key)
    if name in registry.ORACLE_SQL:
        found = duck.sql(registry.ORACLE_SQL[name])
        at = [list(found.columns).index(c) for c in cols]
        assert rows == sorted((tuple(_plain(r[i]) for i in at) for r in found.fetchall()), key=_key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_of_queries_without_sql(spark):
    """What SQL can't say is held against the kernels, or must hold of every row."""
    from collections import defaultdict

    from ratelens.functions import models

    coded = registry.QUERIES["q33_range_coder_roundtrip"](spark, SF).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: r.n_bytes for r in coded} == {k: len(v) for k, v in texts.items()} and all(r.same for r in coded)
    entropy = lambda b: -sum(n * math.log2(n / len(b)) for n in (b.count(x) for x in set(b))) / 8 if b else 0
    assert all(entropy(texts[r.doc_id]) * 0.999 <= r.n_coded <= 1.02 * entropy(texts[r.doc_id]) + 8 for r in coded)

    scores, found = defaultdict(list), {}
    for r in spark.read.parquet(f"{SF}/part.parquet").collect():
        scores[r.p_brand].append((int(math.floor(r.p_retailprice * 16 + 0.5)), r.p_partkey))
    for r in registry.QUERIES["q27_segmentation_means"](spark, SF).collect():
        found[r.p_brand, r.p_partkey] = (r.level, r.centre)
    for brand, rows in scores.items():
        rows.sort()
        centres, levels = models.quantile_clusters([s for s, _ in rows])
        assert [found[brand, k] for _, k in rows] == [(i, centres[i]) for i in levels]

    tables = defaultdict(list)
    for r in registry.QUERIES["q39_huffman_tables"](spark, SF).collect():
        tables[r.event_type].append((r.symbol, r.n, f"{r.code:0{r.bits}b}"))
    for rows in tables.values():
        codes = sorted(c for _, _, c in rows)
        assert not any(b.startswith(a) for a, b in zip(codes, codes[1:]))  # a prefix code
        assert max(map(len, codes)) <= 16 and "1" * len(codes[-1]) != codes[-1]  # no code of ones alone
        assert sum(2.0 ** -len(c) for c in codes) < 1
        by_count = sorted(rows, key=lambda x: x[1])
        assert all(len(a[2]) >= len(b[2]) for a, b in zip(by_count, by_count[1:]) if a[1] < b[1])

    assert all(r.mse_y < 40 and r.n_bytes > 21 for r in registry.QUERIES["q45_baseline_images"](spark, SF).collect())
