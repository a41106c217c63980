import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.llm import classifier, decontaminate, html_text, pii, quality_rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def _hits(texts, items):
    windows = defaultdict(set)
    for i, t in items:
        w = _words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    for t in texts:
        w, hit, found = _words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                x = windows.get(tuple(w[k : k + n]))
                if x:
                    hit |= set(range(k, k + n))
                    found |= {str(i) for i in x if i is not None}
        yield len(w), len(hit), sorted(found)


def test_long_items_are_cut_without_losing_windows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_WORDS", 20)
    test_decontamination_equals_brute_force(spark, 60)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination_equals_brute_force(spark, block):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(9)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.choice([1, 3, 5, 9, 10, 11, 14]))) for i in range(12)] + [(12, None), (13, "..."), (14, ""), (None, make(12)), (1, make(10)), (15, "Ünter é 12 x")]
    items[3] = (3, "v0 v0 v0 v0 v0 v0 v0 v0 v0 v0 v0 v0")
    texts = [make(rng.randrange(0, 60)) for _ in range(30)]
    texts += [f"{make(4)}, {items[k][1].upper()}! {make(3)}" for k in (0, 5, 7, 9)] + [None, "", "ünter É 12 X", "v0 " * 40, "x " * 30000 + items[6][1]]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, found int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.found.n_words, r.found.n_hit, r.found["items"]) for r in decontaminate.find_contamination(docs, bench, out="found", block_bytes=block).collect()}
    assert got == dict(enumerate(_hits(texts, items)))
    clean = {i for i, (_, n, _) in got.items() if n == 0}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == clean


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none, out="d").select("d.n_words", "d.n_hit").first() == (2, 0)
    assert decontaminate.drop_contaminated(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("text", [None, "", "\n\n", "a b c", "x " * 50, "same line\nsame line\n \n \n# $ %", "a b c d e f g h i a b c d e f g h i a b c d e f g h", "w1 " * 40000])
def test_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert quality_rules.counts(text) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_host_verdicts(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "short"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(100)] + [(i, good if i % 20 == 0 else bad, "spam") for i in range(100, 200)]
    rows += [(200 + h, bad if h % 2 else good, f"one{h}") for h in range(6)] + [(300, good, None), (301, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    r = {x.doc_id: x for x in quality_rules.apply_rules(df, max_rate=0.8).collect()}
    assert len(r) == len(rows) and r[1].kept and not r[0].kept and not r[100].kept and r[100].host_rate > 0.8
    mean = sum(x.base_failed for x in r.values()) / len(r)
    assert r[200].kept and 0 < r[200].host_rate < mean < r[201].host_rate < 1 and r[300].kept and not r[301].kept
    assert quality_rules.apply_rules(df.limit(0)).count() == 0


def test_classifier_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = classifier.fit(x[:3000], y[:3000])
    assert (1, 0) in m.pairs and ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert (classifier.fit(np.zeros((0, 3)), np.zeros(0)).score(x[:5]) == 0.5).all()


def test_classifier_on_tables(spark):
    rng = random.Random(0)
    docs, labels = [], []
    for i in range(300):
        ok = i % 3 > 0
        w = [rng.choice("the of and house river green walk over under time".split()) for _ in range(60)]
        docs.append((i, " ".join(w) + "." if ok else " ".join(x.upper() + "!!" for x in w), 0.25))
        labels += [(i, int(ok), 0)] * (1 + i % 2)
    docs += [(300, None, 0.1), (301, "", None), (None, "the house", 0.1)]
    labels += [(300, None, 0), (None, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = classifier.score_documents(d, lab).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 300]
    assert len(held) > 60 and all(r.predicted == (r.doc_id % 3 > 0) for r in held)
    assert sorted(x.doc_id for x in classifier.drop_rejected(d, lab).where("doc_id < 300").collect()) == [i for i in range(300) if i % 3]
    assert classifier.score_documents(d, lab.limit(0)).where("score <> 0.5").count() == 0
    assert classifier.score_documents(d.limit(0), lab).count() == 0


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    d = spark.createDataFrame([(i, "a b c" if i % 2 else "D! E!") for i in range(200)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    wrong = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = classifier.score_documents(d, lab), classifier.score_documents(d, wrong)
    assert a.select("doc_id", "score").exceptAll(b.select("doc_id", "score")).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body class="no-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site and all of that.</div>
<main><article><h1>Title &amp; more</h1><p>The first paragraph is of some length and it is the one that counts here.</p><div class="ad">Buy this.</div>
<p>Short <b>one</b>.<br>Second&nbsp;line<ul><li>an item</li></ul><form><input><button>Send</button></form><p>Last &#233; &lt;tag&gt; part<section class="comments"><p>The first! And it is of no use to the text at all.</p></section></article></main>
<aside><p>The other pages of this site are in the list and you can see them all.</p></aside><footer>&copy; The end of the page and of all that is in it.</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "\n\n".join([
        "Title & more", "The first paragraph is of some length and it is the one that counts here.", "Short one. Second line", "an item", "Last é <tag> part",
    ])
    for p in (None, "", "<", "<p", "<script>never closed <p>x", "<!-- open", "&am", "<nav>a</nav>", "<p title='>'>"):
        assert isinstance(html_text.main_text(p), str)
    assert html_text.main_text("<article><p>cut of") == "cut of" and html_text.main_text("a < b <article>x < y</article>") == "x < y"


def test_comments_marked_as_articles_are_no_text():
    page = "<article class='post has-comments'><p>The text of it.</p></article><div><article class='comment' id=c1><p>I like the text of it very much indeed.</p></article></div>"
    assert html_text.main_text(page) == "The text of it."


def test_text_without_an_article():
    long = "The house of the man is on the hill and it is old, as all of them are in this part of the land. " * 3
    page = f"<div><a href=1>One</a> <a href=2>Two</a></div><h2>A title</h2><p>{long}</p><p>Yes.</p><p>{long}</p><div><a href=1>Three of the links of it</a></div>"
    assert html_text.main_text(page) == "\n\n".join(["A title", long.strip(), "Yes.", long.strip()])


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (3, "", "", "")], "page_id long, url string, html string, text string")
    rows = html_text.extract(df).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows) and sum(r.n_chars == 0 for r in rows) == 2
    assert html_text.extract(df.limit(0)).count() == 0


VALUES = [
    ("4111 1111 1111 1111", "card"), ("5500-0000-0000-0004", "card"), ("97.51.17.173", "ip"), ("joe.x99@mail9.example.com", "email"), ("+1 (017) 555-7713", "phone"),
    ("555-123-4567", "phone"), ("2024-02-29", "date"), ("31/12/1999", "date"), ("12.31.1999", "date"), ("GB82 WEST 1234 5698 7654 32", "iban"), ("123-45-6789", "ssn"), ("04dbebab91ab85687d33eeaaf9ac699e1188f962", "secret"),
]


def _luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms(spark):
    texts = [f"Say {v}, or {v} again. Wörter" for v, _ in VALUES] + ["4111111111111112 999.1.1.1 2023-02-30 1234567", "", None, "no digits", "x " * 50000 + VALUES[0][0]]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    out = pii.pseudonymise(df, "key")
    rows = {r.doc_id: r for r in out.collect()}
    for i, (v, kind) in enumerate(VALUES):
        r = rows[i]
        assert [(x.kind, x.value) for x in r.pii] == [(kind, v)] * 2 and v not in r.text
        p = r.pii[0].pseudonym
        assert p == r.pii[1].pseudonym and r.text == f"Say {p}, or {p} again. Wörter"
        shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", s)))
        assert kind in ("ip", "secret") or shape(p) == shape(v)
        assert kind != "card" or _luhn(p)
        assert kind != "ip" or all(int(x) < 256 for x in p.split("."))
    assert all(rows[i].text == texts[i] and rows[i].pii == [] for i in range(len(VALUES), len(texts) - 1))
    assert rows[len(texts) - 1].pii[0].pseudonym == rows[0].pii[0].pseudonym
    back = pii.pseudonymise(out, "key", inverse=True)
    assert all(r.text == texts[r.doc_id] for r in back.collect())
    other = pii.pseudonymise(df, "another").where("doc_id = 0").first()
    assert other.pii[0].pseudonym != rows[0].pii[0].pseudonym
    assert pii.pseudonymise(df.limit(0), "key").count() == 0
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


def test_cards_are_permuted_not_merged(spark):
    rng = random.Random(2)
    cards = []
    while len(cards) < 200:
        c = "".join(rng.choice("0123456789") for _ in range(16))
        if _luhn(c):
            cards.append(c)
    out = pii.pseudonymise(spark.createDataFrame([(c,) for c in cards], "text string"), "k").collect()
    assert len({r.text for r in out}) == len(set(cards)) and all(_luhn(r.text) for r in out)


def test_sha_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_addresses_in_texts_without_digits(spark):
    texts = ["write to anna.meyer@example.com", "write to anna.meyer@example.com by 10 May", "no address @ all"]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()
    assert [len(r.pii) for r in rows] == [1, 1, 0]
    assert rows[0].pii[0].kind == "email" and rows[0].pii[0].pseudonym == rows[1].pii[0].pseudonym
    assert "anna.meyer" not in rows[0].text and rows[2].text == texts[2]


def _cards(rng, n):
    out = set()
    while len(out) < n:
        c = "".join(str(rng.randrange(10)) for _ in range(16))
        if _luhn(c):
            out.add(c)
    return sorted(out)


def _values(kind, rng):
    """Different valid values of one kind in one layout."""
    import datetime

    days = [datetime.date(1800, 1, 1) + datetime.timedelta(rng.randrange(146097)) for _ in range(400)]
    number = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    if kind == "iso":
        return [f"{d:%Y-%m-%d}" for d in days]
    if kind == "day":
        return [f"{d:%d.%m.%Y}" for d in days]
    if kind == "month":
        return [f"{d:%m/%d/%Y}" for d in days if d.day > 12]
    if kind == "card":
        return _cards(rng, 150)
    if kind == "ssn":
        return [f"{a:03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10000):04}" for a in (rng.randrange(1, 900) for _ in range(400)) if a != 666]
    if kind == "phone":
        return [f"+{rng.randrange(1, 10)} {number(3)} {number(3)} {number(4)}" for _ in range(200)]
    if kind == "ip":
        return [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(300)]
    if kind == "email":
        return [f"user{number(3)}.n@site{number(2)}.org" for _ in range(300)]
    account = lambda b: f"DE{98 - int(b + '131400') % 97:02}{b}"
    return [account(number(18)) for _ in range(150)]


@pytest.mark.parametrize("kind", ["iso", "day", "month", "card", "ssn", "phone", "ip", "email", "iban"])
def test_pseudonyms_are_a_permutation(spark, kind):
    """Each value is found, turns into another valid value of its kind, none into the same, and back."""
    values = sorted(set(_values(kind, random.Random(kind))))
    df = spark.createDataFrame([(v,) for v in values], "text string")
    out = pii.pseudonymise(df, "k").withColumnRenamed("pii", "first")
    rows = pii.pseudonymise(out, "k", inverse=True).collect()
    name = "date" if kind in ("iso", "day", "month") else kind
    assert all([x.kind for x in r.first] == [name] == [x.kind for x in r.pii] for r in rows)
    assert sorted(r.text for r in rows) == values and all(r.text == r.first[0].value for r in rows)
    assert len({r.first[0].pseudonym for r in rows}) == len(values)


def test_values_are_linked_however_they_are_grouped(spark):
    same = [
        ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"], ["+14155552671", "+1 415 555 2671", "+1 (415) 555-2671"], ["+493012345678", "+49 30 1234 5678"],
        ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"], ["05.06.2001", "05/06/2001"],
    ]
    df = spark.createDataFrame([(i, f"Note {v} here.") for i, vs in enumerate(same) for v in vs], "doc_id long, text string")
    found = {}
    for r in pii.pseudonymise(df, "k").collect():
        assert len(r.pii) == 1, r
        found.setdefault(r.doc_id, set()).add(re.sub("[^A-Z0-9]", "", r.pii[0].pseudonym))
    assert all(len(v) == 1 for v in found.values()), found


PROSE = [
    "The harbour was built by the town in the years of the long war, and it is still the place from which the boats go out to the sea.",
    "It is said that the old crane on the quay was the first of its kind, but there is no record of it in the books of the port.",
    "For the visitor there is a path along the wall, with a view of the islands and of the lighthouse that was restored by the county.",
]


def _bare_page():
    """No element or name tells what a block is."""
    links = "".join(f'<div><a href="/{w}">{w}</a></div>' for w in ("Home", "Fish", "Boats"))
    junk = "<div>SKU 4471-A / 4471-B / 4471-C / 4471-D / 4471-E / 4471-F / 4471-G / 4471-H / 4471-I</div>"
    body = f"<h1>Harbour walls</h1><p>{PROSE[0]}</p><p>Crane</p><p>{PROSE[1]}</p><p>{PROSE[2]}</p>"
    return f"<html><body><div>{links}</div><div>{body}</div><div>{junk}</div><div>{links}Terms apply</div></body></html>"


def test_density_and_neighbours_decide_without_markup(monkeypatch):
    want = "\n\n".join(["Harbour walls", PROSE[0], "Crane", PROSE[1], PROSE[2]])
    assert html_text.main_text(_bare_page()) == want
    with monkeypatch.context() as m:  # without the second pass short blocks are lost
        m.setattr(html_text, "_second_pass", lambda found: None)
        assert html_text.main_text(_bare_page()) == "\n\n".join(PROSE)
    monkeypatch.setattr(html_text, "STOP_WORDS", frozenset())  # and without stop words the prose is
    assert html_text.main_text(_bare_page()) == ""


def test_blocks_of_an_article_without_stop_words_follow_their_neighbours():
    table = "Zander 12 kg; Hecht 7 kg; Aal 3 kg; Barsch 9 kg; Wels 22 kg; Karpfen 14 kg; Schleie 5 kg; Forelle 8 kg"
    page = f"<article><p>{PROSE[0]}</p><p>{table}</p><p>{PROSE[1]}</p><p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article><footer>{PROSE[2]}</footer>"
    assert html_text.main_text(page) == "\n\n".join([PROSE[0], table, PROSE[1], "where x=2 holds"])


def test_a_very_long_page(spark):
    page = "<article>" + "".join(f"<p>{PROSE[i % 3]} {i}</p>" for i in range(20000)) + "</article>"
    r = html_text.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert r.n_chars == len(r.text) and r.text.count("\n\n") == 19999 and r.text.endswith("19999")
