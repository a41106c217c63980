"""Line deduplication by an exact set-similarity join, DataFrame and SQL functions only.

A line's tokens are the set of its five-word shingles (of a line of one to four words, its whole
word sequence); two lines match if their sets' Jaccard is 0.8 or more, and a line is removed if it
matches an earlier one in the order of (doc_id, line). Blank lines have no tokens and stay.

Repeats of a word sequence go first: lines are grouped by 128 bits of hash, summed before the
shuffle, so that a hot line is one row a task, and only the earliest of each takes part further.

Tokens are ordered by rarity. A word's rarity is read from a table of fixed size that counts, over
all documents, the pieces between spaces in each hash bucket; a shingle is as rare as its first
word, which bounds how often it occurs. Lines that match share one of their n - ceil(0.8 n) + 1
rarest tokens (prefix filter), are of similar length, have enough tokens left after each shared one
(position filter), and differ by few enough bits of a parity sketch of their sets.

Few lines share anything. So a screen comes first: each line sends the shingles of its rarest
words, enough of them to hold its prefix, as bare hashes, and only lines that meet another under
one of them go on to the join, which takes exact sets, prefixes and sketches. A line is verified
against the earliest lines that it meets, and only lines still without a match against all others
that the filters leave, so groups of near copies cost about a comparison a line. Verification
compares the lines' whole sets, as hashes of 53 bits and the rarity of the first word (odds under
10^-11 for a pair that one hash misleads).

Tokens that may be frequent are dealt by a salt as well, in tasks of bounded size.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.common import cut, small, stash, unstash

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Size of the rarity table, steps for each doubling of a count, salts; a token is salted if its first
#: word's bucket has more than HOT pieces and more than one in HOT_SHARE of all.
BUCKETS, STEPS, SALTS, HOT, HOT_SHARE = 16_384, 16, 64, 200_000, 1024
#: 64-bit words of a set's parity sketch, bits of a hash below the rarity in a token.
SKETCH, BITS = 2, 53
_LOW = (1 << BITS) - 1


def _level(count: int) -> int:
    return min(1023, int(STEPS * math.log2(count + 1)))


def word_rarity(docs: DataFrame, text: str = "text") -> tuple[list[int], int]:
    """BUCKETS levels: how many pieces between spaces of all documents fall in each hash bucket, on
    a log scale; and the level from which tokens are salted. A word at a line's end counts with its
    neighbour: only the order depends on it."""
    words = docs.select(F.explode(F.split(text, " ")).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).count().collect()
    levels = [0] * BUCKETS
    for r in counts:
        levels[r.b] = _level(r["count"])
    return levels, _level(max(HOT, sum(r["count"] for r in counts) // HOT_SHARE))


def _lines(docs: DataFrame, keys: list[str], only: str | None = None) -> DataFrame:
    """keys, ln and line, other white space as spaces: all that aren't blank, or those of the line
    numbers that the SQL `only` gives for the array ls. One array of structs is exploded then, so
    that no row holds the whole text."""
    odd = " or ".join(f"contains(text, '{c}')" for c in (r"\t", r"\u000B", r"\u000C", r"\r"))
    ls = rf"split(if({odd}, translate(text, '\t\u000B\u000C\r', '    '), text), '\n')"
    if only is None:
        found = docs.select(*keys, F.expr(f"posexplode({ls}) as (ln, line)"))
    else:
        found = docs.select(*keys, F.expr(f"inline(transform(array({ls}), ls -> transform({only}, i -> named_struct('ln', i, 'line', get(ls, i))))[0])"))
    return found.where("trim(line) <> ''")


def _words(line: str) -> str:
    return f"if(contains({line}, '  ') or startswith({line}, ' ') or endswith({line}, ' '), array_remove(split({line}, ' '), ''), split({line}, ' '))"


def _ranked(words: str, rarity: list[int]) -> str:
    """Of each word its rarity above the low bits of its hash."""
    table = f"from_json('{json.dumps([x << BITS for x in rarity])}', 'array<bigint>')"
    return f"transform(transform({words}, w -> xxhash64(w)), h -> get({table}, cast(h & {BUCKETS - 1} as int)) | (h & {_LOW}L))"


def _prefix(n: str) -> str:
    return f"cast({n} - ({NUMERATOR} * {n} + {DENOMINATOR - 1}) div {DENOMINATOR} + 1 as int)"


def _index(n: str) -> str:
    """The prefix for partners that are no shorter."""
    return f"cast({n} - (2 * {NUMERATOR} * {n} + {NUMERATOR + DENOMINATOR - 1}) div {NUMERATOR + DENOMINATOR} + 1 as int)"


def _bound(df: DataFrame, keep: list[str], name: str, value: str) -> DataFrame:
    """keep and `name`, computed once by compiled code: Spark would paste an expression into each of
    its uses, but not across a generator."""
    return df.select(*keep, F.explode(F.array(F.expr(value))).alias(name))


def _screened(lines: DataFrame, keys: list[str], rarity: list[int], hot: int) -> DataFrame:
    """keys and ln of the lines that may share a token of their prefixes with another. A line of n
    places, so of at most n tokens, sends every shingle whose first word is among the rarest that
    a prefix of n has: it holds at least as many tokens. Of two lines that match, the shorter one
    shares one of its n - ceil(8 / 9 n) + 1 rarest (index tokens), so a token that is nobody's
    index token leads nowhere. Only a word's rank, its bucket's place by rarity, takes a lambda; the
    rest is compiled. A shingle that a line repeats is sent, and met, more than once, so such a line
    may pass for nothing."""
    me = [*keys, "ln"]
    n = f"greatest(size(ws) - {WORDS - 1}, 1)"
    order = sorted(range(BUCKETS), key=rarity.__getitem__)
    ranks = [0] * BUCKETS
    for i, b in enumerate(order):
        ranks[b] = i
    frequent = sum(x < hot for x in rarity)
    rank = f"get(from_json('{json.dumps(ranks)}', 'array<int>'), cast(xxhash64(w) & {BUCKETS - 1} as int))"
    rows = _bound(lines.select(*me, "line"), me, "ws", _words("line"))
    rows = _bound(rows, [*me, "ws"], "xs", f"transform(slice(ws, 1, {n}), w -> {rank})")
    rows = _bound(rows, [*me, "ws", "xs"], "d", "sort_array(array_distinct(xs))")
    at = lambda k: F.expr(f"element_at(d, least({k}, size(d)))")
    rows = rows.select(*me, "ws", "xs", at(_prefix(n)).alias("most"), at(_index(n)).alias("index"))
    rows = rows.select(*me, "ws", "most", "index", F.posexplode("xs").alias("i", "x")).where("x <= most")
    token = f"xxhash64({', '.join(f'get(ws, i + {j})' for j in range(WORDS))})"
    # Bit 0 marks a frequent first word, whose tokens have the salt in the next bits but one.
    salt = f"shiftleft(pmod(xxhash64({', '.join(me)}), {SALTS}L), 2)"
    marked = f"if(x >= {frequent}, ({token} & {~(4 * SALTS - 1)}L) | {salt} | 1L, {token} & -4L)"
    rows = rows.select(*me, F.expr(marked).alias("token"), F.expr("if(x <= index, 0L, 2L)").alias("probe"))
    w = Window.partitionBy("token").orderBy("probe", *me)
    met = rows.withColumns({"least": F.first("probe").over(w), "rank": F.row_number().over(w), "next": F.lead("ln").over(w)})
    return met.where("least = 0 and (rank > 1 or next is not null) or token & 1 = 1").select(*me).distinct()


def _sets(docs: DataFrame, asked: DataFrame, keys: list[str], rarity: list[int]) -> DataFrame:
    """For the lines asked for: n, the sorted set of tokens ts, and a sketch of it: the parity of how
    many fall in each of SKETCH * 64 bins. Sets differ by no fewer elements than their sketches by
    bits. A token is 10 bits of rarity above a hash."""
    rest = ", ".join(f"get(xs, i + {j})" for j in range(1, WORDS))
    shingles = f"transform(slice(xs, 1, greatest(size(xs) - {WORDS - 1}, 1)), (x, i) -> (x & {~_LOW}L) | (xxhash64(x, {rest}) & {_LOW}L))"
    ts = f"transform(array({_ranked(_words('line'), rarity)}), xs -> sort_array(array_distinct({shingles})))"
    bits = ", ".join(f"'b{j}', aggregate(ts, 0L, (a, x) -> if((shiftright(x, 6) & {SKETCH - 1}) = {j}, a ^ shiftleft(1L, cast(x & 63 as int)), a))" for j in range(SKETCH))
    lines = _lines(docs.join(small(asked), keys), keys, "__asked")
    return lines.select(*keys, "ln", F.expr(f"inline(transform({ts}, ts -> named_struct('n', size(ts), {bits}, 'ts', ts)))"))


def _copies(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ln of every line whose word sequence an earlier line has."""
    me = [*keys, "ln"]
    plain = F.when(
        F.startswith("line", F.lit(" ")) | F.endswith("line", F.lit(" ")) | F.contains("line", F.lit("  ")), F.trim(F.regexp_replace("line", " +", " "))
    ).otherwise(F.col("line"))
    lines = _lines(docs, keys).select(*me, plain.alias("line"))
    hashed, path = stash(lines.select(*me, F.xxhash64("line").alias("a"), F.xxhash64(F.lit("second"), "line").alias("b")), "line-hashes")
    many = cut(hashed.groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").select("a", "b"))
    again = cut(hashed.join(small(many), ["a", "b"]))
    first = cut(again.groupBy("a", "b").agg(F.min(F.struct(*me)).alias("first")))
    found = cut(again.join(small(first), ["a", "b"]).where(F.struct(*me) > F.col("first")).select(*me))
    unstash(docs.sparkSession, path)
    return found


def _by_document(lines: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and an array of the lines' numbers, at most one for each line of the document."""
    return cut(lines.groupBy(*keys).agg(F.sort_array(F.collect_list("ln")).alias(name)))


def _without(gone: str) -> str:
    return f"if({gone} is null, sequence(0, size(ls) - 1), array_except(sequence(0, size(ls) - 1), {gone}))"


def _verified(pairs: DataFrame, sets: DataFrame, me: list[str]) -> DataFrame:
    """Of pairs (line, partner) the lines whose sets are similar to their partner's."""
    it = [f"p_{c}" for c in me]
    pairs = cut(pairs.select(*me, *it).distinct())
    need = cut(pairs.select(*me).union(pairs.select(*it)).distinct())
    sets, path = stash(sets.select(*me, "ts").join(small(need), me, "left_semi"), "line-pairs")
    theirs = sets.select(*[F.col(c).alias(f"p_{c}") for c in me], F.col("ts").alias("us"))
    same = f"transform(array(size(array_intersect(ts, us))), c -> (size(ts) + size(us) - c) * {NUMERATOR} <= c * {DENOMINATOR})[0]"
    found = cut(pairs.join(sets, me).join(theirs, it).where(F.expr(same)).select(*me).distinct())
    unstash(pairs.sparkSession, path)
    return found


def _near(n: str, pos: str, own: list[str], m: str, at: str, theirs: list[str]) -> str:
    """Length, prefix, position and sketch filters; positions count from 1 in each sorted set. Sets
    that overlap by t share a token among the first n - t + 1 and m - t + 1."""
    most = NUMERATOR + DENOMINATOR
    bits = " + ".join(f"bit_count({a} ^ {b})" for a, b in zip(own, theirs))
    t = f"(({NUMERATOR} * ({n} + {m}) + {most - 1}) div {most})"
    return (
        f"{n} * {DENOMINATOR} >= {m} * {NUMERATOR} and {m} * {DENOMINATOR} >= {n} * {NUMERATOR} and {pos} <= {n} - {t} + 1 and {at} <= {m} - {t} + 1"
        f" and 1 + least({n} - {pos}, {m} - {at}) + least({pos} - 1, {at} - 1) >= {t}"
        f" and ({bits}) * {most} <= {DENOMINATOR - NUMERATOR} * ({n} + {m})"
    )


def matched_lines(docs: DataFrame, keys: list[str], copies: DataFrame) -> DataFrame:
    """docs (keys, text) -> keys and ln of every line that matches an earlier one, copies aside."""
    spark, me = docs.sparkSession, [*keys, "ln"]
    rarity, hot = word_rarity(docs)
    lines = _lines(docs.join(small(_by_document(copies, keys, "__gone")), keys, "left"), keys, _without("__gone"))
    asked = _by_document(_screened(lines, keys, rarity, hot), keys, "__asked")
    sets, path = stash(_sets(docs, asked, keys, rarity), "line-sets")

    sketch = [f"b{j}" for j in range(SKETCH)]
    sent = sets.select(*me, "n", *sketch, F.posexplode(F.slice("ts", F.lit(1), F.expr(_prefix("n")))).alias("pos", "token")).withColumn("pos", F.col("pos") + 1)
    sent = sent.withColumn("salt", F.when(F.shiftright("token", BITS) >= hot, F.pmod(F.xxhash64(*me), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1)))
    w = Window.partitionBy("token", "salt").orderBy(*me)
    lead = F.first(F.struct(*me, "n", "pos", *sketch)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = sent.withColumns({"lead": lead, "rank": F.row_number().over(w), "next": F.lead("n").over(w)})
    met, path2 = stash(met.where("rank > 1 or next is not null or salt >= 0").drop("rank", "next"), "line-met")
    # Salted tokens: the first of all salts leads, singles go.
    whole = cut(met.where("salt >= 0").groupBy("token").agg(F.min("lead").alias("least"), F.count("*").alias("c")))
    met = met.join(small(whole), "token", "left").where("c is null or c > 1").withColumn("lead", F.coalesce("least", "lead")).drop("least", "c", "salt")

    led = met.where(F.struct(*me) > F.struct(*[F.col(f"lead.{c}") for c in me])).where(_near("n", "pos", sketch, "lead.n", "lead.pos", [f"lead.{b}" for b in sketch]))
    matched = _verified(led.select(*me, *[F.col(f"lead.{c}").alias(f"p_{c}") for c in me]), sets, me)

    # What is still open against all earlier lines under each token.
    earlier = " or ".join("(" + " and ".join([f"p_{c} = {c}" for c in me[:i]] + [f"p_{me[i]} < {me[i]}"]) + ")" for i in range(len(me)))
    theirs = met.select("token", *[F.col(c).alias(f"p_{c}") for c in (*me, "n", "pos", *sketch)])
    open_ = met.drop("lead").join(small(matched), me, "left_anti")
    near = _near("n", "pos", sketch, "p_n", "p_pos", [f"p_{b}" for b in sketch])
    pairs = open_.join(theirs.withColumnRenamed("token", "p_token"), (F.col("token") == F.col("p_token")) & F.expr(f"({earlier}) and {near}"))
    found = cut(matched.union(_verified(pairs, sets, me)).distinct())
    for p in (path, path2):
        unstash(spark, p)
    return found


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, `text` without the lines that match an earlier one, and n_lines and n_removed (columns
    of these names are replaced). Other lines stay as they are, in order, and a document all of
    whose lines go keeps a row with an empty text. A null text stays null (no lines); an empty one
    is one empty line. doc_id is an integer; null ids come first. Rows that share a doc_id are
    ordered by a hash of their texts, and rows equal in both lose each other's lines like any."""
    key = {"__d": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))}
    docs = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")])
    columns = docs.columns
    if docs.groupBy(doc_id).count().where("count > 1").limit(1).count():
        docs = cut(docs.withColumns({**key, "__h": F.xxhash64(text), "__i": F.monotonically_increasing_id()}))
        keys = ["__d", "__h", "__i"]
    else:
        docs, keys = docs.withColumns(key), list(key)
    plain = docs.select(*keys, F.col(text).alias("text")).where("text is not null")
    copies = _copies(plain, keys)
    gone = _by_document(copies.union(matched_lines(plain, keys, copies)), keys, "__gone")
    t = F.col(text)
    out = docs.join(small(gone), keys, "left").withColumns({
        "n_lines": F.when(t.isNull(), 0).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
        "__t": t,
    })
    kept = f"if(__gone is null, __t, transform(array(split(__t, '\\n')), ls -> array_join(transform({_without('__gone')}, i -> get(ls, i)), '\\n'))[0])"
    return out.withColumn(text, F.expr(kept)).select(*columns, "n_lines", "n_removed")

