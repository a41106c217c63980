"""Balanced label propagation: linked documents drift to their neighbours' shards under quotas.

Documents with equal texts are linked. Every document starts in a shard given by a hash. In each
round every group of linked documents looks at the shards in which its members stand, by joins on
the group; members in the less popular shards move to the most popular one that has room (to the
m most popular if the group is larger than m - 1 shards), in order of how many links the move
mends, until the target's quota, an equal share of all bytes, is used up. Since members of a group
are alike, the state is one row for each (group, shard), never a row for each pair, and a hot
group is no more than one row for each shard.

What has no links is then dealt to fill every shard up to its equal share: documents large against
a share, of which there can only be some thousands, by the greedy rule on the driver, the others
along a line of running sums. Running sums and ranks are two-level, within hash buckets and over
bucket totals, so that no task holds a shard or a group.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.common import cut

SHARDS, ROUNDS, BUCKETS = 40, 8, 4096
#: A document is large if it is over this part of a shard's share; at most LARGE * shards are.
LARGE = 256


def _running(df: DataFrame, by: list[str], bucket: str, order: list, value: F.Column) -> DataFrame:
    """df with `before`: the sum of `value` over what precedes the row in its `by` group, in the
    order of (bucket, order)."""
    df = df.withColumn("__v", value)
    totals = df.groupBy(*by, bucket).agg(F.sum("__v").alias("__t"))
    w = Window.partitionBy(*by).orderBy(bucket) if by else Window.orderBy(bucket)
    totals = totals.select(*by, bucket, (F.sum("__t").over(w) - F.col("__t")).alias("__before"))
    within = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.join(totals, [*by, bucket])
        .withColumn("before", F.col("__before") + F.sum("__v").over(within) - F.col("__v"))
        .drop("__before", "__v")
    )


def _loads(cells: DataFrame, shards: int) -> list[int]:
    found = {r.shard: r.b for r in cells.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("b")).collect()}
    return [int(found.get(i, 0)) for i in range(shards)]


def _at(values: list, index: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), index + 1)


def _propagate(cells: DataFrame, share: int, shards: int, rounds: int) -> DataFrame:
    """cells (key, size, shard, n) after the rounds."""
    for _ in range(rounds):
        room = [max(0, share - x) for x in _loads(cells, shards)]
        open_ = _at(room, F.col("shard")) >= F.col("size")
        g = Window.partitionBy("key")
        ranked = cells.select(
            "key", "size", "shard", "n",
            F.row_number().over(g.orderBy(open_.desc(), F.col("n").desc(), "shard")).alias("r"),
            F.ceil(F.sum(F.col("n") * F.col("size")).over(g) / F.lit(max(share, 1))).cast("int").alias("m"),
        )
        targets = ranked.where("r <= m").select(F.col("key").alias("tk"), F.col("r").alias("tr"), F.col("shard").alias("target"), F.col("n").alias("tn"))
        movers = ranked.where("r > m").join(targets, (F.col("key") == F.col("tk")) & ((F.col("r") - 1) % F.col("m") + 1 == F.col("tr")))
        movers = movers.where("n <= tn").select("key", "size", "shard", "n", "target")
        movers = movers.withColumn("bucket", (63 - F.floor(F.log2(F.col("n")))) * 256 + F.pmod(F.xxhash64("key"), F.lit(256)))
        placed = _running(movers, ["target"], "bucket", ["key", "shard"], F.col("n") * F.col("size"))
        left = F.floor((_at(room, F.col("target")) - F.col("before")) / F.col("size")).cast("long")
        moves = cut(placed.select("key", "size", "shard", "target", F.least(F.col("n"), left).alias("n")).where("n > 0"))
        if moves.limit(1).count() == 0:
            break
        cells = cut(
            cells.select("key", "size", "shard", "n")
            .union(moves.select("key", "size", "shard", -F.col("n")))
            .union(moves.select("key", "size", F.col("target").alias("shard"), "n"))
            .groupBy("key", "size", "shard").agg(F.sum("n").alias("n")).where("n > 0")
        )
    return cells


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of docs: doc_id, size (UTF-8 bytes and 16), text_crc32, text_key,
    shard and slot (gapless from 0 in each shard). Null and empty texts are one group of equal
    texts; null ids are placed like others; rows that repeat an id have a slot each. No rows give
    no rows. The sums of sizes differ by about the largest document that isn't large (share / 256),
    or by what single documents larger than a share force."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = cut(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.md5(t).alias("text_key"),
    ))
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = -(-total // shards)
    spot = rows.withColumns({"key": F.col("text_key"), "mix": F.xxhash64("doc_id", "text_key")})
    spot = spot.withColumns({"bucket": F.pmod("mix", F.lit(BUCKETS)).cast("int"), "start": F.pmod(F.shiftright("mix", 20), F.lit(shards)).cast("int")})
    cells = spot.groupBy("key", "size", F.col("start").alias("shard")).agg(F.count("*").alias("n"))
    linked = cells.withColumn("members", F.sum("n").over(Window.partitionBy("key"))).where("members > 1").drop("members")
    cells = _propagate(cut(linked), share, shards, rounds)

    # A shard that its linked documents alone overfill gives some back, the least linked first.
    loads = _loads(cells, shards)
    if max(loads) > share:
        back = cells.withColumn("bucket", F.floor(F.log2(F.col("n"))) * 256 + F.pmod(F.xxhash64("key"), F.lit(256)))
        back = _running(back, ["shard"], "bucket", ["key"], F.col("n") * F.col("size"))
        excess = _at([max(0, x - share) for x in loads], F.col("shard")) - F.col("before")
        back = back.withColumn("out", F.greatest(F.lit(0), F.least(F.col("n"), F.ceil(excess / F.col("size")).cast("long"))))
        cells = cut(
            back.select("key", "size", "shard", (F.col("n") - F.col("out")).alias("n")).where("n > 0")
            .union(back.where("out > 0").groupBy("key", "size").agg(F.lit(-1).alias("shard"), F.sum("out").alias("n")).select("key", "size", "shard", "n"))
        )

    # Members of a group take the group's places in the order of (bucket, doc_id).
    plan = cells.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("plan"))  # at most shards + 1 entries
    # A group's rows are found by (key, bucket): a text with any number of copies is many such cells.
    grouped = cut(spot.select("key", "bucket").distinct().join(plan.select("key"), "key"))
    members = spot.join(grouped, ["key", "bucket"], "left_semi")
    ranked = _running(members, ["key"], "bucket", ["doc_id"], F.lit(1))
    by_bucket = grouped.join(plan, "key").select(F.col("key").alias("pk"), F.col("bucket").alias("pb"), "plan")
    ends = F.aggregate(
        "plan", F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("int").alias("shard")),
        lambda s, x: F.struct(
            (s["at"] + x["n"]).alias("at"),
            F.when(s["shard"].isNull() & (F.col("before") < s["at"] + x["n"]), x["shard"]).otherwise(s["shard"]).alias("shard"),
        ),
    )["shard"]
    columns = ["doc_id", "size", "text_crc32", "text_key", "bucket"]
    placed = cut(ranked.join(by_bucket, (F.col("key") == F.col("pk")) & (F.col("bucket") == F.col("pb"))).select(*columns, ends.alias("shard")))
    free = cut(
        spot.join(grouped, ["key", "bucket"], "left_anti").select(*columns)
        .union(placed.where("shard < 0").select(*columns))
    )
    placed = placed.where("shard >= 0")

    loads = [max(0, x) for x in _loads(cells.where("shard >= 0"), shards)]
    is_large = F.col("size") * LARGE > share
    heap = [(x, i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    greedy = []
    # At most LARGE * shards rows, whatever the input.
    for r in sorted(free.where(is_large).groupBy("doc_id", "size", "text_crc32", "text_key", "bucket").count().collect(), key=lambda r: (-r.size, r.text_key, r.doc_id is None, r.doc_id or 0)):
        for i in range(r["count"]):
            load, shard = heapq.heappop(heap)
            greedy.append((r.doc_id, r.size, r.text_crc32, r.text_key, r.bucket, shard))
            heapq.heappush(heap, (load + r.size, shard))
    for load, i in heap:
        loads[i] = load
    placed_large = docs.sparkSession.createDataFrame(greedy, "doc_id long, size long, text_crc32 long, text_key string, bucket int, shard int")

    need, level = free.where(~is_large), sorted(loads)
    rest = total - sum(loads)
    # The level up to which the emptiest shards are filled.
    for i in range(len(level), 0, -1):
        if (rest + sum(level[:i])) / i >= level[i - 1]:
            fill = (rest + sum(level[:i])) / i
            break
    ends_at, run = [], 0.0
    for x in loads:
        run += max(0.0, fill - x)
        ends_at.append(run)
    line = _running(need, [], "bucket", ["doc_id", "text_key"], F.col("size"))
    middle = F.col("before") + F.col("size") / 2
    shard = F.least(F.lit(shards - 1), sum((middle >= F.lit(x)).cast("int") for x in ends_at))
    out = cut(
        placed.select(*columns, "shard").union(placed_large.select(*columns, "shard")).union(line.select(*columns, shard.alias("shard")))
        .withColumn("bucket", F.pmod("bucket", F.lit(256)))
    )
    return _running(out, ["shard"], "bucket", ["doc_id", "text_key"], F.lit(1)).select(
        "doc_id", "size", "text_crc32", "text_key", F.col("shard").cast("int").alias("shard"), F.col("before").cast("long").alias("slot")
    )
