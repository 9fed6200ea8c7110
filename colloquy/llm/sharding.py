"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Rows of one text that lie in one block of 1024 rows, as stored, are one node, CELL rows at most, so a
text that a third of all rows have is many nodes of bounded weight. The nodes of a text are linked to their
first one; a text with more rows than half a shard has several such stars, linked in a chain. Links
between documents of different texts may be given besides.

Each node starts in a shard by its hash. In a round half of the nodes, by a seeded coin, look at
the shards of those they are linked with (Spark joins and aggregates over links) and want to move
where that cuts fewer links. What moves from each shard to each other is thinned out until no shard
gains more than its quota of rows has room for, counting what leaves it; so full shards exchange
rows. The greatest gains go first: sums of weights by classes of gain and hash find the last class
that goes, so nothing is sorted or gathered; the driver sees a number for each pair of shards. Rounds
end when nobody wants to move, or none was let in for three rounds, or after ROUNDS. On the way a
shard may have SLACK more than its quota.

Rows without links then fill the shards up, so that row counts are at most one apart (law `rows`);
rows beyond a quota are dealt out with them. All numbers come from counts by block and places inside
one, never from a sort of a shard.

Results at the edges: null text has the size 1 and the check sum of the empty text, and is linked
with empty and null texts; null or repeated ids, repeated rows and extra columns are kept, in the
struct row (all columns of the caller but text); fewer rows than shards leave shards empty; an empty
table gives an empty result. Which unlinked row fills which shard follows the order in which the
table is read.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_keys, join_spread, materialize, read

SHARDS, ROUNDS, SEED = 16, 16, 11
#: Rows of a node at most, and classes of hash in which movers of one gain are let in.
CELL, CLASSES = 1024, 4096
#: Bits of a row's number inside its block.
BLOCK_BITS = 10
#: Share of a quota by which propagation may exceed it; level() ends at the quota itself.
SLACK = 0.01
#: Rounds without a move after which propagation ends.
PATIENCE = 3
LAW = "rows"


def quotas(n: int, shards: int) -> list[int]:
    """Rows of each shard, at most one apart."""
    return [n // shards + (j < n % shards) for j in range(shards)]


def _table(numbers: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps([int(x) for x in numbers])), "array<bigint>")


def nodes_of(rows: DataFrame, cell: int, half: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (k, digest) to (rows with node, nodes (node, weight) of texts found twice or more, links (u, v))."""
    by_part = Window.partitionBy("digest", "part")
    at = rows.withColumn("part", F.shiftright("k", BLOCK_BITS)).withColumn("_sub", F.floor((F.row_number().over(by_part.orderBy("k")) - 1) / cell))
    at = at.withColumn("node", F.first("k").over(Window.partitionBy("digest", "part", "_sub").orderBy("k")))
    at = materialize(at.drop("_sub", "part"), "rows")
    cells = at.groupBy("digest", "node").agg(F.count(F.lit(1)).alias("weight"))
    text = Window.partitionBy("digest")
    cells = cells.withColumn("_all", F.sum("weight").over(text)).where("_all > 1").withColumn("_star", F.floor((F.sum("weight").over(text.orderBy("node")) - F.col("weight")) / half))
    cells = materialize(cells.withColumn("_hub", F.min("node").over(Window.partitionBy("digest", "_star"))), "cells")
    spokes = cells.where("node <> _hub").select(F.col("node").alias("u"), F.col("_hub").alias("v"))
    before = F.lag("node").over(text.orderBy("node"))
    chain = cells.where("node = _hub").select(F.col("node").alias("u"), before.alias("v")).where("v is not null")
    return at, cells.select("node", "weight"), spokes.unionByName(chain)


def with_links(rows: DataFrame, nodes: DataFrame, links: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and links with those that given, pairs (a, b) of doc_ids, add; a doc_id of several rows stands for all of them."""
    of = rows.select("doc_id", "node").where("doc_id is not null").distinct()
    named = lambda df, c, to: df.join(of.select(F.col("doc_id").alias(c), F.col("node").alias(to)), c)
    more = named(named(given, "a", "u"), "b", "v").select("u", "v").where("u <> v")
    ends = more.select(F.col("u").alias("node")).union(more.select("v")).distinct()
    single = ends.join(nodes, "node", "left_anti").select("node", F.lit(1).cast("long").alias("weight"))
    return nodes.unionByName(single), links.unionByName(more)


def flows(wanted: np.ndarray, room: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """Weights that may move from i to j: wanted, thinned out until no shard gains more than its room; rounded by a seeded coin."""
    flow = wanted.astype(float)
    for _ in range(1000):
        gains, leaving = flow.sum(axis=0), flow.sum(axis=1)
        over = gains - leaving > np.maximum(room, 0) + 1e-6
        if not over.any():
            break
        flow[:, over] *= ((np.maximum(room, 0) + leaving)[over] / gains[over])[None, :]
    coins = np.random.default_rng([seed, turn]).random(flow.shape)
    return np.minimum(np.floor(flow + coins), wanted).astype(np.int64)


def _within(taken: np.ndarray, room: np.ndarray) -> np.ndarray:
    """taken without the least pairs whose moves would take a shard beyond its room, since others took less than they might."""
    taken = taken.copy()
    while True:
        over = taken.sum(axis=0) - taken.sum(axis=1) - np.maximum(room, 0)
        j = int(over.argmax())
        if over[j] <= 0:
            return taken
        into = np.where(taken[:, j] > 0, taken[:, j], np.iinfo(np.int64).max)
        enough = np.where(into >= over[j], into, np.iinfo(np.int64).max)
        taken[int((enough if enough.min() < np.iinfo(np.int64).max else into).argmin()), j] = 0


def propagate(nodes: DataFrame, links: DataFrame, quota: list[int], rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """nodes (node, weight) and links (u, v) to (node, weight, shard)."""
    shards = len(quota)
    both = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("links"))
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "links")), "links")
    hot = materialize(hot_keys(both.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "v"), "hot")
    now = materialize(nodes.select("node", "weight", F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(shards)).cast("int").alias("shard")), "shards")
    slack = np.array([max(1, int(SLACK * q)) for q in quota])
    loads, idle = np.zeros(shards, np.int64), 0
    for j, w in now.groupBy("shard").agg(F.sum("weight")).collect():
        loads[j] = w
    for turn in range(rounds):
        near = join_spread(both, now.select(F.col("node").alias("v"), "shard"), "v", hot, "u")
        votes = near.groupBy("u", "shard").agg(F.sum("links").alias("n"))
        best = votes.groupBy(F.col("u").alias("node")).agg(F.max(F.struct("n", F.xxhash64("u", "shard").alias("h"), F.col("shard").alias("to"))).alias("best"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("of"))
        gain = F.col("best.n") - F.coalesce(F.try_element_at("of", F.col("shard")), F.lit(0))
        wants = now.join(best, "node").select("node", "weight", "shard", F.col("best.to").alias("to"), gain.alias("gain")).where("gain > 0")
        coin = F.xxhash64(F.lit(seed), F.lit(turn), "node")
        # the greatest power of two in the gain, then a class of the hash
        rank = (F.lit(62) - F.floor(F.log2("gain"))) * CLASSES + F.pmod(F.shiftright(coin, 8), F.lit(CLASSES))
        pair = F.col("shard") * shards + F.col("to")
        wants = materialize(wants.select("node", "weight", "to", pair.alias("pair"), rank.alias("rank"), (coin % 2 == 0).alias("moves")), "wants")
        room = np.array(quota) - loads + slack
        classes = wants.where("moves").groupBy("pair", "rank").agg(F.sum("weight").alias("w"))
        wanted = np.zeros((shards, shards), np.int64)
        for p, w in classes.groupBy("pair").agg(F.sum("w")).collect():
            wanted[p // shards, p % shards] = w
        allowed = _table(flows(wanted, room, turn, seed).ravel())
        so_far = F.sum("w").over(Window.partitionBy("pair").orderBy("rank"))
        fits = classes.select("pair", "rank", so_far.alias("so_far")).where(F.col("so_far") <= F.get(allowed, F.col("pair"))).groupBy("pair").agg(F.max("rank").alias("last"), F.max("so_far").alias("w"))
        taken, last = np.zeros_like(wanted), {}
        for p, r, w in fits.collect():
            taken[p // shards, p % shards], last[p] = w, r
        taken = _within(taken, room)
        loads += taken.sum(axis=0) - taken.sum(axis=1)
        taken = taken.ravel()
        if taken.any():
            limits = _table([last[p] if taken[p] else -1 for p in range(shards * shards)])
            let_in = wants.where(F.col("moves") & (F.col("rank") <= F.get(limits, F.col("pair")))).select("node", "to")
            now = materialize(now.join(let_in, "node", "left").select("node", "weight", F.coalesce("to", "shard").alias("shard")), "shards")
        idle = 0 if taken.any() else idle + 1
        if idle == PATIENCE or idle and wants.isEmpty():
            break
    return now


def cut_links(links: DataFrame, placed: DataFrame) -> DataFrame:
    """How many links there are, and how many lie across shards."""
    side = lambda c, s: placed.select(F.col("node").alias(c), F.col("shard").alias(s))
    return links.join(side("u", "a"), "u").join(side("v", "b"), "v").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("a") != F.col("b")).alias("cut"))


def level(rows: DataFrame, placed: DataFrame, quota: list[int]) -> DataFrame:
    """rows (k, node) with shard and slot: placed nodes' rows where they are, up to the quota, all others where room is left."""
    shards = len(quota)
    with_shard = rows.join(placed.select("node", F.col("shard").alias("_to")), "node", "left").withColumn("_to", F.coalesce("_to", F.lit(shards))).withColumn("_part", F.shiftright("k", BLOCK_BITS))
    with_shard = materialize(with_shard, "labelled")
    counts = with_shard.groupBy("_to", "_part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("_to", "_part", (F.sum("n").over(Window.partitionBy("_to").orderBy("_part")) - F.col("n")).alias("_before"))
    held = dict(counts.groupBy("_to").agg(F.sum("n")).collect())
    over = [max(0, held.get(j, 0) - q) for j, q in enumerate(quota)]
    kept = [min(held.get(j, 0), q) for j, q in enumerate(quota)]
    free = [q - x for q, x in zip(quota, kept, strict=True)]
    running = lambda xs: [sum(xs[:j]) for j in range(len(xs))]
    place_in = F.row_number().over(Window.partitionBy("_to", "_part").orderBy("k")) - 1
    numbered = with_shard.withColumn("_row", place_in).join(offsets, ["_to", "_part"]).withColumn("_n", F.col("_row") + F.col("_before"))
    stays = (F.col("_to") < shards) & (F.col("_n") < F.get(_table([*quota, 0]), F.col("_to")))
    # the number among all rows that are dealt out: those without links, then those beyond each quota
    spare = F.when(F.col("_to") == shards, F.col("_n")).otherwise(F.lit(held.get(shards, 0)) + F.get(_table([*running(over), 0]), F.col("_to")) + F.col("_n") - F.get(_table([*quota, 0]), F.col("_to")))
    firsts = running(free)
    numbered = numbered.withColumn("_spare", F.when(~stays, spare))
    to = F.when(stays, F.col("_to")).otherwise(F.size(F.filter(_table([x + f for x, f in zip(firsts, free, strict=True)]), lambda end: end <= F.col("_spare"))))
    numbered = numbered.withColumn("shard", to.cast("int"))
    slot = F.when(stays, F.col("_n")).otherwise(F.get(_table(kept), F.col("shard")) + F.col("_spare") - F.get(_table(firsts), F.col("shard")))
    return numbered.withColumn("slot", slot.cast("long"))


def place(docs: DataFrame, shards: int = SHARDS, links: DataFrame | None = None, cell: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """docs (doc_id, text and others) to (row, size, text_crc32, shard, slot); links are pairs (a, b) of doc_ids that belong together."""
    text = F.coalesce("text", F.lit(""))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    size = (F.octet_length(text) + 1).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("k"), whole, F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = materialize(rows, "keys")
    quota = quotas(rows.count(), shards)
    cell = cell or max(1, min(CELL, quota[0] // shards))
    rows, nodes, found = nodes_of(rows, cell, max(1, quota[0] // 2))
    if links is not None:
        nodes, found = with_links(rows, nodes, found, links)
    placed = propagate(nodes, found, quota, rounds)
    return level(rows, placed, quota).select("row", "size", "text_crc32", "shard", "slot")


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
