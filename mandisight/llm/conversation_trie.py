"""Operator 13: the prefix trie of rebuilt conversations, by vertical bitmaps.

1. Turns are range-partitioned and sorted so that a conversation and the one
   it borrows its first turns from (``conv_id - conv_id % FAMILY``) are in one
   task; a turn travels as a 16-byte key of role and text, with its length.
2. A task cuts its conversations, in ascending order, into shards of bounded
   size. In a shard conversation i is bit i. Every (position, turn) has a
   posting, the bitset of the conversations that hold that turn there. From
   the root down, depth first, a node's bitset is intersected with the posting
   of its smallest member's next turn: that is a child, its popcount the
   child's members; its bits are taken out and the next smallest member gives
   the next child. Members without a next turn are the node's end list.
3. Nodes of different shards are one node if their paths are equal (a 16-byte
   chained digest). Member and end counts add up over the shards, and the
   shard of the smallest member owns the node. A second pass over each shard's
   nodes, in the order of the walk, sums over subtrees what the shard owns;
   those sums add up as well. So a first turn or a whole conversation that a
   third of the corpus shares is one row per shard, and depth costs no rounds.

Defined results: rows with a null conv_id belong to no conversation; null role
or text is empty; of rows with equal turn numbers the one with the smaller turn
key comes first, and equal rows are turns of their own; empty turns are turns;
an empty table has no conversation, hence no root and no rows; extra columns
are not read. ``%`` takes the sign of its left side, as in SQL. A task holds the
turn keys of one family of conversations (at most 199) and of one shard.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mandisight.llm.common import table, written

#: A conversation borrows from the one at the start of its family of ids.
FAMILY = 100
#: It borrows crc32 of its id modulo this many turns.
BORROWED = 6
#: Conversations and turns of a shard (a family is not divided).
SHARD_CONVS = 2048
SHARD_TURNS = 1 << 16

ROOT = b"\0" * 16
NODE_SCHEMA = ("shard long, pre long, node binary, depth long, n long, first long, chars long, n_ends long, "
               "ends_sha256 string, ends array<long>")


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that tell turns of different role or text apart."""
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(named.cast("binary"), 256), 1, 32))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, turn, key, chars) without texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    conv = F.col("conv_id").cast("long")
    return conversations.where(F.col("conv_id").isNotNull()).select(
        (conv - conv % FAMILY).alias("base"), conv.alias("conv_id"), "turn",
        turn_key(role, text).alias("key"), F.char_length(text).cast("long").alias("chars"))


def borrowed_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % BORROWED


Conversation = tuple[int, list[bytes], list[int]]


def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Conversation]]:
    """The families of a sorted partition: (conv_id, turn keys, turn lengths) of their rebuilt conversations."""
    base, family = None, {}

    def done() -> list[Conversation]:
        first = family.get(base, ([], []))
        out = []
        for conv_id, (keys, chars) in sorted(family.items()):
            h = borrowed_turns(conv_id)
            out.append((conv_id, first[0][:h] + keys[h:], first[1][:h] + chars[h:]))
        return out

    for batch in batches:
        for b, conv_id, key, n in zip(*(batch.column(c).to_pylist() for c in ("base", "conv_id", "key", "chars")),
                                      strict=True):
            if b != base:
                if family:
                    yield done()
                base, family = b, {}
            keys, chars = family.setdefault(conv_id, ([], []))
            keys.append(key)
            chars.append(n)
    if family:
        yield done()


def sharded(families: Iterator[list[Conversation]], most_convs: int, most_turns: int) -> Iterator[list[Conversation]]:
    held, n_turns = [], 0
    for family in families:
        if held and (len(held) + len(family) > most_convs or n_turns > most_turns):
            yield held
            held, n_turns = [], 0
        held += family
        n_turns += sum(len(c[1]) for c in family)
    if held:
        yield held


def bits_of(bitset: int) -> list[int]:
    """Places of the set bits, ascending."""
    data = np.frombuffer(bitset.to_bytes((bitset.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(data, bitorder="little")).tolist()


def child_of(node: bytes, key: bytes) -> bytes:
    return hashlib.blake2b(node + key, digest_size=16).digest()


def decimal_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def walk(convs: list[Conversation]) -> Iterator[tuple]:
    """The nodes of a shard depth first: (node, depth, members, smallest member, chars, ended conversations)."""
    ids = [c[0] for c in convs]
    ended: dict[int, int] = defaultdict(int)
    alive = np.zeros(max((len(c[1]) for c in convs), default=0) + 2, np.int64)
    for i, (_, keys, _) in enumerate(convs):
        ended[len(keys)] |= 1 << i
        alive[len(keys) + 1] -= 1
    alive = np.cumsum(alive) + len(convs)  # conversations with at least so many turns
    postings: dict[tuple[int, bytes], int] = defaultdict(int)
    for i, (_, keys, _) in enumerate(convs):
        for d, key in enumerate(keys):
            if alive[d + 1] < 2:
                break  # beyond here the conversation is alone
            postings[d, key] |= 1 << i
    open_ = [((1 << len(convs)) - 1, 0, ROOT, 0)]
    while open_:
        members, depth, node, chars = open_.pop()
        n = members.bit_count()
        i = (members & -members).bit_length() - 1
        if n == 1:
            _, keys, sizes = convs[i]
            for d in range(depth, len(keys)):
                yield node, d, 1, ids[i], chars, []
                node, chars = child_of(node, keys[d]), sizes[d]
            yield node, len(keys), 1, ids[i], chars, [ids[i]]
            continue
        here = members & ended.get(depth, 0)
        yield node, depth, n, ids[i], chars, [ids[k] for k in bits_of(here)] if here else []
        rest, children = members ^ here, []
        while rest:
            i = (rest & -rest).bit_length() - 1
            key = convs[i][1][depth]
            # One conversation that goes on alone needs no posting (there may be none).
            child = rest if not rest & (rest - 1) else members & postings[depth, key]
            rest ^= child
            children.append((child, depth + 1, child_of(node, key), convs[i][2][depth]))
        open_ += reversed(children)


def shard_nodes(conversations: DataFrame, shard_convs: int = SHARD_CONVS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of every shard, in the order of its walk; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.string(), pa.list_(pa.int64())]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

        first = TaskContext.get().partitionId() << 40
        for k, convs in enumerate(sharded(rebuilt(batches), shard_convs, shard_turns)):
            rows = []
            for pre, (node, depth, n, least, chars, ends) in enumerate(walk(convs)):
                rows.append((first + k, pre, node, depth, n, least, chars, len(ends),
                             decimal_digest(ends) if ends else None, ends or None))
                if len(rows) >= 10_000:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)

    # The conversation that others borrow from is in the same family, so in the same partition.
    dealt = turns_of(conversations).repartitionByRange("base").sortWithinPartitions(
        "base", "conv_id", F.col("turn").asc_nulls_first(), "key")
    return written(dealt.select("base", "conv_id", "key", "chars").mapInArrow(run, NODE_SCHEMA), "trie-shards")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """Per shard and node what the shard owns below it: children, leaves and saved tokens."""
    columns = ["shard", "node", "depth", "conv_id", "n_convs", "chars", "owned", "childless", "parts", "ends_sha256"]

    def shard_sums(rows: list[tuple]) -> list[tuple]:
        above, path = [], []
        for r in rows:
            del path[r[2]:]
            above.append(path[-1] if path else None)
            path.append(len(above) - 1)
        kids, leaves, saved = [0] * len(rows), [0] * len(rows), [0] * len(rows)
        for i in range(len(rows) - 1, -1, -1):
            _, _, _, _, n_convs, chars, owned, childless, _, _ = rows[i]
            if owned:
                saved[i] += (n_convs - 1) * chars
                leaves[i] += childless
            if (p := above[i]) is not None:
                kids[p] += owned
                leaves[p] += leaves[i]
                saved[p] += saved[i]
        return [(r[1], r[3], r[2], None if p is None else rows[p][3], r[4], k, n, s, r[8], r[9])
                for r, p, k, n, s in zip(rows, above, kids, leaves, saved, strict=True)]

    names = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
             "parts", "ends_sha256"]
    types = [pa.binary(), *[pa.int64()] * 8, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*shard_sums(rows)), types, strict=True)], names)

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield packed(held)
                    held = []
                held.append(row)
        if held:
            yield packed(held)

    dealt = nodes.repartition("shard").sortWithinPartitions("shard", "pre")
    return dealt.select(*columns).mapInArrow(
        run, ", ".join(f"{n} {'binary' if n == 'node' else 'string' if n == 'ends_sha256' else 'long'}" for n in names))


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of end lists (node, ends) that several shards hold, streamed in ascending order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, None
        for batch in batches:
            out = []
            for n, ids in zip(batch["node"], batch["ends"], strict=True):
                if n != node:
                    if node is not None:
                        out.append((node, digest.hexdigest()))
                    node, digest = n, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(",".join(map(str, ids)).encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(node, digest.hexdigest())], columns=["node", "ends_sha256"])

    # Shards hold disjoint ascending ranges, so the order of the lists is that of their first ids. A hot node has
    # a row per shard, not per conversation.
    dealt = ends.repartition("node").sortWithinPartitions("node", F.col("ends")[0])
    return dealt.select("node", "ends").mapInPandas(run, "node binary, ends_sha256 string")


def trie(conversations: DataFrame, shard_convs: int = SHARD_CONVS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    local = shard_nodes(conversations, shard_convs, shard_turns)
    same = Window.partitionBy("node")
    nodes = local.drop("ends").select(
        "*", F.sum("n").over(same).alias("n_convs"), F.min("first").over(same).alias("conv_id"),
        F.sum("n_ends").over(same).alias("_ended"), F.count(F.lit(1)).over(same).alias("parts"))
    nodes = nodes.withColumn("owned", (F.col("first") == F.col("conv_id")).cast("long")).withColumn(
        "childless", (F.col("_ended") == F.col("n_convs")).cast("long"))
    sums = written(subtree_sums(nodes), "trie-sums")
    none = hashlib.sha256(b"").hexdigest()
    whole = sums.where("parts = 1").drop("parts")
    split = sums.where("parts > 1").drop("parts", "ends_sha256").groupBy("node").agg(
        *[F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")],
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    split = written(split, "trie-shared")
    lists = local.where("ends is not null").select("node", "ends").join(split.select("node"), "node", "left_semi")
    split = split.join(end_digests(lists), "node", "left")
    return whole.unionByName(split).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


#: DuckDB has no crc32: the table of its 256 bytes and the fold over an id's digits are stated here.
SQL = """
WITH crc_table AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS v
    FROM range(256) r(n))
), turns AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT conv_id, key, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos FROM turns
), conv AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), rebuilt AS (
  SELECT c.conv_id, pos, key, chars FROM conv c JOIN placed p ON p.conv_id = c.base AND pos <= h
  UNION ALL
  SELECT c.conv_id, pos, key, chars FROM conv c JOIN placed p ON p.conv_id = c.conv_id AND pos > h
), whole AS (
  SELECT c.conv_id, coalesce(list(key ORDER BY pos) FILTER (WHERE key IS NOT NULL), []) AS keys,
         coalesce(list(chars ORDER BY pos) FILTER (WHERE key IS NOT NULL), []) AS sizes
  FROM conv c LEFT JOIN rebuilt r ON c.conv_id = r.conv_id GROUP BY c.conv_id
), member AS (
  SELECT conv_id, len(keys) AS n_turns, unnest(range(len(keys) + 1)) AS depth, keys, sizes FROM whole
), node AS (
  SELECT keys[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(sizes[depth]), 0) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n_turns = depth), '')) AS ends_sha256
  FROM member GROUP BY ALL
), kids AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL
), known AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN kids k ON n.path = k.path
), below AS (
  SELECT path[1:up] AS path, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens,
         count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM known) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM known n JOIN below b ON n.path = b.path
LEFT JOIN node p ON n.depth > 0 AND n.path[1:n.depth - 1] = p.path
"""
