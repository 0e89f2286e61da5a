"""Prefix trie of conversations from vertical bitmaps: what sharing prefixes saves, node by node."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: The root's key; a node's key is a hash of its parent's key and its last turn.
ROOT = bytes(16)
SHARD = "node boolean, key binary, parent binary, depth int, conv_id long, n long, bytes long, ends array<long>, path binary, upto array<long>"
NODE = "key binary, parent binary, depth int, conv_id long, n_convs long, bytes long, ends_sha256 string"

Turn = tuple[bytes, int]


def rebuilt(conv_id: int, own: list[Turn], base: list[Turn]) -> list[Turn]:
    """The first h turns of the base conversation, then the own ones after their first h; h = crc32 of the decimal id modulo 9."""
    h = zlib.crc32(str(conv_id).encode()) % 9
    return base[:h] + own[h:]


def shard_trie(ids: list[int], paths: list[list[Turn]]) -> tuple[list[tuple], list[tuple]]:
    """The trie of a shard's conversations (ids ascend): rows of its nodes, and of its conversations.

    The index has a bitset of conversations for each (position, turn), and one for each length. From the root, a node's bitset is met with
    the posting of its lowest conversation's next turn: that is one child; the conversations left over give the others.
    """
    postings: list[dict[bytes, int]] = []
    lengths: dict[int, int] = {}
    for i, path in enumerate(paths):
        bit = 1 << i
        lengths[len(path)] = lengths.get(len(path), 0) | bit
        while len(postings) < len(path):
            postings.append({})
        for at, (turn, _) in zip(postings, path):
            at[turn] = at.get(turn, 0) | bit
    nodes, keys = [], [[] for _ in ids]
    stack = [((1 << len(ids)) - 1, 0, ROOT, None, 0)] if ids else []
    while stack:
        bits, depth, key, parent, size = stack.pop()
        low = (bits & -bits).bit_length() - 1
        ended = bits & lengths.get(depth, 0)
        rest, ends = bits & ~ended, []
        while ended:
            bit = ended & -ended
            i = bit.bit_length() - 1
            ends.append(ids[i])
            keys[i] = key  # where it ends; see below
            ended ^= bit
        nodes.append((key, parent, depth, ids[low], bits.bit_count(), size, ends))
        while rest:
            turn, n_bytes = paths[(rest & -rest).bit_length() - 1][depth]
            child = rest & postings[depth][turn]
            stack.append((child, depth + 1, hashlib.blake2b(key + turn, digest_size=16).digest(), key, n_bytes))
            rest ^= child
    above = {key: parent for key, parent, *_ in nodes}
    convs = []
    for i, path in enumerate(paths):
        steps, key, total, upto = [], keys[i], 0, [0]
        while key != ROOT:
            steps.append(key)
            key = above[key]
        for _, n_bytes in path:
            upto.append(total := total + n_bytes)
        convs.append((ids[i], b"".join(reversed(steps)), upto))
    return nodes, convs


def _shards(size: int):
    """Sorted turns (base, conv_id, turn, key, bytes) to rows of SHARD, in shards of about `size` conversations that split no family."""

    def rows(ids: list[int], paths: list[list[Turn]]) -> pd.DataFrame:
        nodes, convs = shard_trie(ids, paths)
        out = [(True, *x, None, None) for x in nodes] + [(False, None, None, None, c, None, None, None, path, upto) for c, path, upto in convs]
        return pd.DataFrame(out, columns=["node", "key", "parent", "depth", "conv_id", "n", "bytes", "ends", "path", "upto"]).astype({"depth": "Int32", "n": "Int64", "bytes": "Int64"})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        paths: list[list[Turn]] = []
        family: dict[int, list[Turn]] = {}
        now = None

        def close() -> None:
            for c, own in family.items():
                ids.append(c)
                paths.append(rebuilt(c, own, family.get(now, [])))
            family.clear()

        for pdf in batches:
            for base, c, key, n_bytes in zip(pdf["base"].tolist(), pdf["conv_id"].tolist(), pdf["key"], pdf["bytes"].tolist()):
                if base != now:
                    close()
                    now = base
                    if len(ids) >= size:
                        yield rows(ids, paths)
                        ids, paths = [], []
                family.setdefault(c, []).append((bytes(key), n_bytes))
        close()
        if ids:
            yield rows(ids, paths)

    return each


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shards' nodes in order of key and smallest member to one row a node; shards are ranges of ids, so ends are hashed as they come."""
    columns = ["key", "parent", "depth", "conv_id", "n_convs", "bytes", "ends_sha256"]
    now, digest, any_end = None, hashlib.sha256(), False
    for pdf in batches:
        out = []
        for key, parent, depth, c, n, size, ends in zip(pdf["key"], pdf["parent"], pdf["depth"].tolist(), pdf["conv_id"].tolist(), pdf["n"].tolist(), pdf["bytes"].tolist(), pdf["ends"]):
            if now is None or key != now[0]:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest, any_end = [key, parent, depth, c, 0, size], hashlib.sha256(), False
            now[4] += n
            if len(ends):
                digest.update(("," * any_end + ",".join(map(str, ends))).encode())
                any_end = True
        if out:
            yield pd.DataFrame(out, columns=columns)
    if now is not None:
        yield pd.DataFrame([(*now, digest.hexdigest())], columns=columns)


def conversation_trie(conversations: DataFrame, shard: int = 2048) -> DataFrame:
    """The trie of rebuilt conversations (conv_id, turn, role, text): see rebuilt() for how each one is made from its family, the ids with the same
    conv_id - conv_id % 5 (% as in SQL).

    Per node: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (over its
    subtree, members but one times bytes of the last text) and ends_sha256 (of the ids that end there).

    Turns move once, as hashes and byte counts, to ranges of families. Each range is cut in shards of about `shard` conversations, whose tries come from
    bitmaps; a node has one row a shard, so a first turn that a third of all conversations share moves a row a shard. Shards are merged by the node's key.
    Sums over subtrees need no walk: a conversation owns those nodes whose smallest member it is, which are all of its path from some depth on. Each node
    is owned once, so members but one, summed over a subtree, are its conversations at the depths that they don't own, and leaves are counted by
    their owners. That's one sum by node over the conversations' paths, whatever the depth.

    Null turns come first, equal turns of a conversation in order of a hash of role and text; null role and text are empty; rows with a null conv_id
    are left out; repeated rows are turns of their own; other columns are ignored; an empty table gives no node. One conversation's turns (24 bytes each)
    and one node's hash of ends, which reads its ids shard by shard, are the work of one task.
    """
    text, role = (F.coalesce(c, F.lit("")) for c in ("text", "role"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.sha2(role, 256), text), 256), 1, 32))
    turns = conversations.filter("conv_id is not null").select(
        (F.col("conv_id") - F.col("conv_id") % 5).cast("long").alias("base"), F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes")
    )
    ranged = turns.repartitionByRange("base").sortWithinPartitions("base", "conv_id", F.col("turn").asc_nulls_first(), "key")
    shards = written(ranged.mapInPandas(_shards(shard), SHARD), "shards")
    pieces = shards.filter("node").select("key", "parent", "depth", "conv_id", "n", "bytes", "ends")
    nodes = written(pieces.repartition("key").sortWithinPartitions("key", "conv_id").mapInPandas(_merged, NODE), "nodes")
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("first"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    paths = shards.filter("not node").select("conv_id", "path", "upto").join(owners, "conv_id", "left")
    walk = paths.withColumn("first", F.coalesce("first", F.size("upto"))).select("*", F.explode(F.sequence(F.lit(0), F.size("upto") - 1)).alias("d"))
    before = lambda d: F.get("upto", F.greatest(d - 1, F.lit(0)))
    parts = walk.select(
        F.when(F.col("d") == 0, F.lit(ROOT)).otherwise(F.substring("path", F.col("d") * 16 - 15, F.lit(16))).alias("key"),
        F.greatest(F.lit(0), before(F.col("first")) - before(F.col("d"))).alias("saved"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
    )
    sums = parts.groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "key").join(parents, "parent", "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: h is the crc of the decimal id's bytes, eight shifts a byte.
TRIE_SQL = r"""
WITH turns_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS turns,
         xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b:
             list_reduce(range(8), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(a, b)), 4294967295), 4294967295) % 9 AS h
  FROM turns_ GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5
), steps AS (
  SELECT conv_id, unnest(range(len(turns) + 1)) AS d, turns FROM rebuilt
), nodes AS (
  SELECT d, turns[1:d] AS path, min(conv_id) AS conv_id, count(*) AS n,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = d), '') AS ends FROM steps GROUP BY ALL
), costs AS (
  SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * octet_length(encode(path[d].t)) END AS cost FROM nodes
), kids AS (
  SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), flags AS (
  SELECT c.*, coalesce(n_children, 0) AS n_children FROM costs c LEFT JOIN kids USING (d, path)
), up AS (
  SELECT d, path, unnest(range(d + 1)) AS lv, cost, n_children FROM flags
), sums AS (
  SELECT lv AS d, path[1:lv] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(cost) AS saved FROM up GROUP BY ALL
)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM flags f JOIN sums s ON s.d = f.d AND s.path = f.path LEFT JOIN nodes p ON p.d = f.d - 1 AND p.path = f.path[1:f.d - 1]
"""
