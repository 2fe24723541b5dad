"""Prefix trie of conversations from padded turn-id matrices (operator 12).

A node is a distinct sequence of first turns (role, text); its members are the conversations that start with it. The trie shows
what a training run can share between conversations: ``saved_tokens`` counts code points that need not be read again.

1. *Turn ids.* A turn is the MD5 (128 bits) of its role and text; texts never move. A conversation is the list of its ids.
2. *Range shards.* Conversations are range-partitioned by (ids, conv_id), so that a shard holds a stretch of the sorted order; a
   sequence that a third of all conversations share is cut by conv_id.
3. *Padded matrices.* A shard numbers its turns and sorts its rows by ``numpy.lexsort`` over a matrix of ``COLUMNS`` turns a row,
   padded with zeros. Rows with more turns are sorted on, block by block of columns, within their ties. Column changes between
   neighbours, or-accumulated along the columns, mark where nodes start; their number is the shared prefix ``lcp``.
4. *Every depth by reduceat.* All values of a node are sums over its rows, once ``lcp`` is known. With C(d) the code points of the first d
   turns, in a node of depth d whose first row is s: members: 1 a row; children: rows that are longer than d with lcp <= d, or s;
   leaves: last rows of equal ones whose next row does not go on from them; saved: the sum of C(lcp) over rows but s, less
   (members - 1) * C(d - 1).
5. *Boundary nodes.* Nodes on the path of the first or last row of a shard may go on next door. Their sums carry the MD5 of the path and
   are added up by it. A shard takes its first row to share nothing and its last to be followed by nothing; what the row before
   it changes about that (one row per shard, in order) is added as a correction. All other nodes are whole in their shard.
6. *Ends.* The decimal ids of a node are hashed in the shard; for boundary nodes as a sorted stream of pieces.

Of one conversation all turn ids (not texts) are one row; its head of five turns is joined by conversation number, a hundred to one.

Rows without a conv_id are in no conversation. A null turn comes first, turns that are equal come in the order of the MD5; null roles and
texts are empty. Turnless conversations are members of the root. No conversations: no nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlake.llm.common import stored

#: Width of a padded matrix, and turns (and rows) of a shard.
COLUMNS, SHARD_TURNS = 32, 400_000
#: Boundary nodes are sent to all nodes below them if they are fewer; more are joined.
BROADCAST_NODES = 200_000
BLOCK, HEAD = 100, 5

_EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, ids, chars): per conversation its turn ids and their code points, with the first turns of its block's first one."""
    conv = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.col("turn").cast("long")
    name = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = rows.filter(conv.isNotNull()).select(
        conv.alias("conv_id"), F.struct(turn.isNotNull().alias("there"), turn.alias("turn"), name.alias("id"), F.length(text).cast("long").alias("chars")).alias("t")
    )
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    lists = stored(lists.select("conv_id", F.col("own.id").alias("ids"), F.col("own.chars").alias("chars")), "turns")
    heads = lists.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("of"), F.slice("ids", 1, HEAD).alias("hi"), F.slice("chars", 1, HEAD).alias("hc"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    both = lists.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % BLOCK == F.col("of"), "left")

    def changed(head: str, own: str, kind: str):
        rest = F.slice(own, F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0)))
        return F.concat(F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.lit([]).cast(kind)), rest)

    return both.select("conv_id", changed("hi", "ids", "array<string>").alias("ids"), changed("hc", "chars", "array<long>").alias("chars"))


def lexsorted(conv: np.ndarray, turns: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by (turns, conv), shorter ones first, and what each shares with the row before (-1 for the first)."""
    sizes = np.diff(offsets)
    n = len(sizes)
    rank = np.zeros(n, np.int64)
    blocks = []
    for at in range(0, int(sizes.max(initial=0)), COLUMNS):
        rows = np.flatnonzero(sizes > at)
        matrix = padded(turns, offsets, sizes, rows, at)
        blocks.append(at)
        order = np.lexsort((*matrix.T[::-1], rank[rows]))
        in_order = matrix[order]
        new = np.ones(len(rows), bool)
        new[1:] = (in_order[1:] != in_order[:-1]).any(axis=1) | (np.diff(rank[rows][order]) != 0)
        # rows that ended before come first within their tie, as 0
        place = np.zeros(n, np.int64)
        place[rows[order]] = np.cumsum(new)
        rank = np.unique(rank * (n + 1) + place, return_inverse=True)[1]
    order = np.lexsort((conv, rank))
    shared = np.full(n, -1, np.int64)
    shared[1:] = 0
    open_ = np.arange(1, n)  # places whose row still equals the one before
    for at in blocks:
        open_ = open_[np.minimum(sizes[order[open_]], sizes[order[open_ - 1]]) > at]
        if not len(open_):
            break
        changes = padded(turns, offsets, sizes, order[open_], at) != padded(turns, offsets, sizes, order[open_ - 1], at)
        ends = np.minimum(sizes[order[open_]], sizes[order[open_ - 1]]) - at
        changes |= np.arange(changes.shape[1]) >= ends[:, None]
        marks = np.logical_or.accumulate(changes, axis=1)
        shared[open_] += (~marks).sum(axis=1)
        open_ = open_[~marks[:, -1]]
    return order, shared


def padded(turns: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, rows: np.ndarray, at: int) -> np.ndarray:
    """Turns ``at`` to ``at + COLUMNS`` of the rows, with zeros behind the last."""
    places = at + np.arange(min(COLUMNS, int(sizes.max()) - at))
    inside = places < sizes[rows][:, None]
    return np.where(inside, turns[np.where(inside, offsets[rows][:, None] + places, 0)], 0)


def paths(ids: list[str]) -> list[str]:
    """The MD5 of each prefix of a path of ids, from the empty one."""
    state, out = hashlib.md5(), []
    for i in ["", *ids]:
        state.update(i.encode())
        out.append(state.hexdigest())
    return out


NODE = (
    "kind string, path string, depth long, conv_id long, parent_path string, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved long, base long, ends string, first_ids array<string>, first_chars array<long>, last_ids array<string>"
)
_KINDS = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in NODE.split(", ")])


def shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard: whole ones (``node``), sums of boundary ones (``part``), and its first and last row (``edge``)."""
    table = pa.Table.from_batches(list(batches), pa.schema([("conv_id", pa.int64()), ("ids", pa.list_(pa.string())), ("chars", pa.list_(pa.int64()))]))
    if not table.num_rows:
        return
    conv = table.column("conv_id").to_numpy()
    ids = table.column("ids").combine_chunks()
    offsets = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]).astype(np.int64)
    names = ids.flatten().dictionary_encode()
    turns = names.indices.to_numpy().astype(np.int64) + 1
    # numbers in the order of the ids, so that shard and range order agree
    known = np.array(names.dictionary.to_pylist(), dtype="S32")
    number = np.empty(len(known) + 1, np.int64)
    number[1:][np.argsort(known)] = np.arange(1, len(known) + 1)
    turns = number[turns] if len(turns) else turns
    chars = table.column("chars").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(turns):
        turns, chars = np.zeros(1, np.int64), np.zeros(1, np.int64)
    order, shared = lexsorted(conv, turns, offsets)
    conv, sizes, begins = conv[order], np.diff(offsets)[order], offsets[:-1][order]
    sums = np.concatenate([[0], np.cumsum(chars)])
    n = len(conv)

    def upto(rows: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        return sums[begins[rows] + depth] - sums[begins[rows]]

    every = np.arange(n)
    common = np.where(shared > 0, upto(every, np.maximum(shared, 0)), 0)
    following = np.append(shared[1:], -1)
    leaf = (following < sizes).astype(np.int64)

    def row_ids(row: int) -> list[str]:
        return ids[int(order[row])].as_py()

    first, last = row_ids(0), row_ids(n - 1)
    first_paths, last_paths = paths(first), paths(last)
    edge = [None] * len(_SCHEMA)
    edge[0], edge[3] = "edge", int(conv[0])
    edge[-3:] = [first, [int(c) for c in chars[begins[0] : begins[0] + sizes[0]]], last]
    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(edge, _SCHEMA, strict=True)], schema=_SCHEMA)

    rows, above = every, None
    for depth in range(int(sizes.max()) + 1):
        rows = rows[sizes[rows] >= depth]
        starts = np.flatnonzero((shared[rows] < depth) | (np.arange(len(rows)) == 0))
        heads = rows[starts]
        members = np.diff(np.append(starts, len(rows)))
        longer = sizes[rows] > depth
        children = np.add.reduceat((longer & (shared[rows] <= depth)).astype(np.int64), starts)
        leaves = np.add.reduceat(leaf[rows], starts)
        saved = np.add.reduceat(common[rows], starts) - common[heads]
        least = np.minimum.reduceat(conv[rows], starts)
        base = upto(heads, depth - 1) if depth else np.zeros(len(heads), np.int64)
        ends = np.add.reduceat((~longer).astype(np.int64), starts)
        texts = [_EMPTY] * len(starts)
        for i in np.flatnonzero(ends):
            of = rows[starts[i] : starts[i] + members[i]]
            texts[i] = ",".join(map(str, np.sort(conv[of[sizes[of] == depth]]).tolist()))
        part = np.zeros(len(starts), bool)
        part[0] |= sizes[0] >= depth
        part[-1] |= sizes[n - 1] >= depth
        for i in np.flatnonzero(ends.astype(bool) & ~part):
            texts[i] = hashlib.sha256(texts[i].encode()).hexdigest()
        for i in np.flatnonzero(part & (ends == 0)):
            texts[i] = None
        path: list = [None] * len(starts)
        if sizes[n - 1] >= depth:
            path[-1] = last_paths[depth]
        if sizes[0] >= depth:
            path[0] = first_paths[depth]
        saved = np.where(part, saved, saved - (members - 1) * base)
        if above is None:
            parent_path, parent_conv = [None] * len(starts), [None] * len(starts)
        else:
            parent = np.searchsorted(above[0], heads, side="right") - 1
            parent_path = [above[1][p] for p in parent]
            parent_conv = [None if above[1][p] else int(above[2][p]) for p in parent]
        columns = [
            np.where(part, "part", "node").tolist(), path, [depth] * len(starts), least, parent_path, parent_conv, members, children, leaves, saved, base, texts,
            *[[None] * len(starts)] * 3,
        ]
        above = (heads, path, least)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def corrections(edges: DataFrame) -> DataFrame:
    """What the last row of the shard before changes about the sums of boundary nodes: (path, saved, n_children, n_leaves)."""
    ordered = edges.withColumn("before", F.lag("last_ids").over(Window.orderBy("first_ids", "conv_id"))).filter("before IS NOT NULL")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, chars, before in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shared = next((k for k, (a, b) in enumerate(zip(ids, before)) if a != b), min(len(ids), len(before)))
                saved = sum(chars[:shared])
                # the last row before is no leaf if this one equals it or goes on from it
                leaves = -1 if shared == len(before) else 0
                out = [(p, saved, -1 if d < shared else 0, leaves) for d, p in enumerate(paths(ids[:shared]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["path", "saved", "n_children", "n_leaves"])

    return ordered.select("first_ids", "first_chars", "before").mapInArrow(work, "path string, saved long, n_children long, n_leaves long")


def ends_of(parts: DataFrame) -> DataFrame:
    """(path, sha): the hash of the ids that end at each boundary node, from pieces in the order of their shards."""
    pieces = parts.filter("ends IS NOT NULL").select("path", F.split_part("ends", F.lit(","), F.lit(1)).cast("long").alias("first"), "ends")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for path, ends in zip(batch.column("path").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if path != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = path, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(2)], ["path", "sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["path", "sha"])

    return pieces.repartition("path").sortWithinPartitions("path", "first").select("path", "ends").mapInArrow(work, "path string, sha string")


def trie(conversations: DataFrame) -> DataFrame:
    """For (conv_id, ids, chars): one row per node."""
    rows = stored(conversations, "conversations")
    weight = rows.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    shards = max(1, -(-weight // SHARD_TURNS))
    found = stored(rows.repartitionByRange(shards, "ids", "conv_id").select("conv_id", "ids", "chars").mapInArrow(shard_nodes, NODE), "nodes")
    parts = found.filter("kind = 'part'")
    sums = ["n_convs", "n_children", "n_leaves", "saved"]
    changes = corrections(found.filter("kind = 'edge'")).withColumn("n_convs", F.lit(0).cast("long"))
    all_parts = parts.select("path", "depth", "conv_id", "parent_path", "base", *sums).unionByName(changes, allowMissingColumns=True)
    whole = all_parts.groupBy("path").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent_path").alias("parent_path"),
        F.max("base").alias("base"), *[F.sum(c).alias(c) for c in sums],
    )
    whole = whole.join(ends_of(parts), "path", "left").withColumn("saved", F.col("saved") - (F.col("n_convs") - 1) * F.col("base"))
    whole = stored(whole.withColumn("ends", F.coalesce("sha", F.lit(_EMPTY))).drop("sha", "base"), "boundary")
    up = whole.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("up"))
    up = F.broadcast(up) if whole.count() <= BROADCAST_NODES else up
    inside = found.filter("kind = 'node'").select("depth", "conv_id", "parent_path", "parent_conv_id", *sums, "ends")
    nodes = inside.unionByName(whole.drop("path").withColumn("parent_conv_id", F.lit(None).cast("long"))).join(up, "parent_path", "left")
    return nodes.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP12_SQL = r"""
WITH crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
own AS MATERIALIZED (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h FROM own, crc_table),
seqs AS MATERIALIZED (
  SELECT a.conv_id, list_concat(CASE WHEN b.turns IS NULL THEN [] ELSE b.turns[1:h] END, a.turns[h + 1:]) AS seq
  FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
steps AS MATERIALIZED (
  SELECT conv_id, len(seq) AS n, unnest(range(len(seq) + 1)) AS d, seq FROM seqs),
keyed AS MATERIALIZED (
  SELECT conv_id, n, d, sha256(CAST(seq[1:d] AS VARCHAR) || d) AS k, CASE WHEN d > 0 THEN sha256(CAST(seq[1:d - 1] AS VARCHAR) || (d - 1)) END AS up,
    CASE WHEN d > 0 THEN length(seq[d].t) ELSE 0 END AS chars FROM steps),
nodes AS MATERIALIZED (
  SELECT k, any_value(d) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own_saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM keyed GROUP BY k),
children AS (SELECT up AS k, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
full_nodes AS MATERIALIZED (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (k)),
below AS (
  SELECT DISTINCT a.k AS top, b.k FROM keyed a JOIN keyed b ON a.conv_id = b.conv_id AND a.d <= b.d),
subtree AS (
  SELECT top AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(own_saved)::BIGINT AS saved_tokens FROM below JOIN full_nodes USING (k) GROUP BY top)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_nodes f JOIN subtree USING (k) LEFT JOIN full_nodes p ON p.k = f.up
"""
