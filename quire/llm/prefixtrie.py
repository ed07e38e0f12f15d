"""The trie of conversation prefixes, from padded matrices of turn ids.

Rebuilt conversations are cut into segments of ``SEGMENT`` turns; a segment is a row of 128-bit
turn ids with a digest of all turns before it. Rows are range-partitioned in the order of
(segment, digest, turn ids, conv_id) into shards of bounded size. In a shard the ids become
small numbers in a matrix padded with -1; numpy's lexsort puts rows in order, OR-accumulated
masks of column changes mark where nodes begin, and ``reduceat`` over the columns adds up
members, children, leaves and saved tokens of each node at each depth.

A node is closed if all its members must be in one shard. The nodes on the paths of a shard's
first and last rows, and of rows that go on in a next segment, are open: their parts from all
shards are added by the digest of their prefix, and sums over their subtrees are made by
doubling pointers to ancestors, in as many rounds as the depth has bits. Only the members that
end at an open node are gathered, in order of their ids, and hashed as a stream.

* Turns are ordered by turn (null first), equal ones by an order that depends on their role
  and text; a repeated row is a turn of its own. Null roles and texts become empty.
* A row without a conv_id belongs to no conversation and is left out. Ids may be negative;
  the remainder by five is that of the floor, so that families are runs of five ids.
* A hot first turn or a crowd of equal conversations spreads over shards. One conversation, with
  those that take its head, is read as a stream in one task: ids only, 64 turns held at a time.
* Other columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import gathered, passing, small_batches, written

#: Turns of a segment: the most columns of a matrix. Rows of a shard, about.
SEGMENT, SHARD_ROWS = 64, 25_000
_SEED = 0x5DEECE66D

_ROW = [("segment", pa.int64(), "long"), ("digest", pa.binary(), "binary"), ("ids", pa.list_(pa.int64()), "array<long>"), ("conv_id", pa.int64(), "long"), ("sizes", pa.list_(pa.int64()), "array<long>"), ("goes_on", pa.bool_(), "boolean")]

#: What a shard knows: closed nodes, parts of open nodes and members that end at open nodes.
_PART = [
    ("kind", pa.string(), "string"), ("key", pa.binary(), "binary"), ("parent_key", pa.binary(), "binary"), ("depth", pa.int64(), "long"), ("conv_id", pa.int64(), "long"), ("parent_conv_id", pa.int64(), "long"),
    ("n_convs", pa.int64(), "long"), ("n_children", pa.int64(), "long"), ("n_leaves", pa.int64(), "long"), ("saved_tokens", pa.int64(), "long"), ("size", pa.int64(), "long"), ("ends_sha256", pa.string(), "string"),
]


def _ddl(fields: list[tuple]) -> str:
    return ", ".join(f"{n} {k}" for n, _, k in fields)


def _record(fields: list[tuple], columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k, _) in zip(columns, fields)], names=[f[0] for f in fields])


def shared_heads(conversations: DataFrame, family: int = 5, modulus: int = 9) -> DataFrame:
    """Segments of rebuilt conversations: each takes the first turns of the conversation whose
    id is the next lower multiple of ``family``, as many as the crc32 of its own id leaves by
    ``modulus``, and goes on with its own turns after as many. A conversation without turns
    that are left has one empty segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in _ROW]
        base, head, conv = None, [], None  # the family, its first turns, the conversation that is open
        turns: list[tuple] = []  # of the segment that is open
        segment, digest, at, skip = 0, b"", 0, 0

        def close(goes_on: bool) -> None:
            nonlocal segment, digest, turns
            ids = [x for t in turns for x in t[:2]]
            for c, v in zip(out, (segment, digest, ids, conv, [t[2] for t in turns], goes_on)):
                c.append(v)
            if goes_on:
                digest = hashlib.blake2b(digest + np.array(ids, np.int64).tobytes(), digest_size=16).digest()
                segment, turns = segment + 1, []

        def put(turn: tuple) -> None:
            if len(turns) == SEGMENT:
                close(True)
            turns.append(turn)

        for t in gathered(batches):
            for b, c, h, *turn in zip(*(t.column(n).to_pylist() for n in ("base", "conv_id", "take", "a", "b", "size"))):
                if c != conv:
                    if conv is not None:
                        close(False)
                    if b != base:
                        base, head = b, []
                    conv, turns, segment, digest, at, skip = c, [], 0, b"", 0, 0
                    if c != b:
                        skip = h
                        for x in head[:h]:
                            put(x)
                if c == b and len(head) < modulus - 1:
                    head.append(tuple(turn))
                if at >= skip:
                    put(tuple(turn))
                at += 1
            if len(out[0]) > 2000:
                yield _record(_ROW, out)
                for x in out:
                    x.clear()
        if conv is not None:
            close(False)
        if out[0]:
            yield _record(_ROW, out)

    small_batches(conversations.sparkSession)
    c = F.col("conv_id").cast("long")
    said = [F.coalesce(F.col(x), F.lit("")) for x in ("role", "text")]
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        (c - F.pmod(c, F.lit(family))).alias("base"), c.alias("conv_id"), F.col("turn").alias("turn"), (F.crc32(c.cast("string")) % modulus).alias("take"),
        F.xxhash64(*said).alias("a"), F.xxhash64(F.lit(_SEED), *said).alias("b"), F.octet_length(said[1]).cast("long").alias("size"),
    )
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "a", "b"]
    return turns.repartition("base").sortWithinPartitions(*order).drop("turn").mapInArrow(run, _ddl(_ROW))


def _numbered(ids: np.ndarray) -> np.ndarray:
    """Pairs of 64-bit numbers as numbers from 0, in the order of the pairs."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]).any(1)
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


class Shard:
    """The segments of a shard as a padded matrix in order, with the starts of all nodes."""

    def __init__(self, t: pa.Table):
        self.digests = t.column("digest").to_pylist()
        segment, conv = (t.column(c).to_numpy().astype(np.int64) for c in ("segment", "conv_id"))
        lists = [t.column(c).combine_chunks() for c in ("ids", "sizes")]
        flat = lists[0].flatten().to_numpy().reshape(-1, 2)
        lengths = lists[1].value_lengths().to_numpy().astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        width = int(lengths.max(initial=0))
        rows, columns = np.repeat(np.arange(len(conv)), lengths), np.arange(len(flat)) - np.repeat(starts, lengths)
        matrix, size = np.full((len(conv), width), -1, np.int64), np.zeros((len(conv), width), np.int64)
        matrix[rows, columns], size[rows, columns] = _numbered(flat), lists[1].flatten().to_numpy()
        names = {d: i for i, d in enumerate(sorted(set(self.digests)))}
        group = np.array([names[d] for d in self.digests])
        self.order = order = np.lexsort((conv, *matrix.T[::-1], group, segment))
        self.matrix, self.size, self.conv, self.segment, self.lengths = matrix[order], size[order], conv[order], segment[order], lengths[order]
        self.goes_on = t.column("goes_on").to_numpy(zero_copy_only=False)[order]
        self.flat, self.starts, self.width = flat, starts[order], width
        change = np.zeros((len(conv), width + 1), bool)
        change[0] = True
        change[1:, 0] = (np.diff(segment[order]) != 0) | (np.diff(group[order]) != 0)
        change[1:, 1:] = self.matrix[1:] != self.matrix[:-1]
        self.change = np.logical_or.accumulate(change, axis=1)
        open_row = self.goes_on.copy()
        open_row[[0, -1]] = True
        self.open_row = open_row

    def digest(self, row: int) -> bytes:
        return self.digests[self.order[row]]

    def prefix(self, row: int, turns: int) -> bytes:
        """The digest that names the node at ``turns`` turns into the row's segment."""
        if not turns:
            return self.digest(row)
        at = self.starts[row]
        return hashlib.blake2b(self.digest(row) + np.ascontiguousarray(self.flat[at : at + turns]).tobytes(), digest_size=16).digest()

    def parts(self) -> Iterator[pa.RecordBatch]:
        """What the shard knows of its nodes, a batch for each column from the last one."""
        rows = len(self.conv)
        below = {k: np.zeros(rows, np.int64) for k in ("children", "leaves", "saved")}  # at the starts of closed nodes of the next column
        for j in range(self.width, -1, -1):  # column j holds the nodes j turns into the segment
            all_starts = np.flatnonzero(self.change[:, j])
            real = self.matrix[all_starts, j - 1] >= 0 if j else np.ones(len(all_starts), bool)
            total = lambda x: np.add.reduceat(x, all_starts)[real]  # noqa: E731, B023
            starts = all_starts[real]
            ends = np.append(all_starts[1:], rows)[real]
            n, conv = ends - starts, np.minimum.reduceat(self.conv, all_starts)[real]
            is_open = np.logical_or.reduceat(self.open_row, all_starts)[real] if j else np.ones(len(starts), bool)
            children, leaves, saved = (total(below[k]) for k in ("children", "leaves", "saved"))
            size = self.size[starts, j - 1] if j else np.zeros(len(starts), np.int64)
            depth = self.segment[starts] * SEGMENT + j
            ending = np.add.reduceat(((self.lengths == j) & ~self.goes_on).astype(np.int64), all_starts)[real]
            closed = ~is_open
            leaves_in = leaves + (closed & (children == 0))
            saved_in = saved + np.where(closed, (n - 1) * size, 0)
            for k, v in (("children", np.ones(len(starts), np.int64)), ("leaves", leaves_in), ("saved", saved_in)):
                below[k] = np.zeros(rows, np.int64)
                below[k][starts[closed]] = v[closed]
            yield self._batch(j, starts, ending, depth, n, conv, children, leaves_in, saved_in, size, is_open)

    def _batch(self, j, starts, ending, depth, n, conv, children, leaves, saved, size, is_open) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in _PART]

        def put(*row) -> None:
            for c, v in zip(columns, row):
                c.append(v)

        if j:  # where the node one turn above begins, and whether it is open
            above = np.flatnonzero(self.change[:, j - 1])
            over = np.searchsorted(above, starts, side="right") - 1
            over_open = np.logical_or.reduceat(self.open_row, above)[over] if j > 1 else np.ones(len(starts), bool)
            over_conv = np.minimum.reduceat(self.conv, above)[over]
        for i, row in enumerate(starts.tolist()):
            members = self.conv[row : row + ending[i]]  # shorter rows come first in a run
            if j == SEGMENT and ending[i]:
                run = slice(row, row + int(n[i]))
                members = self.conv[run][~self.goes_on[run]]
            if is_open[i]:
                key = self.prefix(row, j)
                first = bool(j) or not self.segment[row]  # the node above a later segment is counted where it ends its own
                put("open", key, self.prefix(row, j - 1) if j else None, int(depth[i]), int(conv[i]) if first else None, None, int(n[i]) if first else 0, int(children[i]), int(leaves[i]), int(saved[i]), int(size[i]), None)
                for m in members.tolist():
                    put("end", key, None, int(depth[i]), m, None, None, None, None, None, None, None)
            else:
                sha = hashlib.sha256(",".join(map(str, members.tolist())).encode()).hexdigest()
                put("closed", None, self.prefix(row, j - 1) if over_open[i] else None, int(depth[i]), int(conv[i]), None if over_open[i] else int(over_conv[i]), int(n[i]), int(children[i]), int(leaves[i]), int(saved[i]), int(size[i]), sha)
        return _record(_PART, columns)


def _ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256) of members (key, conv_id), hashed as they come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, keys, found = None, None, [], []
        for t in gathered(batches):
            for k, c in zip(t.column("key").to_pylist(), t.column("conv_id").to_pylist()):
                if sha is None or k != key:
                    if sha is not None:
                        keys.append(key)
                        found.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256(str(c).encode())
                else:
                    sha.update(f",{c}".encode())
        if sha is not None:
            keys.append(key)
            found.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "sha"])

    return members.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, sha string")


def _subtrees(nodes: DataFrame) -> DataFrame:
    """(key, n_leaves, saved_tokens): the values of open nodes (key, parent_key, leaves, saved)
    added over their subtrees. In each round a node adds what its pointer's far end has added,
    and the pointer doubles."""
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    t = nodes.select("key", F.col("parent_key").alias("up"), "leaves", "saved")
    for _ in range(int(depth).bit_length()):
        t = written(t, "subtrees")
        more = t.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        far = t.where("up is not null").select(F.col("key").alias("up"), F.col("up").alias("_up"))
        t = t.join(more.hint("shuffle_hash"), "key", "left").join(far.hint("merge"), "up", "left")
        t = t.select("key", F.col("_up").alias("up"), (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"))
    return written(t.select("key", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), "subtrees")


def prefix_trie(conversations: DataFrame, family: int = 5, modulus: int = 9, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)
    of every node of the trie of rebuilt conversations (``shared_heads``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            yield from Shard(pa.Table.from_batches(held)).parts()

    with passing(conversations.sparkSession) as keep:
        segments = written(shared_heads(conversations, family, modulus), "segments")
        shards = max(1, -(-segments.count() // shard_rows))
        ranged = segments.repartitionByRange(shards, "segment", "digest", "ids", "conv_id")
        parts = written(ranged.mapInArrow(run, _ddl(_PART)), "nodes")
        nodes = _merged(parts)
        sums = _subtrees(nodes)
        keep += [parts, nodes, sums]
    return _named(parts, nodes, sums)


def _merged(parts: DataFrame) -> DataFrame:
    """Open nodes, whole."""
    grouped = parts.where("kind = 'open'").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("closed_children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("size").alias("size"),
    )
    nodes = written(grouped, "open-nodes")
    over = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("_open"))
    children = F.col("closed_children") + F.coalesce("_open", F.lit(0))
    nodes = nodes.join(over.hint("shuffle_hash"), "key", "left").withColumn("n_children", children)
    return written(nodes.withColumn("leaves", F.col("leaves") + (children == 0).cast("long")).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("size")), "open-nodes")


def _named(parts: DataFrame, nodes: DataFrame, sums: DataFrame) -> DataFrame:
    """All nodes with their parents' conversations and the digests of their ends."""
    names = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    ends = _ends(parts.where("kind = 'end'").select("key", "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    opened = nodes.select("key", "parent_key", "conv_id", "depth", "n_convs", "n_children").join(sums.hint("shuffle_hash"), "key").join(ends.hint("merge"), "key", "left")
    opened = opened.join(names.hint("merge"), "parent_key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(none)))
    closed = parts.where("kind = 'closed'")
    inner, outer = closed.where("parent_key is null"), closed.where("parent_key is not null").drop("parent_conv_id").join(names.hint("merge"), "parent_key")
    return opened.select(*columns).unionByName(inner.select(*columns)).unionByName(outer.select(*columns))
