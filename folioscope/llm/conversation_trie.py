"""Conversation prefix trie by double arrays: what conversations share from their first turn on, and what that saves.

Conversations are sequences of turns; each distinct sequence of first turns is a node. Turns are told apart by a 128-bit
digest of role and text, so texts stay where they are and 20 bytes a turn move.

1. Sequences: the turns of each conversation in order (`sequences`), rebuilt where asked (`rebuilt`), written once.
2. Shards: sequences are dealt by ranges of their first `UPPER` turns, then by a hash of the conversation, so that
   a first turn, or a whole conversation, that a third of all share is spread as well. A task cuts its range into shards
   of about `SHARD_TURNS` turns, which bounds its memory.
3. A shard numbers its turns densely in order of first use, packs BASE and CHECK over these numbers (a child of state s
   by turn c is cell BASE[s] + c, and CHECK of that cell is s), and traverses them by all its sequences at once for members,
   smallest member, endings, and sums over subtrees.
4. Nodes found in one shard only are done. Nodes in several (upper ones, and what hot conversations share) are merged:
   members add up; a shared node was counted once a shard, so what is too much is put right in the shard that owns it (the
   first) and handed up to the node's ancestors there, which that shard holds too.

Endings of a shared node are joined in order in pieces of `PIECE` neighbouring ids, and the pieces stream through the
digest, which no step can split.

Defined results: null roles and texts are empty; turns are ordered by turn (null first), ties by their digest, so
repeated rows are turns of their own; rows without conv_id are no conversation; an empty table has no node. Other
columns are ignored. A conversation is one row of 20 bytes a turn and must fit a task, as a text must.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, slim

UPPER = 8
SHARD_TURNS = 200_000
PIECE_BITS = 12
ROOT = hashlib.md5(b"").digest()
TRIES = 1 << 16
NODES = ("shard long, digest binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, bytes long, ends_sha256 string, ends array<long>")


def turn_digest(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def _turns(conversations: DataFrame) -> DataFrame:
    rows = slim(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    return rows.select("conv_id", F.struct(
        F.col("turn").isNotNull().alias("known"), "turn", turn_digest(F.col("role"), F.col("text")).alias("key"),
        F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes")).alias("at"))


def _as_sequences(frame: DataFrame, turns: str) -> DataFrame:
    return frame.select(
        "conv_id", F.transform(turns, lambda at: at["key"]).alias("keys"), F.transform(turns, lambda at: at["bytes"]).alias("bytes"))


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, keys and bytes of the turns in order, for every conversation as it stands."""
    return _as_sequences(_turns(conversations).groupBy("conv_id").agg(F.array_sort(F.collect_list("at")).alias("turns")), "turns")


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Sequences whose first h turns are those of conversation c - c % family, h = crc32(c) % (most + 1), then c's own
    turns after its first h. The families are dealt out once; no join is needed."""
    rows = _turns(conversations).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).repartition("base")
    own = rows.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("at")).alias("own"))
    head = F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, most))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    rows = own.select(
        "conv_id", "own", F.max(head).over(Window.partitionBy("base")).alias("head"), shared.alias("h"))
    after = F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))
    return _as_sequences(rows.select("conv_id", F.concat(
        F.when(F.col("head").isNull(), F.slice("own", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h"))), after).alias("turns")), "turns")


class DoubleArray:
    """BASE and CHECK over dense turn ids, which start at 1; state 0 is the root. A cell is free where CHECK is -1."""

    def __init__(self) -> None:
        self.base, self.check = np.zeros(1024, dtype=np.int64), np.full(1024, -1, dtype=np.int64)
        self.check[0] = 0
        self.low, self.end = 1, 1

    def _reach(self, cell: int) -> None:
        while cell >= len(self.check):
            self.base = np.concatenate([self.base, np.zeros_like(self.base)])
            self.check = np.concatenate([self.check, np.full_like(self.check, -1)])

    def place(self, state: int, codes: np.ndarray) -> np.ndarray:
        """Cells of the children of `state` by these ascending codes: the lowest free cells where all of them fit."""
        offsets = codes - codes[0]
        while self.low < self.end and self.check[self.low] >= 0:
            self.low += 1
        cell = self.low if len(codes) == 1 else self._fitting(offsets)
        cells = cell + offsets
        self._reach(int(cells[-1]))
        self.base[state] = cell - codes[0]
        self.check[cells] = state
        self.end = max(self.end, int(cells[-1]) + 1)
        return cells

    def _fitting(self, offsets: np.ndarray) -> int:
        window = max(TRIES // len(offsets), 1)
        for start in range(self.low, self.end, window):
            self._reach(start + window + int(offsets[-1]))
            cells = np.flatnonzero(self.check[start:start + window] < 0) + start
            fits = (self.check[cells[:, None] + offsets] < 0).all(axis=1)
            if fits.any():
                return int(cells[np.argmax(fits)])
        return self.end

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of `states` by `codes`; -1 where there is none."""
        cells = self.base[states] + codes
        inside = (cells > 0) & (cells < len(self.check))
        found = inside & (self.check[np.where(inside, cells, 0)] == states)
        return np.where(found, cells, -1)


def dense_ids(keys: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Ids from 1 for distinct keys, numbered level by level, so that most siblings are neighbours."""
    order = np.argsort(depths, kind="stable")
    _, first, which = np.unique(keys[order], return_index=True, return_inverse=True)
    rank = np.empty(len(first), dtype=np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(1, len(first) + 1)
    codes = np.empty(len(keys), dtype=np.int64)
    codes[order] = rank[which]
    return codes


class Shard:
    """The trie of some sequences: its double array, and for every state what NODES tells of a node."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, keys: np.ndarray, bytes_: np.ndarray) -> None:
        self.ids, self.lengths = ids, lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, dtype=np.int64)
        depths = np.arange(len(keys)) - np.repeat(self.starts, lengths)
        self.codes = dense_ids(keys, depths)
        self.trie = DoubleArray()
        self.digests, self.levels = {0: ROOT}, [np.zeros(1, dtype=np.int64)]
        self._pack(keys)
        self._traverse(bytes_)

    def _pack(self, keys: np.ndarray) -> None:
        states, depth = np.zeros(len(self.ids), dtype=np.int64), 0
        while (going := np.flatnonzero(self.lengths > depth)).size:
            at = self.starts[going] + depth
            order = np.lexsort((self.codes[at], states[going]))
            parents, codes, some = states[going][order], self.codes[at][order], at[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (parents[1:] != parents[:-1]) | (codes[1:] != codes[:-1])
            parents, codes, some = parents[new], codes[new], some[new]
            cuts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1], [True]]))
            cells = np.concatenate([
                self.trie.place(int(parents[a]), codes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            for cell, parent, place in zip(cells.tolist(), parents.tolist(), some.tolist(), strict=True):
                self.digests[cell] = hashlib.md5(self.digests[parent] + keys[place].ljust(16, b"\0")).digest()
            self.levels.append(cells)
            states[going] = self.trie.step(states[going], self.codes[at])
            depth += 1

    def _traverse(self, bytes_: np.ndarray) -> None:
        size = len(self.trie.check)
        self.n, self.bytes, self.depth = (np.zeros(size, dtype=np.int64) for _ in range(3))
        self.least = np.full(size, np.iinfo(np.int64).max)
        states, going, depth = np.zeros(len(self.ids), dtype=np.int64), np.arange(len(self.ids)), 0
        while going.size:
            self.n += np.bincount(states[going], minlength=size) if going.size * 8 > size else 0
            if going.size * 8 <= size:
                np.add.at(self.n, states[going], 1)
            np.minimum.at(self.least, states[going], self.ids[going])
            self.depth[states[going]] = depth
            going = going[self.lengths[going] > depth]
            at = self.starts[going] + depth
            states[going] = self.trie.step(states[going], self.codes[at])
            self.bytes[states[going]] = bytes_[at]
            depth += 1
        self.ends = defaultdict(list)
        for at in np.argsort(self.ids, kind="stable").tolist():
            self.ends[int(states[at])].append(int(self.ids[at]))
        self.children, self.leaves, self.saved = (np.zeros(size, dtype=np.int64) for _ in range(3))
        for level in reversed(self.levels):
            self.leaves[level] += self.children[level] == 0
            self.saved[level] += (self.n[level] - 1) * self.bytes[level]
            if level[0] != 0:
                above = self.trie.check[level]
                np.add.at(self.children, above, 1)
                np.add.at(self.leaves, above, self.leaves[level])
                np.add.at(self.saved, above, self.saved[level])

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        for level in self.levels:
            for start in range(0, len(level), 10_000):
                cells = level[start:start + 10_000]
                above, listed = self.trie.check[cells], [self.ends.get(cell, []) for cell in cells.tolist()]
                root = cells == 0
                columns = [
                    pa.array(np.full(len(cells), number)), pa.array([self.digests[cell] for cell in cells.tolist()], pa.binary()),
                    pa.array([None if top else self.digests[cell] for cell, top in zip(above.tolist(), root, strict=True)], pa.binary()),
                    pa.array(self.depth[cells]), pa.array(self.least[cells]), pa.array(self.least[above], mask=root),
                    *[pa.array(values[cells]) for values in (self.n, self.children, self.leaves, self.saved, self.bytes)],
                    pa.array([hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for ids in listed]),
                    pa.array(listed, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[field.split()[0] for field in NODES.split(", ")])


def _shard_of(batches: list[pa.RecordBatch]) -> Shard:
    """One shard of these sequences (conv_id, keys, bytes)."""
    table = pa.Table.from_batches(batches)
    keys = table["keys"].combine_chunks()
    flat = keys.flatten() if not isinstance(keys, pa.ChunkedArray) else pa.concat_arrays([chunk.flatten() for chunk in keys.chunks])
    sizes = table["bytes"].combine_chunks()
    some = sizes.flatten() if not isinstance(sizes, pa.ChunkedArray) else pa.concat_arrays([chunk.flatten() for chunk in sizes.chunks])
    packed = b"".join(flat.to_pylist())
    return Shard(
        table["conv_id"].to_numpy(), np.array([len(value) for value in table["keys"]], dtype=np.int64),
        np.frombuffer(packed, dtype="S16"), some.to_numpy(zero_copy_only=False).astype(np.int64))


def _shard_nodes(most: int):
    """mapInArrow function: the nodes of every shard of a task's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, turns = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                held.append(part)
                turns += part.num_rows + len(part.column(1).flatten())
                if turns >= most:
                    yield from _shard_of(held).rows(number)
                    number, held, turns = number + 1, [], 0
        if held:
            yield from _shard_of(held).rows(number)

    return run


def _handed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of a shard's shared nodes, each with those below it; rows by shard, the deepest first."""
    at, waiting = None, defaultdict(lambda: [0, 0, 0])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["shard"] != at:
                at = row["shard"]
                waiting.clear()
            children, leaves, saved = waiting.pop(row["digest"], (0, 0, 0))
            leaves, saved = leaves + row["leaves"], saved + row["saved"]
            out.append((row["digest"], children, leaves, saved))
            if row["parent"] is not None:
                above = waiting[row["parent"]]
                above[0] += row["again"]
                above[1] += leaves
                above[2] += saved
        columns = zip(*out, strict=True) if out else [()] * 4
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)], names=["digest", "children", "leaves", "saved"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the joined pieces of each node; rows by node and piece."""
    at, state = None, None
    for batch in batches:
        done = []
        for node, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node != at:
                done += [(at, state.hexdigest())] if at is not None else []
                at, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        yield _pairs(done)
    if at is not None:
        yield _pairs([(at, state.hexdigest())])


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([row[0] for row in rows], pa.binary()), pa.array([row[1] for row in rows], pa.string())], names=["digest", "sha"])


def nodes(found: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Every node of the trie over sequences (conv_id, keys, bytes): conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (bytes of last turns that members beyond the first repeat, over
    the subtree), ends_sha256 (of the ids of conversations that end there)."""
    found = kept(found).select("*", F.slice("keys", 1, UPPER).alias("upper"), F.xxhash64("conv_id").alias("spread"))
    dealt = found.repartitionByRange("upper", "spread").sortWithinPartitions("upper", "spread")
    local = kept(dealt.select("conv_id", "keys", "bytes").mapInArrow(_shard_nodes(shard_turns), NODES))
    merged = kept(local.groupBy("digest").agg(
        F.count("*").alias("shards"), F.min("shard").alias("owner"), F.max("parent").alias("parent"), F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), F.min("parent_conv_id").alias("parent_conv_id"), F.max("bytes").alias("bytes"),
        *[F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.count_if(F.col("n_children") == 0).alias("ending"), F.min("ends_sha256").alias("ends_sha256")))
    shared = kept(merged.where("shards > 1"))
    tops = shared.select(F.col("digest").alias("parent"), F.col("conv_id").alias("top"))
    result = ["conv_id", "depth", F.coalesce("top", "parent_conv_id").alias("parent_conv_id"), "n_convs"]
    alone = merged.where("shards = 1").join(tops, "parent", "left").select(*result, "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    places = local.select("digest", "shard").join(shared, "digest")
    mine = F.col("shard") == F.col("owner")
    leaf = (F.col("n_children") == 0).cast("long") - F.col("ending")
    fixes = places.select(
        "shard", "digest", "parent", "depth", F.when(mine, leaf).otherwise(0).alias("leaves"), F.when(mine, F.col("shards") - 1).otherwise(0).alias("again"),
        F.when(mine, (F.col("shards") - 1) * F.col("bytes")).otherwise(0).alias("saved"))
    fixed = fixes.repartition("shard").sortWithinPartitions("shard", F.desc("depth")).mapInArrow(
        _handed_up, "digest binary, children long, leaves long, saved long").groupBy("digest").agg(
        *[F.sum(name).alias(name) for name in ("children", "leaves", "saved")])
    ids = local.where("size(ends) > 0").join(shared.select("digest"), "digest", "left_semi").select("digest", F.explode("ends").alias("id"))
    pieces = ids.groupBy("digest", F.shiftright("id", PIECE_BITS).alias("piece")).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("id")), lambda one: one.cast("string"))).alias("ids"))
    ends = pieces.repartition("digest").sortWithinPartitions("digest", "piece").select("digest", "ids").mapInArrow(
        _digested, "digest binary, sha string")
    upper = shared.join(tops, "parent", "left").join(fixed, "digest").join(ends, "digest", "left").select(
        *result, (F.col("n_children") - F.col("children")).alias("n_children"), (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    return alone.unionByName(upper)
