"""The conversation trie against a dictionary of prefixes, whole and cut into many shards, and awkward tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from folioscope.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
EMPTY = hashlib.sha256(b"").hexdigest()


def digest(role, text):
    return hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()


def brute(rows):
    """conv_id, depth, parent, members, children, leaves, saved, hash of every node of the rebuilt conversations."""
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    own = {conv: [at[3:] for at in sorted(some)] for conv, some in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for conv, some in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        base = conv - int(np.fmod(conv, 5))
        whole = tuple(own.get(base, [])[:h] + some[h:])
        ends[whole].append(conv)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def sums(node):
        below = [sums(child) for child in children[node]]
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        return (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))

    return sorted((
        min(some), len(node), min(members[node[:-1]]) if node else None, len(some), len(children[node]), *sums(node),
        hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, some in members.items()) if own else []


def found(frame):
    return sorted(((
        row.conv_id, row.depth, row.parent_conv_id, row.n_convs, row.n_children, row.n_leaves, row.saved_tokens, row.ends_sha256)
        for row in frame.collect()), key=lambda row: (row[0], row[1]))


def invented(seed, conversations, words=3, hot=0.4):
    draw, rows = random.Random(seed), []
    for conv in range(conversations):
        some = [("system", "hot " * 5)] if draw.random() < hot else []
        some += [(draw.choice(["user", None]), draw.choice("ab cd é😀".split()[:words])) for _ in range(draw.randrange(9))]
        rows += [(conv, turn, role, text, "x") for turn, (role, text) in enumerate(some)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [5, 60, 200_000])
def test_nodes_match_brute_force(spark, shard_turns):
    rows = invented(shard_turns, 300) + [(-7, None, "user", "ab", "x"), (-7, 1, "user", "cd", "x"), (9_000_000_004, 0, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(trie.nodes(trie.rebuilt(frame), shard_turns)) == sorted(brute(rows), key=lambda row: (row[0], row[1]))


def test_equal_conversations_over_many_shards(spark):
    rows = [(5 * conv, turn, "user", f"turn {turn}", "") for conv in range(500) for turn in range(4)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = found(trie.nodes(trie.sequences(frame), 30))
    assert [row[3] for row in got] == [500] * 5 and [row[4] for row in got] == [1, 1, 1, 1, 0] and {row[5] for row in got} == {1}
    assert got[0][6] == 499 * 6 * 4 and got[4][7] == hashlib.sha256(",".join(str(5 * c) for c in range(500)).encode()).hexdigest()
    assert {row[7] for row in got[:4]} == {EMPTY}


def test_double_array_knows_its_children_only():
    draw, array, placed = np.random.default_rng(3), trie.DoubleArray(), {}
    states, fresh = [0], 1
    for _ in range(300):
        state = states.pop(0)
        codes = np.unique(draw.integers(1, 400, draw.integers(1, 25)))
        cells = array.place(state, codes)
        assert not set(cells.tolist()) & {0, *placed.values()}
        placed.update({(state, int(code)): int(cell) for code, cell in zip(codes, cells, strict=True)})
        states += cells.tolist()[:3]
        fresh += len(codes)
    for state in {state for state, _ in placed}:
        got = array.step(np.full(400, state), np.arange(1, 401))
        assert got.tolist() == [placed.get((state, code), -1) for code in range(1, 401)]
    assert array.end < 3 * fresh


def test_awkward(spark):
    rows = [(None, 1, "user", "lost", None), (1, None, None, None, None), (1, None, "", "", "mine"), (1, 2, "user", "x" * 200_000, None),
            (1, 2, "user", "x" * 200_000, None), (2, 1, "", None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for column in ("shard", "digest", "upper", "keys", "n_convs"):
        frame = frame.withColumn(column, frame.text)
    assert found(trie.nodes(trie.rebuilt(frame))) == sorted(brute(rows), key=lambda row: (row[0], row[1]))
    assert trie.nodes(trie.rebuilt(frame.limit(0))).collect() == []
    assert trie.nodes(trie.rebuilt(frame.where("conv_id IS NULL"))).collect() == []
