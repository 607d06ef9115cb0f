"""Jaccard join of five-word shingle sets through R-trees of count vectors; exact.

Shingles hash into groups; a document is the point of its counts per group, and the sum of coordinate minima of two
points bounds their overlap from above, as does that of two boxes for all points in them. One tree over a corpus would
compare almost every pair of leaves, because the box of unlike documents is nearly the whole space. So trees are built
per shingle: linked sets must share one of their rarest shingles (the first n - ceil(3n/4) + 1 in any common order), and
only documents listed under such a shingle enter its tree. The order is by document counts of hashed shingles, taken over
all documents in a table of fixed size, so that text which many documents share comes last and makes no long lists.

1. Profiles: set size, set key and count vector. Documents of one set are one node from here on.
2. Lists: rare shingles with the documents under them; hot lists are salted. A row holds the shingle's place in the
   order, from which follows the largest partner it leaves room for (`reach`): at the first shingle two linked sets share,
   what comes after it in either must still hold their overlap. Points of a list meet only within each other's reach,
   which loses no link.
3. Stars: every document of a list against the list's hub, the document whose shingles are the most common. Survivors of the
   bound are verified on whole texts. A group of near copies so becomes one component without its pairs: what the copies
   were made from shares all lists with them, and is their hub in all of these.
4. Trees: only lists whose documents lie in several components remain. A list is a tree of one block or, with more
   than `BLOCK` points, of several by size and hash; a block's points are packed into leaves by halving along the widest group.
   Boxes of blocks, then of leaves, bound what their points can share, then the points are bounded; survivors across
   components are verified. Links inside a component cannot change it, so the components are those of all links.

Verification moves a text to the document it is compared with, streams through sorted partitions and holds one set per
side. Texts and lists pass through no driver; the broadcast table of counts has `COUNT_CELLS` cells at any size.

Defined results: null or empty texts and texts without words have size 0 and no links. Null doc_ids have no component
(null) and no links. Rows of one doc_id are one document: it has the links of all its rows, and `n_shingles` of each row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, kept, slim
from .components import components
from .shingles import mix, set_key, shingle_sets

COUNT_CELLS = 1 << 17
HOT_LIST = 4096
BLOCK = 128
LEAF = 16
PARTS = 64
PER_GROUP = 2
FINE_PER_GROUP = 0.5
FINE = 512
BATCH_ROWS = 1000
MIN_GROUPS = 16
MAX_GROUPS = 16384
ID_CELLS = 1 << 20
PLACE_BITS = 8
PLACE_SCALE = 4 * (2 ** PLACE_BITS - 1)  # a place among the rarest shingles, at most a quarter of all, as a part of 255


def required(size: int) -> int:
    """Least overlap of a set of this size with any set linked to it."""
    return (3 * size + 3) // 4


def fits(left: int, right: int) -> bool:
    return 4 * min(left, right) >= 3 * max(left, right)


def linked(overlap: int, left: int, right: int) -> bool:
    return 100 * overlap >= 75 * (left + right - overlap)


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """Counts per hash group, about `PER_GROUP` shingles to a group, fewer for up to `FINE` shingles; coarser vectors are
    folds of finer ones."""
    groups, per_group = MIN_GROUPS, FINE_PER_GROUP if len(shingles) <= FINE else PER_GROUP
    while groups < MAX_GROUPS and groups * per_group < len(shingles):
        groups *= 2
    return np.bincount((mix(shingles, 3) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def packed(vector: np.ndarray) -> bytes:
    """The vector in the narrowest type that holds it, deflated, after a byte with that type's size."""
    kind = next(kind for kind in (np.uint8, np.uint16, np.uint32) if vector.max() <= np.iinfo(kind).max)
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(vector.astype(kind).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"u{data[0]}").astype(np.int64)


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    return vector.reshape(-1, groups).sum(axis=0)


def bound(left: np.ndarray, right: np.ndarray) -> int:
    groups = min(len(left), len(right))
    return int(np.minimum(folded(left, groups), folded(right, groups)).sum())


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [(len(s), *set_key(s), packed(count_vector(s)) if len(s) else None) for s in shingle_sets(batch.column(1))]
        sizes, first, second, vectors = zip(*sets, strict=True) if sets else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
             pa.array(vectors, pa.binary())], names=["doc_id", "n", "key1", "key2", "vector"])


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNT_CELLS.bit_length() + 1)).astype(np.int64)


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNT_CELLS, dtype=np.int64)
    for batch in batches:
        for shingles in shingle_sets(batch.column(0)):
            counts += np.bincount(_cell(shingles), minlength=COUNT_CELLS) if len(shingles) > COUNT_CELLS else 0
            if len(shingles) <= COUNT_CELLS:
                np.add.at(counts, _cell(shingles), 1)
    cells = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], names=["cell", "n"])


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How many documents' shingles fall into each cell, over all documents; `COUNT_CELLS` numbers."""
    summed = docs.select("text").mapInArrow(_cell_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNT_CELLS, dtype=np.int64)
    counts[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return counts


def reaches(size: int, places: np.ndarray) -> np.ndarray:
    """The largest set that a set of this size can link to if the first shingle they share has this place in its order:
    `size - place` shingles are left, and 7 times the overlap is at least 3 times both sizes."""
    return (4 * size - 7 * places) // 3


def _rare_shingles(counts):
    """mapInArrow function: a row for each of a document's rarest shingles, with a salt where the list may be hot, and how common
    the document's shingles are on the mean. The text that others were made from has none of their changes, so it is the
    most common of its group. A list may be hot where its cell exceeds what cells hold on the mean. `mark` is the shingle
    with its place in the order instead of its last bits, so that the place moves for nothing; shingles that differ in
    those bits alone share a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts.value
        usual = int(known.mean())
        for batch in batches:
            ids, tokens, salts, owners, means = batch.column(0).to_numpy(zero_copy_only=False), [], [], [], []
            dealt = mix(ids.view(np.uint64), 5)
            for at, shingles in enumerate(shingle_sets(batch.column(1))):
                if not len(shingles):
                    continue
                often = known[_cell(shingles)]
                rare = np.argsort(often, kind="stable")[:len(shingles) - required(len(shingles)) + 1]
                spread = (np.maximum(often[rare] - usual, 0) // HOT_LIST + 1).astype(np.uint64)
                places = (np.arange(len(rare)) * PLACE_SCALE // len(shingles)).astype(np.uint64)
                tokens.append((shingles[rare] >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | places).view(np.int64))
                salts.append(np.where(spread > 1, (dealt[at] % spread).astype(np.int64), -1))
                owners.append(np.full(len(rare), ids[at], dtype=np.int64))
                means.append(np.full(len(rare), 16 * np.log2(often.mean() + 1), dtype=np.int16))
                if sum(map(len, tokens)) > 100_000:
                    yield _list_rows(tokens, owners, salts, means)
                    tokens, salts, owners, means = [], [], [], []
            if tokens:
                yield _list_rows(tokens, owners, salts, means)

    return run


def _list_rows(tokens: list, owners: list, salts: list, means: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(tokens)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(salts).astype(np.int32)),
         pa.array(np.concatenate(means))], names=["mark", "doc_id", "salt", "common"])


def _reach(size: str, scaled_place: str) -> Column:
    """`reaches` of a place as marks hold it: exact for sets below `PLACE_SCALE` shingles, never too small for others."""
    place = F.ceil(F.col(scaled_place).cast("long") * F.col(size) / F.lit(PLACE_SCALE))
    return F.floor((4 * F.col(size) - 7 * place) / F.lit(3))


def _within_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*[batch.column(name).to_pylist() for name in ("vector_a", "vector_b", "n_a", "n_b")], strict=True)
        good = [7 * bound(unpacked(left), unpacked(right)) >= 3 * (n + m) for left, right, n, m in rows]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, role): first the text or texts of document a, then those to compare with it."""
    at, centres = None, []
    for batch in batches:
        left, right = [], []
        keys = zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist(), strict=True)
        roles, ids = batch.column("role").to_pylist(), batch.column("id").to_pylist()
        for key, role, other, shingles in zip(keys, roles, ids, shingle_sets(batch.column("text")), strict=True):
            if key != at:
                at, centres = key, []
            if role == 0:
                centres.append(shingles)
            elif any(_overlap(centre, shingles) for centre in centres):
                left.append(key[0])
                right.append(other)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _overlap(left: np.ndarray, right: np.ndarray) -> bool:
    if not len(left) or not len(right) or not fits(len(left), len(right)):
        return False
    places = np.minimum(np.searchsorted(left, right), len(left) - 1)
    return linked(int((left[places] == right).sum()), len(left), len(right))


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose whole texts link. A document with many partners meets them in `PARTS` parts."""
    cells = np.zeros(ID_CELLS, dtype=bool)
    # At most `ID_CELLS` numbers; documents in other cells are in no pair and stay where they are.
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    cells[ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(ID_CELLS)).alias("cell")).distinct().toArrow()["cell"].to_numpy()] = True
    wanted = docs.sparkSession.sparkContext.broadcast(cells)

    def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.value[batch.column("cell").to_numpy()])).select(["doc_id", "text"])

    cell = F.pmod(F.xxhash64("doc_id"), F.lit(ID_CELLS)).alias("cell")
    near = docs.select("doc_id", "text", cell).mapInArrow(of_pairs, "doc_id long, text string")
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int").alias("salt"))
    needs = dealt.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("id")).union(
        dealt.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("id")))
    texts = needs.join(near, F.col("id") == F.col("doc_id")).select("a", "salt", "role", "id", "text")
    return texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(
        _compared, "a long, b long").distinct()


def bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose sizes fit and whose count vectors allow enough overlap."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("vector").alias("vector_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("vector").alias("vector_b"))
    met = pairs.join(right, "b").join(left, "a").where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    return met.select("a", "b", "n_a", "n_b", "vector_a", "vector_b").mapInArrow(_within_bound, "a long, b long")


def _lists(docs: DataFrame) -> DataFrame:
    """token, doc_id, place (`at`) and hub (the most common document of the list or its part) for every list of two or more."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs))
    marked = docs.mapInArrow(_rare_shingles(counts), "mark long, doc_id long, salt int, common short")
    token = F.shiftright("mark", PLACE_BITS)
    rows = marked.repartition(token, "salt").select(
        token.alias("token"), "salt", "doc_id", "common", F.col("mark").bitwiseAND(F.lit(2 ** PLACE_BITS - 1)).cast("short").alias("at"))
    part = Window.partitionBy("token", "salt").orderBy(F.desc("common"), "doc_id", "at")
    first = F.first(F.struct("common", "doc_id", "at")).over(part.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starred = rows.select("token", "doc_id", "salt", "at", first.alias("first"), F.lead("doc_id").over(part).alias("next"))
    single = F.expr("first.doc_id = doc_id AND next IS NULL")
    dealt = kept(starred.where((F.col("salt") >= 0) | ~single).select(
        "token", "doc_id", "salt", "at", F.col("first.doc_id").alias("hub"), F.col("first.at").alias("hub_at"),
        F.col("first.common").alias("common"), single.alias("single")))
    # A document alone in its part stays if the shingle's other parts hold others; full parts need not be looked up.
    parts = dealt.where("salt >= 0").groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1").select("token")
    return dealt.where("salt < 0 OR NOT single").union(dealt.where("salt >= 0 AND single").join(parts, "token", "left_semi").select(*dealt.columns)).drop("single")


def _star_pairs(lists: DataFrame) -> DataFrame:
    """a and b, documents with the hubs of their lists, and hubs of parts with the first of these; the least place of either
    in any list that they share."""
    hubs = lists.where("salt >= 0").select("token", "hub", "common").distinct()
    over_parts = hubs.groupBy("token").agg(F.max_by("hub", F.struct("common", F.bitwise_not("hub"))).alias("first"))
    joined = hubs.join(over_parts, "token").select(
        F.col("first").alias("a"), F.col("hub").alias("b"), F.lit(0).cast("short").alias("at_a"), F.lit(0).cast("short").alias("at_b"))
    within = lists.select(F.col("hub").alias("a"), F.col("doc_id").alias("b"), F.col("hub_at").alias("at_a"), F.col("at").alias("at_b"))
    return within.union(joined).where("a <> b").groupBy("a", "b").agg(F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b"))


class _Tree:
    """R-tree of a block's points: leaves of at most `LEAF` points, halved along the widest group, under the block's box."""

    def __init__(self, points: pa.StructScalar) -> None:
        self.nodes, self.parts, self.sizes = (points[name].values.to_numpy() for name in ("node", "component", "n"))
        self.reach = points["reach"].values.to_numpy() if "reach" in points.keys() else 4 * self.sizes // 3
        self.vectors = [unpacked(data) for data in points["vector"].as_py()]
        self.groups = min(map(len, self.vectors))
        self.points = np.stack([folded(vector, self.groups) for vector in self.vectors])
        self.leaves = list(self._packed(np.arange(len(self.nodes))))
        self.low = [int(self.sizes[leaf].min()) for leaf in self.leaves]
        self.far = [int(self.reach[leaf].max()) for leaf in self.leaves]

    def _packed(self, at: np.ndarray) -> Iterator[np.ndarray]:
        if len(at) <= LEAF:
            yield at
            return
        widest = int(np.argmax(self.points[at].max(axis=0) - self.points[at].min(axis=0)))
        at = at[np.argsort(self.points[at, widest], kind="stable")]
        yield from self._packed(at[:len(at) // 2])
        yield from self._packed(at[len(at) // 2:])

    def at(self, groups: int) -> np.ndarray:
        return self.points.reshape(len(self.points), -1, groups).sum(axis=1)


def _near(left: _Tree, right: _Tree) -> Iterator[tuple[int, int]]:
    """Pairs of points of two trees, or of one, in different components, that pass the bound: boxes of blocks first, then
    of leaves, then the points. Points beyond each other's reach do not meet."""
    groups = min(left.groups, right.groups)
    a, b = left.at(groups), right.at(groups)
    if 7 * np.minimum(a.max(axis=0), b.max(axis=0)).sum() < 3 * (left.sizes.min() + right.sizes.min()):
        return
    boxes_a, boxes_b = ([points[leaf].max(axis=0) for leaf in tree.leaves] for tree, points in ((left, a), (right, b)))
    for i, one in enumerate(left.leaves):
        for j in range(i if left is right else 0, len(right.leaves)):
            other = right.leaves[j]
            if left.far[i] < right.low[j] or right.far[j] < left.low[i]:
                continue
            if 7 * np.minimum(boxes_a[i], boxes_b[j]).sum() < 3 * (left.low[i] + right.low[j]):
                continue
            for point in one:
                n, m = left.sizes[point], right.sizes[other]
                good = (right.parts[other] != left.parts[point]) & (m <= left.reach[point]) & (n <= right.reach[other])
                near = other[good]
                near = near[7 * np.minimum(b[near], a[point]).sum(axis=1) >= 3 * (n + right.sizes[near])]
                for with_point in near:
                    # The block's points are folded to its coarsest; the pair decides by its own resolution.
                    if 7 * bound(left.vectors[point], right.vectors[with_point]) < 3 * (n + right.sizes[with_point]):
                        continue
                    yield tuple(sorted((int(left.nodes[point]), int(right.nodes[with_point]))))


def _pairs_of(found: set[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near points of two blocks of a list."""
    for batch in batches:
        found = set()
        for left, right in zip(batch.column("points_a"), batch.column("points_b"), strict=True):
            found.update(_near(_Tree(left), _Tree(right)))
        yield _pairs_of(found)


def _inner_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near points within each block."""
    for batch in batches:
        found = set()
        for points in batch.column("points"):
            tree = _Tree(points)
            found.update(_near(tree, tree))
        yield _pairs_of(found)


def tree_pairs(lists: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs across components that share a list and pass the trees' bounds; `members` has doc_id, n, node, component and several."""
    # Dealt by shingle once. Lists of one component need no look, nor lists of two nodes, whose one pair the stars tried,
    # unless one document has `several` sets. Equal lists, as the many shingles of a group of copies make, are one: named
    # by two folds of their nodes.
    placed = lists.select("token", "doc_id", "at").join(members, "doc_id").select(
        "token", "node", "component", "n", _reach("n", "at").alias("reach"), "several").repartition("token").groupBy("token", "node", "component", "n").agg(
        F.max("reach").alias("reach"), F.max("several").alias("several"))
    whole = Window.partitionBy("token")
    by_size = whole.orderBy("n", "node")
    # A point that reaches no larger one and is reached by no smaller one has no partner in the list: its vector need not come.
    sized = placed.select(
        "*", F.count("*").over(whole).alias("all"), F.max("several").over(whole).alias("any_several"), F.lead("n").over(by_size).alias("more"),
        F.max("reach").over(by_size.rowsBetween(Window.unboundedPreceding, -1)).alias("reached"))
    fitting = sized.where("(all > 2 OR any_several) AND (reached >= n OR reach >= more)")
    mixed = fitting.select(
        "token", "node", "component", "n", "reach", F.min("component").over(whole).alias("low"), F.max("component").over(whole).alias("high"),
        F.count("*").over(whole).alias("size"), F.bit_xor(F.xxhash64("node", F.lit(1))).over(whole).alias("one"),
        F.bit_xor(F.xxhash64("node", F.lit(2))).over(whole).alias("two")).where("low <> high")
    named = mixed.groupBy(F.struct("size", "one", "two").alias("token"), "node", "component", "n").agg(F.max("reach").alias("reach"))
    points = named.join(nodes.select("node", "n", "vector"), ["node", "n"])
    # A short list is one block. Of a long one, linked sizes lie in the same band or in neighbours; a band fills several blocks.
    long = F.col("token.size") > BLOCK
    band = F.when(long, F.floor(F.ln("n") / F.ln(F.lit(4 / 3)))).otherwise(0).cast("int")
    part = F.when(long, F.pmod(F.xxhash64("node"), F.ceil(F.col("token.size") / F.lit(BLOCK)))).otherwise(0).cast("int")
    blocks = kept(points.select("token", "node", "component", "n", "reach", "vector", F.struct(band.alias("band"), part.alias("part")).alias("block")).groupBy(
        "token", "block").agg(F.struct(*[F.collect_list(name).alias(name) for name in ("node", "component", "n", "reach", "vector")]).alias("points"),
                              F.min("n").alias("low"), F.max("reach").alias("far")))
    inner = blocks.where("size(points.node) > 1").select("points").mapInArrow(_inner_pairs, "a long, b long")
    several = blocks.where(F.col("token.size") > BLOCK)
    left, right = several.alias("l"), several.alias("r")
    met = left.join(right, F.expr("l.token = r.token AND l.block < r.block AND l.far >= r.low AND r.far >= l.low"))
    across = met.select(F.col("l.points").alias("points_a"), F.col("r.points").alias("points_b")).mapInArrow(_block_pairs, "a long, b long")
    return inner.union(across).distinct()


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs` (doc_id, text)."""
    docs = slim(docs, "doc_id", "text")
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _joined(docs)


def _joined(docs: DataFrame) -> DataFrame:
    profile = kept(docs.mapInArrow(_profile, "doc_id long, n long, key1 long, key2 long, vector binary"))
    full = profile.where("n > 0 AND doc_id IS NOT NULL")
    keys = ["n", "key1", "key2"]
    classes = full.groupBy(*keys).agg(F.min("doc_id").alias("node"), F.min("vector").alias("vector"))
    nodes = kept(classes.select("node", "n", "vector", "key1", "key2"))
    owners = kept(full.select("doc_id", *keys).join(nodes.select("node", *keys), keys).select("doc_id", "node", "n").distinct())
    copies = owners.where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    lists = _lists(docs.where("doc_id IS NOT NULL").select("doc_id", "text"))

    def by_node(pairs: DataFrame) -> DataFrame:
        first = pairs.join(owners.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("node").alias("node_a")), "a")
        both = first.join(owners.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("node").alias("node_b")), "b").where(
            (F.col("n_b") <= _reach("n_a", "at_a")) & (F.col("n_a") <= _reach("n_b", "at_b")))
        return both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).where("a <> b").distinct()

    starred = kept(by_node(_star_pairs(lists)))
    texts = docs.where("doc_id IS NOT NULL")
    tried = kept(bounded(starred, nodes))
    stars = kept(verified(tried, texts))
    labels = components(stars.union(copies))
    several = full.select("doc_id", *keys).distinct().groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1").select("doc_id", F.lit(True).alias("several"))
    members = owners.join(labels, F.col("doc_id") == labels.node, "left").select(
        "doc_id", owners.node, F.coalesce("component", "doc_id").alias("component"), "n").join(several, "doc_id", "left").select(
        "doc_id", "n", "node", "component", F.coalesce("several", F.lit(False)).alias("several"))
    known = tried.select("a", "b").union(tried.select("b", "a"))
    rest = kept(tree_pairs(lists, nodes, members).join(known, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        labels = components(stars.union(copies).union(kept(verified(rest, texts))))
    final = labels.select(F.col("node").alias("doc_id"), "component")
    return profile.select("doc_id", "n").join(final, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component, that of the smallest doc_id; rows without doc_id stay."""
    columns = [F.col(f"`{name}`") for name in docs.columns]
    others = joined(docs).where("component_id <> doc_id").select("doc_id").distinct().hint("merge")
    left = docs.join(others, "doc_id", "left_anti").select(*columns)
    repeated = kept(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return left
    rows = left.join(repeated, "doc_id", "left_semi").select(F.struct(*columns).alias("row"), "doc_id", "text")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    once = rows.withColumn("number", F.row_number().over(first)).where("number = 1").select("row.*")
    return left.join(repeated, "doc_id", "left_anti").select(*columns).unionByName(once)
