"""Trees of set signatures: which sets of two nodes can be similar enough, and which are.

A set is an array of distinct 64-bit hashes of shingles. Its signature is a bitmap of its hashes. A tree over the sets of a node
(at most about NODE_SETS sets and NODE_SHINGLES shingles) has inner nodes of FANOUT children, with the OR of their bitmaps, the
range of their sizes, and the most hashes of one set beyond one a bit. Two trees are traversed together from their roots: of
sets x and y, at most (bits that both have) + (hashes of x beyond one a bit) are common, so a pair of nodes is dropped if that, or
the ranges of sizes, leave no similarity of the threshold. What is left at the leaves is confirmed on the sets, except for pairs
that are already connected; so a dense group costs about one test a set.

``inside`` traverses each node against itself. ``between`` finds links between different components exactly: sets that are similar
enough share a shingle of their prefixes in any common order, so nodes meet on such shingles, each pair of nodes once. Pairs of nodes are
traversed with narrow bitmaps first, and with the sets themselves if leaves of different components are left. Rows are nodes and
pairs of nodes, never pairs of sets; nodes of one and the same component don't meet.

Sets come as bytes that ``decode`` turns into an array: the array itself (``stored``), or a text, which is shorter.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import light, release, staged

NODE_SETS, NODE_SHINGLES, FANOUT = 64, 1 << 15, 4
#: Bits of a bitmap for each hash, of a narrow one; members from which on a component has nodes of its own; bytes of bitmaps compared at once.
SPARSE, NARROW, OWN, AT_ONCE = 64, 4, 16, 1 << 23
NODE = "array<struct<row:bigint,c:bigint,set:binary>>"
LINKS = "a long, b long"


def least_common(a: int, b: int, percent: int) -> int:
    """The fewest shingles that sets of a and b have in common if 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many shingles of a set of n, in an order common to all sets, meet others: as the smaller of a pair, as the larger."""
    return n - least_common(n, n, percent) + 1, n - -(-percent * n // 100) + 1


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if percent * len(y) > 100 * len(x):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def stored(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), np.uint64)


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """The bits of a set's hashes, in words of 64."""
    out = np.zeros(bits // 64, np.uint64)
    at = s & np.uint64(bits - 1)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def width(n: int, sparse: int) -> int:
    """Bits for a set of n: a power of two, 64 at least."""
    return max(64, 1 << int(sparse * n - 1).bit_length())


def _folded(maps: np.ndarray, bits: int) -> np.ndarray:
    while maps.shape[-1] * 64 > bits:
        maps = maps[..., : maps.shape[-1] // 2] | maps[..., maps.shape[-1] // 2 :]
    return maps


class Tree:
    """rows, components c and sets (if given) of a node's members; levels[0] holds the leaves."""

    def __init__(self, rows: list[int], c: list[int], sizes: list[int], maps: list[np.ndarray], sets: list[np.ndarray] | None = None):
        self.bits = min(len(m) for m in maps) * 64
        maps = np.stack([_folded(m, self.bits) for m in maps])
        order = sorted(range(len(rows)), key=lambda k: (c[k], sizes[k], tuple(maps[k][:1]), rows[k]))  # what is alike stands together
        self.rows, self.c, self.sets = ([x[k] for k in order] for x in (rows, c, sets or rows))
        self.sizes, self.levels = np.array(sizes)[order], []
        self._raise(maps[order])

    def _raise(self, maps: np.ndarray) -> None:
        """Make the levels over these bitmaps of the leaves: of each node bitmap, smallest and largest size, most hashes beyond one a bit."""
        self.bits = maps.shape[1] * 64
        self.levels = [(maps, self.sizes, self.sizes, self.sizes - np.bitwise_count(maps).sum(1).astype(np.int64))]
        while len(self.levels[-1][1]) > 1:
            maps, lo, hi, beyond = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(beyond, at)))

    def narrowed(self, bits: int) -> Tree:
        """The same tree with bitmaps of at most so many bits."""
        if self.bits <= bits:
            return self
        out = copy.copy(self)
        out._raise(_folded(self.levels[0][0], bits))
        return out

    def level(self, k: int):
        """Level k, or the root if the tree is lower."""
        return self.levels[min(k, len(self.levels) - 1)]

    def children(self, k: int) -> int:
        return len(self.levels[k][1]) if k < len(self.levels) else 1


def _possible(x, y, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (i, j) of the nodes of two levels may hold similar sets."""
    (mx, lx, hx, bx), (my, ly, hy, by) = x, y
    ok = (percent * np.maximum(lx[i], ly[j]) <= 100 * np.minimum(hx[i], hy[j])).nonzero()[0]
    step = max(1, AT_ONCE // (mx.shape[1] * 8))
    common = np.concatenate([np.empty(0, np.int64), *(np.bitwise_count(mx[i[p]] & my[j[p]]).sum(1, dtype=np.int64) for p in (ok[at : at + step] for at in range(0, len(ok), step)))])
    most = np.minimum(common + np.minimum(bx[i[ok]], by[j[ok]]), np.minimum(hx[i[ok]], hy[j[ok]]))
    return ok[most * (100 + percent) >= percent * (lx[i[ok]] + ly[j[ok]])]


def leaves(x: Tree, y: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of x and y that their signatures leave possible. x may be y."""
    same, x, y = x is y, x.narrowed(y.bits), y.narrowed(x.bits)
    i = j = np.zeros(1, np.int64)
    for k in range(max(len(x.levels), len(y.levels)) - 1, -1, -1):
        keep = _possible(x.level(k), y.level(k), i, j, percent)
        i, j = i[keep], j[keep]
        if not k or not len(i):
            break
        below = []
        for tree, at in ((x, i), (y, j)):  # a tree that is lower waits at its root
            n, own = tree.children(k - 1), tree.children(k)
            below.append((at[:, None], np.zeros(1, np.int64), n) if n == own == 1 else (at[:, None] * FANOUT, np.arange(FANOUT), n))
        (a, p, m), (b, q, n) = below
        i, j = np.broadcast_arrays((a + p)[:, :, None], (b + q)[:, None, :])
        i, j = i.ravel(), j.ravel()
        ok = (i < m) & (j < n) & ((i <= j) if same else True)
        i, j = i[ok], j[ok]
    return i, j


def traverse(x: Tree, y: Tree, percent: int) -> tuple[list[tuple[int, int]], int]:
    """Links between members of x and y that join their components, and how many pairs of sets were compared. x may be y."""
    i, j = leaves(x, y, percent)
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while (d := up.get(c, c)) != c:
            up[c] = up.get(d, d)
            c = d
        return c

    found, tested = [], 0
    for p, q in zip(i.tolist(), j.tolist()):
        a, b = root(x.c[p]), root(y.c[q])
        if a != b and (x is not y or p != q):
            tested += 1
            if similar(x.sets[p], y.sets[q], percent):
                up[a] = b
                found.append((x.rows[p], y.rows[q]))
    return found, tested


def tree_of(members: list[tuple[int, int, np.ndarray]]) -> Tree:
    """Of (row, component, sorted set)."""
    rows, c, sets = (list(x) for x in zip(*members))
    return Tree(rows, c, [len(x) for x in sets], [bitmap(x, width(len(x), SPARSE)) for x in sets], sets)


def _whole(members: pa.Array, decode) -> Tree:
    row, c, data = (members.field(k) for k in ("row", "c", "set"))
    return tree_of(list(zip(row.to_pylist(), c.to_pylist(), map(decode, data))))


def _narrow(members: pa.Array) -> Tree:
    """Of a node's list of structs (row: size, c, set: narrow bitmap)."""
    size, c, data = (members.field(k) for k in ("row", "c", "set"))
    size = size.to_pylist()
    return Tree(list(range(len(size))), c.to_pylist(), size, [np.frombuffer(m.as_buffer(), np.uint64) for m in data])


def _traversals(percent: int, decode) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (_x, _y), two nodes: links; a null _y stands for _x itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for x, y in zip(batch["_x"], batch["_y"]):
                tree = _whole(x.values, decode)
                links += traverse(tree, _whole(y.values, decode) if y.is_valid else tree, percent)[0]
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], ["a", "b"])

    return run


def _survivors(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pairs of nodes with narrow bitmaps: those with a pair of leaves of different components left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["_x"], batch["_y"]):
                x, y = _narrow(x.values), _narrow(y.values)
                i, j = leaves(x, y, percent)
                keep.append(bool((np.array(x.c)[i] != np.array(y.c)[j]).any()))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch[c].filter(mask) for c in ("_node", "_node1")], ["_node", "_node1"])

    return run


def _narrowed(decode) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [bitmap(s, width(len(s), NARROW)).tobytes() for s in map(decode, batch["_set"])]
            yield pa.RecordBatch.from_arrays([batch["_row"], pa.array(maps, pa.binary())], ["_row", "_map"])

    return run


def dealt(members: DataFrame) -> DataFrame:
    """members (_row, _c, _cluster, _n) with the _node each is in: (_row, _c, _n, _node); staged.

    A cluster's sets of like size are dealt by a hash to as many nodes as it takes. What a component of OWN or more members holds is
    in nodes of its own.
    """
    many = members.groupBy("_c").agg(F.count(F.lit(1)).alias("_own")).filter(F.col("_own") >= OWN)
    m = members.join(many, "_c", "left").withColumn("_size", F.floor(F.log(F.col("_n")) / F.log(F.lit(1.25))))
    m = staged(m.select("_row", "_c", "_n", "_size", F.when(F.col("_own").isNotNull(), F.xxhash64(F.lit("own"), "_c")).otherwise(F.col("_cluster")).alias("_cluster")), "clustered")
    parts = m.groupBy("_cluster", "_size").agg(F.greatest(F.ceil(F.count(F.lit(1)) / NODE_SETS), F.ceil(F.sum("_n") / NODE_SHINGLES)).alias("_parts"))
    out = staged(m.join(parts, ["_cluster", "_size"]).select("_row", "_c", "_n", F.xxhash64("_cluster", "_size", F.pmod(F.xxhash64("_row"), F.col("_parts"))).alias("_node")), "dealt")
    release(m)
    return out


def _gathered(rows: DataFrame, row: str, data: str) -> DataFrame:
    """(_node, _members) of rows with _node and _c."""
    return rows.groupBy("_node").agg(F.collect_list(F.struct(F.col(row).alias("row"), F.col("_c").alias("c"), F.col(data).alias("set"))).alias("_members"))


def _mixed(placed: DataFrame) -> DataFrame:
    """Nodes of several components."""
    return placed.groupBy("_node").agg(F.min("_c").alias("_a"), F.max("_c").alias("_b")).filter("_a < _b").select("_node")


def _alone(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """A row (_x, _y) for each node of several components, _y null."""
    rows = staged(placed.join(_mixed(placed), "_node"), "mixed")
    return _gathered(sets.join(light(rows, 40), "_row"), "_row", "_set").select(F.col("_members").alias("_x"), F.lit(None).cast(NODE).alias("_y"))


def inside(members: DataFrame, sets: DataFrame, percent: int, decode=stored) -> DataFrame:
    """Links within the nodes of members (_row, _c, _cluster, _n) that join different _c; staged. sets: (_row, _set)."""
    placed = dealt(members)
    out = staged(_alone(placed, sets).mapInArrow(_traversals(percent, decode), LINKS), "tree-links")
    release(placed)
    return out


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set."""
    for batch in batches:
        for row, each in zip(batch["_row"].to_pylist(), batch["_set"]):
            x = np.frombuffer(each.as_buffer(), np.int64)
            for at in range(0, len(x), 1 << 16):
                part = x[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), row)), pa.array(part)], ["_row", "_shingle"])


def _prefixes(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sets in order of rarity: the prefix's shingles that others have too, how many of them stand in the shorter prefix, and the most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 64):
                batch, out = whole.slice(k, 64), []
                for each in batch["_sorted"]:
                    many, x = (each.values.field(f).to_numpy() for f in ("_many", "_shingle"))
                    short, long = prefix_lengths(len(x), percent)
                    first = int(np.searchsorted(many[:long], 2))
                    out.append((x[first:long], max(0, short - first), int(x[long - 1]), len(x)))
                ends = np.cumsum([0, *(len(o[0]) for o in out)])
                keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *(o[0] for o in out)])))
                yield pa.RecordBatch.from_arrays([batch["_row"], keys, *(pa.array([o[c] for o in out], t) for c, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64())))], ["_row", "_prefix", "_short", "_cluster", "_n"])

    return run


def rarest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(_row, _prefix, _short, _cluster, _n) of members that share a shingle of their prefixes, in order of rarity among members; staged."""
    each = staged(sets.join(members, "_row").select("_row", "_set").mapInArrow(_shingles, "_row long, _shingle long"), "shingles")
    many = staged(each.groupBy("_shingle").agg(F.count(F.lit(1)).alias("_many")), "rarity")
    ranked = each.join(many, "_shingle").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_many", "_shingle"))).alias("_sorted"))
    out = staged(ranked.mapInArrow(_prefixes(percent), "_row long, _prefix array<long>, _short int, _cluster long, _n long").filter(F.size("_prefix") > 0), "prefixes")
    for x in (each, many):
        release(x)
    return out


def between(keys: DataFrame, members: DataFrame, sets: DataFrame, percent: int, decode=stored) -> DataFrame:
    """Links (a, b) that join different _c, as many as it takes to join all that are linked; staged.

    keys: (_row, _shingle, _short) of prefixes, _short whether the shingle stands in the shorter one; members: (_row, _c, _cluster, _n).
    """
    placed = dealt(members)
    nodes = placed.groupBy("_node").agg(F.when(F.min("_c") == F.max("_c"), F.min("_c")).alias("_c"), F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
    met = keys.join(placed.select("_row", "_node"), "_row").groupBy("_shingle", "_node").agg(F.max("_short").alias("_short"))
    several = met.groupBy("_shingle").agg(F.count(F.lit(1)).alias("_many")).filter("_many > 1").select("_shingle")
    met = staged(met.join(several, "_shingle").join(nodes, "_node"), "met")
    other = met.select("_shingle", *(F.col(c).alias(f"{c}1") for c in ("_node", "_short", "_c", "_lo", "_hi")))
    sizes = (F.greatest("_lo", "_lo1") * percent) <= (F.least("_hi", "_hi1") * 100)
    apart = ~F.coalesce(F.col("_c") == F.col("_c1"), F.lit(False))
    pairs = met.join(other, "_shingle").filter((F.col("_node") < F.col("_node1")) & (F.col("_short") | F.col("_short1")) & sizes & apart)
    pairs = staged(pairs.select("_node", "_node1").distinct(), "node-pairs")

    def both(pairs: DataFrame, table: DataFrame) -> DataFrame:
        one = lambda node, to: table.select(F.col("_node").alias(node), F.col("_members").alias(to))
        return pairs.join(one("_node", "_x"), "_node").join(one("_node1", "_y"), "_node1").select("_node", "_node1", "_x", "_y")

    ends = lambda pairs: pairs.select("_node").union(pairs.select("_node1")).distinct()
    near = light(staged(placed.join(ends(pairs), "_node"), "near"), 40)
    maps = sets.join(near.select("_row"), "_row", "left_semi").mapInArrow(_narrowed(decode), "_row long, _map binary")
    maps = staged(_gathered(maps.join(near, "_row"), "_n", "_map"), "narrow")
    left = staged(both(pairs, maps).mapInArrow(_survivors(percent), "_node long, _node1 long"), "left-pairs")
    wanted = light(staged(placed.join(ends(left), "_node"), "wanted"), 40)
    whole = staged(_gathered(sets.join(wanted, "_row"), "_row", "_set"), "whole")
    links = both(left, whole).select("_x", "_y").unionByName(_alone(placed, sets))
    links = staged(links.mapInArrow(_traversals(percent, decode), LINKS), "tree-links")
    for x in (placed, met, pairs, maps, left, whole):
        release(x)
    return links


def between_sets(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``between`` for members (_row, _c) whose prefixes are not known yet."""
    members = staged(members, "members")
    prefix = rarest(members, sets, percent)
    keys = prefix.select("_row", "_short", F.posexplode("_prefix").alias("_at", "_shingle")).select("_row", "_shingle", (F.col("_at") < F.col("_short")).alias("_short"))
    links = between(keys, prefix.join(members, "_row").select("_row", "_c", "_cluster", "_n"), sets, percent)
    for x in (members, prefix):
        release(x)
    return links
