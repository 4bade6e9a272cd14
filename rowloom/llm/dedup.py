"""Near-duplicate groups by a Chosen-Path set similarity join over word shingles.

Every document is the set of its shingles. Documents with equal sets form a class and are compared as one. Classes
then descend several independent trees: at a node a few positions of the minwise signature are selected by a hash of
the node's path, and a document goes to the child named by its minwise token at each of them, so similar documents
share paths and others part quickly. Nodes of few documents are compared exhaustively, first by signatures and then,
where these come near the threshold, on the full sets; nodes of many documents branch on. Independent trees are
repeated until a pair at the threshold is missed with a chance under 1 - recall. Links confirmed on full sets are
joined to components.

What keeps large groups cheap: a node's size is found by a counted aggregate and branching needs only the row itself,
so no node is ever gathered while it is large. A large node is first cut into random chunks that share a few pivots;
their confirmed links collapse groups of near copies, nodes inside one component are finished, and a node that is one
large component plus a few others is finished by comparing the few with every chunk of the large one. All this moves
rows in proportion to the node's size. Nodes that resist it to the last level - many documents, far apart, that agree in
every token of a path of LEVELS branches - are compared exactly, every block of half a leaf with every other, at the
cost of 2 / leaf times the square of the node's size. A leaf reports links that span its components, not all its pairs,
and compares full sets in blocks of bounded bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import sorted_groups, text_chunks
from rowloom.session import drop_table, materialise

SHINGLE = 5
#: Bytes of the signature that estimates similarity, and minwise tokens that the paths of one tree choose from.
ESTIMATE, TOKENS = 128, 8
#: Standard deviations below the threshold at which an estimate still leads to a comparison of full sets.
SLACK = 4.5
#: Documents that a leaf compares exhaustively.
LEAF = 1500
#: Bytes of full sets that a leaf compares at once with as many others; a single set may have more.
SET_BYTES = 8 << 20
#: Pivots that chunks of a large node share, and levels after which nodes are compared block by block.
PIVOTS, LEVELS = 16, 8
#: Links that one task contracts (about 100 MB of Python objects).
LINK_BLOCK = 500_000
#: Documents whose sets are fetched through a broadcast of their ids up to this many (16 MB), by a shuffle beyond.
BROADCAST_IDS = 2_000_000

_random = np.random.Generator(np.random.PCG64(20240229))
_LETTERS = _random.integers(1, 2**64, 256, dtype=np.uint64)
_MULTIPLY = _random.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers so that every bit depends on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as needed."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, self.base, dtype=np.uint64))))
            self.down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, self.inverse, dtype=np.uint64))))
        return self.up, self.down


_powers = _Powers()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word, from prefix sums of one polynomial over the bytes."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + _BLOCK)
        while to < len(data) and not _SPACE[data[to]]:
            to += 1  # a word is never cut
        raw = np.frombuffer(data, dtype=np.uint8, count=to - at, offset=at)
        edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[raw], [True])).view(np.int8)))
        begin, end = edges[0::2], edges[1::2]
        up, down = _powers.upto(len(raw))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_LETTERS[raw] * up[: len(raw)], dtype=np.uint64)))
        hashes.append(mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)))
        starts.append(begin + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `size` words; fewer words count as one run.

    Words are separated by ASCII white space and compare with A-Z in lower case.
    """
    parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower() touches A-Z alone
    offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
    words, starts = word_hashes(b"\n".join(parts))
    bounds = np.searchsorted(starts, offsets)
    n = len(words)
    runs = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for j in range(size):
        runs += words[j : j + len(runs)] * _MULTIPLY[j]
    runs = mix(runs)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            whole = (words[a:b] * _MULTIPLY[8 : 8 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums that name a set, whatever the order of its members."""
    a, b = mix(s ^ _MULTIPLY[40]).sum(dtype=np.uint64), mix(s + _MULTIPLY[41]).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def minwise(count: int) -> np.ndarray:
    """The multipliers of `count` minwise functions; more of them begin with the same ones."""
    return np.random.Generator(np.random.PCG64(20240301)).integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimate bytes, `tokens` path tokens) of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    estimate = np.empty((len(sets), ESTIMATE), dtype=np.uint8)
    path = np.empty((len(sets), tokens), dtype=np.int32)
    buffer = np.empty_like(flat)
    for t, multiplier in enumerate(minwise(ESTIMATE + tokens)):
        np.multiply(flat, multiplier, out=buffer)
        least = np.minimum.reduceat(buffer, at)
        if t < ESTIMATE:
            estimate[:, t] = (least >> np.uint64(20)).astype(np.uint8)
        else:
            path[:, t - ESTIMATE] = (least >> np.uint64(16)).astype(np.uint32).view(np.int32)
    return estimate, path


def fingerprints(docs: DataFrame, size: int, tokens: int) -> DataFrame:
    """(uid, key, n, k1, k2, estimate, path) for each row of docs(uid, key, text); n is the size of its set."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            sets = shingle_sets(texts, size)
            estimates, paths, names = [None] * len(sets), [None] * len(sets), [(0, 0)] * len(sets)
            full = [k for k, s in enumerate(sets) if len(s)]
            if full:
                e, p = signatures([sets[k] for k in full], tokens)
                for row, k in enumerate(full):
                    estimates[k], paths[k], names[k] = e[row].tobytes(), p[row], set_keys(sets[k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()), pa.array(estimates, pa.binary()), pa.array(paths, pa.list_(pa.int32()))],
                names=["uid", "key", "n", "k1", "k2", "estimate", "path"],
            )

    return docs.select("uid", "key", "text").mapInArrow(run, f"uid long, key {kind}, n long, k1 long, k2 long, estimate binary, path array<int>")


def _by_node(df: DataFrame) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "node").sortWithinPartitions("node")


def _near(table: pa.Table, floor: float, percent: int) -> np.ndarray:
    """Rows of a leaf that have a partner to compare on full sets here.

    A pair that is already in one component is not compared. In a leaf of a tree (side 0; own: the row's leaves) a
    pair is compared in the smallest of its common leaves only. In a part of a large node rows of side 1 are compared
    with all, rows of another side not among themselves: those meet elsewhere.
    """
    m = table.num_rows
    size, label = table["n"].to_numpy(), table["label"].to_numpy()
    if (label == label[0]).all():
        return np.zeros(0, np.int64)
    estimate = np.frombuffer(b"".join(table["estimate"].to_pylist()), dtype=np.uint8).reshape(m, ESTIMATE)
    node = table["node"][0].as_py()
    own: list[set | None] = [None] * m
    lists, side = table["own"], table["side"].to_numpy()
    in_tree = side[0] == 0
    hit = np.zeros(m, dtype=bool)

    def leaves(k: int) -> set:
        if own[k] is None:
            own[k] = set(lists[k].as_py())
        return own[k]

    need = floor * (1 - 1 / 256) + 1 / 256  # two different bytes are equal once in 256
    step = max(1, (1 << 23) // (m * ESTIMATE))
    for a in range(0, m, step):
        b = min(m, a + step)
        equal = (estimate[a:b, None, :] == estimate[None, a:, :]).sum(axis=2, dtype=np.int32) >= math.floor(need * ESTIMATE)
        small, large = np.minimum(size[a:b, None], size[None, a:]), np.maximum(size[a:b, None], size[None, a:])
        equal &= (100 * small >= percent * large) & (label[a:b, None] != label[None, a:])
        if not in_tree:
            equal &= (side[a:b, None] != side[None, a:]) | (side[a:b, None] == 1)
        rows, cols = np.nonzero(equal)
        if not in_tree:
            hit[rows + a] = hit[cols + a] = True
            continue
        for i, j in zip((rows + a).tolist(), (cols + a).tolist(), strict=True):
            if i < j and not (hit[i] and hit[j]) and min(leaves(i) & leaves(j)) == node:
                hit[i] = hit[j] = True
    return np.flatnonzero(hit)


def _by_bytes(rows: np.ndarray, size: np.ndarray, percent: int, most: int = SET_BYTES) -> list[np.ndarray]:
    """Rows of a leaf as one part or, where their sets have more bytes, as pairs of blocks that hold every pair of near sizes."""
    if 8 * size[rows].sum() <= most:
        return [rows]
    rows = rows[np.argsort(size[rows], kind="stable")]
    upto = np.cumsum(8 * size[rows])
    block = (upto - 8 * size[rows]) // most
    blocks = np.split(rows, np.flatnonzero(np.diff(block)) + 1)
    out = []
    for a, small in enumerate(blocks):
        for b in range(a, len(blocks)):
            if 100 * size[small[-1]] < percent * size[blocks[b][0]]:
                break
            out.append(small if a == b else np.concatenate((small, blocks[b])))
    return out


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def spanning_links(sets: list[np.ndarray], labels: list[int], percent: int) -> list[tuple[int, int]]:
    """Positions of pairs with 100 * intersection >= percent * union that join different components; exact.

    Intersections come from an inverted index over members that occur twice or more.
    """
    m = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begins = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    lengths = np.diff(np.concatenate((begins, [len(flat)])))
    shared = lengths > 1
    begins, lengths = begins[shared], lengths[shared]
    # by document: the posting lists that it is in
    column = np.repeat(np.arange(len(begins)), lengths)
    place = np.repeat(begins, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    member = owner[place]
    by = np.argsort(member, kind="stable")
    columns, edges = column[by], np.searchsorted(member[by], np.arange(m + 1))
    size = np.array([len(s) for s in sets])
    parent, first = list(range(m)), {}
    for k, label in enumerate(labels):
        parent[k] = first.setdefault(label, k)
    out = []
    for i in range(m):
        lists = columns[edges[i] : edges[i + 1]]
        if not len(lists):
            continue
        total = lengths[lists].sum()
        at = np.repeat(begins[lists], lengths[lists]) + np.arange(total) - np.repeat(np.cumsum(lengths[lists]) - lengths[lists], lengths[lists])
        common = np.bincount(owner[at], minlength=m)
        close = 100 * common >= percent * (size + size[i] - common)
        for j in np.flatnonzero(close[i + 1 :]) + i + 1:
            a, b = _find(parent, i), _find(parent, int(j))
            if a != b:
                parent[b] = a
                out.append((i, int(j)))
    return out


def _contracted(edges: DataFrame, blocks: int, most: int) -> DataFrame:
    """(u, v): inside each of `blocks` blocks of edges, every end u with the smallest end v of its component there.

    A block that turns out to have over 2 * `most` ends hands on what it has and begins anew, so its memory is bounded."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def forest() -> pa.RecordBatch:
            ends = [x for x in parent if root(x) != x]
            return pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array([parent[x] for x in ends], pa.int64())], names=["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                if len(parent) > 2 * most:
                    yield forest()
                    parent.clear()
        yield forest()

    return edges.coalesce(blocks).mapInArrow(contract, "u long, v long")


def connected(links: DataFrame, block: int = LINK_BLOCK) -> DataFrame:
    """(uid, label) of every end of the written table links(a, b): label is the smallest uid of its component.

    Links are contracted in blocks of bounded size; where there is more than one block, alternating large-star and
    small-star steps (grouped minima and joins) connect the blocks' components until nothing changes.
    """
    edges, state = links.select(F.col("a").alias("u"), F.col("b").alias("v")), None
    while True:
        blocks = max(1, math.ceil(edges.count() / block))
        edges = materialise(_contracted(edges, blocks, block), "links")
        if blocks == 1:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = materialise(small, "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == state:
            break
        state = now
    labels = edges.select(F.col("u").alias("uid"), F.col("v").alias("label"))
    if blocks > 1:
        labels = labels.groupBy("uid").agg(F.min("label").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("uid"), "label").distinct())


class ChosenPath:
    """One run of the join over docs(uid, key, text), a written table: rows keep their numbers whatever happens to executors."""

    def __init__(self, docs: DataFrame, percent: int, size: int, recall: float, leaf: int):
        if not 50 <= percent <= 100:
            raise ValueError("the threshold is a similarity of 50 to 100 percent")
        self.docs, self.percent, self.size, self.leaf = docs, percent, size, leaf
        share = percent / 100
        self.floor = share - SLACK * math.sqrt(share * (1 - share) / ESTIMATE)
        # a pair meets at the root with chance `share`, and below it its line of descent dies out with chance `lost`
        lost = ((1 - share) / share) ** 2  # smaller root of s = (1 - share + share * s) ** 2
        meets = share * (1 - min(lost, 0.5))
        self.trees = max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets))) if meets < 1 else 1
        self.written: list[DataFrame] = []
        self.prints = materialise(fingerprints(docs, size, self.trees * TOKENS), "fingerprints")
        full = self.prints.where("n > 0")
        self.classes = materialise(full.groupBy("k1", "k2", "n").agg(F.min("uid").alias("rep"), F.min(F.struct(F.col("key").isNull().alias("unknown"), "key", "uid")).alias("first")), "classes")
        self.links: list[DataFrame] = []

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        """A written table that goes when the run is over."""
        self.written.append(materialise(df, name))
        return self.written[-1]

    def _counted(self, rows: DataFrame, name: str) -> DataFrame:
        """rows(node, uid, tree) of nodes with company, and the node's size c."""
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        return self._keep(rows.join(counts, "node"), name)

    def _labelled(self, rows: DataFrame) -> DataFrame:
        label = self._labels()
        if label is None:
            return rows.withColumn("label", F.col("uid"))
        return rows.join(label, "uid", "left").withColumn("label", F.coalesce("label", "uid"))

    def _labels(self) -> DataFrame | None:
        if not self.links:
            return None
        if self._known[0] != len(self.links):
            all_links = self.links[0]
            for more in self.links[1:]:
                all_links = all_links.unionByName(more)
            self._known = (len(self.links), materialise(connected(all_links), "labels"))
        return self._known[1]

    _known: tuple = (0, None)

    def _with_own(self, leaves: DataFrame) -> DataFrame:
        """leaves(node, uid) of trees with side 0 and each row's list of leaves, which are at most a few in each tree."""
        leaves = leaves.distinct()
        own = leaves.groupBy("uid").agg(F.collect_set("node").alias("own"))
        return leaves.join(own, "uid").select("node", "uid", F.lit(0).alias("side"), "own")

    def _parts(self, parts: DataFrame) -> DataFrame:
        """parts(node, uid, side) of large nodes, each row once."""
        return parts.groupBy("node", "uid").agg(F.min("side").alias("side")).withColumn("own", F.lit(None).cast("array<bigint>"))

    def _compare(self, leaves: DataFrame) -> None:
        """Adds the confirmed links of leaves(node, uid, side, own)."""
        percent, floor = self.percent, self.floor
        rows = self._labelled(leaves).join(self.prints.select("uid", "n", "k1", "estimate"), "uid")

        def filter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in sorted_groups(batches):
                if t.num_rows < 2 or not len(found := _near(t, floor, percent)):
                    continue
                parts = _by_bytes(found, t["n"].to_numpy(), percent)
                names = mix(np.arange(len(parts), dtype=np.uint64) + t["node"].to_numpy()[:1].view(np.uint64)).view(np.int64)
                for name, part in zip(names, parts, strict=True):
                    took = t.select(["uid", "label", "k1"]).take(pa.array(part)).combine_chunks()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name)), *(c.chunk(0) for c in took.columns)], names=["node", "uid", "label", "k1"])

        ordered = _by_node(rows.select("node", "uid", "label", "n", "k1", "estimate", "side", "own"))
        near = materialise(ordered.mapInArrow(filter_rows, "node long, uid long, label long, k1 long"), "near")
        wanted = near.select("uid").distinct()
        few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        texts = self.docs.select("uid", "text").join(F.broadcast(wanted) if few else wanted, "uid", "left_semi")
        size = self.size

        def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, chunk in text_chunks(batches):
                packed = [s.tobytes() for s in shingle_sets(chunk, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["uid", "members"])

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in sorted_groups(batches):
                if t.num_rows < 2:
                    continue
                sets = [np.frombuffer(b, dtype=np.uint64) for b in t["members"].to_pylist()]
                if any(set_keys(s)[0] != k for s, k in zip(sets, t["k1"].to_pylist(), strict=True)):
                    raise RuntimeError("the written documents have changed")
                uids = t["uid"].to_pylist()
                pairs = spanning_links(sets, t["label"].to_pylist(), percent)
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([uids[i] for i, _ in pairs], pa.int64()), pa.array([uids[j] for _, j in pairs], pa.int64())], names=["a", "b"])

        sets = texts.mapInArrow(to_sets, "uid long, members binary")
        found = _by_node(near.join(sets, "uid").select("node", "uid", "label", "k1", "members")).mapInArrow(confirm, "a long, b long")
        self.links.append(self._keep(found, "confirmed"))
        drop_table(near)

    def _roots(self) -> DataFrame:
        trees = F.sequence(F.lit(0), F.lit(self.trees - 1))
        roots = F.transform(trees, lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.get("path", t * TOKENS)).alias("node")))
        reps = self.prints.select("uid", "path").join(self.classes.select(F.col("rep").alias("uid")), "uid", "left_semi")
        return reps.select(F.inline(roots), "uid").select("node", "uid", "tree")

    def _children(self, rows: DataFrame) -> DataFrame:
        """Two children of each row, by two of its tree's own tokens, which a hash of the node chooses."""
        others = TOKENS - 1  # the first one is the root's
        first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(others))
        second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(others - 1)), F.lit(others))
        token = lambda p: F.get("path", (F.col("tree") * TOKENS + 1 + p).cast("int"))
        with_path = rows.select("node", "uid", "tree").join(self.prints.select("uid", "path"), "uid")
        return with_path.select(F.explode(F.transform(F.array(first, second), lambda p: F.xxhash64("node", p, token(p)))).alias("node"), "uid", "tree")

    def _large(self, big: DataFrame, level: int) -> DataFrame:
        """Works on large nodes; returns parts for the final comparison and leaves what has to branch on in self._rest."""
        leaf = self.leaf
        guest = lambda part: F.when(F.col(part) == 0, F.lit(1)).otherwise(F.lit(2)).alias("side")
        chunks = F.ceil(F.col("c") / F.lit(leaf)).cast("long")
        chunk = F.pmod(F.xxhash64("uid", "node"), chunks)
        members = big.select(F.xxhash64("node", F.lit("chunk"), chunk).alias("node"), "uid", F.lit(1).alias("side"))
        pivots = big.where(F.pmod(F.xxhash64("uid", "node", F.lit("pivot")), F.col("c")) < PIVOTS)
        pivots = pivots.select("node", "uid", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
        self._compare(self._parts(members.unionByName(pivots.select(F.xxhash64("node", F.lit("chunk"), "chunk").alias("node"), "uid", guest("chunk")))))
        rows = self._labelled(big)
        kinds = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("k"))
        info = kinds.groupBy("node").agg(F.max(F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        rows = self._keep(rows.join(info.select("node", F.col("top.k").alias("major"), F.col("top.label").alias("major_label")), "node"), "mixed")
        # one large component and few others: each chunk of the large one meets all others
        parts = F.ceil(F.col("major") / F.lit(leaf)).cast("long")
        ends = rows.where(F.col("c") - F.col("major") <= leaf)
        most = ends.where("label = major_label").select("node", "uid", F.pmod(F.xxhash64("uid"), parts).alias("part"), F.lit(1).alias("side"))
        others = ends.where("label != major_label").select("node", "uid", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        done = most.unionByName(others.select("node", "uid", "part", guest("part"))).select(F.xxhash64("node", F.lit("part"), "part").alias("node"), "uid", "side")
        self._rest = rows.where(F.col("c") - F.col("major") > leaf).select("node", "uid", "tree", "c")
        if level >= LEVELS:  # blocks of half a leaf, every block with every other
            blocks = F.ceil(F.col("c") * 2 / F.lit(leaf)).cast("long")
            mine = F.pmod(F.xxhash64("uid"), blocks)
            pairs = self._rest.select("node", "uid", mine.alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("b"))
            side = F.when(F.col("a") == F.col("b"), 1).when(F.col("a") < F.col("b"), 2).otherwise(3)
            done = done.unionByName(pairs.select(F.xxhash64("node", F.lit("block"), F.least("a", "b"), F.greatest("a", "b")).alias("node"), "uid", side.alias("side")))
            self._rest = self._rest.where("false")
        return done

    def run(self) -> DataFrame:
        """(uid, key, n, component): component is the struct of the component's smallest key and its row."""
        rows, level, leaves, parts = self._counted(self._roots(), "level0"), 0, None, None
        while True:
            mine = rows.where(F.col("c") <= self.leaf).select("node", "uid")
            leaves = mine if leaves is None else leaves.unionByName(mine)
            big = rows.where(F.col("c") > self.leaf)
            if big.isEmpty():
                break
            done = self._large(big, level)
            parts = done if parts is None else parts.unionByName(done)
            level += 1
            rows = self._counted(self._children(self._rest), f"level{level}")
        final = self._with_own(leaves)
        self._compare(final if parts is None else final.unionByName(self._parts(parts)))
        labelled = self._labelled(self.classes.withColumnRenamed("rep", "uid"))
        firsts = labelled.groupBy("label").agg(F.min("first").alias("component"))
        classes = labelled.join(firsts, "label").select("k1", "k2", F.col("n").alias("size"), "component")
        rows = self.prints.select("uid", "key", "n", "k1", "k2")
        joined = rows.where("n > 0").join(classes.withColumnRenamed("size", "n"), ["k1", "k2", "n"]).select("uid", "key", "n", "component")
        alone = rows.where("n = 0").select("uid", "key", "n", F.struct(F.col("key").isNull().alias("unknown"), "key", "uid").alias("component"))
        for table in self.written:  # the result reads fingerprints, classes and labels
            drop_table(table)
        return joined.unionByName(alone)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, size: int = SHINGLE, recall: float = 0.99999, leaf: int = LEAF) -> DataFrame:
    """key, n_shingles, component_id, kept for each row of docs.

    Two rows are linked if 100 * |intersection| >= percent * |union| of their sets of word runs; component_id is the
    smallest key that links reach, and kept tells whether it is the row's own.
    Null or empty texts, and texts of white space, have an empty set and are linked with nothing. Null keys: such rows
    are linked like others, but a component takes its id from rows that have one; kept is false for them. Repeated
    keys: rows are told apart by place. Other columns are ignored, whatever their names. An empty table gives an empty
    table. A text of any length is read whole; its set is in one task's memory beside SET_BYTES of others.
    recall is the least chance, for a pair at the threshold, that some tree compares it; closer pairs have a higher one.
    """
    numbered = materialise(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), F.col(text).alias("text")), "numbered", "zstd")
    found = ChosenPath(numbered, percent, size, recall, leaf).run()
    drop_table(numbered)
    same = F.coalesce(F.col("key") == F.col("component.key"), F.lit(False))
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component.key").alias("component_id"), same.alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """One row of docs for each component, the one with the smallest key (nulls last, then the first row), as it was.

    Rows whose text is null, empty or white space are linked with nothing and stay. Columns of any name are kept. An
    empty table gives an empty table.
    """
    name = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    numbered = materialise(docs.select(F.monotonically_increasing_id().alias("uid"), *(F.col(f"`{c}`").alias(n) for c, n in name.items())), "numbered", "zstd")
    found = ChosenPath(numbered.select("uid", F.col(name[key]).alias("key"), F.col(name[text]).alias("text")), percent, SHINGLE, 0.99999, LEAF).run()
    chosen = found.where(F.col("uid") == F.col("component.uid")).select("uid")
    return numbered.join(chosen, "uid", "left_semi").select(*(F.col(n).alias(c) for c, n in name.items()))


#: DuckDB's version of near_duplicates(percent=85): all pairs that share a shingle, exact.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, list_aggregate(w, 'string_agg', ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
z AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id AND r.c < e.b),
m AS (SELECT doc_id, MIN(c) AS c FROM r GROUP BY 1)
SELECT w.doc_id, COALESCE(z.n, 0) AS n_shingles, COALESCE(LEAST(m.c, w.doc_id), w.doc_id) AS component_id, COALESCE(LEAST(m.c, w.doc_id), w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN z USING (doc_id) LEFT JOIN m USING (doc_id)
"""
