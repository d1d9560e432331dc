"""Jaccard join on word 5-grams: a MinHash LSH forest proposes, an exact check disposes.

Texts are sets of hashed 5-word shingles (a text of one to four words is one
shingle). Equal sets are one representative. Each of ``TREES`` trees orders the
representatives by ``DEPTH`` signature values of its own; representatives that
agree on the first p of them are a node of the tree's prefix trie at depth p.
The search begins at the full depth and verifies every pair that shares a node
there. The verified pairs tell how many others there are: a pair of similarity s
meets at depth p with probability q(p, s) = 1 - (1 - s ** p) ** TREES, so each
one found stands for 1 / q of its kind, and one pair at the threshold is always
reckoned with. As long as the recall that follows is below ``RECALL``, the
matched prefixes are shortened, to the longest depth that promises it, and the
pairs that first meet there are verified too.

A pair is verified in one place: in the first tree in which it meets at its
depth, unless it has met at a greater one. A node is cut by set size (sets at
the threshold lie in one bin or in neighbours) and by hash into blocks; a pair
of blocks is one unit of work. Units first compare prefixes alone, then the
shingles of the representatives that have a pair left there are sent to them and
counted. Units send on link counts and spanning links, never pairs.

A row is returned for each document: class_id (least doc_id of its component of
verified links) and n_links (other rows at the threshold or above, copies
included). Texts without words (null ones too) link to nothing and are classes
of their own; rows with a null doc_id take part, and a class of such rows alone
has a null class_id. Repeated rows link to each other. An empty table
gives no rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, fresh, staged
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 8
RECALL = 0.9999
BLOCK = 256
FAN = 64  # of the trees of spanning links
BROADCAST_ROWS = 500_000
BINS = 100  # of similarities, for the estimate of the recall
SEED = 20_240_607
CACHE_WORDS = 400_000
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def meeting(similarity: np.ndarray, depth: int) -> np.ndarray:
    """Probability that a pair shares a node of some tree at this depth."""
    return 1 - (1 - similarity**depth) ** TREES


def recall_at(depth: int, links: np.ndarray, found_at: int, threshold: float) -> float:
    """Expected recall of a search at ``depth``, from a histogram of the links' similarities found at ``found_at``."""
    centre = (np.arange(BINS + 1) + 0.5).clip(max=BINS) / BINS
    similarity = np.append(np.maximum(centre, threshold), threshold)
    weight = np.append(links, 1) / meeting(similarity, found_at)
    return float((weight * meeting(similarity, depth)).sum() / weight.sum())


def next_depth(depth: int, links: np.ndarray, threshold: float) -> int:
    """The depth at which to search next: the present one where its recall is enough, else the longest that promises it."""
    for p in range(depth, 0, -1):
        if recall_at(p, links, depth, threshold) >= RECALL:
            return p
    return 1


class _Words(dict):
    """Word to 64-bit hash; bounded."""

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        h = zlib.crc32(raw) | zlib.crc32(raw, 0x9E3779B9) << 32
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


_words = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams."""
    words = [w for w in _SPLIT.split(text or "") if w]
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for j in range(size):
        out = mix(out + h[j : len(words) - size + 1 + j] + np.uint64(j + 1))
    return np.unique(out)


_rng = np.random.default_rng(SEED)
_mul = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_add = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def signature(s: np.ndarray, values: int) -> np.ndarray:
    """The least of each of ``values`` permuted hashes."""
    out = np.empty(values, np.uint32)
    for at in range(0, values, 16):
        k = slice(at, min(at + 16, values))
        out[k] = ((s[None, :] * _mul[k, None] + _add[k, None]) >> np.uint64(32)).astype(np.uint32).min(1)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, t, u (hashes of the text), n (shingles), s0, s1 (hash of the set), sig (the signature values by tree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s0, s1, sig = [], [], [], []
            for text in batch.column(3):
                s = shingles(text.as_py())
                h0, h1 = set_hash(s)
                n.append(len(s))
                s0.append(h0)
                s1.append(h1)
                sig.append(signature(s, TREES * DEPTH).tobytes() if len(s) else None)
            arrays = [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(s0, pa.int64()), pa.array(s1, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "t", "u", "n", "s0", "s1", "sig"])

    return docs.select(*identity(), "text").mapInArrow(run, "doc_id long, t long, u long, n long, s0 long, s1 long, sig binary")


def identity() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.xxhash64("text", F.lit(1)).alias("u")]


def set_hash(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(mix(x).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for x in (s, s ^ MIX1))


def prefix_keys(depth: int, tree: Column) -> Column:
    """Hash of the first ``depth`` values of a tree (four bytes each)."""
    return F.xxhash64(tree, F.substring(F.col("sig"), tree * (4 * DEPTH) + 1, F.lit(4 * depth)))


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Matrix of common shingles between the sets of two blocks, by dense products over column slices."""
    ha, hb = np.concatenate(a), np.concatenate(b)
    ra = np.repeat(np.arange(len(a)), [len(x) for x in a])
    rb = np.repeat(np.arange(len(b)), [len(x) for x in b])
    shared = np.intersect1d(ha, hb)
    out = np.zeros((len(a), len(b)), np.float32)
    ca, cb = np.searchsorted(shared, ha), np.searchsorted(shared, hb)
    ia = (ca < len(shared)) & (shared[np.minimum(ca, len(shared) - 1)] == ha) if len(shared) else np.zeros(len(ha), bool)
    ib = (cb < len(shared)) & (shared[np.minimum(cb, len(shared) - 1)] == hb) if len(shared) else np.zeros(len(hb), bool)
    ra, ca, rb, cb = ra[ia], ca[ia], rb[ib], cb[ib]
    width = 4096
    for at in range(0, len(shared), width):
        x = np.zeros((len(a), min(width, len(shared) - at)), np.float32)
        y = np.zeros((len(b), x.shape[1]), np.float32)
        k = (ca >= at) & (ca < at + width)
        x[ra[k], ca[k] - at] = 1
        k = (cb >= at) & (cb < at + width)
        y[rb[k], cb[k] - at] = 1
        out += x @ y.T
    return out


def forest(hits: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of the pairs (i, j): the members of each component in a tree of ``FAN`` children a member."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in hits.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    parts: dict[int, list[int]] = {}
    for i in sorted(root):
        parts.setdefault(find(i), []).append(i)
    return [(m[(k - 1) // FAN], m[k]) for m in parts.values() for k in range(1, len(m))]


def met(left: list[tuple], right: list[tuple], tree: int, same: bool, threshold: float) -> np.ndarray:
    """Pairs to verify here: they meet in this tree and in none before it, in no tree at the greater depth, and their sizes allow it.

    Members are (rep, n, keys, deeper keys); ``same``: both sides are one block, whose pairs count once.
    """
    n, m = (np.array([x[1] for x in side], np.int64) for side in (left, right))
    # 1000 * smaller >= t * larger is needed for a similarity of t thousandths
    t = round(1000 * threshold)
    out = 1000 * np.minimum(n[:, None], m[None, :]) >= t * np.maximum(n[:, None], m[None, :])
    if same:
        out = np.triu(out, 1)
    keys, other = (np.array([np.frombuffer(x[2], np.int64) for x in side]) for side in (left, right))
    out &= keys[:, None, tree] == other[None, :, tree]
    for k in range(tree):
        out &= keys[:, None, k] != other[None, :, k]
    if left[0][3] is not None:
        keys, other = (np.array([np.frombuffer(x[3], np.int64) for x in side]) for side in (left, right))
        for k in range(keys.shape[1]):
            out &= keys[:, None, k] != other[None, :, k]
    return out


def verify(left: list[tuple], right: list[tuple], tree: int, same: bool, threshold: float) -> tuple[dict[int, int], list[tuple[int, int]], np.ndarray]:
    """Link counts by rep, spanning links and similarity histogram of one unit; members are (rep, n, keys, deeper keys, copies, shingles)."""
    wanted = met(left, right, tree, same, threshold)
    inter = common([x[5] for x in left], [x[5] for x in right]).astype(np.int64)
    union = np.array([x[1] for x in left])[:, None] + np.array([x[1] for x in right])[None, :] - inter
    # J >= t exactly as t as a fraction of thousandths allows: inter / union >= t
    near = wanted & (1000 * inter >= round(1000 * threshold) * union)
    hits = np.argwhere(near)
    histogram = np.bincount((BINS * inter[near]) // np.maximum(union[near], 1), minlength=BINS + 1)
    counts: dict[int, int] = {}
    for rows, axis, other in ((left, 1, right), (right, 0, left)):
        weight = np.array([x[4] for x in other])
        linked = (near * (weight[None, :] if axis == 1 else weight[:, None])).sum(axis)
        for x, c in zip(rows, linked.tolist()):
            if c:
                counts[x[0]] = counts.get(x[0], 0) + int(c)
    shift = 0 if same else len(left)
    name = [x[0] for x in left] if same else [x[0] for x in (*left, *right)]
    links = [(name[i], name[j]) for i, j in forest(hits + np.array([0, shift]))] if len(hits) else []
    return counts, links, histogram


UNIT = ["node", "a", "b"]


def units(members: DataFrame, threshold: float) -> DataFrame:
    """node, tree, rep and the pairs of blocks (a, b, side) that a member of a node belongs to.

    A node of at most ``BLOCK`` members is one block; counting larger ones needs no task to see a whole node.
    """
    width = math.log(1 / threshold) if threshold < 1 else 1.0
    size = F.when(F.col("total") <= BLOCK, F.lit(0)).otherwise(F.floor(F.log("n") / F.lit(width) + F.lit(1e-9)).cast("int") + 1)
    binned = members.withColumn("bin", size)
    alone = binned.filter("bin = 0").select("node", "tree", "rep", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"))
    binned = binned.filter("bin > 0")
    parts = binned.groupBy("node", "bin").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    name = lambda bin_, part: (bin_ * (1 << 20) + part).cast("int")
    placed = binned.join(parts, ["node", "bin"]).withColumn("block", name(F.col("bin"), F.pmod("rep", "parts")))
    blocks = parts.select("node", "bin", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    blocks = blocks.select("node", "bin", name(F.col("bin"), F.col("part")).alias("block"))
    a = blocks.select("node", F.col("block").alias("a"), F.col("bin").alias("a_bin"))
    b = blocks.select("node", F.col("block").alias("b"), F.col("bin").alias("b_bin"))
    pairs = a.join(b, "node").filter("b >= a AND b_bin - a_bin <= 1").select("node", "a", "b")
    sides = pairs.select("node", "a", "b", F.col("a").alias("block"), F.lit(0).alias("side")).unionByName(
        pairs.filter("a <> b").select("node", "a", "b", F.col("b").alias("block"), F.lit(1).alias("side"))
    )
    return alone.unionByName(placed.join(sides, ["node", "block"]).select("node", "tree", "rep", "a", "b", "side"))


def named_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, list[tuple], list[tuple], bool]]:
    """Name, tree, members of both sides and whether these are one block, of a stream (node, a, b, tree, side, rep, ...) sorted by name, side, rep."""
    key, sides, last, tree = None, ([], []), None, 0

    def out():
        same = key[1] == key[2]
        return key, tree, sides[0], sides[0] if same else sides[1], same

    for batch in batches:
        for node, a, b, t, side, rep, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if key is not None and (node, a, b) != key:
                yield out()
                sides, last = ([], []), None
            key, tree = (node, a, b), t
            if (side, rep) != last:
                sides[side].append((rep, *rest))
            last = (side, rep)
    if key is not None:
        yield out()


def search(docs: DataFrame, reps: DataFrame, depth: int, before: int | None, threshold: float) -> DataFrame:
    """rep, linked, a, b, histogram: what the pairs add that meet at ``depth`` and did not at the depth ``before``."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    keyed = reps.select("rep", "n", "sig", tree)
    node = F.xxhash64("tree", prefix_keys(depth, F.col("tree")))
    deep = prefix_keys(before, F.col("tree")) if before else F.lit(0).cast("long")
    keyed = keyed.select("rep", "n", "tree", node.alias("node"), deep.alias("deep"))
    # a node whose members are one node at the greater depth has no new pairs
    nodes = keyed.groupBy("node").agg(F.count("*").alias("total"), (F.min("deep") == F.max("deep")).alias("one")).filter("total > 1")
    nodes = nodes.filter("NOT one") if before else nodes
    members = staged(keyed.join(nodes.select("node", "total"), "node").select("node", "tree", "rep", "n", "total"), "nodes")
    dealt = units(members, threshold)
    every = F.sequence(F.lit(0), F.lit(TREES - 1))
    pack = lambda p: F.transform(every, lambda t: prefix_keys(p, t)) if p else F.lit(None).cast("array<long>")
    told = reps.select("rep", "n", "copies", pack(depth).alias("keys"), pack(before).alias("deeper"))
    with_keys = dealt.join(told, "rep").select(*UNIT, "tree", "side", "rep", "n", "keys", "deeper").repartition(*UNIT).sortWithinPartitions(*UNIT, "side", "rep")

    def arrays(x):
        return [None if k is None else np.array(k, np.int64).tobytes() for k in x]

    def needed(batches):
        def packed():
            for batch in batches:
                columns = [*batch.columns[:7], pa.array(arrays(batch.column(7).to_pylist()), pa.binary()), pa.array(arrays(batch.column(8).to_pylist()), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        for (node, a, b), tree, left, right, same in named_units(packed()):
            wanted = met(left, right, tree, same, threshold)
            rows = [(node, a, b, tree, 0, x) for x, keep in zip(left, (wanted.any(1) | (wanted.any(0) if same else False)).tolist()) if keep]
            if not same:
                rows += [(node, a, b, tree, 1, x) for x, keep in zip(right, wanted.any(0).tolist()) if keep]
            if rows:
                out = [[r[i] for r in rows] for i in range(5)] + [[r[5][i] for r in rows] for i in range(4)]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], NEEDED)

    asked = staged(with_keys.mapInArrow(needed, "node long, a int, b int, tree int, side int, rep long, n long, keys binary, deeper binary"), "units")
    listed = asked.groupBy("rep").agg(F.first("keys").alias("keys"), F.first("deeper", True).alias("deeper"), F.collect_list(F.struct("node", "a", "b", "tree", "side")).alias("units"))
    lent = listed.join(reps.select("rep", "n", "copies", "lender"), "rep")
    wanted = lent.select("rep", F.col("lender.none").alias("w_none"), F.coalesce("lender.id", F.lit(0).cast("long")).alias("w_id"), F.col("lender.t").alias("w_t"), F.col("lender.u").alias("w_u"))
    wanted = F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted
    texts = docs.select(*identity(), "text").filter("text IS NOT NULL")
    here = (F.col("doc_id").isNull() == F.col("w_none")) & (F.coalesce("doc_id", F.lit(0).cast("long")) == F.col("w_id")) & (F.col("t") == F.col("w_t")) & (F.col("u") == F.col("w_u"))
    # rows that repeat id and text lend it once
    lender = texts.join(wanted, here).groupBy("rep").agg(F.first("text").alias("text"))
    carried = lender.join(lent.select("rep", "n", "copies", "keys", "deeper", "units"), "rep").select("rep", "n", "keys", "deeper", "copies", "units", "text")

    def expand(batches):
        names = [*UNIT, "tree", "side", "rep", "n", "keys", "deeper", "copies", "packed"]
        kinds = [pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        for batch in batches:
            out = [[] for _ in names]
            for rep, n, keys, deeper, copies, units_, text in zip(*(c.to_pylist() for c in batch.columns)):
                packed = shingles(text).tobytes()
                for u in units_:
                    for column, x in zip(out, (u["node"], u["a"], u["b"], u["tree"], u["side"], rep, n, keys, deeper, copies, packed)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    schema = "node long, a int, b int, tree int, side int, rep long, n long, keys binary, deeper binary, copies long, packed binary"
    sent = carried.mapInArrow(expand, schema).repartition(*UNIT).sortWithinPartitions(*UNIT, "side", "rep")

    def check(batches):
        for _, tree, left, right, same in named_units(batches):
            if not right:
                continue
            left, right = ([(*x[:5], np.frombuffer(x[5], np.uint64)) for x in side] for side in (left, right))
            counts, links, histogram = verify(left, right, tree, same, threshold)
            if counts:
                rows = [(r, c, None, None, None) for r, c in counts.items()] + [(None, None, a, b, None) for a, b in links] + [(None, None, None, None, histogram.tolist())]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.list_(pa.int64()))], ["rep", "linked", "a", "b", "histogram"])

    found = staged(sent.mapInArrow(check, "rep long, linked long, a long, b long, histogram array<long>"), "verified")
    discard(members)
    discard(asked)
    return found


NEEDED = [*UNIT, "tree", "side", "rep", "n", "keys", "deeper"]


def classes_of(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The rows' sketches, and s0, s1, component, class_id, n_links of every set that has words."""
    spark = docs.sparkSession
    arrow_rows(spark)
    drawn = staged(sketches(docs), "sketches")
    wordy = drawn.filter("n > 0")
    # A representative is named by its set: the hash decides, so ties and null ids need no rule. One row lends its text.
    lender = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "t", "u")
    reps = wordy.groupBy("s0", "s1").agg(F.count("*").alias("copies"), F.min("n").alias("n"), F.min("sig").alias("sig"), F.min(lender).alias("lender"))
    reps = staged(reps.withColumn("rep", F.xxhash64("s0", "s1")), "representatives")
    links, depth, before, parts = np.zeros(BINS + 1), DEPTH, None, []
    while True:
        found = search(docs, reps, depth, before, threshold)
        parts.append(found)
        sums = found.filter("histogram IS NOT NULL").select(F.posexplode("histogram").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect()
        for r in sums:
            links[r.bin] += r.n
        after = next_depth(depth, links, threshold)
        if after == depth:
            break
        depth, before = after, depth
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    linked = found.filter("rep IS NOT NULL").groupBy("rep").agg(F.sum("linked").alias("linked"))
    classes = components(found.filter("a IS NOT NULL").select("a", "b"))
    named = reps.select("rep", "s0", "s1", "copies", F.col("lender.id").alias("least")).join(linked, "rep", "left").join(classes.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("least").alias("class_id"))
    named = staged(named.join(least, "component").select("s0", "s1", "component", "class_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "classes")
    for done in (reps, *parts):
        discard(done)
    return drawn, named


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``docs``."""
    drawn, named = classes_of(docs, threshold)
    result = drawn.select("doc_id", "n", "s0", "s1").join(named, ["s0", "s1"], "left")
    alone = F.col("n") == 0
    return result.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with exactly one row of each verified class: least doc_id, nulls last, then text hash; rows without words are all kept.

    The class decides, not the id: rows that share an id or have none are judged by their texts.
    """
    drawn, named = classes_of(docs.select("doc_id", "text"), threshold)
    rows = drawn.filter("n > 0").join(named.select("s0", "s1", "component"), ["s0", "s1"])
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "u")).alias("best"))
    own = fresh(docs, "near_none", "near_id", "near_t", "near_u")
    best = best.select(F.col("best.none").alias(own[0]), F.coalesce("best.doc_id", F.lit(0).cast("long")).alias(own[1]), F.col("best.t").alias(own[2]), F.col("best.u").alias(own[3]))
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    doc_id, t, u = identity()
    named_rows = docs.filter(wordy).select("*", doc_id.isNull().alias(own[0]), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias(own[1]), t.alias(own[2]), u.alias(own[3]))
    kept = named_rows.join(best, own, "left_semi").dropDuplicates(own).select(*docs.columns)
    return kept.unionByName(docs.filter(~wordy))
