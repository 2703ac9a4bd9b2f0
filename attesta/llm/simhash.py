"""Near duplicates by SimHash fingerprints and BK-trees.

Fingerprints: the majority bits of the XXH64 hashes of a text's word shingles.  Equal fingerprints are one node.  Two
fingerprints within `radius` bits agree in at least `e` of `radius + e` blocks of bits, so nodes are dealt into shards
by every choice of e blocks; e grows with the number of nodes so that a shard stays near `shard_size`.  In a shard a
BK-tree, whose children are keyed by their Hamming distance to the parent, answers each query along edges within the
radius only.  A subtree that already lies in one component, the query's own, is not entered, so a dense group of near
copies costs about a step for each copy.  A shard reports a star for each component; stars are joined into global
components by alternating large-star and small-star steps, each written to the shared folder.

Trees are dealt by a shuffle rather than broadcast whole, because together they hold every fingerprint of the corpus.  A
shard that one value of its bits crowds is split further, so no task gets more than a bounded number of nodes.

Null and empty texts have fingerprint zero and are linked like any other.  Repeated rows and equal texts share a
fingerprint and so a component.  A null doc_id is never a component's name unless it is alone.  No rows give no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_columns, materialise, near_ids, remove, unused

SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every run of `shingle` words; a shorter text is one run, a text without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hashed(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.fromiter((hashed(joined[s:e], SEED) for s, e in zip(starts, stops)), np.uint64, len(starts))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


class BKTree:
    """A BK-tree that also keeps the components of links found so far."""

    def __init__(self, radius: int):
        self.radius = radius
        self.keys: list[int] = []
        self.children: list[dict[int, int]] = []
        self.root: list[int] = []  # union-find over nodes
        self.whole: list[bool] = []  # the subtree lies in one component
        self.joins: list[tuple[int, int]] = []  # links between what were two components

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def add(self, key: int) -> None:
        """key: not in the tree yet.  Links it with every component that has a node within the radius."""
        keys, children, radius, find, whole = self.keys, self.children, self.radius, self.find, self.whole
        new = len(keys)
        self.root.append(new)
        todo = [0] if new else []
        mine = new
        while todo:
            at = todo.pop()
            theirs = find(at)
            if whole[at] and theirs == mine:
                continue
            d = (keys[at] ^ key).bit_count()
            if d <= radius and theirs != mine:
                self.joins.append((new, at))
                self.root[max(theirs, mine)] = mine = min(theirs, mine)
            todo += [c for edge, c in children[at].items() if -radius <= edge - d <= radius]
        path, at = [], 0
        while new:
            path.append(at)
            d = (keys[at] ^ key).bit_count()
            if (below := children[at].get(d)) is None:
                children[at][d] = new
                break
            at = below
        for p in path:
            whole[p] = whole[p] and find(p) == mine
        keys.append(key)
        children.append({})
        whole.append(True)

    def components(self) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for k, key in enumerate(self.keys):
            found.setdefault(self.find(k), []).append(key)
        return found


def block_masks(radius: int, equal: int) -> list[int]:
    """Masks of every choice of `equal` among radius + equal blocks of the 64 bits."""
    n = radius + equal
    cuts = [64 * k // n for k in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(blocks, equal)]


def shard_masks(n: int, radius: int, shard_size: int) -> list[int]:
    """The masks with the fewest equal blocks that leave about shard_size of n nodes in a shard."""
    for equal in range(1, 8):
        masks = block_masks(radius, equal)
        if n <= shard_size << min(m.bit_count() for m in masks):
            break
    return masks


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def rest_masks(mask: int, radius: int) -> list[int]:
    """The bits outside mask in radius + 1 parts, of which two fingerprints within the radius share one."""
    bits = [1 << k for k in range(64) if not mask >> k & 1]
    return [sum(bits[len(bits) * k // (radius + 1) : len(bits) * (k + 1) // (radius + 1)]) for k in range(radius + 1)]


def shards(nodes: DataFrame, radius: int, shard_size: int, crowd: int) -> DataFrame:
    """shard, fp: every two nodes within the radius share a shard, and no shard grows with a crowded value.

    Nodes are dealt by the bits of each mask.  A shard of more than `crowd` nodes is dealt again by parts of its other bits;
    one that is still crowded is cut into pieces of half that size, and each two pieces are a shard.
    """
    masks = shard_masks(nodes.count(), radius, shard_size)
    bits = [signed(m) for m in masks]
    choice = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(bits)]))
    dealt = nodes.select("fp", choice.alias("s")).select("fp", "s.mask", F.xxhash64("s.mask", "s.part").alias("shard"))

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The rows of shards that aren't crowded, and those that are, with the shard's size."""
        sizes, _ = materialise(rows.groupBy("shard").agg(F.count("*").alias("size")).where(F.col("size") > crowd), "crowded")
        if sizes.isEmpty():
            return rows, None
        return rows.join(sizes, "shard", "left_anti"), rows.join(sizes, "shard")

    out, crowded = split(dealt)
    out = out.select("shard", "fp")
    if crowded is None:
        return out
    rest = F.array(*[F.array(*[F.lit(signed(r)) for r in rest_masks(m, radius)]) for m in masks])
    again = crowded.select("fp", "shard", F.posexplode(F.element_at(rest, F.col("mask") + 1)).alias("k", "bits"))
    few, crowded = split(again.select("fp", F.xxhash64("shard", "k", F.col("fp").bitwiseAND(F.col("bits"))).alias("shard")))
    out = out.union(few.select("shard", "fp"))
    if crowded is None:
        return out
    pieces = F.ceil(2 * F.col("size") / F.lit(crowd))
    own = F.pmod(F.xxhash64("fp"), pieces)
    each = crowded.select("fp", "shard", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("other")).where("own != other")
    return out.union(each.select(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "fp"))


def links(nodes: DataFrame, radius: int = 4, shard_size: int = 2000, crowd: int = 20_000, direct: bool = False) -> DataFrame:
    """a, b: a star around the least fingerprint of every shard's component, or (direct) a tree of links within the radius;
    nodes: distinct column fp.
    """
    dealt = shards(nodes, radius, shard_size, crowd)

    def search(batches):
        held, tree = None, BKTree(radius)

        def stars():
            a, b = [], []
            if direct:
                a, b = ([signed(tree.keys[pair[k]]) for pair in tree.joins] for k in (0, 1))
            elif len(tree.keys) > 1:
                for members in tree.components().values():
                    if len(members) > 1:
                        least = signed(min(members))
                        members = [signed(m) for m in members]
                        a += (rest := [m for m in members if m != least])
                        b += [least] * len(rest)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if a else None

        for batch in batches:
            for shard, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != held:
                    if (out := stars()) is not None:
                        yield out
                    held, tree = shard, BKTree(radius)
                tree.add(fp & 0xFFFFFFFFFFFFFFFF)
        if (out := stars()) is not None:
            yield out

    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(search, "a long, b long")


def linked_nodes(nodes: DataFrame, radius: int = 4, shard_size: int = 2000, crowd: int = 20_000) -> DataFrame:
    """a, b (structs of node and size): nodes whose fingerprints link, enough of them to span each component of a shard.

    nodes: node, size, fp.  The least node of a fingerprint stands for it in the trees, and links with its others.
    """
    heads, _ = materialise(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("head")), "heads")
    equal = nodes.join(heads, "fp").select(F.col("head").alias("a"), F.struct("node", "size").alias("b")).where("a.node != b.node")
    of_a, of_b = (heads.select(F.col("fp").alias(f"fp_{c}"), F.col("head").alias(c)) for c in "ab")
    near = links(heads.select("fp"), radius, shard_size, crowd, direct=True).toDF("fp_a", "fp_b")
    return equal.union(near.join(of_a, "fp_a").join(of_b, "fp_b").select("a", "b"))


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root (the least node that it reaches) of an undirected graph with columns a and b."""
    spark = edges.sparkSession
    now, path = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), "m"), F.struct("a", "m"))).alias("e")).select("e.a", F.col("e.m").alias("b")).where("a != b").distinct()
        after, path_after = materialise(small, "links")
        same = [d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for d in (now, after)]
        remove(spark, path)
        now, path = after, path_after
        if same[0] == same[1]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")


def grouped(docs: DataFrame, shingle: int = 4, radius: int = 4, shard_size: int = 2000, crowd: int = 20_000) -> DataFrame:
    """doc_id, h (the text's hash), fp, root (the component's least fingerprint), component_id: a row for each row of docs."""

    def make():
        forget()

        def run(keys, hashes, texts):
            return keys, hashes, [signed(fingerprint(t, shingle)) for t in texts]

        return run

    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    prints, _ = materialise(map_columns(keyed, "doc_id long, h long, fp long", make), "fingerprints")
    nodes, _ = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, radius, shard_size, crowd))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(names, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "h", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable by links, itself included)."""
    return grouped(docs, **options).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with one document of every component of near_duplicates."""
    return least_of_each(docs, grouped(docs, **options))


def least_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs, all columns, with one document of every component: the one with the least doc_id, then the least text hash.

    groups: doc_id, h (the hash of the text), root (the component).  Ids may repeat: rows of one id with other texts stay or go
    each by its own component.  Of rows of equal id and text one stays.  Documents without an id cannot be named, and stay.

    The rows that go are fewer than those that stay, so only rows near their ids meet the exact join.
    """
    groups, _ = materialise(groups.where("doc_id is not null").groupBy("doc_id", "h", "root").agg(F.count("*").alias("rows")), "groups")
    # as a table of its own, so that the join below is between plain shuffles and Spark can split a large group's rows
    heads, _ = materialise(groups.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("head")), "heads")
    judged = groups.join(heads, "root").withColumn("stays", (F.col("head.doc_id") == F.col("doc_id")) & (F.col("head.h") == F.col("h")))
    acted, _ = materialise(judged.where("not stays or rows > 1").select("doc_id", "h", "stays"), "copies")
    text_hash = unused("text_hash", docs)
    near = near_ids(docs, acted).withColumn(text_hash, F.xxhash64("text"))

    gone, again = acted.where("not stays").alias("__gone"), acted.where("stays").alias("__again")
    kept = near.join(gone, (near["doc_id"] == F.col("__gone.doc_id")) & (near[text_hash] == F.col("__gone.h")), "left_anti")
    out = near_ids(docs, acted, inside=False)
    if again.isEmpty():
        return out.union(kept.drop(text_hash))
    match = (kept["doc_id"] == F.col("__again.doc_id")) & (kept[text_hash] == F.col("__again.h"))
    once = kept.join(again, match, "left_anti").union(kept.join(again, match, "left_semi").dropDuplicates(["doc_id", text_hash]))
    return out.union(once.drop(text_hash))
