"""Removal of repeated passages: every byte covered by a string of `length` bytes that also starts anywhere else.

1. Anchors deal the work out.  Each window of `deal` (256) bytes is named by its minimizer, the leftmost least hash of
   its 64-byte pieces; a run of starts whose windows have the same minimizer is a context: those starts and the 400 bytes
   after each.  Equal strings have equal anchors at equal places, so they are compared only with those of the same anchor.
2. Copies are summed up before and in the shuffle: a context that occurs twice as a whole is repeated as a whole, and only
   one of its copies is sorted, beside the different contexts of its anchor.
3. A task sorts its contexts as suffixes, by a difference-cover blockwise construction.  The positions of a difference
   cover (modulo 64) get lexicographic ranks to a depth of 64, 128, 256 and 384 bytes, each from pairs of those before.
   Then one bucket (a first byte) is sorted at a time: by its first 64 bytes, and longer ties by the ranks of the
   cover positions a few bytes on, so that no comparison walks through a long tie and memory is bounded by the flush
   size.  Neighbours that share 400 bytes are repeated.
4. An anchor with more than `most` different contexts does not fit in one bucket; it is split by more of its bytes
   (what all strings at some 32 offsets from the anchor have in common), and what is still too much, by whole strings.
   A bucket of equal strings has one suffix, so it is counted instead of sorted.
5. Ranges return to all copies of their contexts and are cut out of the texts.

Neighbours that share only 256 bytes give `n_passages`: stretches of over 50 words of which every 256 bytes also stand in
another document.  They are reported, not removed.

Matches never cross documents; overlapping matches count, the same document counts, and strings are judged on the input.
Each row is a document: repeated rows repeat each other.  Null and empty texts, and texts shorter than `length`, keep
all their bytes.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache, cmp_to_key

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, materialise, settle, small_parts

LENGTH, DEAL, PIECE = 400, 256, 64
PASSAGE_WORDS = 50
PERIOD = 64
BASE = 0x9E3779B97F4A7C15
#: Bits of a key that hold the position.
PLACE = 32


@cache
def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64, endpoint=False) | np.uint64(1)


def piece_hashes(data: np.ndarray, size: int, seed: int = 17) -> np.ndarray:
    """A hash of the `size` (a power of two) bytes from every position on."""
    h, power, width = byte_values(seed)[data], BASE, 1
    while width < size:
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power & 0xFFFFFFFFFFFFFFFF, 2 * width
    return h ^ (h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """For every start of `window` pieces, the place of the leftmost least piece."""
    low = np.uint64((1 << PLACE) - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    n = len(keys) - window + 1
    padded = np.concatenate([keys, np.full(-len(keys) % window, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, window)
    front = np.minimum.accumulate(padded, axis=1).reshape(-1)
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(back[:n], front[window - 1 : window - 1 + n]) & low).astype(np.int64)


def contexts(texts: list[bytes], length: int, deal: int) -> tuple[np.ndarray, ...]:
    """Text number, first start (in the text), number of starts, bytes, anchor's offset from the first start, anchor hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    empty = np.zeros(0, np.int64)
    if len(data) < deal:
        return empty, empty, empty, empty, empty, empty
    hashes = piece_hashes(data, PIECE)
    place = minimizers(hashes, deal - PIECE + 1)
    left = np.repeat(ends, sizes)[: len(place)] - np.arange(len(place))
    starts = np.flatnonzero(left >= deal)
    if not len(starts):
        return empty, empty, empty, empty, empty, empty
    at = place[starts]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(at) != 0)]))
    counts = np.diff(np.append(first, len(starts)))
    begin, anchor = starts[first], at[first]
    text = np.searchsorted(ends, begin, side="right")
    return text, begin - (ends - sizes)[text], counts, np.minimum(counts - 1 + length, left[begin]), anchor - begin, hashes[anchor].view(np.int64)


@cache
def difference_cover(period: int) -> tuple[int, ...]:
    """Residues of which every difference modulo period is one: a run of r and every r-th after it."""
    r = int(period**0.5)
    cover = tuple(sorted({*range(r), *range(r - 1, period, r)}))
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("no difference cover")
    return cover


@cache
def meeting(period: int) -> dict[tuple[int, int], int]:
    """How far ahead two residues are in the cover at once."""
    cover = set(difference_cover(period))
    return {(a, b): next(d for d in range(period) if {(a + d) % period, (b + d) % period} <= cover) for a in range(period) for b in range(period)}


def names(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return out


class BlockwiseSuffixes:
    """The starts of contexts in the order of their 400 bytes, one bucket at a time, with cover-sample ranks for long ties."""

    def __init__(self, stretches: list[bytes], offsets: list[int], counts: list[int]):
        """offsets: where each stretch has its anchor; counts: the starts of each, from its beginning on."""
        self.cover = np.array(difference_cover(PERIOD))
        begins, at = [], 0
        for s, o, n in zip(stretches, offsets, counts):
            at += (-(at + o)) % PERIOD  # the anchor's place is a multiple of the period, so equal strings lie alike
            begins.append(at)
            at += max(len(s), n - 1 + LENGTH)  # zeros follow where the text's end cuts a stretch short
        self.text = np.zeros((at + 2 * PERIOD - 1) // PERIOD * PERIOD + 512, np.uint8)
        for b, s in zip(begins, stretches):
            self.text[b : b + len(s)] = np.frombuffer(s, np.uint8)
        self.words = np.ndarray((len(self.text) - 7,), ">u8", self.text.data, strides=(1,))
        counts, sizes = np.array(counts, np.int64), np.array([len(s) for s in stretches], np.int64)
        self.stretch = np.repeat(np.arange(len(counts)), counts)
        inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        self.starts = np.array(begins, np.int64)[self.stretch] + inside
        self.left = sizes[self.stretch] - inside
        residues = np.arange(PERIOD)
        #: By residue: the bytes to the next cover position, and that position's number in the cover.
        self.to_cover = np.array([int(min((c - r) % PERIOD for c in self.cover)) for r in residues])
        self.slot = np.searchsorted(self.cover, residues)
        self._rank()
        self.meets, self.slots, self.rank_of = meeting(PERIOD), self.slot.tolist(), self.ranks[384].item

    def word(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes as a number that orders like them."""
        return self.words[at].astype(np.uint64)

    def heads(self, places: np.ndarray) -> np.ndarray:
        """The rank of each place by its next 64 bytes; of those that are alike in both hashes one is compared with the others."""
        first, second = (h[places] for h in self.hashed)
        order = np.argsort(first)
        first, second = first[order], second[order]
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        group, one = np.cumsum(new) - 1, places[order[new]]
        # by eight bytes at a time, and only those that are still tied by the next eight
        in_order = np.argsort(key := self.word(one))
        fresh = np.concatenate([[True], key[in_order[1:]] != key[in_order[:-1]]])
        for k in range(8, PERIOD, 8):
            tied = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))
            if not len(tied):
                break
            members = in_order[tied]
            key = self.word(one[members] + k)
            turn = np.lexsort((key, np.cumsum(fresh)[tied]))
            in_order[tied], key = members[turn], key[turn]
            fresh[tied] |= np.concatenate([[True], key[1:] != key[:-1]])
        rank, out = np.empty(len(one), np.int64), np.empty(len(places), np.int64)
        rank[in_order] = np.cumsum(fresh)
        out[order] = rank[group]
        return out

    def _rank(self) -> None:
        n = len(self.cover)
        self.hashed = piece_hashes(self.text, PERIOD), piece_hashes(self.text, PERIOD, 18)
        self.ranks = {PERIOD: self.heads((np.arange((len(self.text) - 512) // PERIOD + 1)[:, None] * PERIOD + self.cover).reshape(-1))}

        def after(width: int, by: int) -> np.ndarray:
            rank = self.ranks[width]
            return np.append(rank[by * n :], np.zeros(min(by * n, len(rank)), np.int64))[: len(rank)]

        # positions a period on are in the cover too
        self.ranks[128] = names(self.ranks[64] << 31 | after(64, 1))
        self.ranks[256] = names(self.ranks[128] << 31 | after(128, 2))
        self.ranks[384] = names(self.ranks[256] << 31 | after(128, 4))

    def sample(self, at):
        """The number of a cover position."""
        return at // PERIOD * len(self.cover) + self.slot[at % PERIOD]

    def compare(self, a: int, b: int) -> int:
        """The order of two places whose first 64 bytes are equal, by the ranks where both meet the cover."""
        d = self.meets[a % PERIOD, b % PERIOD]
        p, q, n, slot = a + d, b + d, len(self.cover), self.slots
        x, y = self.rank_of(p // PERIOD * n + slot[p % PERIOD]), self.rank_of(q // PERIOD * n + slot[q % PERIOD])
        if x == y:
            x, y = (self.text[p + d + 384 : p + LENGTH].tobytes() for p in (a, b))
        return (x > y) - (x < y)

    def buckets(self):
        """For each first byte: the starts' numbers in order, and whether each shares 400 and 256 bytes with the one before."""
        first = self.text[self.starts]
        by_bucket = np.argsort(first, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(first, minlength=256))])
        for low, high in zip(edges, edges[1:]):
            if high > low:
                yield self._sort_bucket(by_bucket[low:high])

    def _sort_bucket(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = self.starts[which]
        r = p % PERIOD
        head, sample = self.heads(p), self.sample(p + self.to_cover[r])
        # the rank is that of the 384 bytes from at most 7 bytes on; what is left are the last 16 bytes
        key, tails = head << 31 | self.ranks[384][sample], (self.word(p + 384), self.word(p + 392))
        order = np.argsort(key)

        def alike(keys, a, b):
            return np.logical_and.reduce([k[a] == k[b] for k in keys])

        def groups_with(ties: np.ndarray, odd: np.ndarray):
            """The stretches of ties in order that hold an odd one."""
            group = np.cumsum(np.concatenate([[True], ~ties]))
            for g in np.unique(group[1:][odd]):
                yield slice(*np.searchsorted(group, [g, g + 1]))

        tied = key[order[1:]] == key[order[:-1]]
        if (unlike := tied & ~alike(tails, order[1:], order[:-1])).any():
            for ties in groups_with(tied, unlike):
                some = order[ties]
                order[ties] = some[np.lexsort((tails[1][some], tails[0][some]))]
        tied = head[order[1:]] == head[order[:-1]]
        if (mixed := tied & (r[order[1:]] != r[order[:-1]])).any():  # other residues meet at other places than the next cover position
            for ties in groups_with(tied, mixed):
                some = order[ties]
                at = dict(zip(some.tolist(), p[some].tolist()))
                order[ties] = sorted(at, key=cmp_to_key(lambda a, b: self.compare(at[a], at[b])))
        p, sample, r = p[order], sample[order], r[order]
        lies_alike = tied & (r[1:] == r[:-1])
        same = lies_alike & alike((key, *tails), order[1:], order[:-1])
        n = len(self.cover)
        shared = lies_alike & alike((self.ranks[128], self.ranks[64][2 * n :]), sample[1:], sample[:-1])
        close = np.flatnonzero(shared)
        shared[close] = np.logical_and.reduce([self.words[p[close + 1] + k] == self.words[p[close] + k] for k in range(192, 256, 8)])
        return which[order], np.concatenate([[False], same]), np.concatenate([[False], shared])

    def repeated(self, docs: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start whether its 400 bytes start elsewhere too, and whether its 256 bytes start in another document;
        docs: a document of each stretch, many: whether it stands in several."""
        out, cross = np.zeros(len(self.starts), bool), np.zeros(len(self.starts), bool)
        for order, same, shared in self.buckets():
            whole = self.left[order] >= LENGTH
            run = np.cumsum(~same) - 1
            out[order] = whole & (np.bincount(run, weights=whole)[run] > 1)
            first = np.flatnonzero(~shared)
            own = self.stretch[order]
            several = (np.minimum.reduceat(docs[own], first) != np.maximum.reduceat(docs[own], first)) | np.maximum.reduceat(many[own], first)
            cross[order] = several[np.cumsum(~shared) - 1]
        return out, cross


def ranges_of(flags: np.ndarray, first: int = 0) -> list[int]:
    """first, last, first, last ... of the runs of true flags, from `first` on."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [first + int(x) - (k & 1) for k, x in enumerate(edges)]


CONTEXTS = "anchor long, c1 long, c2 long, d long, h long, a int, n int, m int, off int"
STRETCHES = "anchor long, c1 long, c2 long, k int, n int, off int, doc long, many boolean, stretch binary"
RANGES = "c1 long, c2 long, ranges array<int>, shared array<int>"
NO_ID = -(1 << 63)


def find_contexts(keyed: DataFrame, length: int, deal: int, batch_bytes: int = 2 << 20) -> DataFrame:
    schema = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in (x.split() for x in CONTEXTS.split(", "))])

    def run(batches):
        for batch in small_parts(batches):
            ids, hashes, texts = (c.to_pylist() for c in batch.columns)
            low = 0
            while low < len(texts):
                high, size, part = low, 0, []
                while high < len(texts) and (not part or size < batch_bytes):
                    part.append((texts[high] or "").encode())
                    size += len(part[-1])
                    high += 1
                text, a, n, m, off, anchor = contexts(part, length, deal)
                digest = xxhash.xxh3_128_digest
                c = np.frombuffer(b"".join([digest(part[t][s : s + k]) for t, s, k in zip(text.tolist(), a.tolist(), m.tolist())]), np.int64).reshape(-1, 2)
                d = np.array(ids[low:high], np.int64)[text]
                h = np.array(hashes[low:high], np.int64)[text]
                arrays = [anchor, c[:, 0], c[:, 1], d, h, a, n, m, off]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(arrays, schema)], schema=schema)
                low = high

    return keyed.mapInArrow(run, CONTEXTS)


def repeated_ranges(stretches: DataFrame, flush_bytes: int) -> DataFrame:
    """c1, c2, ranges, shared for stretches sorted by anchor within each partition."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def search():
            _, c1, c2, first, counts, offsets, docs, many, texts = zip(*held)
            flags, cross = BlockwiseSuffixes(texts, offsets, counts).repeated(np.array(docs, np.int64), np.array(many, bool))
            ends = np.cumsum(counts)
            out = [(a, b, ranges_of(flags[e - n : e], k), ranges_of(cross[e - n : e], k)) for a, b, k, n, e in zip(c1, c2, first, counts, ends)]
            columns = list(zip(*(r for r in out if r[2] or r[3]))) or [(), (), (), ()]
            kinds = pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["c1", "c2", "ranges", "shared"])

        for batch in batches:
            for part in small_parts([batch], 256):
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    if size >= flush_bytes and row[0] != held[-1][0]:
                        yield search()
                        held, size = [], 0
                    held.append(row)
                    size += len(row[-1])
        if held:
            yield search()

    return stretches.mapInArrow(run, RANGES)


def removed_ranges(docs: DataFrame, length: int = LENGTH, deal: int = DEAL, most: int = 1024, flush_bytes: int = 4 << 20, part_bytes: int = 24 << 20) -> DataFrame:
    """docs' doc_id and text, with `found` array<struct<a, ranges, shared>>: starts (from a on) whose strings occur elsewhere."""
    if length != LENGTH or deal != DEAL:
        raise ValueError("the cover's levels are laid out for 400 and 256 bytes")
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("h"))
    found, found_path = materialise(find_contexts(keyed.select("d", "h", "text"), length, deal), "contexts")
    anchors = found.groupBy("anchor").agg(F.count("*").alias("times"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("c1", "c2") for f in (F.min, F.max)])
    contested = (F.col("min_c1") != F.col("max_c1")) | (F.col("min_c2") != F.col("max_c2"))
    # as a table of its own, so that the join below is between plain shuffles and Spark can split a hot anchor's rows
    anchors, anchors_path = materialise(anchors.where("times > 1").select("anchor", contested.alias("contested")), "anchors")
    suspects, _ = materialise(found.join(anchors, "anchor"), "suspects")
    settle(spark, found_path, anchors_path)
    doc = F.xxhash64("d", "h")
    sums = suspects.groupBy("c1", "c2").agg(F.count("*").alias("times"), (F.min(doc) != F.max(doc)).alias("many"), *[F.first(c).alias(c) for c in ("d", "h", "a", "anchor", "n", "m", "off", "contested")])
    classes, classes_path = materialise(sums.where("times > 1 or contested"), "classes")
    # of a context that its text's end cuts short, only the first m - length + 1 starts have a whole string
    n_whole = F.least(F.col("n"), F.col("m") - (length - 1))
    none = F.array().cast("array<int>")
    whole = classes.where("times > 1").select("c1", "c2", F.when(n_whole > 0, F.array(F.lit(0), n_whole - 1)).otherwise(none).alias("ranges"), F.when(F.col("many"), F.array(F.lit(0), F.col("n") - 1)).otherwise(none).alias("shared"))

    # the bytes of one copy of each contested context
    place = F.struct("a", "m", "anchor", "c1", "c2", "n", "off", "many", doc.alias("doc")).alias("c")
    per_doc = classes.where("contested").select("d", "h", place).groupBy("d", "h").agg(F.collect_list("c").alias("cs"))

    def cut(texts, lists):
        out = []
        for t, cs in zip(texts, lists):
            data = (t or "").encode()
            out += [(c["anchor"], c["c1"], c["c2"], 0, c["n"], c["off"], c["doc"], c["many"], data[c["a"] : c["a"] + c["m"]]) for c in cs]
        return tuple(map(list, zip(*out))) if out else ([], [], [], [], [], [], [], [], [])

    cuts = map_columns(keyed.select("d", "h", "text").join(per_doc, ["d", "h"]).select("text", "cs"), STRETCHES, lambda: cut)
    cuts, cuts_path = materialise(cuts, "stretches")
    settle(spark)
    ranges, paths = sorted_ranges(cuts, length, deal, most, flush_bytes, part_bytes)
    merged, _ = materialise(ranges.union(whole).groupBy("c1", "c2").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("ranges", "shared")]), "ranges")
    settle(spark, classes_path, cuts_path, *paths)
    back = suspects.select("c1", "c2", "d", "h", "a").join(merged, ["c1", "c2"]).groupBy("d", "h").agg(F.collect_list(F.struct("a", "ranges", "shared")).alias("found"))
    return keyed.join(back, ["d", "h"], "left").select("doc_id", "text", "found")


def sorted_ranges(cuts: DataFrame, length: int, deal: int, most: int, flush_bytes: int, part_bytes: int) -> tuple[DataFrame, list[str]]:
    """c1, c2, ranges, shared of the stretches, bucket by bucket; and tables to remove when these are read."""
    spark, paths = cuts.sparkSession, []

    def in_buckets(rows: DataFrame) -> DataFrame:
        size = rows.agg(F.coalesce(F.sum(F.length("stretch")), F.lit(0))).first()[0]
        parts = max(spark.sparkContext.defaultParallelism, int(size // part_bytes) + 1)
        return repeated_ranges(rows.repartition(parts, "anchor").sortWithinPartitions("anchor"), flush_bytes)

    heavy = cuts.groupBy("anchor").count().where(F.col("count") > most).select("anchor")
    heavy, path = materialise(heavy, "heavy")
    paths.append(path)
    if heavy.isEmpty():
        return in_buckets(cuts), paths
    out = in_buckets(cuts.join(heavy, "anchor", "left_anti"))
    split, path = materialise(by_more_bytes(cuts.join(heavy, "anchor", "left_semi"), length, deal), "split")
    paths.append(path)
    # these are cut shorter, so more of them fit
    sizes, path = materialise(split.groupBy("anchor").count().where("count > 1").select("anchor", (F.col("count") > 16 * most).alias("heavy")), "sizes")
    paths.append(path)
    split = split.join(sizes, "anchor")
    out = out.union(in_buckets(split.where("not heavy").drop("heavy")))
    return out.union(counted(split.where("heavy").drop("heavy"), length, deal)), paths


def by_more_bytes(cuts: DataFrame, length: int, deal: int, width: int = 32) -> DataFrame:
    """Stretches in parts of `width` offsets from the anchor, each dealt by the bytes that all strings at those offsets hold."""

    def split(anchors, c1, c2, first, counts, offsets, docs, many, stretches):
        out = []
        for x, a, b, k, n, off, doc, m, s in zip(anchors, c1, c2, first, counts, offsets, docs, many, stretches):
            for block in range((off - n + 1) // width, off // width + 1):
                low, high = max(0, off - block * width - width + 1), min(n, off - block * width + 1)  # starts at these offsets
                core = s[off - block * width : off - block * width - width + 1 + deal]
                key = xxhash.xxh3_64_intdigest(core, (x + block) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
                out.append((key, a, b, k + low, high - low, off - low, doc, m, s[low : high - 1 + length]))
        return tuple(map(list, zip(*out))) if out else ([], [], [], [], [], [], [], [], [])

    return map_columns(cuts, STRETCHES, lambda: split)


def counted(cuts: DataFrame, length: int, deal: int) -> DataFrame:
    """The same for stretches dealt by whole strings: a bucket holds one string, and is counted in partial sums."""

    def strings(c1, c2, first, counts, docs, many, stretches):
        out, digest = [], xxhash.xxh3_128_digest
        for a, b, k, n, doc, m, s in zip(c1, c2, first, counts, docs, many, stretches):
            for j in range(n):
                for size in (length, deal):
                    if j + size <= len(s):
                        w = digest(s[j : j + size])
                        out.append((size, int.from_bytes(w[:8], "little", signed=True), int.from_bytes(w[8:], "little", signed=True), a, b, k + j, doc, m))
        return tuple(map(list, zip(*out))) if out else ([], [], [], [], [], [], [], [])

    each = map_columns(cuts.select("c1", "c2", "k", "n", "doc", "many", "stretch"), "size int, w1 long, w2 long, c1 long, c2 long, k int, doc long, many boolean", lambda: strings)
    sums = each.groupBy("size", "w1", "w2").agg(F.count("*").alias("times"), (F.max("many") | (F.min("doc") != F.max("doc"))).alias("several"))
    found = sums.where((F.col("size") == length) & (F.col("times") > 1) | (F.col("size") == deal) & F.col("several")).select("size", "w1", "w2")
    twice = F.array("k", "k")
    some = [F.flatten(F.collect_list(F.when(F.col("size") == size, twice))).alias(name) for size, name in ((length, "ranges"), (deal, "shared"))]
    return each.join(found, ["size", "w1", "w2"]).groupBy("c1", "c2").agg(*some)


def covered(found: list[dict], length: int, ranges: str = "ranges") -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, ends exclusive."""
    pairs = sorted((c["a"] + c[ranges][k], c["a"] + c[ranges][k + 1] + length) for c in found for k in range(0, len(c[ranges]), 2))
    out: list[list[int]] = []
    for s, e in pairs:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def digest(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages: one row for each row of docs."""

    def run(ids, texts, lists):
        out = []
        for i, t, found in zip(ids, texts, lists):
            data, runs, at, kept = (t or "").encode(), covered(found or [], length), 0, []
            for s, e in runs:
                kept.append(data[at:s])
                at = e
            kept = b"".join([*kept, data[at:]])
            passages = sum(len(data[s:e].split()) > PASSAGE_WORDS for s, e in covered(found or [], DEAL, "shared"))
            out.append((i, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), passages))
        return tuple(map(list, zip(*out))) if out else ([], [], [], [], [], [])

    return map_columns(removed_ranges(docs, length, **options), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long", lambda: run)
