"""Removal of lines that many documents share, by two Bloom filters.

1. Every task sets the hash bits of each document's distinct line keys in a once-seen filter, and in a twice-seen filter
   those whose bits were set before.  Filters merge segment by segment: bits set in both once-seen filters move to
   the twice-seen one, so a key of two documents is never missed.
2. Only keys that the twice-seen filter suspects are counted (summed within each task before the shuffle, by the key
   itself, not by a hash) together with their first document and line.
3. Keys of at least `min_docs` documents lose their lines.  If those keys are small they are broadcast; beyond
   `broadcast_bytes` the suspects' line numbers are joined by key, which Spark can split where a key is hot.

The filters have a fixed largest size (`most_bits`), which bounds what a task holds and what is broadcast.  Where the
documents need more, keys are dealt into parts by their hash and each part has filters, and a pass over the documents,
of its own: the share of keys that are suspected for no reason stays what it is for small inputs.

A key is the line without white space at both ends and with A-Z lower-cased.  Each row is a document: repeated rows
count as documents of their own.  Null and empty texts are one empty line; empty keys never count.  Other columns are
ignored by the decisions and kept by `drop_lines`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_columns, map_text, materialise, unused

SEGMENT_BITS = 1 << 16
MIX = np.uint64(0x94D049BB133111EB)
PROBES = 2


def keys_of(text: str | None) -> list[bytes]:
    return [line.strip().lower() for line in (text or "").encode().split(b"\n")]


def distinct_keys(text: str | None, least: int) -> set[bytes]:
    keys = set(keys_of(text))
    keys.discard(b"")
    return keys if least <= 1 else {k for k in keys if len(k.decode()) >= least}


class SeenFilters:
    """A once-seen and a twice-seen Bloom filter over the same bits."""

    def __init__(self, bits: int):
        self.mask = np.uint64(bits - 1)
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def probes(self, hashes: np.ndarray) -> list[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return [((hashes + np.uint64(k) * step) & self.mask).astype(np.int64) for k in range(PROBES)]

    @staticmethod
    def put(bitmap: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))

    @staticmethod
    def holds(bitmap: np.ndarray, probes: list[np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(bitmap[at >> 3] >> (at & 7)) & 1 == 1 for at in probes])

    def add(self, hashes: np.ndarray) -> None:
        """hashes: one for each document and distinct key."""
        fresh, counts = np.unique(hashes, return_counts=True)
        probes = self.probes(fresh)
        again = (counts > 1) | self.holds(self.once, probes)
        for at in probes:
            self.put(self.twice, at[again])
            self.put(self.once, at)

    def segments(self) -> Iterator[tuple[int, bytes, bytes]]:
        size = SEGMENT_BITS // 8
        for k in np.flatnonzero(self.once.reshape(-1, size).any(axis=1)):
            s = slice(k * size, (k + 1) * size)
            yield int(k), zlib.compress(self.once[s].tobytes(), 1), zlib.compress(self.twice[s].tobytes(), 1)


def hash_keys(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def in_part(hashes: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Which keys are the part's: by other bits than the filters use."""
    return (hashes * MIX >> np.uint64(40)) % np.uint64(parts) == part


def twice_seen(docs: DataFrame, bits: int, least: int, part: int = 0, parts: int = 1) -> np.ndarray:
    """The merged twice-seen filter of a part's keys of all documents; its size is fixed by bits."""

    def own_hashes(keys: list[bytes]) -> np.ndarray:
        hashes = hash_keys(keys)
        return hashes[in_part(hashes, part, parts)]

    def build(batches):
        forget()
        filters = SeenFilters(bits)
        for batch in batches:
            keys: list[bytes] = []
            for t in batch.column(0):
                keys += distinct_keys(t.as_py(), least)
                if len(keys) > 200_000:
                    filters.add(own_hashes(keys))
                    keys = []
            filters.add(own_hashes(keys))
        part: list[tuple[int, bytes, bytes]] = []
        for row in filters.segments():
            part.append(row)
            if len(part) == 256:
                yield pa.RecordBatch.from_pydict(dict(zip(("segment", "once", "twice"), map(list, zip(*part)))), schema=SEGMENTS)
                part = []
        if part:
            yield pa.RecordBatch.from_pydict(dict(zip(("segment", "once", "twice"), map(list, zip(*part)))), schema=SEGMENTS)

    def merge(batches):
        merged: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, o, t in zip(*(c.to_pylist() for c in batch.columns)):
                o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
                once, twice = merged.setdefault(k, (np.zeros_like(o), np.zeros_like(t)))
                twice |= t | (once & o)
                once |= o
        if merged:
            yield pa.RecordBatch.from_pydict({"segment": list(merged), "twice": [zlib.compress(t.tobytes(), 1) for _, t in merged.values()]}, schema=MERGED)

    parts = docs.select("text").mapInArrow(build, "segment int, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    size = SEGMENT_BITS // 8
    for k, t in parts.repartition("segment").mapInArrow(merge, "segment int, twice binary").toLocalIterator():
        out[k * size : (k + 1) * size] = np.frombuffer(zlib.decompress(t), np.uint8)
    return out


SEGMENTS = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
MERGED = pa.schema([("segment", pa.int32()), ("twice", pa.binary())])


def shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, most_bits: int = 1 << 28, bits: int | None = None, doc_bits: int = 64) -> DataFrame:
    """key binary, n_docs, first_doc, first_line: keys of at least min_docs documents (2 at least)."""
    wanted = doc_bits * docs.count()
    parts = max(1, -(-wanted // most_bits))
    if bits is None:
        bits = min(most_bits, max(1 << 20, 1 << wanted.bit_length()))
    return reduce(DataFrame.union, (shared_in_part(docs, min_docs, min_chars, bits, part, parts) for part in range(parts)))


def shared_in_part(docs: DataFrame, min_docs: int, min_chars: int, bits: int, part: int, parts: int) -> DataFrame:
    """The same for one part of the keys; with several parts the result is written, so that one filter is out at a time."""
    suspected = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, bits, min_chars, part, parts))

    def count(batches):
        filters = SeenFilters(8)
        filters.mask = np.uint64(bits - 1)
        seen: dict[bytes, tuple[int, int, int]] = {}

        def flush():
            keys = list(seen)
            n, doc, line = map(list, zip(*seen.values())) if seen else ([], [], [])
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(doc, pa.int64()), pa.array(line, pa.int32())], schema=COUNTS)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = keys_of(text)
                at: dict[bytes, int] = {}
                for k, key in enumerate(keys):
                    at.setdefault(key, k)
                at.pop(b"", None)
                own = list(at) if min_chars <= 1 else [k for k in at if len(k.decode()) >= min_chars]
                if not own:
                    continue
                first = doc if doc is not None else 1 << 62
                hashes = hash_keys(own)
                hits = SeenFilters.holds(suspected.value, filters.probes(hashes)) & in_part(hashes, part, parts)
                for i in np.flatnonzero(hits):
                    key = own[i]
                    n, d, line = seen.get(key, (0, 1 << 62, 0))
                    seen[key] = (n + 1, *min((d, line), (first, at[key])))
                if len(seen) > 100_000:
                    yield flush()
        yield flush()

    rows = docs.select("doc_id", "text").mapInArrow(count, "key binary, n long, doc long, line int")
    sums = rows.groupBy("key").agg(F.sum("n").alias("n_docs"), F.min(F.struct("doc", "line")).alias("first"))
    out = sums.where(F.col("n_docs") >= max(2, min_docs)).select("key", "n_docs", F.col("first.doc").alias("first_doc"), F.col("first.line").alias("first_line"))
    if parts == 1:
        return out
    out, _ = materialise(out, "shared-part")
    suspected.destroy()
    return out


COUNTS = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("doc", pa.int64()), ("line", pa.int32())])


def line_numbers(docs: DataFrame, shared: DataFrame, keep_first: bool, dropped: str) -> DataFrame:
    """The rows of docs with another column, an array of line numbers, joined by key: the way for sets of keys of any size."""
    text_hash = unused("text_hash", docs)
    docs = docs.withColumn(text_hash, F.xxhash64("text"))

    def lines(keys, hashes, texts):
        out = [(d, h, n, k) for d, h, t in zip(keys, hashes, texts) for n, k in enumerate(keys_of(t)) if k]
        return tuple(map(list, zip(*out))) if out else ([], [], [], [])

    each = map_columns(docs.select("doc_id", text_hash, "text"), "doc_id long, h long, n int, key binary", lambda: lines)
    hit = each.join(shared, "key")
    if keep_first:
        hit = hit.where(~((F.col("doc_id") == F.col("first_doc")) & (F.col("n") == F.col("first_line"))))
    found = hit.groupBy("doc_id", "h").agg(F.collect_set("n").alias("numbers"))
    match = docs["doc_id"].eqNullSafe(F.col("__found.doc_id")) & (docs[text_hash] == F.col("__found.h"))
    return docs.join(found.alias("__found"), match, "left").select(*[docs[c] for c in docs.columns if c != text_hash], F.col("__found.numbers").alias(dropped))


def kept_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, broadcast_bytes: int = 16 << 20, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without the lines of shared keys), one row for each row of docs.

    keep_first: the first occurrence (least doc_id, then least line) of each shared key stays.
    """
    shared, _ = materialise(shared_lines(docs, min_docs, min_chars, **options), "shared-lines")
    size = shared.agg(F.coalesce(F.sum(F.length("key") + 100), F.lit(0))).first()[0]
    schema = "doc_id long, n_lines long, n_dropped long, kept string"
    if size > broadcast_bytes:

        def by_number(keys, texts, dropped):
            out = []
            for k, t, d in zip(keys, texts, dropped):
                lines, gone = (t or "").split("\n"), set(d or ())
                out.append((k, len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
            return tuple(map(list, zip(*out))) if out else ([], [], [], [])

        return map_columns(line_numbers(docs.select("doc_id", "text"), shared, keep_first, "dropped").select("doc_id", "text", "dropped"), schema, lambda: by_number)
    first = {bytes(r[0]): (r[1], r[2]) for r in shared.select("key", "first_doc", "first_line").collect()}
    known = docs.sparkSession.sparkContext.broadcast(first)

    def make():
        first = known.value

        def by_key(keys, texts):
            out = []
            for doc, t in zip(keys, texts):
                t = t or ""
                lines = t.split("\n")
                own = keys_of(t)
                gone = [i for i, k in enumerate(own) if k in first and not (keep_first and first[k] == (doc, i))]
                if gone:
                    dropped = set(gone)
                    t = "\n".join(x for i, x in enumerate(lines) if i not in dropped)
                out.append((doc, len(lines), len(gone), t))
            return tuple(map(list, zip(*out))) if out else ([], [], [], [])

        return by_key

    return map_columns(docs.select("doc_id", "text"), schema, make)


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, broadcast_bytes: int = 16 << 20, **options) -> DataFrame:
    """docs, all columns and rows, without the lines of shared keys (n_chars follows the text)."""
    shared, _ = materialise(shared_lines(docs, min_docs, min_chars, **options), "shared-lines")
    size = shared.agg(F.coalesce(F.sum(F.length("key") + 100), F.lit(0))).first()[0]

    def without(text: str | None, gone: set[int]) -> str | None:
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text

    if size > broadcast_bytes or keep_first:
        name = unused("dropped_lines", docs)
        numbered = line_numbers(docs, shared, keep_first, name)
        return map_text(numbered, lambda: lambda texts, dropped: [without(t, set(d or ())) for t, d in zip(texts, dropped)], name).drop(name)
    known = docs.sparkSession.sparkContext.broadcast({bytes(r[0]) for r in shared.select("key").collect()})

    def make():
        keys = known.value
        return lambda texts: [without(t, {i for i, k in enumerate(keys_of(t)) if k in keys}) for t in texts]

    return map_text(docs, make)


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return kept_lines(docs, **options).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


