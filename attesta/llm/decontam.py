"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of lower-cased words; in scripts that write without blanks every letter is a word.  The CGK random
walk reads a sequence and writes two symbols on average for each of its own, staying at or moving past a symbol by a shared
random bit for (step, symbol); a small edit distance becomes a small Hamming distance.  Every walk is sampled a few times
(before the steps where most walks are past the end, and equal for no reason), and each sample of a few output positions is a
hash table of the items of one length: an item-sized window of a document looks its own sample up in each table, and the
items found there are its candidates.  The walks of all windows of a batch, of every length, go step by step side by side.
Walks are added until edited copies of the items, at the distance limit and read through the same windows, are found with the target recall; a target that
cannot be reached raises.  Candidates are verified by the exact word edit distance, with free ends in the document, and
where that is above the limit by the exact edit distance of letters, since a misspelt word is not another word.

Windows are taken wherever a document has a run of words that any text within the word limit must share with an item
(after e edits of an item of m words at least m - q + 1 - q * e of its q-word runs are whole; q is the largest of 3, 2, 1 for which this
is at least one), aligned to that run.  This loses no text within the word limit.  A document is read once; nothing is shuffled.

Only the items are broadcast, in blocks of at most `block_chars` letters, one block at a time; more items mean more passes
over the documents.  Null or empty texts and items without words match nothing.  An item of under five words must occur
exactly, or with at most a fifth of its letters edited.  Of equally near matches the one with the earliest start and end
is reported.  Equal item texts are reported under each id, repeated rows each for themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep_texts, map_columns, materialise

#: Scripts without blanks between words: Thai to Burmese, Khmer, kana and Chinese characters.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
#: For each Latin-1 character its small letter, or a blank if it is in no word.
LATIN = bytes(ord(c.lower()) if WORD.fullmatch(c) else 32 for c in map(chr, range(256)))
#: Steps for each word of the item, samples of each walk, and the symbols in a sample.
STRETCH, TABLES, SAMPLED = 2, 4, 3
MOST_WALKS = 256
#: Symbols of the windows and walks that go side by side; together they bound the memory of a step.
SYMBOLS, ABREAST = 1 << 18, 8
MIX = np.uint64(0x94D049BB133111EB)


def words_of(text: str | None) -> list[str]:
    text = text or ""
    try:  # the same words without the regular expression
        return text.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(text.lower())


def infix_distance(item: list, region: list, limit: int) -> tuple[int, int, int]:
    """Least edits that turn item into a stretch of region, and that stretch; above limit it stops with limit + 1."""
    n = len(region)
    row, starts = [0] * (n + 1), list(range(n + 1))
    for k, w in enumerate(item, 1):
        last, last_starts = row, starts
        row, starts = [k], [0]
        for j in range(1, n + 1):
            best, start = last[j - 1] + (w != region[j - 1]), last_starts[j - 1]
            if last[j] + 1 < best:
                best, start = last[j] + 1, last_starts[j]
            if row[-1] + 1 < best:
                best, start = row[-1] + 1, starts[-1]
            row.append(best)
            starts.append(start)
        if min(row) > limit:
            return limit + 1, 0, 0
    best = min(row)
    at = row.index(best)
    return best, starts[at], at


def infix_letters(item: str, region: str, limit: int, anchored: bool = False) -> tuple[int, int]:
    """Least letter edits that turn item into a stretch of region (anchored: into a beginning), and that stretch's end;
    one bit of a number for each letter of the item."""
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    m = len(item)
    whole, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = whole, 0, m
    best, end = (m, 0) if m <= limit or anchored else (limit + 1, 0)
    for j, c in enumerate(region, 1):
        eq = masks.get(c, 0)
        vertical = eq | down
        eq = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(eq | up) & whole, up & eq
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | anchored) & whole, minus << 1 & whole
        up, down = minus | ~(vertical | plus) & whole, plus & vertical
        if score < best:
            best, end = score, j
    return best, end


def pack(codes: np.ndarray, q: int) -> np.ndarray:
    """A number for each run of q codes; 0 for runs with an unknown word."""
    n = len(codes) - q + 1
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(q):
        part = codes[k : k + n]
        out = mixed(out, part)
        known &= part > 0
    return np.where(known, out | np.uint64(1), np.uint64(0))


def mixed(key: np.ndarray, part: np.ndarray) -> np.ndarray:
    key = (key ^ part.astype(np.uint64)) * MIX
    return key ^ key >> np.uint64(31)


def expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number from low[i] up to high[i], with its i."""
    n = high - low
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[of]


class EditIndex:
    """Items under CGK embeddings; finds their near copies in batches of documents."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = 0.8, recall: float = 0.97, plan_items: int = 128, seed: int = 11):
        self.similarity, self.seed = similarity, seed
        self.items = [(i, w) for i, t in items if (w := words_of(t))]
        self.words: dict[str, int] = {}
        for _, w in self.items:
            for x in w:
                self.words.setdefault(x, len(self.words) + 1)
        self.codes = [np.array([self.words[x] for x in w], np.int64) for _, w in self.items]
        self.edits = [int((1 - similarity) * len(w) + 1e-9) for _, w in self.items]
        self.letters = [" ".join(w) for _, w in self.items]
        self.letter_edits = [int((1 - similarity) * len(t) + 1e-9) for t in self.letters]
        self.sizes = np.array([len(c) for c in self.codes], np.int64)
        self.lengths = np.unique(self.sizes)
        self.steps = STRETCH * int(self.sizes.max(initial=1))
        #: The walk's shared random bit for (walk, step, symbol) is the top bit of a product of these.
        self.symbols = np.random.default_rng(seed).integers(1, 1 << 63, len(self.words) + 1, np.uint64) | np.uint64(1)
        self.walks: list[tuple] = []
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self._seeds()
        self._plan(recall, plan_items)

    def _walk(self) -> None:
        """One more walk: its random bits, sampled positions by length, and its tables, one after another by key."""
        rng = np.random.default_rng([self.seed, len(self.walks)])
        factors = rng.integers(0, 1 << 63, self.steps, np.uint64) << np.uint64(1) | np.uint64(1)
        shifts = rng.integers(0, 1 << 63, self.steps, np.uint64)
        sampled = np.stack([np.sort(rng.integers(0, STRETCH * m, (TABLES, SAMPLED)), axis=1) for m in self.lengths.tolist()])
        self.walks.append((factors, shifts, sampled))
        own, keys = np.argsort(-self.sizes, kind="stable"), []
        for low, high in self.slices(self.sizes[own]):
            m = self.sizes[own[low:high]]
            symbols = np.zeros((high - low, int(m[0]) + 1), np.int64)
            for row, k in zip(symbols, own[low:high].tolist()):
                row[: len(self.codes[k])] = self.codes[k]
            keys.append(self.embed(symbols, m, [len(self.walks) - 1]).ravel())
        found = np.concatenate(keys)
        order = np.argsort(found, kind="stable")
        self.tables.append((found[order], own[order // TABLES]))

    @staticmethod
    def slices(m: np.ndarray) -> Iterator[tuple[int, int]]:
        """Slices of windows, which come by length with the longest first."""
        low = 0
        while low < len(m):
            high = min(len(m), low + max(1, SYMBOLS // max(int(m[low]) + 1, 32)))
            yield low, high
            low = high

    def embed(self, windows: np.ndarray, m: np.ndarray, walks: list[int]) -> np.ndarray:
        """For windows of m symbols and zeros after them, the longest first: a number for each sample, walks by windows by tables."""
        n, width = windows.shape
        factors, shifts, sampled = map(np.stack, zip(*(self.walks[w] for w in walks)))
        codes, symbols = windows.ravel(), self.symbols[windows.ravel()]
        first = np.arange(n) * width
        last, at = first + m, np.tile(first, (len(walks), 1))
        path = np.zeros((STRETCH * int(m[0]), len(walks), n), np.int64 if n * width >> 31 else np.int32)
        for step, going in enumerate(np.searchsorted(-m, -(np.arange(len(path)) // STRETCH)).tolist()):
            here = at[:, :going]
            path[step, :, :going] = here
            moves = ((symbols[here] ^ shifts[:, step, None]) * factors[:, step, None]) >> np.uint64(63)
            np.minimum(here + moves.astype(np.int64), last[:going], out=here)
        steps = sampled[:, np.searchsorted(self.lengths, m)]
        seen = codes[path[steps, np.arange(len(walks))[:, None, None, None], np.arange(n)[:, None, None]]]
        keys = np.broadcast_to(mixed(np.uint64(1), m[:, None] * TABLES + np.arange(TABLES)), seen.shape[:3])
        for k in range(SAMPLED):
            keys = mixed(keys, seen[..., k])
        return keys

    def _seeds(self) -> None:
        """Runs of q words of all items in order, and by run the lengths of its items and its places in them."""
        self.seeds = []
        runs: dict[int, dict[int, set[tuple[int, int]]]] = {}
        for code, e in zip(self.codes, self.edits):
            m = len(code)
            q = next(q for q in (3, 2, 1) if m - q + 1 - q * e >= 1)
            for at, run in enumerate(pack(code, q).tolist()):
                runs.setdefault(q, {}).setdefault(run, set()).add((m, at))
        for q, found in sorted(runs.items()):
            known = sorted(found)
            places = np.array([x for run in known for x in sorted(found[run])], np.int64)
            self.seeds.append((q, np.array(known, np.uint64), np.cumsum([0, *(len(found[run]) for run in known)]), places))

    def _plan(self, recall: float, plan_items: int) -> None:
        """Adds walks until copies edited up to the limit, amid other words, are found with the target recall."""
        if not self.items:
            return
        rng, copies = np.random.default_rng([self.seed, 1 << 20]), []
        chosen = rng.permutation(len(self.items))[:plan_items]
        for k in chosen.tolist():
            copy = list(self.codes[k])
            for _ in range(self.edits[k]):
                at, kind = int(rng.integers(0, max(1, len(copy)))), int(rng.integers(0, 3))  # insert, change, delete
                copy[at : at + (kind > 0)] = [0] * int(kind < 2)
            copies.append(np.array([0, 0, *copy, 0, 0], np.int64))
        ends = np.cumsum([len(c) for c in copies])
        stream, found = np.concatenate(copies), np.zeros(len(copies), bool)
        parts = list(self.parts(stream, ends))
        while found.mean() < recall:
            if len(self.walks) == MOST_WALKS:
                raise ValueError(f"{MOST_WALKS} walks find {found.mean():.3f} of the edited items, not {recall}")
            self._walk()
            for doc, m, _, windows in parts:
                window, item = self.lookup(windows, m, [len(self.walks) - 1])
                mine = chosen[doc[window]]
                found[doc[window[mine == item]]] = True

    def parts(self, stream: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Text number, length, first word and symbols of the windows to look at, the longest first, some at a time."""
        found = self.windows(stream, ends)
        order = np.argsort(-found[1], kind="stable")
        doc, m, start = (x[order] for x in found)
        for low, high in self.slices(m):
            some = doc[low:high], m[low:high], start[low:high]
            yield *some, self.cut(stream, ends, *some)

    def windows(self, stream: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, length and first word (in the stream) of the windows to look at, without repeats."""
        found = []
        for q, known, edges, places in self.seeds:
            if len(stream) < q:
                continue
            runs = pack(stream, q)
            place = np.minimum(np.searchsorted(known, runs), len(known) - 1)
            p = np.flatnonzero(known[place] == runs)
            doc = np.searchsorted(ends, p, side="right")
            p, doc = (x[p + q <= ends[doc]] for x in (p, doc))
            of, at = expand(edges[place[p]], edges[place[p] + 1])
            found.append((doc[of], places[at, 0], p[of] - places[at, 1]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        doc, m, start = map(np.concatenate, zip(*found))
        order = np.lexsort((start, m, doc))
        doc, m, start = doc[order], m[order], start[order]
        new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(m) != 0) | (np.diff(start) != 0)])[: len(doc)]
        return doc[new], m[new], start[new]

    @staticmethod
    def cut(stream, ends, doc, m, start) -> np.ndarray:
        """The symbols of windows, the longest first; 0 outside their text and from the end of the window on."""
        first, k = np.concatenate([[0], ends])[doc], np.arange(int(m[0]) + 1)
        at = start[:, None] + k
        return np.where((at >= first[:, None]) & (at < ends[doc][:, None]) & (k < m[:, None]), stream[np.clip(at, 0, len(stream) - 1)], 0)

    def lookup(self, windows: np.ndarray, m: np.ndarray, walks: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Window number and item number of the candidates, without repeats."""
        found = [np.zeros(0, np.int64)]
        for low in range(0, len(walks), ABREAST):
            some = walks[low : low + ABREAST]
            for walk, keys in zip(some, self.embed(windows, m, some)):
                known, items = self.tables[walk]
                place = np.searchsorted(known, keys)
                window, table = np.nonzero(known[np.minimum(place, len(known) - 1)] == keys)
                of, at = expand(place[window, table], np.searchsorted(known, keys[window, table], side="right"))
                found.append(window[of] * len(self.items) + items[at])
        both = np.unique(np.concatenate(found))
        window, item = both // len(self.items), both % len(self.items)
        same = self.sizes[item] == m[window]
        return window[same], item[same]

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, str, int, float, int, int]]:
        """(text number, item number, unit, edits, similarity, first word, word after the last): the best match for each text and item."""
        docs = [words_of(t) for t in texts]
        ends = np.cumsum([len(d) for d in docs])
        if not self.items or not len(ends) or not ends[-1]:
            return
        stream = np.fromiter(map(self.words.get, chain.from_iterable(docs), repeat(0)), np.int64, int(ends[-1]))
        best: dict[tuple[int, int], tuple] = {}
        for of, m, starts, windows in self.parts(stream, ends):
            for i, k in zip(*(x.tolist() for x in self.lookup(windows, m, list(range(len(self.walks)))))):
                doc = int(of[i])
                if (found := self.verify(k, windows[i, : m[i]], docs[doc], stream[ends[doc] - len(docs[doc]) : ends[doc]], int(starts[i] - ends[doc]) + len(docs[doc]))) and found < best.get((doc, k), (2.0,)):
                    best[doc, k] = found
        for (doc, k), (distance, s, t, unit, edits) in sorted(best.items()):
            yield doc, k, unit, edits, 1 - distance, s, t

    def verify(self, k: int, window: np.ndarray, words: list[str], codes: np.ndarray, start: int) -> tuple[float, int, int, str, int] | None:
        """Distance, stretch, unit and edits of item k near a window, or None above both limits."""
        m, e = len(self.codes[k]), self.edits[k]
        if start >= 0 and (window == self.codes[k]).all():
            return 0.0, start, start + m, "word", 0
        low, high = max(0, start - e), min(len(words), start + m + e)
        cost, s, t = infix_distance(self.codes[k].tolist(), codes[low:high].tolist(), e)
        if cost <= e:
            return cost / m, low + s, low + t, "word", cost
        region, limit = " ".join(words[low:high]), self.letter_edits[k]
        cost, end = infix_letters(self.letters[k], region, limit)
        if cost > limit:
            return None
        _, size = infix_letters(self.letters[k][::-1], region[:end][::-1], limit, anchored=True)
        return cost / len(self.letters[k]), low + region.count(" ", 0, end - size), low + region.count(" ", 0, end) + 1, "letter", cost


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items' ids and texts, in blocks that are small enough to broadcast, one at a time."""
    block, size = [], 0
    for r in items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        if block and size + len(r[1]) > block_chars:
            yield in_order(block)
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    yield in_order(block)


def in_order(block: list[tuple[int, str]]) -> list[tuple[int, str]]:
    return sorted(block, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def parts_of(texts: list, most: int):
    """Slices of texts with about `most` letters each."""
    low = 0
    while low < len(texts):
        high, n = low, 0
        while high < len(texts) and (high == low or n < most):
            n += len(texts[high] or "")
            high += 1
        yield low, high
        low = high


SCHEMA = "doc_id long, item_id long, unit string, edits int, similarity double, start_word int, end_word int"


def leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8, recall: float = 0.97, block_chars: int = 4_000_000, part_chars: int = 2_400_000) -> DataFrame:
    """doc_id, item_id, unit, edits, similarity, start_word, end_word: each document's best match with each item within a limit.

    Where the items are more than one block, each block's matches are written before the next block is sent out.
    """

    def scan(index):
        def make():
            forget()
            own = index.value

            def run(keys, texts):
                out = []
                for low, high in parts_of(texts, part_chars):
                    out += [(keys[low + d], own.items[k][0], *found) for d, k, *found in own.search(texts[low:high])]
                return tuple(map(list, zip(*out))) if out else ([], [], [], [], [], [], [])

            return run

        return map_columns(docs.select("doc_id", "text"), SCHEMA, make)

    done, waiting = [], None
    for block in item_blocks(items, block_chars):
        if waiting:
            done.append(materialise(scan(waiting), "leaks")[0])
            waiting.destroy()
        waiting = docs.sparkSession.sparkContext.broadcast(EditIndex(block, similarity, recall))
    out = scan(waiting)
    for part in done:
        out = out.union(part)
    return out


def clean(docs: DataFrame, items: DataFrame, similarity: float = 0.8, recall: float = 0.97, block_chars: int = 4_000_000, part_chars: int = 2_400_000) -> DataFrame:
    """The documents without a match, with all their columns."""

    def without(docs, index):
        def make():
            forget()

            def run(texts):
                keep = [True] * len(texts)
                for low, high in parts_of(texts, part_chars):
                    for d, *_ in index.value.search(texts[low:high]):
                        keep[low + d] = False
                return keep

            return run

        return keep_texts(docs, make)

    waiting = None
    for block in item_blocks(items, block_chars):
        if waiting:
            docs, _ = materialise(without(docs, waiting), "clean")
            waiting.destroy()
        waiting = docs.sparkSession.sparkContext.broadcast(EditIndex(block, similarity, recall))
    return without(docs, waiting)
