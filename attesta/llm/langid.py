"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives the longest match from any point of a text; the text's letters (its
words, lower-cased, with a blank between, in UTF-8) are parsed from left to right into such longest matches, across words; a
byte that the language does not have is a phrase of its own.  The number of phrases a language needs, times the bits of
a pointer into its training text and divided by the bytes parsed, estimates the cross entropy; the language with the
least wins.  A stream is parsed in blocks of 2,048 bytes, so that long texts and many texts are parsed side by side; a
phrase ends where its block ends.

Learning takes a hash sample of labelled rows that no evaluation holds out: about `sample_docs` documents a language, of
which whole texts are kept, in order of their hash, while they fit in `train_bytes`.  Beyond `total_bytes` over all languages
each language gets less, and one whose sampled texts are all longer than its part learns from the beginning of one.  These
bounds are parameters and do not grow; every language that has a label is learned.

Null texts and texts without any letter get `und` and score 0.  Ties go to the language first in the alphabet.  With
no labelled rows every text gets `und`.  Repeated rows are scored alike; other columns are never read.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_below, held_out, map_columns, materialise, remove, worker_state

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
BLOCK = 2048
#: Lanes (blocks times languages) that are parsed at once.
LANES = 1 << 16


def letters(text: str | None) -> bytes:
    return " ".join(WORD.findall(text.lower())).encode() if text else b""


class SuffixAutomaton:
    """Recognises every substring of a text; one flat table holds where each byte leads from each state, or -1."""

    def __init__(self, text: bytes):
        present = sorted(set(text))
        self.width = width = len(present) + 1
        #: The column of each byte; the last one is of all bytes that the text does not have.
        self.codes = np.full(256, width - 1, np.int64)
        self.codes[present] = np.arange(width - 1)
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in map({b: k for k, b in enumerate(present)}.__getitem__, text):
            here = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = here
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[here] = q
                else:
                    copy = len(nexts)
                    nexts.append(nexts[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = copy
                        p = link[p]
                    link[q] = link[here] = copy
            last = here
        self.table = np.full(len(nexts) * width, -1, np.int32)
        places = [s * width + c for s, to in enumerate(nexts) for c in to]
        self.table[places] = [t * width for to in nexts for t in to.values()]

    def longest(self, text: bytes, at: int = 0) -> int:
        """Length of the longest prefix of text[at:] that occurs in the automaton's text."""
        state, end = 0, at
        while end < len(text) and (to := int(self.table[state + self.codes[text[end]]])) >= 0:
            state, end = to, end + 1
        return end - at


class CrossParser:
    def __init__(self, texts: tuple[tuple[str, bytes], ...]):
        automata = [SuffixAutomaton(t) for _, t in texts]
        self.langs = [k for k, _ in texts]
        self.bits = np.array([math.log2(len(t) + 2) for _, t in texts])
        if not texts:
            return
        self.roots = np.cumsum([0, *(len(a.table) for a in automata[:-1])])[:, None]
        self.table = np.concatenate([np.where(a.table < 0, -1, a.table + r) for a, r in zip(automata, self.roots)])
        self.codes = np.stack([a.codes for a in automata])
        #: Where each byte leads from the root of each language.
        self.first = self.table[self.roots + self.codes]

    def phrases(self, streams: list[bytes]) -> np.ndarray:
        """The number of phrases of each stream (rows) in each language (columns)."""
        data = np.frombuffer(b"".join(streams), np.uint8)
        sizes = np.fromiter(map(len, streams), np.int64, len(streams))
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(streams)), blocks)
        inside = (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + inside
        lengths = np.minimum(BLOCK, sizes[owner] - inside)
        out = np.zeros((len(streams), len(self.langs)), np.int64)
        order = np.argsort(-lengths, kind="stable")
        at_once = max(1, LANES // len(self.langs))
        for low in range(0, len(order), at_once):
            some = order[low : low + at_once]
            np.add.at(out, owner[some], self._lanes(data, starts[some], lengths[some]).T)
        return out

    def _lanes(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases by language and block; the longest blocks come first."""
        state = np.repeat(self.roots, len(starts), axis=1)
        n = np.zeros(state.shape, np.int32)
        left = len(starts) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0])), side="right")
        for step, k in enumerate(left.tolist()):
            byte = data[starts[:k] + step]
            own = state[:, :k]
            to = self.table[own + self.codes[:, byte]]
            ends = to < 0
            n[:, :k] += ends & (own != self.roots)  # the phrase ends before this byte
            to = np.where(ends, self.first[:, byte], to)
            strange = to < 0
            n[:, :k] += strange
            state[:, :k] = np.where(strange, self.roots, to)
        return n + (state != self.roots)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text the language and a score: its share of the softmax of negative entropies."""
        out = [(UNDETERMINED, 0.0)] * len(texts)
        streams = [letters(t) for t in texts]
        some = [k for k, s in enumerate(streams) if s]
        if not some or not self.langs:
            return out
        entropy = self.phrases([streams[k] for k in some]) * self.bits / np.array([[len(streams[k])] for k in some])
        best = entropy.min(axis=1, keepdims=True)
        score = 1 / np.exp2(3 * (best - entropy)).sum(axis=1)
        for k, lang, s in zip(some, entropy.argmin(axis=1).tolist(), score.tolist()):
            out[k] = self.langs[lang], s
        return out


def parser(texts: tuple[tuple[str, bytes], ...]) -> CrossParser:
    return worker_state("langid", texts, CrossParser)


def learn(docs: DataFrame, may_learn: Column, sample_docs: int = 120, train_bytes: int = 60_000, total_bytes: int = 480_000) -> tuple[tuple[str, bytes], ...]:
    """(language, training text) pairs, small enough to broadcast: about total_bytes at most."""
    spark = docs.sparkSession
    rows = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts, counts_path = materialise(rows.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    known = counts.count()
    if not known:
        return ()
    most = max(1, min(train_bytes, total_bytes // known))
    # one row for each language is broadcast
    drawn = rows.join(F.broadcast(counts), "lang").where(hashed_below(F.least(F.lit(1.0), sample_docs / F.col("n")), F.col("doc_id"), F.lit("langid")))
    sample, sample_path = materialise(drawn.select("lang", "text", F.xxhash64("doc_id", "text").alias("h")), "lang-sample")
    chosen, sizes = [], {}
    for lang, h, size in sorted(map(tuple, sample.select("lang", "h", F.octet_length("text")).distinct().collect())):
        if sizes.get(lang, 0) + size <= most:
            sizes[lang] = sizes.get(lang, 0) + size
            chosen.append((lang, h))
    texts: dict[str, list] = {}
    if chosen:
        wanted = spark.createDataFrame(chosen, "lang string, h long")
        for r in sorted(sample.join(F.broadcast(wanted), ["lang", "h"], "left_semi").select("lang", "h", "text").distinct().collect()):
            texts.setdefault(r[0], []).append(letters(r[2]))
    # a language whose sampled texts are all too long gets the beginning of one
    for r in sample.where(~F.col("lang").isin(list(sizes))).groupBy("lang").agg(F.min(F.substring("text", 1, most))).collect():
        texts[r[0]] = [letters(r[1])]
    remove(spark, counts_path, sample_path)
    return tuple((k, b" ".join(s for s in texts[k] if s)) for k in sorted(texts) if any(texts[k]))


def identify(docs: DataFrame, texts: tuple[tuple[str, bytes], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score."""
    rows = docs.select(id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(texts)

    def make():
        p = parser(shared.value)

        def run(keys, values):
            found = p.predict(values)
            return keys, [f[0] for f in found], [f[1] for f in found]

        return run

    return map_columns(rows, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, lang_pred string, score double", make)


def identify_held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from the rows that are not held out, predicts for all."""
    out = identify(docs, learn(docs, ~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
