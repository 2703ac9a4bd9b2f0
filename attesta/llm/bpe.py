"""BPE encoding and decoding by forced-boundary splitting.

A merge can only ever join two symbols whose touching bytes stand side by side inside some vocabulary token.  Byte
pairs that occur inside no token are therefore certain cuts: a word is split there, the fragments are encoded
independently (and remembered), and their ids are concatenated.  The result equals encoding the word whole.

Null and empty texts have no ids and decode to the empty string.  Texts of any length are encoded whole; repeated
words and fragments cost one lookup.  Other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata

import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import map_columns, worker_state

END = "</w>"
REMEMBERED = 250_000
#: Above every rank.
NONE = 1 << 40
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE = regex.compile(r"\s+")
#: Texts that need more than lower(): a final sigma is written as any sigma here.
SIGMA = str.maketrans({"Σ": "σ"})


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    shown = set(printable)
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Memo(dict):
    """A dict that computes what is missing, in bounded memory: when it is full it becomes the older generation, from
    which keys that are asked for again come back."""

    def __init__(self, make, most: int = 250_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class ForcedBoundaryBPE:
    """Encodes and decodes with a word-end BPE vocabulary in the JSON form of the public tokenizers library."""

    def __init__(self, raw: bytes, remembered: int = REMEMBERED):
        """remembered: words in a generation of the memory."""
        spec = json.loads(raw)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: Both ids in one number -> rank and the new id in one number.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a] << 16 | self.vocab[b]] = rank << 16 | self.vocab[a + b]
        if len(self.vocab) > 1 << 16:
            raise ValueError("vocabularies of up to 65,536 tokens are supported")
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.letters = byte_letters()
        self.values = {c: b for b, c in enumerate(self.letters)}
        self.raw, self.library = raw, None
        self.inside = {p for t in self.vocab for u in [t.removesuffix(END)] for p in zip(u, u[1:])}
        self.cut_specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fragments = Memo(self._fragment, most=remembered * 2 // 5)
        self.chunks = Memo(self._chunk, most=remembered)
        self.pieces = Memo(self._piece, most=remembered, longest=1024)

    def _merge(self, ids: list[int]) -> list[int]:
        """Lowest rank first, leftmost first."""
        if len(ids) > 64:
            return self._merge_long(ids)
        get = self.merges.get
        todo = [get(a << 16 | b, NONE) for a, b in zip(ids, ids[1:])]
        while todo and (best := min(todo)) != NONE:
            i, new = todo.index(best), best & 0xFFFF
            ids[i : i + 2] = [new]
            del todo[i]
            if i:
                todo[i - 1] = get(ids[i - 1] << 16 | new, NONE)
            if i < len(todo):
                todo[i] = get(new << 16 | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list: n log n for fragments of any length."""
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        get = self.merges.get
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << 16 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j, new = right[i], m & 0xFFFF
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = new, False
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (m := get(new << 16 | ids[k])) is not None:
                    heapq.heappush(heap, (m, i, new, ids[k]))
            if (h := left[i]) >= 0 and (m := get(ids[h] << 16 | new)) is not None:
                heapq.heappush(heap, (m, h, ids[h], new))
        return [x for x, on in zip(ids, alive) if on]

    def _fragment(self, fragment: str) -> list[int]:
        """fragment: byte letters, with a blank at the end where the word ends."""
        vocab = self.vocab
        if fragment[-1] == " ":
            return self._merge([*map(vocab.__getitem__, fragment[:-2]), vocab[fragment[-2] + END]])
        return self._merge([*map(vocab.__getitem__, fragment)])

    def split(self, word: str) -> list[str]:
        """The word's byte letters, cut where no token has the two bytes side by side."""
        s, letters, inside = 0, self.as_letters(word), self.inside
        out = []
        for e, pair in enumerate(zip(letters, letters[1:]), 1):
            if pair not in inside:
                out.append(letters[s:e])
                s = e
        return [*out, letters[s:] + " "]

    def as_letters(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))

    def words(self, chunk: str) -> list[str]:
        if chunk.isascii() or not any(unicodedata.category(c) == "Cn" for c in chunk):
            return WORDS.findall(chunk)
        if self.library is None:  # only the library knows letters newer than this Python's tables
            self.library = Tokenizer.from_str(self.raw.decode())
        spans = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(map(self.values.__getitem__, letters)).decode() for letters, _ in spans]

    def _chunk(self, chunk: str) -> bytes:
        ids = [i for word in self.words(chunk) for part in self.split(word) for i in self.fragments[part]]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, ids: bytes) -> str:
        return " ".join(self.tokens[i] for i in struct.unpack(f"<{len(ids) // 4}I", ids))

    def encode_parts(self, text: str) -> list[bytes]:
        """Little-endian 32-bit ids of each run between white space, in order."""
        parts: list[bytes] = []
        for piece in self.cut_specials.split(text) if self.cut_specials and "<|" in text else (text,):
            if piece in self.special:
                parts.append(struct.pack("<I", self.special[piece]))
                continue
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece)
                if "Σ" in piece:
                    piece = piece.translate(SIGMA)
            piece = piece.lower()
            chunks = filter(None, SPACE.split(piece)) if any(c in piece for c in NOT_SPACE) else piece.split()
            parts += map(self.chunks.__getitem__, chunks)
        return parts

    def encode(self, text: str | None) -> list[int]:
        ids = b"".join(self.encode_parts(text or ""))
        return list(struct.unpack(f"<{len(ids) // 4}I", ids))

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder, so tokens are joined by a blank; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def decode_parts(self, parts: list[bytes]) -> str:
        return " ".join(map(self.pieces.__getitem__, parts))


#: str.split() also splits at these controls, which the vocabulary's pattern keeps.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


def tokenizer(raw: bytes, remembered: int = REMEMBERED) -> ForcedBoundaryBPE:
    """One per worker process; its memory of words lasts from task to task."""
    return worker_state(f"bpe {remembered}", raw, lambda raw: ForcedBoundaryBPE(raw, remembered))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>.  path: the vocabulary file, read on the driver and broadcast (about 2 MB, whatever the input)."""
    raw = df.sparkSession.sparkContext.broadcast(open(path, "rb").read())

    def make():
        bpe = tokenizer(raw.value)
        return lambda keys, texts: (keys, [bpe.encode(t) for t in texts])

    rows = df.select(id_col, text_col)
    return map_columns(rows, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, ids array<int>", make)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text string; null ids decode to the empty string."""
    raw = df.sparkSession.sparkContext.broadcast(open(path, "rb").read())

    def make():
        bpe = tokenizer(raw.value)
        return lambda keys, ids: (keys, [bpe.decode(i or []) for i in ids])

    rows = df.select(id_col, ids_col)
    return map_columns(rows, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, text string", make)


def digest(df: DataFrame, path: str, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, without moving the ids.

    remembered: words in memory, about 400 bytes each in two generations; fewer take less memory and more time.
    """
    raw = df.sparkSession.sparkContext.broadcast(open(path, "rb").read())

    def make():
        bpe = tokenizer(raw.value, remembered)

        def run(keys, texts):
            n, ids, decoded = [], [], []
            for t in texts:
                parts = bpe.encode_parts(t) if t else []
                joined = b"".join(parts)
                n.append(len(joined) // 4)
                ids.append(hashlib.sha256(joined).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode_parts(parts).encode()).hexdigest())
            return keys, n, ids, decoded

        return run

    return map_columns(df.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
