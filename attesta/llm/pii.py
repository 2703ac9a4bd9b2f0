"""Personal data by weak supervision.

Labelers vote on candidate spans (yes, no, or nothing): the form of the span itself (regex and checksums), gazetteers
(name parts, domain endings, key prefixes) and the words before it (context for and against).  Expectation
maximisation over the votes of all candidates of the corpus estimates each labeler's reliability for each kind and each
candidate's probability; a logistic span classifier is then trained on those probabilities and decides the additional spans.  Votes and features
are discrete, so the corpus is summed up exactly by counting their combinations: a bounded number of rows, gathered
by partial sums, from every document.

The base kinds (email, ip, card, phone) are exact rules and always stay.  The classifier adds spans of other kinds
(iban, local phone, mac, person, secret, ssn) that overlap no base span; they are listed after the base ones, by kind in
alphabetical order.  Offsets are code points, the end exclusive.

Every two capitalised words are a person candidate.  Where two share a word, the more probable one is reported.

Null and empty texts have no spans.  Texts are read whole in time linear in their length.  Repeated rows give equal
results and count as often as they occur; other columns are ignored.  No candidates, or no candidates but base ones,
leave the classifier at its prior, which adds nothing.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "local", "mac", "person", "secret", "ssn")
THRESHOLD = 0.7

# The base rules; each is written so that a failing start is not tried again from within its own run of letters.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Candidates of the other kinds.
OTHER = {
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "local": re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "mac": re.compile(r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
SECRET = re.compile(r"(?<![A-Za-z0-9_-])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer)\s{0,3}[=:]\s{0,3}[\"']?([^\s\"'<>,;!]{8,}+)", re.I)
CAPITALISED = re.compile(r"[^\W\d_a-z](?:[^\W\d_A-Z]|[\u0300-\u036f])++(?!\w)")

# Gazetteers.
GIVEN_NAMES = frozenset("James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Karen Nancy Hans Peter Klaus Anna Maria Pierre Jean Marie Claire Juan Carlos Carmen Pedro Sofia".split())
ENDINGS = frozenset("com org net edu gov mil int info biz de fr es uk eu it nl ch at us ca au jp io".split())
KEY_PREFIXES = ("AKIA", "ghp_", "sk-", "sk_", "xoxb-", "eyJ", "AIza")
FOR = {
    "email": "mail email contact write address",
    "ip": "ip address host server from",
    "card": "card visa mastercard credit payment",
    "phone": "phone tel call mobile fax contact",
    "local": "phone tel call mobile fax contact",
    "iban": "iban account bank transfer konto",
    "mac": "mac device address",
    "ssn": "ssn social security",
    "person": "name mr mrs ms dr dear regards signed by author herr frau",
    "secret": "password passwd pwd secret token api key access auth bearer login",
}
FOR = {k: frozenset(v.split()) for k, v in FOR.items()}
AGAINST = frozenset("version isbn page chapter section figure order invoice part model item".split())
NO_NAMES = FOR["person"] | AGAINST | frozenset(w for k in ("email", "phone", "iban") for w in FOR[k])
WORD = re.compile(r"[A-Za-z]+")

LABELERS = ("form", "gazetteer", "for", "against")
#: Pseudo votes of each labeler and kind: so many, and such a part of those cast.
PSEUDO = 10, 1.0


def emails(text: str) -> list[tuple[int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL_PART:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, low := m.end()))
            at = text.find("@", low)
        else:
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def pairs(text: str) -> list[tuple[int, int]]:
    """Every two capitalised words with a blank between; pairs may share a word."""
    out, start, end = [], -1, -1
    for m in CAPITALISED.finditer(text):
        s, e = m.span()
        if not (text[s].isupper() and text[s + 1 : e].islower()) or s and (text[s - 1].isalnum() or text[s - 1] == "_"):
            continue
        if s == end + 1 and start >= 0 and text[end] == " ":
            out.append((start, e))
        start, end = s, e
    return out


def extra_candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    found = []
    if DIGIT.search(text):
        found = [(kind, *m.span()) for kind, rule in OTHER.items() for m in rule.finditer(text)]
    if "=" in text or ":" in text:
        found += [("secret", *m.span(1)) for m in SECRET.finditer(text)]
    found += [("person", *s) for s in pairs(text)]
    if not found:
        return []
    starts, ends = [], []  # base spans, joined where they overlap: one bisection finds those that a candidate meets
    for s, e in sorted((s, e) for _, s, e in base):
        if ends and s < ends[-1]:
            ends[-1] = max(e, ends[-1])
        else:
            starts.append(s)
            ends.append(e)
    return [c for c in sorted(found) if (k := bisect_left(starts, c[2])) == 0 or ends[k - 1] <= c[1]]


def entropy_level(value: str) -> int:
    counts = Counter(value).values()
    bits = -sum(c / len(value) * math.log2(c / len(value)) for c in counts)
    return min(4, int(bits))


def well_formed(kind: str, value: str) -> bool:
    if kind == "iban":
        v = value.replace(" ", "")
        return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    if kind == "ssn":
        area, group, serial = value.split("-")
        return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    if kind == "local":
        return value.strip("(")[0] in "23456789"
    if kind == "secret":
        return entropy_level(value) >= 2 and len(set(map(str.isdigit, value))) == 2
    if kind == "person":
        return NO_NAMES.isdisjoint(value.lower().split(" "))
    return True


def votes(kind: str, value: str, before: list[str]) -> tuple[int, ...]:
    """1 for, 0 against, -1 nothing, in the order of LABELERS."""
    form = int(well_formed(kind, value))
    gazetteer, context = -1, 1 if not FOR[kind].isdisjoint(before) else -1
    if kind == "email":
        gazetteer = int(value.rsplit(".", 1)[-1].lower() in ENDINGS)
    elif kind == "person":
        first, last = value.split(" ")
        if first in GIVEN_NAMES:
            gazetteer = int(last not in GIVEN_NAMES)
        elif context < 0:  # a short list says little against a name that the context announces
            gazetteer = 0
    elif kind == "secret" and value.startswith(KEY_PREFIXES):
        gazetteer = 1
    return form, gazetteer, context, 0 if not AGAINST.isdisjoint(before) else -1


def describe(text: str, span: tuple[str, int, int]) -> tuple:
    """Kind, votes and discrete features of a candidate: what the corpus is counted by."""
    kind, s, e = span
    value = text[s:e]
    before = [w.lower() for w in WORD.findall(text[max(0, s - 48) : s])][-5:]
    digits = sum(map(str.isdigit, value))
    return kind, votes(kind, value, before), (min(5, (e - s) // 8), 4 * digits // (e - s), entropy_level(value))


class SpanModel:
    """Reliabilities by EM, then a logistic classifier; both over counted descriptions."""

    def __init__(self, counts: dict[tuple, int], rounds: int = 40):
        #: By kind and labeler: P(for | personal) and P(for | not), among votes cast.
        self.reliability = {(kind, name): (0.85, 0.25) for kind in (*BASE, *EXTRA) for name in LABELERS}
        self.prior = {k: 0.5 for k in (*BASE, *EXTRA)}
        self.weights = np.zeros(0)
        self.columns: dict[tuple, int] = {}
        if not counts:
            return
        rows, n = list(counts), np.array([float(c) for c in counts.values()])
        cast = np.array([r[1] for r in rows])
        kinds = np.array([r[0] for r in rows])
        for _ in range(rounds):
            p = np.array([self.posterior(r[0], r[1]) for r in rows])
            for kind in set(kinds.tolist()):
                own = kinds == kind
                self.prior[kind] = float(((n * p)[own].sum() + 2) / (n[own].sum() + 4))
                for j, name in enumerate(LABELERS):
                    some = own & (cast[:, j] >= 0)
                    yes, a, b = (cast[:, j] == 1)[some], (n * p)[some], (n * (1 - p))[some]
                    # pseudo votes, worth a part of the votes cast, hold a labeler that always votes alike near its start
                    held = PSEUDO[0] + PSEUDO[1] * n[some].sum()
                    self.reliability[kind, name] = (
                        float(np.clip(((a * yes).sum() + 0.85 * held) / (a.sum() + held), 0.05, 0.95)),
                        float(np.clip(((b * yes).sum() + 0.25 * held) / (b.sum() + held), 0.05, 0.95)),
                    )
        self._train(rows, n, np.array([self.posterior(r[0], r[1]) for r in rows]))

    def posterior(self, kind: str, cast) -> float:
        odds = math.log(self.prior[kind] / (1 - self.prior[kind]))
        for name, v in zip(LABELERS, cast):
            if v >= 0:
                a, b = self.reliability[kind, name]
                odds += math.log(a / b) if v else math.log((1 - a) / (1 - b))
        return 1 / (1 + math.exp(-odds))

    @staticmethod
    def features(row: tuple) -> list[tuple]:
        kind, cast, shape = row
        return [("bias",), ("kind", kind), *(("vote", j, v) for j, v in enumerate(cast)), *(("shape", kind, j, v) for j, v in enumerate(shape)), ("form", kind, cast[0])]

    def _train(self, rows: list[tuple], n: np.ndarray, p: np.ndarray, steps: int = 400, rate: float = 0.5, l2: float = 1e-3) -> None:
        for row in rows:
            for f in self.features(row):
                self.columns.setdefault(f, len(self.columns))
        x = np.zeros((len(rows), len(self.columns)))
        for i, row in enumerate(rows):
            x[i, [self.columns[f] for f in self.features(row)]] = 1
        w, n = np.zeros(x.shape[1]), n / n.sum()
        for _ in range(steps):
            q = 1 / (1 + np.exp(-x @ w))
            w += rate * (x.T @ (n * (p - q)) * 4 - l2 * w)
        self.weights = w

    def probability(self, row: tuple) -> float:
        if not len(self.weights):
            return self.posterior(row[0], row[1])
        z = sum(self.weights[self.columns[f]] for f in self.features(row) if f in self.columns)
        return float(1 / (1 + math.exp(-z)))


def key(row: tuple) -> str:
    return json.dumps(row)


def unkey(text: str) -> tuple:
    kind, cast, shape = json.loads(text)
    return kind, tuple(cast), tuple(shape)


def learn(docs: DataFrame) -> SpanModel:
    """Counts the candidates' descriptions over all documents and trains on the counts."""

    def make():
        def run(texts):
            counts: Counter = Counter()
            for t in texts:
                if t:
                    base = base_spans(t)
                    counts.update(key(describe(t, c)) for c in (*base, *extra_candidates(t, base)))
            return list(counts), list(counts.values())

        return run

    sums = map_columns(docs.select("text"), "description string, n long", make).groupBy("description").agg(F.sum("n").alias("n"))
    return SpanModel({unkey(r[0]): r[1] for r in sums.orderBy("description").collect()})


def spans(text: str | None, model: SpanModel, threshold: float = THRESHOLD, memo: dict | None = None) -> tuple[list, list]:
    """Base spans and added spans of a text."""
    if not text:
        return [], []
    base, added, best = base_spans(text), [], 0.0
    memo = {} if memo is None else memo
    for c in extra_candidates(text, base):
        row = describe(text, c)
        if (p := memo.get(row)) is None:
            p = memo[row] = model.probability(row)
        if p < threshold:
            continue
        if not (added and added[-1][0] == c[0] and added[-1][2] > c[1]):
            added.append(c)
            best = p
        elif p > best:
            added[-1], best = c, p
    return base, added


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def find(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, all spans and n_spans, their number: one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def make():
        model, memo = shared.value, {}

        def run(keys, texts):
            counts: list[list[int]] = [[] for _ in BASE]
            digests, all_spans, totals = [], [], []
            for t in texts:
                base, added = spans(t, model, memo=memo)
                own = Counter(k for k, _, _ in base)
                for out, kind in zip(counts, BASE):
                    out.append(own[kind])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                all_spans.append(written([*base, *added]))
                totals.append(len(base) + len(added))
            return keys, *counts, digests, all_spans, totals

        return run

    return map_columns(docs.select("doc_id", "text"), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long", make)
