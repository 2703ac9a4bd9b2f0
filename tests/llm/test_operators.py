"""Each operator against a brute-force version, a round trip or held-out accuracy, and in the cases its docstring names."""

import hashlib
import random
import re
import struct
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import bpe, decontam, flac, langid, linededup, maintext, pii, quality, shinglesim, simhash, suffixdedup
from attesta.llm.common import held_out
from attesta.operators import dom

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "\n", "a", "The same text twice.\nA line", "The same text twice.\nA line", "é😀" * 50, "x " * 30_000, "1234 5678 é́", "1" * 50_000]
#: Columns that operators use inside.
CLASHES = "fp long, key string, h long, d long, label int, score double, found string, ranges string, n_chars int, lang string, source string, root long, dropped string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, repeated rows, long texts, clashing columns."""
    rows = [(i if i != 4 else None, t, *[None] * 13) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], *[None] * 13)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHES}")


@pytest.fixture(scope="module")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}


# --- language identification


def plain_phrases(text, known):
    """Longest matches from left to right, by searching the training text; a byte it lacks is a phrase."""
    n = 0
    for low in range(0, len(text), langid.BLOCK):
        block, at = text[low : low + langid.BLOCK], 0
        while at < len(block):
            size = 1
            while at + size < len(block) and block[at : at + size + 1] in known:
                size += 1
            at, n = at + size, n + 1
    return n


def test_suffix_automaton_finds_longest_matches():
    rng = random.Random(2)
    texts = [(lang, bytes(rng.choice(letters) for _ in range(300))) for lang, letters in (("x", b"abc"), ("y", b"abde"))]
    parser = langid.CrossParser(texts)
    probes = [bytes(rng.choice(b"abcdz") for _ in range(rng.randint(1, 20))) for _ in range(300)] + [bytes(rng.choice(b"abc") for _ in range(5000))]
    got = parser.phrases(probes).tolist()
    for k, (_, known) in enumerate(texts):
        automaton = langid.SuffixAutomaton(known)
        for probe, counts in zip(probes, got):
            if len(probe) <= 20:
                assert automaton.longest(probe) == max(n for n in range(len(probe) + 1) if probe[:n] in known)
            assert counts[k] == plain_phrases(probe, known)


def test_query_equals_plain_cross_parsing(docs, texts):
    """The whole query against cross-parsing by substring search."""
    model = langid.learn(docs, ~held_out(F.col("doc_id")))
    got = {r.doc_id: r.lang_pred for r in langid.identify_held_out(docs).collect()}
    for i in sorted(texts)[:60]:
        stream = langid.letters(texts[i])[: 4 * langid.BLOCK]
        if stream and len(langid.letters(texts[i])) == len(stream):
            assert got[i] == min(model, key=lambda m: plain_phrases(stream, m[1]) * np.log2(len(m[1]) + 2))[0]


def test_languages_of_held_out_documents(docs):
    out = langid.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 20 and right > 0.97


def test_every_language_is_learned(spark):
    rows = [(i, f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} " * 30, f"l{i % 300}") for i in range(900)]
    model = langid.learn(spark.createDataFrame([*rows, (1000, "a " * 50_000, "long")], "doc_id long, text string, lang string"), F.lit(True))
    assert len(model) == 301 and sum(len(t) for _, t in model) <= 480_000


def test_language_ties_go_by_the_alphabet():
    parser = langid.CrossParser((("aa", b"same text here"), ("bb", b"same text here")))
    assert parser.predict(["same here", "zz", None, "12"]) == [("aa", 0.5), ("aa", 0.5), ("und", 0.0), ("und", 0.0)]


def test_language_edge_cases(odd, empty, docs):
    model = langid.learn(docs, ~held_out(F.col("doc_id")))
    rows = langid.identify(odd, model).collect()
    assert len(rows) == len(TEXTS) + 1
    assert [r.lang_pred for r in rows[:4]] == ["und"] * 4 and all(0 <= r.score <= 1 for r in rows)
    assert langid.learn(empty, F.lit(True)) == () and langid.learn(odd, F.lit(True)) == ()
    assert {r.lang_pred for r in langid.identify(odd, ()).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


# --- main text


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav class="menu"><ul><li><a href=/a>Home</a></li><li><a href=/b>More</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site.</p></div>
<article><h1>A &amp; B</h1><p>First   words<br>of the story.<p>Second <b>part</b> of it, which is longer than the first.</p><div class="ad">Buy now!</div></article>
<section class="comments"><h2>Comments</h2><p>I liked this a lot, thanks for the story.</p></section><footer>&copy; 2020 Site</footer></body></html>"""


def test_main_text():
    assert maintext.trained().content(PAGE) == ["A & B", "First words of the story.", "Second part of it, which is longer than the first."]


def test_marginals_equal_enumeration():
    m = maintext.TreeModel()
    m.tables = [[[0.3, -0.2], [-0.7, 0.9]], [[0.1, 0.4], [0.0, 0.2]], [[0.0, 0.0], [0.5, 1.0]], [[0.2, 0.1], [0.3, -0.4]]]
    parents, kinds, own = [-1, 0, 0, 1, 1, 2], [0, 1, 2, 3, 0, 1], [0.4, -1.0, 0.3, 2.0, -0.5, 0.1]
    mass, total = np.zeros(6), 0.0
    for bits in range(64):
        y = [bits >> k & 1 for k in range(6)]
        w = np.exp(sum(o for o, v in zip(own, y) if v) + sum(m.tables[kinds[k]][y[parents[k]]][y[k]] for k in range(1, 6)))
        total += w
        mass += w * np.array(y)
    assert np.allclose(m.marginals(parents, kinds, own)[0], mass / total)


def test_main_text_of_generated_layouts():
    model, rng, right, n = maintext.trained(), random.Random(77), 0, 0
    for _ in range(60):
        parents, kinds, found, labels = maintext.labelled_nodes(maintext.labelled_page(rng))
        p, _ = model.marginals(parents, kinds, model.own_potentials(found))
        right += sum((x >= 0.5) == y for x, y in zip(p, labels))
        n += len(labels)
    assert right / n > 0.96


def test_pages_equal_their_articles(spark, data):
    """The whole query against the articles' blocks, read by the library's own tree of elements."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r.text for r in maintext.extract(pages).collect()}
    want = {}
    for r in pages.collect():
        root = dom.tree(r.html)
        article = root.find(lambda e: e.tag == "article")
        blocks = [re.sub(r"\s+", " ", e.text()).strip() for e in article.walk() if e.tag in ("h1", "p")]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want) and len(want) > 40


def test_stray_ends_take_linear_time():
    seconds = []
    for n in (2_000, 16_000):
        page, began = "<div><i>" * n + "</p></b></span>" * n, time.perf_counter()
        maintext.parse(page)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 30 * seconds[0]


def test_page_edge_cases(spark):
    pages = [(1, None, None, 1), (2, "u", "", 1), (3, "u", "plain words only", 1), (4, None, "<p>cut <b", 1), (4, None, "<p>cut <b", 1), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 10, 1), (6, "u", "<article><p>" + "long words. " * 50_000, 1)]
    rows = maintext.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text int")).collect()
    assert len(rows) == 7 and rows[0].text == rows[1].text == "" and all(r.n_chars == len(r.text) for r in rows)
    assert rows[6].n_chars == len(("long words. " * 50_000).strip())


# --- BPE


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORD_BPE)
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.ForcedBoundaryBPE(open(WORD_BPE, "rb").read())


def test_ids_equal_the_library(own, library, texts):
    rng, letters = random.Random(4), "aAéßΣσς İi'sSn  \t\n\x1c\x85\xa0<|>09½ⅷ中文😀!!--$é\U0001fae9"
    probes = [t for t in texts.values()] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    probes += ["x<|endoftext|>y <|startoftext|>", "'re'LL 'd", "a" * 3000, "ab" * 2000 + "ξ" * 500]
    for t, e in zip(probes, library.encode_batch(probes, add_special_tokens=False)):
        ids = own.encode(t)
        assert ids == e.ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == own.decode_parts(own.encode_parts(t))


def test_every_letter(own, library):
    probes = [f"a{chr(c)}b" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert all(own.encode(t) == e.ids for t, e in zip(probes, library.encode_batch(probes, add_special_tokens=False)))


def test_cuts_change_nothing(own):
    for word in ("internationalization", "xqzjkvb", "naïveté", "zzzzqqqq"):
        letters = own.as_letters(word)
        whole = own._merge([*map(own.vocab.__getitem__, letters[:-1]), own.vocab[letters[-1] + bpe.END]])
        assert [i for part in own.split(word) for i in own._fragment(part)] == whole == own._merge_long([*map(own.vocab.__getitem__, letters[:-1]), own.vocab[letters[-1] + bpe.END]])


def test_bpe_frames(spark, odd, empty, own):
    ids = bpe.encode(odd, WORD_BPE)
    back = bpe.decode(ids, WORD_BPE).collect()
    got = bpe.digest(odd, WORD_BPE).collect()
    for r, i, t, d in zip(got, ids.collect(), back, [*TEXTS, TEXTS[5]]):
        assert i.ids == own.encode(d) and r.n_tokens == len(i.ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(i.ids)}I", *i.ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.text.encode()).hexdigest()
    assert bpe.digest(empty, WORD_BPE).count() == 0


# --- FLAC


def test_flac_round_trip(texts):
    rng = random.Random(6)
    payloads = [flac.payload(t)[0] for t in list(texts.values())[:60]] + [flac.payload(None)[0], rng.randbytes(576 * 3), b"\0" * 576 + b"\xff" * 576, bytes([0, 255] * 288 * 150)]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    for p, s in list(zip(payloads, streams))[-12:]:  # the general reader, without the seek table
        head, channels = flac.decode_stream(s)
        assert bytes(x + 128 for x in channels[0]) == p and head["samples"] == len(p)
    assert flac.decode([streams[0]], 1, 1)[0] == payloads[0][576:1152]


def test_flac_checksums():
    stream = bytearray(flac.encode([flac.payload("some text " * 300)[0]])[0])
    for at in (-1, -40, -len(stream) // 2):
        broken = stream.copy()
        broken[at] ^= 4
        for read in (lambda s: flac.decode([s]), flac.decode_stream):
            with pytest.raises(flac.CorruptStream):
                read(bytes(broken))


def test_flac_frame_numbers():
    assert all(flac.frame_number(n) == chr(n).encode() for n in (0, 127, 128, 2047, 2048, 50_000, 70_000))


def test_flac_frames(odd, empty):
    rows = flac.digest(odd).collect()
    blocks = flac.pcm_blocks(flac.to_media(odd)).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r.doc_id: r.n for r in blocks if r.doc_id not in (None, 5)} == {r.doc_id: r.payload_bytes // 576 for r in rows if r.doc_id not in (None, 5)}
    for r, t in zip(rows, [*TEXTS, TEXTS[5]]):
        data, n = flac.payload(t)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(data), hashlib.sha256(data).hexdigest())
    assert rows[5].media_sha256 == rows[6].media_sha256
    assert flac.digest(empty).count() == 0


# --- personal data


def plain_base(t):
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans(texts):
    rng = random.Random(3)
    probes = [*texts.values(), *("".join(rng.choice("a@..--+ ()12345é@b%") for _ in range(rng.randint(0, 40))) for _ in range(20_000))]
    assert all(pii.base_spans(t) == plain_base(t) for t in probes)


def test_added_spans(spark):
    rows = [(1, 'token = "ce0cc631f6559e745b37cb8be6fc63ae2d235c5f" here'), (2, "password=e3b3ed3cc8548923d6"), (3, "call 555-123-4567 now"), (4, "nothing to see, version 12"), (5, "write to a.b@mail.example.com")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert found[1] == "secret:9:49" and found[2] == "secret:9:27" and found[4] == "" and found[5] == "email:9:29"
    assert found[3] == "local:5:17"


def test_secrets_are_whole(spark):
    jwt = "eyJ" + "aB3." * 150
    assert pii.extra_candidates(f"token: {jwt} end", []) == [("secret", 7, 7 + len(jwt))]
    found = pii.find(spark.createDataFrame([(1, f"token: {jwt} end")] * 40, "doc_id long, text string")).first()
    assert found.spans == f"secret:7:{7 + len(jwt)}"


def test_persons_of_every_surrounding():
    names = {"(James Smith)": "James Smith", "Contact James Smith": "James Smith", "Mr James Smith": "James Smith", "signed by Hans Müller": "Hans Müller", "Dear Tariq Aziz,": "Tariq Aziz", "it was Mr Ömer Şahin": "Ömer Şahin", "by Anna Mu\u0308ller": "Anna Mu\u0308ller"}
    plain = ["the New York office", "Der Hund und Die Katze", "Grand Hotel in town", "McDonald Farm2 XJames Smith"]
    texts = [*names, *plain]
    counts = Counter(pii.describe(t, c) for t in texts for c in pii.extra_candidates(t, []))
    model = pii.SpanModel({k: 40 * n for k, n in counts.items()})
    assert {t: [t[s:e] for _, s, e in pii.spans(t, model)[1]] for t in texts} == {t: [names[t]] if t in names else [] for t in texts}


def test_candidates_meet_no_base_span():
    rng, secret = random.Random(4), 'token = "ce0cc631f6559e745b37cb8be6fc63ae2d235c5f"'
    text = " ".join(rng.choice(("a.b@mail.example.com", "10.0.0.1", "+1 (826) 555-4081", secret, "token=a.b@mail.example.com", "James Smith")) for _ in range(300))
    base = pii.base_spans(text)
    got, want = pii.extra_candidates(text, base), [c for c in pii.extra_candidates(text, []) if not any(s < c[2] and c[1] < e for _, s, e in base)]
    assert got == want and len(got) > 50


def test_reliabilities_follow_agreement():
    row = lambda v: ("secret", v, (5, 1, 3))
    m = pii.SpanModel({row((1, 1, 1, -1)): 500, row((0, -1, -1, 0)): 500, row((1, -1, -1, 0)): 40})
    assert m.probability(row((1, 1, 1, -1))) > 0.8 > 0.5 > m.probability(row((0, -1, -1, 0)))


def test_pii_edge_cases(odd, empty):
    rows = pii.find(odd).collect()
    assert len(rows) == len(TEXTS) + 1 and all(r.spans == "" for r in rows)
    assert pii.find(empty).count() == 0


# --- suffix-array dedup


def plain_removed(texts, length=400, passage=256):
    data, seen, owners = [(t or "").encode() for t in texts], Counter(), {}
    for i, b in enumerate(data):
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
        for k in range(len(b) - passage + 1):
            owners.setdefault(b[k : k + passage], set()).add(texts[i])
    out = []
    for b in data:
        gone, shared = bytearray(len(b)), bytearray(len(b))
        for k in range(len(b) - passage + 1):
            if seen[b[k : k + length]] > 1 and k + length <= len(b):
                gone[k : k + length] = b"\1" * length
            if len(owners[b[k : k + passage]]) > 1:
                shared[k : k + passage] = b"\1" * passage
        kept = bytes(x for x, g in zip(b, gone) if not g)
        passages = sum(len(b[m.start() : m.end()].split()) > 50 for m in re.finditer(b"\1+", shared))
        out.append((len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest(), passages))
    return out


@pytest.mark.parametrize("options", [{}, {"most": 3}, {"most": 20}, {"flush_bytes": 1}])
def test_repeated_strings(spark, options):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages, docs = [prose(rng.randint(60, 250)) for _ in range(6)], []
    for n in range(70):
        k, p = rng.random(), rng.choice(passages)
        if k < 0.5:
            docs.append(prose(rng.randint(0, 60)) + p * (k > 0.1) + prose(rng.randint(0, 60)))
        elif k < 0.7:
            docs.append(rng.choice(("a", "ab ", "xyz-")) * rng.randint(1, 400))
        elif k < 0.9:
            w = p.split()
            w[rng.randrange(len(w))] = "X"
            docs.append(" ".join(w))
        else:
            docs.append(p + f" {n}")
    docs += [None, "", "x" * 399, "y" * 400, "y" * 400, "z" * 401, passages[0][:300], "\0" * 300, "\0" * 420]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(docs)], "doc_id long, text string, h string, d int")
    got = {r.doc_id: tuple(r)[1:] for r in suffixdedup.digest(df, **options).collect()}
    want = plain_removed(docs)
    assert [got[i][:4] for i in range(len(docs))] == [w[:4] for w in want]
    once = Counter(docs)  # equal texts of different ids are different documents
    assert [got[i][4] for i in range(len(docs)) if once[docs[i]] == 1] == [w[4] for w, t in zip(want, docs) if once[t] == 1]


def test_suffixes_are_in_order():
    """The whole order equals a plain sort of the strings, over stretches whose ties meet at different residues too."""
    rng = random.Random(3)
    for letters in (b"a", b"ab ", b"abcdefgh "):
        any_of = lambda n: bytes(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        base, rows = any_of(900), []
        for _ in range(40):
            text = bytearray(base if rng.random() < 0.7 else (any_of(7) * 200)[:900])
            if rng.random() < 0.6:
                text[rng.randrange(900)] = ord("X")
            size = (count := rng.randint(1, 113)) + rng.choice([255, 300, 399])
            at = rng.randint(0, 900 - size)
            rows.append((bytes(text[at : at + size]), rng.randint(0, 200), count))
        suffixes = suffixdedup.BlockwiseSuffixes(*zip(*rows))
        strings = [suffixes.text[s : s + 400].tobytes() for s in suffixes.starts]
        order = [i for numbers, _, _ in suffixes.buckets() for i in numbers.tolist()]
        assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)


def test_difference_cover():
    cover = suffixdedup.difference_cover(64)
    assert {(a - b) % 64 for a in cover for b in cover} == set(range(64)) and len(cover) <= 16


def test_suffix_edge_cases(odd, empty):
    assert sorted(tuple(r)[1:5] for r in suffixdedup.digest(odd).collect()) == sorted(r[:4] for r in plain_removed([*TEXTS, TEXTS[5]]))
    assert suffixdedup.digest(empty).count() == 0


# --- benchmark decontamination


def plain_letters(a, b, anchored=False):
    """Least edits that turn a into a stretch (anchored: a beginning) of b."""
    row = list(range(len(b) + 1)) if anchored else [0] * (len(b) + 1)
    for x in a:
        last, row = row, [row[0] + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[-1] + 1))
    return min(row)


def edited(rng, words, edits):
    copy = list(words)
    for _ in range(edits):
        k = rng.randrange(len(copy))
        copy[k : k + 1] = rng.choice(([], ["qqq"], [copy[k], "rrr"]))
    return copy


@pytest.mark.parametrize("share", [0.5, 1.0])
def test_leaks_are_recalled(spark, data, share):
    """Copies of every item at half the limit and at the limit: found through the LSH tables, with the exact distance."""
    benchmark = {r.item_id: decontam.words_of(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    rng, rows, want = random.Random(8), [], {}
    for n in range(5):
        for i, w in benchmark.items():
            rows.append((key := 1000 * n + i, "before it " + " ".join(edited(rng, w, int(share * 0.2 * len(w) + 1e-9))) + " after it"))
            want[key] = i
    found = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{data}/benchmark.parquet")).collect()
    hits = {r.doc_id for r in found if want[r.doc_id] == r.item_id}
    assert len(hits) >= (0.99 if share < 1 else 0.9) * len(want)
    texts = dict(rows)
    for r in found:
        w, text = benchmark[r.item_id], decontam.words_of(texts[r.doc_id])
        if r.unit == "word":
            assert r.edits == decontam.infix_distance(w, text, len(w))[0] <= int(0.2 * len(w) + 1e-9)
        else:
            assert decontam.infix_distance(w, text, len(w))[0] > int(0.2 * len(w) + 1e-9)
            assert r.edits <= int(0.2 * len(" ".join(w)) + 1e-9)


def test_leaks_against_all_windows(spark, docs, data):
    """The whole query against every window of every document, by the exact distance of words."""
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    benchmark = {r.item_id: decontam.words_of(r.text) for r in items.collect()}
    texts, want = {r.doc_id: decontam.words_of(r.text) for r in docs.collect()}, set()
    for d, t in texts.items():
        here = set(t)
        for i, w in benchmark.items():
            limit = int(0.2 * len(w) + 1e-9)
            if sum(x in here for x in w) >= len(w) - limit and decontam.infix_distance(w, t, limit)[0] <= limit:
                want.add((d, i))
    found = decontam.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.unit == "word"} == want and want


def test_misspelt_and_unspaced_leaks(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(24)]
    typos = [w[:3] + "x" + w[4:] if k % 4 == 1 else w for k, w in enumerate(words)]  # six of 24 words, six of 191 letters
    chinese = "".join(chr(0x4E00 + k) for k in rng.sample(range(5000), 12))
    items = spark.createDataFrame([(1, " ".join(words)), (2, chinese)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + " ".join(typos) + " on"), (2, f"甲乙{chinese[:5]}丙{chinese[6:]}丁戊")], "doc_id long, text string")
    found = {r.doc_id: r for r in decontam.leaks(docs, items).collect()}
    assert (found[1].item_id, found[1].unit, found[1].edits, found[1].start_word, found[1].end_word) == (1, "letter", 6, 1, 25)
    assert (found[2].item_id, found[2].unit, found[2].edits, found[2].start_word, found[2].end_word) == (2, "word", 1, 2, 14)


def test_letter_distance():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randint(1, n))) for n in (80, 90))
        for anchored in (False, True):
            assert decontam.infix_letters(a, b, 1000, anchored)[0] == plain_letters(a, b, anchored)


def items_of_lengths(rng, lengths):
    return [(m, " ".join(f"w{rng.randrange(60)}" for _ in range(m))) for m in lengths]


def test_walks_of_all_lengths_go_side_by_side(monkeypatch):
    """What a search costs besides its windows must not grow with the number of lengths and walks."""
    items, calls, mixed = items_of_lengths(random.Random(4), range(10, 50)), [], decontam.mixed
    index = decontam.EditIndex(items)
    monkeypatch.setattr(decontam, "mixed", lambda *a: calls.append(1) or mixed(*a))
    assert {k for _, k, *_ in index.search([t for _, t in items])} == set(range(len(items)))
    assert len(calls) < len(items)


def test_candidates_equal_plain_walks(monkeypatch):
    """Windows of several lengths at once, in small slices, against one walk after another."""
    rng = random.Random(5)
    index = decontam.EditIndex(items_of_lengths(rng, [1, 2, 5, 9, 9, 14, 30]))
    text = [rng.choice((0, *range(1, len(index.words) + 1))) for _ in range(40)] + [c for w in index.codes for c in (*w.tolist(), 0)]
    lengths = sorted(index.sizes.tolist() * 20, reverse=True)
    m, start = np.array(lengths), np.array([rng.randrange(-3, len(text)) for _ in lengths])

    def samples(codes, walk):
        factors, shifts, sampled = index.walks[walk]
        at, seen = 0, []
        for factor, shift in zip(factors.tolist(), shifts.tolist()):
            seen.append(code := codes[at] if at < len(codes) else 0)
            at = min(at + (((int(index.symbols[code]) ^ shift) * factor & (1 << 64) - 1) >> 63), len(codes))
        return [tuple(seen[k] for k in table) for table in sampled[index.lengths.tolist().index(len(codes))].tolist()]

    walks, want = list(range(len(index.walks))), set()
    for n, (size, s) in enumerate(zip(lengths, start.tolist())):
        window = [text[k] if 0 <= k < len(text) else 0 for k in range(s, s + size)]
        for k, code in enumerate(index.codes):
            if len(code) == size and any(a == b for w in walks for a, b in zip(samples(window, w), samples(code.tolist(), w))):
                want.add((n, k))
    monkeypatch.setattr(decontam, "SYMBOLS", 200)
    monkeypatch.setattr(decontam, "ABREAST", 2)
    found = set()
    for low, high in index.slices(m):
        windows = index.cut(np.array(text), np.array([len(text)]), np.zeros(high - low, np.int64), m[low:high], start[low:high])
        found |= {(low + n, k) for n, k in zip(*(x.tolist() for x in index.lookup(windows, m[low:high], walks)))}
    assert found == want and want


def test_words_equal_the_expression():
    for c in map(chr, [*range(0x3000), 0x3042, 0x4E2D, 0xD800, 0xFB01, 0x1D4B3]):
        for text in (c, f"aB{c}Cd e", f"É{c}ß"):
            assert decontam.words_of(text) == decontam.WORD.findall(text.lower())


def test_unreachable_recall_raises():
    with pytest.raises(ValueError):
        decontam.EditIndex([(1, "a b c d e f g h i j")], similarity=0.3, recall=1.01)


def test_infix_distance():
    assert decontam.infix_distance([1, 2, 3], [9, 1, 2, 3, 9], 3) == (0, 1, 4)
    assert decontam.infix_distance([1, 2, 3, 4], [9, 1, 3, 4, 9], 3)[0] == 1
    assert decontam.infix_distance([1, 2], [5, 6, 7], 1)[0] == 2


def test_decontamination_edge_cases(spark, odd, empty):
    items = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "same text twice", 0), (3, "same text twice", 0), (None, "one two three four five six", 0)], "item_id long, text string, doc_id int")
    assert {r.item_id for r in decontam.leaks(odd, items).collect()} == {3}
    assert decontam.clean(odd, items).count() == len(TEXTS) - 2
    assert decontam.clean(odd, items).columns == odd.columns
    assert decontam.leaks(empty, items).count() == 0 and decontam.leaks(odd, items.limit(0)).count() == 0
    blocks = decontam.leaks(odd, items, block_chars=5).collect()
    assert {r.item_id for r in blocks} == {3}


# --- quality


def test_quality_of_held_out_documents(spark, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    out = quality.score_held_out(docs, labels).join(labels, "doc_id").where("held_out")
    right, n = out.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double")), F.count("*")).first()
    assert n > 10 and right > 0.85


def test_scores_equal_plain_averages(spark, docs, data):
    """The whole query against the average of all features of a text, one by one."""
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = quality.learn(docs, labels, ~held_out(F.col("doc_id")))
    got = {r.doc_id: r for r in quality.score_held_out(docs, labels).collect()}
    for r in docs.collect():
        words = (r.text or "").split()
        used = [f for w in words for f in quality.features(w)] + [quality.REPEATED] * (quality.REPEAT_WEIGHT * sum(a == b for a, b in zip(words, words[1:])))
        odds = float(model.feature[used].astype(float).mean()) + model.bias if words else model.base
        want = 1 / (1 + np.exp(-odds))
        assert abs(got[r.doc_id].score - want) < 1e-4 and (got[r.doc_id].predicted == int(want >= 0.7) or abs(want - 0.7) < 1e-4)


def test_label_ties_count_as_good(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality.SubwordClassifier, "fit", lambda self, texts, marks: seen.update(zip(texts, marks)) or self)
    docs = spark.createDataFrame([(1, "tie"), (2, "bad"), (3, "good")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    quality.learn(docs, labels, F.lit(True))
    assert seen == {"tie": 1, "bad": 0, "good": 1}
    seen.clear()
    quality.learn(docs.withColumn("text", F.repeat("text", F.lit(100))), labels, F.lit(True), train_chars=450)
    assert 1 <= len(seen) < 3


def test_quality_edge_cases(spark, odd, empty, docs, data):
    labels = spark.createDataFrame([(5, 1, "x"), (5, 0, "x"), (8, 0, "x"), (None, 1, "x"), (9, None, "x"), (7, 1, "x")], "doc_id long, quality int, text string")
    model = quality.learn(odd, labels, F.lit(True))
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(TEXTS) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(empty, model).count() == 0
    none = quality.learn(empty, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}
    kept = quality.good(odd, none, 0.5)
    assert kept.columns == odd.columns and kept.count() == len(TEXTS) + 1


# --- line dedup


def plain_lines(texts, least):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    keys = [[low(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for t in texts]
    counts = Counter(k for own in keys for k in set(own) if k)
    out = []
    for t, own in zip(texts, keys):
        lines = (t or "").split("\n")
        kept = "\n".join(x for x, k in zip(lines, own) if not (k and counts[k] >= least))
        out.append((len(lines), sum(bool(k) and counts[k] >= least for k in own), kept))
    return out


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"bits": 1 << 16}, {"most_bits": 1 << 16, "doc_bits": 1000}])
def test_shared_lines(spark, texts, options):
    rows = [*texts.values(), None, "", *["  Head LINE\t\nÉtude own", "head line\n\x0bétude own"] * 6]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(rows)], "doc_id long, text string, key string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in linededup.kept_lines(df, **options).collect()}
    assert [got[i] for i in range(len(rows))] == plain_lines(rows, 10)
    assert "\nhead line" not in "\n".join(v[2] for v in got.values()).lower()


def test_line_filters_are_sharded():
    """Beyond most_bits the keys are dealt into parts, so few keys that are seen once are suspected."""
    rng = random.Random(3)
    hashes = np.array([rng.getrandbits(64) for _ in range(20_000)], np.uint64)
    owner = np.array([linededup.in_part(hashes, part, 4) for part in range(4)])
    assert (owner.sum(axis=0) == 1).all() and owner.sum(axis=1).min() > 4_000
    suspects = {}
    for parts in (1, 4):
        suspects[parts] = 0
        for part in range(parts):
            filters = linededup.SeenFilters(1 << 16)
            own = hashes[linededup.in_part(hashes, part, parts)]
            for low in range(0, len(own), 500):
                filters.add(own[low : low + 500])
            suspects[parts] += filters.holds(filters.twice, filters.probes(own)).sum()
    assert 10 * suspects[4] < suspects[1]


def test_first_occurrences_stay(spark):
    df = spark.createDataFrame([(i, f"shared\nown {i}\nshared") for i in range(12)], "doc_id long, text string")
    for options in ({}, {"broadcast_bytes": 0}):
        got = {r.doc_id: r.kept for r in linededup.kept_lines(df, keep_first=True, **options).collect()}
        assert got[0] == "shared\nown 0" and got[5] == "own 5"
    dropped = linededup.drop_lines(df, keep_first=True).orderBy("doc_id").collect()
    assert dropped[0].text == "shared\nown 0" and dropped[5].text == "own 5"


def test_line_edge_cases(odd, empty):
    out = linededup.drop_lines(odd, min_docs=2)
    assert out.columns == odd.columns and out.count() == len(TEXTS) + 1
    again = linededup.drop_lines(odd, min_docs=2, broadcast_bytes=0)
    clashing = odd.withColumn("text_hash", F.lit("mine")).withColumn("dropped_lines", F.lit(1))
    for options in ({}, {"broadcast_bytes": 0}):
        kept = linededup.drop_lines(clashing, min_docs=2, **options)
        assert kept.columns == clashing.columns and kept.where("text_hash = 'mine' and dropped_lines = 1").count() == len(TEXTS) + 1
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    assert sorted(map(key, out.collect())) == sorted(map(key, again.collect()))
    assert linededup.digest(empty).count() == 0 and linededup.drop_lines(empty).count() == 0


# --- SimHash


def plain_fingerprint(t, shingle=4):
    words = re.findall("[^\\x20\\x09-\\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + shingle]).encode(), 42) for k in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    f = np.array(prints, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def test_fingerprints_and_components(docs, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    assert [got[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in ids] == [ids[k] for k in plain_components(prints)]


@pytest.mark.parametrize(("shard_size", "crowd"), [(1, 20_000), (2000, 20_000), (2000, 60)])
def test_links_of_crowded_fingerprints(spark, shard_size, crowd):
    rng, prints = random.Random(9), set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(80)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, 4, shard_size, crowd)).collect()}
    groups = {}
    for p, k in zip(prints, plain_components(prints)):
        groups.setdefault(k, set()).add(roots.get(simhash.signed(p), simhash.signed(p)))
    assert all(len(g) == 1 for g in groups.values()) and len(set(map(min, groups.values()))) == len(groups)


def test_crowded_shards_are_split(spark):
    """One value of a block holds all nodes: they are spread over shards of a bounded size, and meet there."""
    rng = random.Random(7)
    prints = sorted({rng.getrandbits(40) << 24 for _ in range(3000)} | {0xABCDEF << 40 | rng.getrandbits(3) << rng.randrange(38) for _ in range(400)})
    nodes = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    rows = simhash.shards(nodes, 4, 2000, 200).collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, set()).add(r.fp)
    assert max(map(len, shards.values())) <= 300
    met = {(a, b) for members in shards.values() for a in members for b in members}
    near = [(simhash.signed(a), simhash.signed(b)) for k, a in enumerate(prints) for b in prints[:k] if (a ^ b).bit_count() <= 4]
    assert len(near) > 100 and all(x in met for x in near)


def test_repeated_ids_with_other_texts_stay(spark):
    a, b, c, d = ("".join(f"{x}{k} " for k in range(40)) for x in "abcd")
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (9, c, 4), (9, d, 5), (11, c, 6), (12, b, 7), (12, b, 7), (None, a, 8), (13, "own text", 9), (13, "own text", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash int")
    want = [(3, a, 1), (5, b, 3), (9, c, 4), (9, d, 5), (13, "own text", 9), (None, a, 8)]
    for kept in (simhash.one_of_each(docs), simhash.least_of_each(docs, shinglesim.near_duplicates(docs))):
        assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str) and kept.columns == docs.columns


def test_chains_join(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(1, 61)) and roots[101] == 100


def test_near_duplicate_edge_cases(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(TEXTS) + 1 and rows[0].fingerprint is not None
    assert {r.component_id for r in rows if r.doc_id in (0, 1, 2, 3)} == {0}
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id = 6").count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0

