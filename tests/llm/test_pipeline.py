"""run() against the same stages written plainly, and the stages' contract."""

import hashlib
import random
import struct

import public_tokenizers
from pyspark.sql import functions as F
from test_operators import plain_lines

import corpus_pipeline
from attesta.llm import bpe, decontam, quality, shinglesim, simhash
from attesta.llm.common import held_out


def plain_pairs(texts):
    """Pairs with a Jaccard similarity of five-word shingles of at least 0.8, by comparing all."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    return [(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def plain_groups(texts):
    """The least number that each text reaches by such pairs."""
    root = list(range(len(texts)))
    for i, j in plain_pairs(texts):
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_run_equals_plain_stages(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    score = quality.learn(docs, labels, ~held_out(F.col("doc_id"))).scorer()
    left = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if score(r.text) >= 0.7]
    left = [(i, kept) for (i, _), (_, _, kept) in zip(left, plain_lines([t for _, t in left], 10))]
    groups = plain_groups([t for _, t in left])
    left = [x for k, x in enumerate(left) if groups[k] == k]
    items = [decontam.words_of(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]

    def leaked(text):
        words = decontam.words_of(text)
        runs = set(zip(words, words[1:], words[2:]))
        near = (w for w in items if not runs.isdisjoint(zip(w, w[1:], w[2:])))
        return any(decontam.infix_distance(w, words, int(0.2 * len(w)))[0] <= int(0.2 * len(w)) for w in near)

    left = [x for x in left if not leaked(x[1])]
    own = bpe.ForcedBoundaryBPE(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    want = set()
    for i, t in left:
        ids = own.encode(t)
        want.add((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, data).collect()} == want and len(want) > 50


def test_stages_keep_the_columns_and_take_odd_rows(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "words " * 20_000, None, "s", 1), (2, "words " * 20_000, None, "s", 1), (2, "other text of that id", None, "s", 1), (3, "a b c d e", "en", "s", 9)]
    odd = spark.createDataFrame(rows, schema)
    more = odd.selectExpr("*", "1 as h", "'x' as root", "2L as node", "3 as text_hash", "4 as dropped_lines", "5 as found", "6 as key", "7 as bucket", "true as stays")
    for docs in (odd, more, odd.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, data)
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
            out.count()


def test_copies_equal_brute_force_jaccard(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rng, rows = random.Random(4), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    base = [w for _, t in rows for w in t.split()][:300]
    for n, edits in enumerate([*range(1, 16)] * 4):  # every edit touches five of about 296 shingles
        copy = list(base)
        for k in rng.sample(range(len(copy)), edits):
            copy[k] = f"edit{n}x{k}"
        rows.append((10_000 + n, " ".join(copy)))
    rows += [(20_000, None), (20_001, ""), (20_002, "one two"), (20_003, "One  two")]
    root = plain_groups([t for _, t in rows])
    want = {i: rows[root[k]][0] for k, (i, _) in enumerate(rows)}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in shinglesim.near_duplicates(frame).collect()} == want
    kept = {r.doc_id for r in corpus_pipeline.by_copies(spark, frame, data).collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_copies_go_through_simhash_and_its_trees(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    texts = [" ".join(base[:k] + ["edited"] + base[k + 1 :]) for k in range(5, 395, 30)] + [" ".join(f"x{rng.randrange(900)}" for _ in range(200)) for _ in range(30)]
    found = []

    def searched(nodes, *args, _links=simhash.links, **options):
        out = _links(nodes, *args, **options)
        found.append(({r.fp for r in nodes.collect()}, {(r[0], r[1]) for r in out.collect()}))
        return out

    monkeypatch.setattr(simhash, "links", searched)
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.by_copies(spark, frame, "").collect()}
    assert kept == {i for i, g in enumerate(plain_groups(texts)) if i == g}
    prints = [simhash.fingerprint(t, 5) for t in texts]
    [(fps, pairs)] = found
    assert fps == set(map(simhash.signed, prints))
    assert pairs and all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in pairs)
    # the links span the components that comparing all fingerprints gives
    root = {p: p for p in prints}
    for p in root:
        for q in list(root):
            if (p ^ q).bit_count() <= 4:
                low, high = sorted((root[p], root[q]))
                root = {k: low if v == high else v for k, v in root.items()}
    span = {p: p for p in prints}
    for a, b in pairs:
        low, high = sorted((span[a & (1 << 64) - 1], span[b & (1 << 64) - 1]))
        span = {k: low if v == high else v for k, v in span.items()}
    assert span == root
