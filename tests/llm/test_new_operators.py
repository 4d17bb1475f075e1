"""Centroid clustering, byte-level BPE and ranked search against brute force, the public library and SQL."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from paylens.llm import bpe, centroids, lexical, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op13_lexical_search"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(rel.columns)
    cols = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rel.project(cols).fetchall(), key=str)


# Centroid clustering


def lloyd(vectors: list[tuple], clusters: int, rounds: int, dim: int):
    """Plain whole-number rounds, every distance from scratch."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    by_hash = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=by_hash)[:clusters]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(members[k]) for x in zip(*members[k])] if k in members else c for k, c in enumerate(centres)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centres


def as_rows(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance").collect()), key=str)


@pytest.mark.parametrize("clusters,rounds", [(1, 2), (4, 3), (40, 5)])
def test_clusters_match_brute_force(spark, clusters, rounds):
    rng = np.random.default_rng(clusters)
    vectors = [(int(i), [float(np.float32(x)) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(60)]
    vectors += [(7, vectors[7][1])] * 3 + [(7, vectors[8][1]), (None, vectors[9][1]), (None, [0.0] * 6)] + [(200 + i, [0.5] * 6) for i in range(40)]
    vectors += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 5 + [float("nan")]), (304, [float("inf")] + [1.0] * 5), (305, [None] + [1.0] * 5)]
    want, centres = lloyd(vectors, clusters, rounds, 6)
    got, found = centroids.cluster(spark.createDataFrame([(*v, 0) for v in vectors], VECTORS).withColumn("v", F.lit(1)), clusters, rounds, dim=6)
    assert as_rows(got) == sorted(want, key=str) and found.tolist() == centres
    for row in got.collect():  # the updated products are those of the final centroids
        assert row.products == [sum(a * b for a, b in zip(row.v, c)) for c in centres]
    report = centroids.report(got, found).collect()
    assert sum(r.distance for r in report) == report[0].inertia and len(report) == len(want)
    assert {r.centroid_sha256 for r in report if r.cluster == 0} == {hashlib.sha256(",".join(map(str, centres[0])).encode()).hexdigest()}


def test_only_changed_components_count():
    rng = np.random.default_rng(1)
    vectors, before = rng.integers(-99, 99, (50, 8)), rng.integers(-99, 99, (3, 8))
    after = before.copy()
    after[1, [2, 5]] += [7, -4]
    assert (centroids.updated(vectors @ before.T, vectors, after - before) == vectors @ after.T).all()


def test_clusters_of_few_none_and_too_large_vectors(spark):
    rows = [(1, [0.5, 1.0], 0), (2, [3.0, 3.0], 0), (3, [1e9, 0.0], 0), (4, [3e38, 0.0], 0)]
    got, found = centroids.cluster(spark.createDataFrame(rows, VECTORS), dim=2)
    assert sorted(r.vec_id for r in got.collect()) == [1, 2] and len(found) == 2 and {r.distance for r in got.collect()} == {0}
    none, no_centres = centroids.cluster(spark.createDataFrame(rows[2:], VECTORS), dim=2)
    assert none.isEmpty() and not len(no_centres) and centroids.report(none, no_centres).isEmpty()
    nulls = spark.createDataFrame([(None, None, None)], VECTORS)
    assert centroids.report(*centroids.cluster(nulls)).isEmpty()


# Byte-level BPE


@pytest.fixture(scope="module")
def library():
    with open(bpe.VOCABULARY, "rb") as file:
        ranks = bpe.ranks_of(file.read())
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Tokenizer(ranks)


def ids_of(tokenizer, text):
    return np.frombuffer(tokenizer.encode(text), "<u4").tolist()


def test_ids_are_the_librarys(library):
    encoding, ours = library
    rng = random.Random(5)
    tokens = [t for t in ours.ranks if len(t) > 1]
    texts = ["", " ", "\n\n  x", "<|endoftext|>", "don't I'll", "a" * 5000, "ab" * 3000 + "aab" * 1000, "日本語テキスト", "é̂", "\x00\x1c\x85\xa0  x", "🙂🙂 ok"]
    texts += ["".join(rng.choice("abcdeèñ 'st\n09.,-") for _ in range(rng.randint(1, 300))) for _ in range(1500)]
    texts += [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 30))).decode("utf-8", "replace") for _ in range(1500)]
    texts += ["".join(rng.choice(letters) for _ in range(2000)) for letters in ("ab", "aab", "=-", " \n", "ing", "ée")]
    for text in texts:
        assert ids_of(ours, text) == encoding.encode_ordinary(text)
        assert ours.decode(ours.encode(text)) == text.encode()


def test_every_character_is_split_as_by_the_library(library):
    encoding, ours = library
    for start in range(0, 0x110000, 0x400):
        text = "".join(f"a{chr(c)}1 {chr(c)}{chr(c)} b" for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000)
        assert ids_of(ours, text) == encoding.encode_ordinary(text)


def plain_merges(ranks, piece):
    """Merge the neighbours of the lowest rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_small_vocabularies_match_plain_merging():
    rng = random.Random(3)
    for _ in range(60):
        tokens = [bytes([b]) for b in range(256)]
        for _ in range(rng.randint(0, 40)):  # each token joins two earlier ones, as merges do
            pair = rng.choice(tokens[97:100] + tokens[256:]) + rng.choice(tokens[97:100] + tokens[256:])
            if pair not in tokens and len(plain_merges({t: i for i, t in enumerate(tokens)}, pair)) == 2:
                tokens.append(pair)
        ranks = {t: i for i, t in enumerate(tokens)}
        ours = bpe.Tokenizer(ranks, r"[\s\S]+")
        for _ in range(60):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
            assert ours.merge(piece) == ([ranks[piece]] if piece in ranks else plain_merges(ranks, piece))


def test_a_token_that_merging_never_makes_is_a_whole_piece_only():
    tokens = [bytes([b]) for b in range(256)] + [b"abcd", b"ab"]
    ours = bpe.Tokenizer({t: i for i, t in enumerate(tokens)}, r"[a-z]+|[^a-z]+")
    assert ours.merge(b"abcd") == [256] and ours.merge(b"abcde") == [257, 99, 100, 101]


def test_vocabularies_without_all_bytes_are_refused():
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Tokenizer({b"a": 0, b"b": 1})


def test_encode_and_decode_tables(spark, library, monkeypatch):
    encoding, ours = library
    long = "word " * 3000 + "x" * 20000
    rows = [(1, "hello world", "k"), (1, "hello world", "k"), (None, None, None), (2, "", "k"), (3, long, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumn("row", F.lit(1)).withColumn("source", F.lit(2))
    out = bpe.decode(bpe.encode(df))
    assert out.columns == ["doc_id", "text", "row", "source", "ids", "n_tokens", "decoded"]
    for r in out.collect():
        want = encoding.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want) and bytes(r.decoded) == (r.text or "").encode() and (r.row, r.source) == (1, 2)
    assert bpe.decode(bpe.encode(df.limit(0))).isEmpty() and out.count() == len(rows)
    broken = spark.sql("select cast(unhex('61FF62') as string) as text")
    assert bytes(bpe.decode(bpe.encode(broken)).first().decoded) == "a�b".encode()
    monkeypatch.setattr(bpe, "SPLIT_CHARS", 100)
    monkeypatch.setattr(bpe, "GROUP", 7)
    assert ours.encode(long) == np.array(encoding.encode_ordinary(long), "<u4").tobytes()


def test_query_matches_the_library(spark, library):
    got = {r.doc_id: r for r in queries.op12_byte_bpe(spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids = library[0].encode_ordinary(doc.text or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((doc.text or "").encode()).hexdigest())
        assert tuple(got[doc.doc_id])[1:] == want


# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    """Every item scored against every document."""
    bags = [(d, Counter(terms_of(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    all_words = sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in {(i, tuple(sorted(terms_of(t)))) for i, t in items}:
        scores = []
        for d, b, n in bags:
            m = 75 + (25 * n * len(bags)) // all_words
            score = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 12 * m)) for t in text if t in b)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("bag", F.lit("x"))


@pytest.mark.parametrize("k", [1, 3, 20])
def test_ranking_matches_brute_force(spark, k, monkeypatch):
    rng = random.Random(k)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(400)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120)))) for i in range(150)]
    docs += [(i + 500, docs[3][1]) for i in range(30)] + [(3, docs[3][1]), (None, docs[4][1]), (None, None), (900, ""), (901, "?! .."), (902, "Éa éA W1 w1\x85W1"), (903, "w1 " * 5000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(15)]
    items += [(3, items[3][1]), (3, "w1 w1 w2"), (None, "w1"), (50, None), (51, ""), (52, "nowhere"), (53, "éA W1!w1"), (54, docs[3][1])]
    want = ranked(docs, items, k)
    frames = tables(spark, docs, items)
    assert sorted(map(tuple, lexical.search(*frames, k=k).collect()), key=str) == want
    assert sorted(map(tuple, lexical.search(*frames, k=k, block_terms=40).collect()), key=str) == want


def test_parts_of_any_size_give_the_same_best():
    rng = np.random.default_rng(2)
    n, terms = 400, 30
    sizes = rng.integers(0, 12, n)
    term = np.concatenate([rng.choice(terms, s, replace=False) for s in sizes])
    impact = rng.integers(1, 60, len(term)) * 10
    asked, weights = np.array([0, 3, 4, 9, 20]), np.array([5, 1, 0, 7, 2])
    weight_of = np.zeros(terms, np.int64)
    weight_of[asked] = weights
    score = np.zeros(n, np.int64)
    np.add.at(score, np.repeat(np.arange(n), sizes), weight_of[term] * impact)
    want = sorted(((-s, i) for i, s in enumerate(score.tolist()) if s))[:20]
    ends = np.r_[0, np.cumsum(sizes)]
    for size in (1, 7, 100, 400):
        best, zeros, looked_up = lexical.Best(20), np.zeros(terms, np.int64), 0
        for lo in range(0, n, size):
            some = slice(ends[lo], ends[min(lo + size, n)])
            ids = np.arange(lo, min(lo + size, n))
            part = lexical.Part.of(ids, np.zeros(len(ids), bool), sizes[lo : lo + size], term[some], impact[some], terms)
            looked_up += lexical.best_positions(part, asked, weights, zeros, best)
        assert [(-s, i) for s, i in zip(best.score.tolist(), best.ids.tolist()) if s] == want and not zeros.any()


def test_reading_stops_early():
    rng = np.random.default_rng(4)
    n = 20000
    impact = np.sort(rng.pareto(1.5, 2 * n) * 100).astype(np.int64)[::-1].reshape(n, 2).ravel()
    part = lexical.Part.of(np.arange(n), np.zeros(n, bool), np.full(n, 2), np.tile([0, 1], n), impact, 2)
    assert lexical.best_positions(part, np.array([0, 1]), np.array([3, 2]), np.zeros(2, np.int64), lexical.Best(20)) < n / 20


def test_long_words_and_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(lexical, "TEXT_BYTES", 16)
    text = "Abc " * 9 + "x" * 50 + " é,é" * 9 + "END"
    assert [w.decode() for some in lexical.words(text.encode()) for w in some] == terms_of(text)


def test_lengths_beyond_64_bits_are_whole():
    got = lexical.impacts(np.array([2]), np.array([10**9]), 10**11, 10**13)
    assert got.tolist() == [(10**9 * 2) // (2000 + 12 * (75 + 25 * 10**20 // 10**13))]


def test_search_of_empty_tables(spark):
    docs, items = tables(spark, [(1, "a b")], [(1, "a")])
    nulls = tables(spark, [(None, None)], [(None, None)])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), nulls, (docs, nulls[1]), (nulls[0], items)):
        assert lexical.search(d, i).isEmpty()
