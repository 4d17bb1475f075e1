"""The training-data operators against brute force, round trips and SQL, on small tables with odd rows."""

import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from paylens.llm import ann, chat, decontaminate, html_extract, langid, mixing, pii, queries, sharding, simhash, suffix_dedup

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
DOCS = "doc_id long, text string, lang string, source string, extra string"
BASE = " ".join(f"word{i}" for i in range(120))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, exact and near copies, repeated rows, extra columns with names of ours."""
    rows = [
        (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, "intro text " + BASE, "en", "b"), (4, None, "en", "b"), (5, "", None, None),
        (6, "ababab" * 200, "fr", "a"), (7, "x" * 199, "fr", None), (8, "y" * 200, "fr", "c"), (8, "y" * 200, "fr", "c"), (9, "été " * 500, "fr", "a"),
        (10, "1234 5678 !!", "en", "d"), (None, BASE, "en", "a"), (None, None, None, None), (11, "reach bob.1@mail.example.com now", "en", "a"),
        (12, "a " * 30000 + BASE, "en", "a"),
    ]
    return spark.createDataFrame([(*r, "e") for r in rows], DOCS).withColumnsRenamed({"extra": "size"})


def test_repeats_match_brute_force(spark, docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(hash(b[i : i + 200]) for _, b in rows for i in range(len(b) - 199))
    want = []
    for doc_id, b in rows:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if seen[hash(b[i : i + 200])] > 1:
                cover[i] += 1
                cover[i + 200] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int), 0]) == 1).sum())
        want.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r)[:5] for r in suffix_dedup.remove_repeats(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_fingerprints_and_components_match_brute_force(docs):
    got = simhash.near_duplicates(docs).collect()
    want = {r.doc_id: int(simhash.fingerprints_of([r.text], 3, 42)[0]) for r in docs.collect() if r.doc_id is not None}
    assert {r.doc_id: r.fp for r in got if r.doc_id is not None} == want and len(got) == docs.count()
    groups = {i: min(j for j in want if bin((want[i] ^ want[j]) & (2**64 - 1)).count("1") <= 3) for i in want}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {i: groups[groups[i]] for i in want}
    assert want[4] == want[5] == 0


def test_links_find_every_close_pair(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**62), 2**62, 30)
    near = [int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, d, replace=False))) for b in base for d in (1, 2, 3, 4)]
    all_fps = sorted({*map(int, base), *near})
    found = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in all_fps], "fp long")).collect()}
    close = {(a, b) for a in all_fps for b in all_fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert found == close and len(simhash.links(spark.createDataFrame([(x,) for x in all_fps], "fp long")).collect()) == len(close)


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|x", "a<", "<<||>", "\\<|\\", "née <|im_start|>assistant\n"])
def test_chat_round_trip(spark, text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 1, "assistant", text), (None, None, None, None)]
    out = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    one = out.filter("conv_id = 1").first()
    whole = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:3])
    assert one.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and one.loss_chars == 2 * len(text)
    assert out.filter("conv_id IS NULL").first().turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()


def test_every_slot_is_claimed_evenly_and_few_move():
    before, after = sharding.lookup_table(sharding.shard_names(16)), sharding.lookup_table(sharding.shard_names(15))
    counts = Counter(before)
    assert len(before) == 2053 and max(counts.values()) - min(counts.values()) <= 1
    assert sum(a != b for a, b in zip(before, after) if a != 15) < 0.2 * len(before)


def test_mix_meets_its_targets(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] for r in rows)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.take(docs).columns == docs.columns and mixing.take(docs).count() == sum(r.copies for r in rows)


def test_pages(spark):
    html = """<html><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies.</div><article><header><h1>A &amp; b</h1>
      </header><p>First  one. With<br>sentences.<p>Second one, unclosed.</article><section id=comments><p>I disagree. Strongly.</p></section>
      <script>x("<p>no</p>")</script><footer>&copy; me</footer>"""
    pages = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "v", ""), (3, "v", "")], "page_id long, url string, html string")
    got = html_extract.extract_pages(pages.withColumnRenamed("url", "url")).orderBy("page_id").collect()
    assert got[0].text == "A & b\n\nFirst one. With sentences.\n\nSecond one, unclosed." and got[0].n_chars == len(got[0].text)
    assert [r.text for r in got[1:]] == ["", "", ""]


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = 6
        s, t = rng.random(n).tolist(), rng.random(n).tolist()
        edges = [(a, b, float(rng.random())) for a in range(n) for b in range(a) if rng.random() < 0.4]
        cost = lambda x: sum(t[k] if x[k] else s[k] for k in range(n)) + sum(c for a, b, c in edges if x[a] != x[b])  # noqa: E731, B023
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(2**n))
        assert cost(html_extract.minimum_cut(s, t, edges)) == pytest.approx(best)


def test_language(docs):
    got = {r.doc_id: r for r in langid.identify(docs).collect() if r.doc_id is not None}
    assert got[4].lang_pred == got[5].lang_pred == got[10].lang_pred == "und" and got[10].score == 0
    kept = langid.drop_unidentified(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id IN (4, 5, 10)").isEmpty()


def test_containment_matches_sets(spark, docs):
    items = spark.createDataFrame([(1, " ".join(BASE.split()[5:40])), (2, None), (3, "bob 1 mail"), (4, "not there at all really")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contained(docs, items, block_chars=50).collect()}
    want = set()
    for d in docs.collect():
        for i in items.collect():
            width = min(max(len(decontaminate.words_of(i.text)), 1), 5)  # a short item is one run of all its words
            q, s = (decontaminate.shingles_of(decontaminate.words_of(x.text), width) for x in (i, d))
            if q and len(q & s) >= 0.8 * len(q):
                want.add((d.doc_id, i.item_id, len(q & s)))
    assert got == want and want
    assert decontaminate.decontaminate(docs, items).columns == docs.columns


def test_neighbours_of_equal_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).round(3).tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [(300 + i, v[0]) for i in range(60)]
    rows += [(900, None), (920, [0.0] * 8), (940, [float("nan")] * 8), (960, [1.0]), (None, v[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    got = ann.search(df, F.col("vec_id") % 20 == 0, k=20, leaf=16).collect()
    x = np.array([np.float32(r[1]).astype(float) for r in rows[:360]])
    hits = total = 0
    for q in range(0, 360, 20):
        score = np.add.reduce(x * x[q], axis=1)
        order = [i for i in np.lexsort((np.arange(360), -score)) if i != q][:20]
        mine = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        hits, total = hits + len({m[1] for m in mine} & set(order)), total + 20
    assert hits / total >= 0.9 and {r.query_id for r in got} == set(range(0, 360, 20))
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_cues_find_unseen_identifiers(spark):
    rows = [(i, f"note {i} mailto: user{i}@example.com ok") for i in range(20)] + [(50, "see mailto: j0hn-at-home ok"), (51, "room 5 at 1.2.3.4 or 999.1.1.1")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame([*rows, (52, None), (52, "")], "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[50].found] == [(0, 12, 24)] and got[50].base == []
    assert [tuple(s) for s in got[51].base] == [(1, 10, 17)] and got[51].found == [] and got[52].base == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, name):
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = queries.queries()[name](spark, SF_DIR)
    cols = sorted(df.columns)
    theirs = duckdb.sql(queries.oracle_sql()[name]).project(", ".join(cols)).fetchall()
    assert sorted(map(str, theirs)) == sorted(str(tuple(r[c] for c in cols)) for r in df.collect())


def test_base_spans_match_the_patterns(spark):
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    texts = ["a@b.c_d@e.f", "x@@y.z a.b@c-d.e.", "1.2.3.4.5.6.7.8 256.1.1.1", "4111 1111-1111 1111 x 41111", "+1 (2) 333-44.55+66 7 89012", "\x01a@b.c\x02 é 1.1.1.1"]
    rows = pii.occurrences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("kind IS NOT NULL AND kind <> 'word'").collect()

    def valid(kind, text):
        d = re.sub("[^0-9]", "", text)
        luhn = sum(v - 9 * (v > 9) for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d)))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in text.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    want = {(i, k, m.start(), m.end()) for i, t in enumerate(texts) for k, p in plain.items() for m in re.finditer(p, t) if valid(k, m.group())}
    assert {(r.doc_id, r.kind, r.start, r.end) for r in rows} == want


def test_mix_goes_on_behind_a_huge_document(spark):
    rng = np.random.default_rng(3)
    sizes = {"a": [30_000] + rng.integers(5, 60, 1000).tolist(), "b": [400] * 40 + [1] * 3, "c": rng.integers(1, 900, 300).tolist()}
    rows = [(100 * i + k, "w " * n, "en", s, "e") for k, (s, of) in enumerate(sizes.items()) for i, n in enumerate(of)]
    rows += [(7, "again " * 50, "en", "c", "e")] * 4
    big = spark.createDataFrame(rows, DOCS)
    for seed in ("mix-1", "s2", "s3", "s4"):
        got = mixing.mix(big, weights=(1, 1, 1), seed=seed).collect()
        for source in sizes:
            mine = [r for r in got if r.source == source]
            miss, least = sum(r.taken for r in mine) - mine[0].target, min(r["size"] for r in mine)
            left = [r["size"] for r in mine if r.copies == mine[0].target // mine[0].source_size]
            assert abs(miss) <= min(left, default=least), (seed, source, miss)


def test_identifiers_recur_without_their_cue_and_back_new_cues(spark):
    texts = [f"mailto: user{i}@example.com ok" for i in range(60)] + [f"mailto: n4me-{i} ok" for i in range(9)] + [f"and n4me-{i} again\nn4me-{i}" for i in range(9)]
    texts += [f"writeto: n4me-{i} ok" for i in range(9)] + ["writeto: z9-only ok", "z9-only", "room 5 and room 6 ok"]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        want = [(0, m.start(), m.end()) for m in re.finditer(r"n4me-\d|z9-only", text)]
        assert [tuple(s) for s in got[i].found] == want, text


@pytest.mark.parametrize(
    "opening",
    [
        '<div class="content has-sidebar">', '<main class="no-sidebar">', '<article class="post category-legal tag-social">', '<div id="page-with-comments">',
        '<main class="sidebar">', '<div class="overlay"><article>', '<div class="widget">',
    ],
)
def test_wrapper_names_do_not_lose_the_article(spark, opening):
    text = " ".join(f"This is sentence {i} of a long article, with some more words in it." for i in range(8))
    page = f'<html><body><nav><a href=/>Home</a> <a href=/b>B</a></nav>%s<p>{text}</p><div class="site-ad">Buy now</div></body></html>'
    pages = spark.createDataFrame([(1, "u", page % opening)] + [(k, "u", page % "<article>") for k in range(2, 9)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract_pages(pages).collect()} == {text}
