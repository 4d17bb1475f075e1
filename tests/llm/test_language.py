"""Language ID against a plain program written from the method, and its accuracy on the held-out fold."""

import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import regex
import xxhash
from pyspark.sql import functions as F

from paylens.llm import langid, queries

LONGEST = 4


def letters(text):
    return regex.findall(r"\p{L}+", (text or "").lower())


def held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


def sample(rows, per_language):
    """Of each language, the texts of the ids with the smallest hash among labelled rows of the training folds."""
    by_lang = defaultdict(lambda: defaultdict(list))
    for doc_id, lang, text in rows:
        if doc_id is not None and lang is not None and text is not None and not held_out(doc_id):
            by_lang[lang][doc_id].append(text)
    place = lambda i: (xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest() >> 11, i)
    return {lang: [t for i in sorted(ids, key=place)[:per_language] for t in ids[i]] for lang, ids in by_lang.items()}


def grams(word, size):
    marked = f"^{word}$"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def centred_logs(counts, languages):
    """Log of add-half frequencies by language, less their mean over languages, of every key that any language has."""
    keys = set().union(*counts.values())
    totals = {lang: sum(counts[lang].values()) + 0.5 * len(keys) for lang in languages}
    logs = {key: [math.log((counts[lang][key] + 0.5) / totals[lang]) for lang in languages] for key in keys}
    return {key: [x - sum(row) / len(row) for x in row] for key, row in logs.items()}


def predictions(rows, per_language):
    """(lang_pred, score) of every row, as the docstrings of langid describe them."""
    texts = sample(rows, per_language)
    languages = sorted(texts)
    words = {lang: Counter(w for t in texts[lang] for w in letters(t)) for lang in languages}
    by_word = centred_logs(words, languages)
    by_gram = {}
    for size in range(1, LONGEST + 1):
        counted = {lang: Counter() for lang in languages}
        for lang in languages:
            for word, n in words[lang].items():
                for gram in grams(word, size):
                    counted[lang][gram] += n
        by_gram[size] = centred_logs(counted, languages)

    def word_score(word):
        if word in by_word:
            return by_word[word], "word"
        for size in range(LONGEST, 0, -1):
            known = [by_gram[size][g] for g in grams(word, size) if g in by_gram[size]]
            if known:
                return [sum(column) / len(known) for column in zip(*known)], size
        return [0.0] * len(languages), 0

    out, used = [], Counter()
    for _, _, text in rows:
        found = letters(text)
        if not found:
            out.append(("und", 0.0, 1.0))
            continue
        total = [0.0] * len(languages)
        for word in found:
            scores, how = word_score(word)
            used[how] += 1
            total = [a + b for a, b in zip(total, scores)]
        share = [math.exp(x - max(total)) for x in total]
        ranked = sorted(total, reverse=True)
        out.append((languages[total.index(ranked[0])], 1 / sum(share), ranked[0] - ranked[1]))
    return out, used


def fixture(spark):
    """Given documents, and held-out rows of a few of their words, some of them changed so that no one has seen them."""
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text").collect()]
    rng, rows = random.Random(7), list(given)
    ids = (i for i in range(10**6, 10**7) if held_out(i))
    for _, _, text in given:
        for many in (1, 2, 4):
            words = [rng.choice((text or "x").split() or ["x"]) for _ in range(many)]
            rows.append((next(ids), None, " ".join(w if rng.random() < 0.4 else w[::-1] + w[:2] for w in words)))
    return rows + [(next(ids), None, t) for t in (None, "", "12 34", "qqzzxxjj", "1a2b", "ДОМ дом", "中文")] + [(8, "en", "one more row")] * 2


def test_scores_equal_a_plain_program(spark):
    rows = fixture(spark)
    df = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], "n int, doc_id long, lang string, text string")
    for per_language in (2, 400):
        model = langid.fit(df, per_language)
        got = {r.n: (r.lang_pred, r.score) for r in langid.predict(df, model).select("n", "lang_pred", "score").collect()}
        want, used = predictions(rows, per_language)
        assert len(got) == len(rows) and used["word"] and used[LONGEST] and sum(used[s] for s in range(LONGEST))
        for n, (lang, score, margin) in enumerate(want):
            assert abs(got[n][1] - score) < 1e-3, rows[n]
            assert got[n][0] == lang or margin < 1e-3, rows[n]
        assert len({round(score, 3) for _, score, _ in want}) > 50  # not only certain ones


def test_query_returns_the_plain_program_s_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text").collect()]
    got = {r.doc_id: r for r in queries.op7_language_id(spark, "/root/testdata/sf0.001").collect()}
    want, _ = predictions(rows, langid.PER_LANGUAGE)
    assert len(got) == len(rows)
    for (doc_id, _, _), (lang, score, margin) in zip(rows, want):
        assert got[doc_id].held_out == held_out(doc_id) and abs(got[doc_id].score - score) < 1e-3
        assert got[doc_id].lang_pred == lang or margin < 1e-3


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    true = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").filter("lang IS NOT NULL")
    judged = queries.op7_language_id(spark, sf_dir).filter("held_out AND lang_pred <> 'und'").join(true, "doc_id")
    n, right = judged.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right >= 0.98 * n
