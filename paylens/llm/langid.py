"""Language identification: known words by log frequency, unseen words by character n-grams, longest first.

The classifier is fitted on a bounded sample: for each language the `per_language` labelled training rows with the
smallest hash of doc_id. Word counts and n-gram counts by language are made by Spark; the model, whose size the sample
bounds, is broadcast. A word of the model scores its log frequency in each language. An unseen word falls back to its
n-grams (of the word between marks), from the longest length down, to the first length with a known n-gram. A text's
score adds up its words; all its words count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens.llm.common import map_in_arrow

PER_LANGUAGE = 400
LONGEST = 4
UNKNOWN = "und"
#: Unseen words whose fallback a task remembers.
REMEMBERED = 1 << 16

_word = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


class Model:
    """Log frequencies by language of words and n-grams."""

    def __init__(self, counts: dict[str, dict[str, int]], longest: int = LONGEST):
        self.languages = sorted(counts)
        k = len(self.languages)
        grams: list[dict[str, np.ndarray]] = [{} for _ in range(longest + 1)]
        words: dict[str, np.ndarray] = {}
        for j, lang in enumerate(self.languages):
            for word, n in counts[lang].items():
                words.setdefault(word, np.zeros(k))[j] += n
                marked = f"^{word}$"
                for size in range(1, longest + 1):
                    for i in range(len(marked) - size + 1):
                        grams[size].setdefault(marked[i : i + size], np.zeros(k))[j] += n
        self.longest = longest
        self.words = self._logs(words)
        self.grams = [self._logs(g) for g in grams]

    @staticmethod
    def _logs(table: dict[str, np.ndarray]) -> tuple[dict[str, int], np.ndarray]:
        """Row numbers, and log of add-half frequencies less their mean over languages: only differences decide."""
        if not table:
            return {}, np.zeros((0, 1), np.float32)
        counts = np.array(list(table.values())) + 0.5
        logs = np.log(counts / counts.sum(axis=0))
        return dict(zip(table, range(len(table)))), (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)

    def unseen(self, word: str) -> np.ndarray:
        marked = f"^{word}$"
        for size in range(self.longest, 0, -1):
            index, logs = self.grams[size]
            known = [v for i in range(len(marked) - size + 1) if (v := index.get(marked[i : i + size])) is not None]
            if known:
                return logs[known].mean(axis=0, dtype=np.float64)
        return np.zeros(len(self.languages))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.fallback: dict[str, int] = {}
        self.index, self.matrix = model.words
        self.more = np.zeros((1024, len(model.languages)))

    def _unseen(self, word: str) -> int:
        at = self.fallback.get(word)
        if at is None:
            if len(self.fallback) >= REMEMBERED:
                self.fallback.clear()
            at = len(self.fallback)
            if at >= len(self.more):
                self.more = np.vstack([self.more, np.zeros_like(self.more)])
            self.more[at] = self.model.unseen(word)
            self.fallback[word] = at
        return at

    def __call__(self, text: str | None) -> tuple[str, float]:
        languages = self.model.languages
        counts = Counter(words_of(text)) if text else None
        if not counts or not languages:
            return UNKNOWN, 0.0
        known, known_n, total = [], [], np.zeros(len(languages))
        others: list[tuple[str, int]] = []
        for word, n in counts.items():
            at = self.index.get(word)
            if at is None:
                if not word.isalpha():  # digits of other kinds are no letters
                    word = "".join(filter(str.isalpha, word))
                if word:
                    others.append((word, n))
            else:
                known.append(at), known_n.append(n)
        if not known and not others:
            return UNKNOWN, 0.0
        if known:
            total += np.array(known_n) @ self.matrix[known]
        for lo in range(0, len(others), REMEMBERED):  # the memory may be emptied between parts only
            part = others[lo : lo + REMEMBERED]
            if len(self.fallback) + len(part) > REMEMBERED:
                self.fallback.clear()
            rows = [self._unseen(w) for w, _ in part]
            total += np.array([n for _, n in part]) @ self.more[rows]
        best = int(np.argmax(total))
        return languages[best], float(1 / np.exp(total - total[best]).sum())


def training_fold(doc_id: Column) -> Column:
    """False for held-out rows: those whose CRC-32 of the id as text leaves 2 when divided by 4 (null id: of '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 != 2


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> Model:
    """The model of docs' training rows with a non-null lang and doc_id."""
    usable = docs.filter(training_fold(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # One row for each language, fewer than the model holds: broadcast, so that rows are told off before any shuffle.
    # Four times the sample by hash value of the ids, however many rows each has (their estimated number is near enough), then exactly the sample by rank: the ranked rows of a language are bounded.
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    share = usable.groupBy("lang").agg((F.lit(4.0 * per_language) / F.approx_count_distinct("doc_id")).alias("share"))
    near = usable.select("lang", "doc_id", h.alias("h")).join(F.broadcast(share), "lang").filter(F.col("h") < F.col("share")).drop("share").distinct()
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language)
    chosen = usable.join(F.broadcast(ids.select("lang", "doc_id").distinct()), ["lang", "doc_id"], "left_semi")
    # The sample has at most per_language ids of each language, so its word counts are bounded by its texts.
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    counts: dict[str, dict[str, int]] = {}
    for lang, w, n in chosen.select("lang", word.alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1))).toLocalIterator():
        counts.setdefault(lang, {})[w] = n
    return Model(counts, longest)


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs (with a column text) and two columns: the language, the score. No letter, or null: 'und', 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    rows = docs.select(*kept)
    at = rows.columns.index("text")
    ddl = T.StructType([*rows.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(sent.value)
        for batch in batches:
            texts = batch.column(at)
            found = [score(x) for lo in range(0, len(texts), 64) for x in texts.slice(lo, 64).to_pylist()]
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return map_in_arrow(rows, run, ddl)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    score is the share of the best language among all (softmax of the scores), 0 for 'und'. Equal scores: the language
    that is first by code point. Without training rows every text is 'und'.
    """
    out = predict(docs.select("doc_id", "text"), fit(docs, per_language, longest))
    return out.select("doc_id", (~training_fold(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> DataFrame:
    """The rows of docs whose text has a language; columns as in docs.

    Null texts and texts without a letter go. Without training rows there is no language to tell, and letters alone decide.
    """
    names = ("__lang_pred", "__lang_score")
    model = fit(docs, per_language, longest)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = predict(docs, model, names)
    return found.filter(F.col(names[0]) != UNKNOWN).drop(*names)
