"""Ranked lexical search with the Best Position Algorithm over impact lists.

A term's impact in a document is a whole number that grows with its occurrences and falls with the document's length; a
document's score for an item is the weighted sum of the impacts of the item's terms. Corpus counts and document
frequencies come from all documents first. Then every task searches its own documents, a bounded part at a time, which
splits the list of a frequent term over all tasks:

- the part's postings become impact lists, largest impact first, beside the documents' own rows for direct access;
- for an item, all lists are read from their best position on: the end of the unbroken run of positions seen so far. A
  document met for the first time is looked up in its own row, which gives its whole score and marks its positions in
  all the other lists as seen, so best positions move on over what other lists have shown;
- no unseen document can score more than the weighted impacts at the first unseen positions together. Reading ends when
  this is strictly below the k-th best score (equal scores are ordered by id, so at equality reading goes on).

The best k of an item so far are kept from part to part, so later parts end sooner; the tasks' best rows are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paylens.llm.common import map_in_arrow, text_bytes, written

#: Items are searched for in blocks of about so many different terms per item, summed up: what a broadcast holds.
BLOCK_TERMS = 1 << 18
#: Postings of a part of the documents that is indexed at once.
PART = 1 << 21
#: Positions read from each list in the first step; steps double.
STEP = 16
#: Bytes of a text whose words are held at once.
TEXT_BYTES = 1 << 20
_LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(b if b >= 0x80 or b in _LETTERS else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, in lists of bounded size: runs of ASCII letters, digits and bytes of other characters; A-Z in lower case."""
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= TEXT_BYTES else folded.find(b" ", at + TEXT_BYTES)
        end = end if end >= 0 else len(folded)
        yield folded[at:end].split()
        at = end


def bags(items: DataFrame) -> DataFrame:
    """(item_id, bag, terms, counts) of the different rows of items that hold a term; bag is equal for equal contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch["text"].to_pylist():
                bag: Counter = Counter()
                for some in words(text or b""):
                    bag.update(some)
                found.append(sorted(bag.items()))
            columns = [batch["item_id"], pa.array([[t for t, _ in b] for b in found], pa.list_(pa.binary())), pa.array([[n for _, n in b] for b in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "terms", "counts"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    found = map_in_arrow(rows, run, "item_id long, terms array<binary>, counts array<long>").filter("size(terms) > 0")
    text = F.concat_ws(" ", F.transform("terms", F.hex), F.col("counts").cast("array<string>"))
    return found.withColumn("bag", F.sha2(text, 256)).dropDuplicates(["item_id", "bag"])


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of documents with a term: n counts all, terms and counts are those of the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in batches:
            lengths, terms, counts, ends = [], [], [], [0]
            for text in batch["text"].to_pylist():
                n, bag = 0, Counter()
                for some in words(text_bytes(text) if isinstance(text, str) else text or b""):
                    n += len(some)
                    bag.update(map(number, some))
                bag.pop(None, None)
                lengths.append(n), terms.extend(bag), counts.extend(bag.values()), ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((terms, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_in_arrow(rows, run, "doc_id long, n long, terms array<int>, counts array<long>").filter("n > 0")


def weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


def impacts(counts: np.ndarray, lengths: np.ndarray, documents: int, words_in_all: int) -> np.ndarray:
    """Impacts of postings from their counts and their documents' lengths, all in whole numbers."""
    wide = int(lengths.max(initial=0)) * documents * 25 >= 1 << 63
    relative = (25 * documents * (lengths.astype(object) if wide else lengths)) // words_in_all
    return (1_000_000_000 * counts) // (1000 * counts + 12 * (75 + relative.astype(np.int64)))


@dataclass
class Part:
    """Impact lists of some documents, and their rows; positions number the postings by (term, impact descending)."""

    ids: np.ndarray  # of documents; -1 where missing, then absent is set
    absent: np.ndarray
    row_at: np.ndarray  # first posting of each document, then the end
    term: np.ndarray  # of postings by document
    impact: np.ndarray
    position: np.ndarray
    list_at: np.ndarray  # first position of each term, then the end
    listed: np.ndarray  # document at a position
    height: np.ndarray  # impact at a position

    @classmethod
    def of(cls, ids, absent, sizes, term, impact, n_terms: int) -> Part:
        row_at = np.r_[0, np.cumsum(sizes)]
        by_list = np.lexsort((-impact, term))
        position = np.empty(len(term), np.int64)
        position[by_list] = np.arange(len(term))
        list_at = np.searchsorted(term[by_list], np.arange(n_terms + 1))
        return cls(ids, absent, row_at, term, impact, position, list_at, np.repeat(np.arange(len(ids)), sizes)[by_list], impact[by_list])

    def rows(self, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the documents, and which of these each belongs to."""
        sizes = self.row_at[documents + 1] - self.row_at[documents]
        owner = np.repeat(np.arange(len(documents)), sizes)
        return np.arange(len(owner)) + np.repeat(self.row_at[documents] - np.r_[0, np.cumsum(sizes)[:-1]], sizes), owner


class Best:
    """The k best (score, missing id, id), best first: higher scores, then smaller ids, missing ids last."""

    def __init__(self, k: int):
        self.k, self.score = k, np.zeros(0, np.int64)
        self.absent, self.ids = np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, absent: np.ndarray, ids: np.ndarray) -> None:
        if len(self.score) == self.k:  # most documents are told off by their score
            near = score >= self.score[-1]
            score, absent, ids = score[near], absent[near], ids[near]
        score, absent, ids = np.r_[self.score, score], np.r_[self.absent, absent], np.r_[self.ids, ids]
        order = np.lexsort((ids, absent, -score))[: self.k]
        self.score, self.absent, self.ids = score[order], absent[order], ids[order]

    def beats(self, bound: int) -> bool:
        """Whether a document of this score or less cannot come in."""
        return len(self.score) == self.k and bound < int(self.score[-1])


def best_positions(part: Part, terms: np.ndarray, weights: np.ndarray, weight_of: np.ndarray, best: Best) -> int:
    """Add the part's best documents for the item with these weighted terms to `best`; returns how many were looked up.

    weight_of is an array of zeros over all terms for the item to use; it is left as it was.
    """
    starts, ends = part.list_at[terms], part.list_at[terms + 1]
    some = (ends > starts) & (weights > 0)
    terms, weights, at, ends = terms[some], weights[some], starts[some].copy(), ends[some]
    weight_of[terms] = weights
    seen = np.zeros(len(part.term) + 1, bool)
    met = np.zeros(len(part.ids), bool)
    looked_up, step = 0, STEP
    while True:
        # The first unseen position of each list bounds what is left in it.
        open_lists = at < ends
        bound = int((weights[open_lists] * part.height[at[open_lists]]).sum())
        if bound == 0 or best.beats(bound):
            break
        reach = np.minimum(at + step, ends)
        new = np.unique(np.concatenate([part.listed[a:b] for a, b in zip(at, reach)]))
        new = new[~met[new]]
        met[new] = True
        looked_up += len(new)
        found, owner = part.rows(new)
        gain = weight_of[part.term[found]]
        mine = gain > 0
        found, owner, gain = found[mine], owner[mine], gain[mine]
        seen[part.position[found]] = True
        score = np.zeros(len(new), np.int64)
        np.add.at(score, owner, gain * part.impact[found])
        best.add(score, part.absent[new], part.ids[new])
        for i in np.flatnonzero(open_lists):  # on to the best position
            run = seen[at[i] : ends[i]]
            first = int(run.argmin()) if len(run) else 0
            at[i] = ends[i] if len(run) and run[first] else at[i] + first
        step *= 2
    weight_of[terms] = 0
    return looked_up


def _search(rows: DataFrame, asked: list[tuple[str, list[int], list[int]]], weights: np.ndarray, documents: int, words_in_all: int, k: int) -> DataFrame:
    """(bag, doc_id, score): the best k of each task's rows (doc_id, n, terms, counts) for each of asked (bag, terms, counts)."""
    sent = rows.sparkSession.sparkContext.broadcast(([(b, np.array(t), np.array(c) * weights[t]) for b, t, c in asked], weights))
    names = ["bag", "doc_id", "score"]

    def parts(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[Part]:
        held: list[tuple] = []

        def part() -> Part:
            ids, absent, lengths, sizes, term, count = map(np.concatenate, zip(*held))
            impact = impacts(count, np.repeat(lengths, sizes), documents, words_in_all)
            held.clear()
            return Part.of(ids, absent, sizes, term, impact, n_terms)

        for batch in batches:
            ends = batch["terms"].offsets.to_numpy().astype(np.int64)
            for lo in range(0, batch.num_rows, 1024):
                hi = min(lo + 1024, batch.num_rows)
                ids = batch["doc_id"].slice(lo, hi - lo)
                flat = slice(ends[lo], ends[hi])
                held.append(
                    (
                        ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch["n"].to_numpy()[lo:hi], np.diff(ends[lo : hi + 1]),
                        batch["terms"].values.to_numpy()[flat], batch["counts"].values.to_numpy()[flat],
                    )
                )
                if sum(len(h[4]) for h in held) >= PART:
                    yield part()
        if held:
            yield part()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        found = [Best(k) for _ in items]
        weight_of = np.zeros(len(weights), np.int64)
        for part in parts(batches, len(weights)):
            for best, (_, terms, weighted) in zip(found, items):
                best_positions(part, terms, weighted, weight_of, best)
        for best, (bag, _, _) in zip(found, items):
            n = int((best.score > 0).sum())
            ids = pa.array(best.ids[:n], mask=best.absent[:n])
            yield pa.RecordBatch.from_arrays([pa.array([bag] * n, pa.string()), ids, pa.array(best.score[:n])], names=names)

    return map_in_arrow(rows, run, "bag string, doc_id long, score long")


def _top(found: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents with the highest scores above 0, best first.

    Equal scores go by ascending doc_id, missing ids last. A null or empty text has no terms: as a document it counts
    nowhere, as an item it finds nothing. Every row of docs is a document, also where ids repeat; rows of items that are
    equal in id and terms are one item, others are items of their own, also where ids repeat or are missing. Texts of any length are read whole. Empty tables give
    no rows. Other columns are not read. Items of equal contents are searched once, in blocks of about block_terms
    different terms per item, each block a pass over the documents.
    """
    spark = docs.sparkSession
    asked = written(bags(items), "items")
    different = asked.groupBy("bag").agg(F.first("terms").alias("terms"), F.first("counts").alias("counts"))
    different = written(different, "bags")
    size = different.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = math.ceil(size / block_terms)
    result = spark.createDataFrame([], "bag string, doc_id long, score long, rank int")
    for block in range(n_blocks):
        part = different.filter(F.pmod(F.xxhash64("bag"), F.lit(n_blocks)) == block)
        some = [(r.bag, [bytes(t) for t in r.terms], list(r.counts)) for r in part.collect()]  # as many terms as a block has
        vocabulary = {term: i for i, term in enumerate(sorted({t for _, terms, _ in some for t in terms}))}
        rows = written(postings(docs, vocabulary), "postings")
        total = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not total[0] or not some:
            continue
        having = rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # one row a term of the block
        weights = np.zeros(len(vocabulary), np.int64)
        for term, n in having:
            weights[term] = weight(total[0], n)
        numbered = [(bag, [vocabulary[t] for t in terms], counts) for bag, terms, counts in some]
        best = written(_top(_search(rows, numbered, weights, total[0], total[1], k), "bag", k), "ranked")
        result = result.unionByName(best)
    return asked.select("item_id", "bag").join(result, "bag").select("item_id", "rank", "doc_id", "score")
