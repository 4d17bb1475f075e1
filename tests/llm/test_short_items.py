"""Benchmark items of few words, repeated items, and numbers of rows without ids."""

import pytest

from paylens.llm import decontaminate, mixing

DOCS = [(1, "one two three four five six seven"), (2, "two Three"), (3, "three two"), (None, "x one two three"), (4, ""), (5, None), (6, "seven")]
ITEMS = [(10, "two three"), (10, "two three"), (11, "Seven"), (None, "one two three four"), (12, ""), (13, "one two three four five"), (14, "five six seven eight nine ten"), (10, "seven")]


def plain(docs, items):
    out = []
    for d, text in docs:
        words = decontaminate.words_of(text)
        for i, item in items:
            held = decontaminate.words_of(item)
            width = min(len(held), 5)
            own = {tuple(held[k : k + width]) for k in range(len(held) - width + 1)} if held else set()
            shared = own & {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
            if own and len(shared) >= 0.8 * len(own):
                out.append((d, i, len(own), len(shared), len(shared) / len(own)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_chars", [1 << 23, 20])
def test_short_and_repeated_items(spark, block_chars):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contained(docs, items, block_chars=block_chars)
    assert sorted(map(tuple, got.collect()), key=str) == plain(DOCS, ITEMS)
    held = {d for d, *_ in plain(DOCS, ITEMS)}
    assert sorted((r.doc_id for r in decontaminate.decontaminate(docs, items, block_chars=block_chars).collect()), key=str) == sorted((d for d, _ in DOCS if d not in held), key=str)


def test_one_item_on_many_rows_is_searched_once(spark):
    items = spark.createDataFrame([(1, "two three")], "item_id long, text string").crossJoin(spark.range(5000)).select("item_id", "text")
    sent = list(decontaminate._blocks(items, 100))
    assert [b.value for b in sent] == [[(1, "two three")]]
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert decontaminate.contained(docs, items).count() == 5000 * 3


def test_rows_without_an_id_have_numbers_of_their_own(spark):
    df = spark.range(1000).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text")
    u = df.select(mixing.uniform(df.doc_id, df.text).alias("u")).distinct()
    assert u.count() == 1000 and u.where("u <= 0 OR u >= 1").isEmpty()
