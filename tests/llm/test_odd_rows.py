"""Odd rows: clashing columns, repeated and missing ids, empty tables; defined results for each."""

import pytest
from pyspark.sql import functions as F

from paylens.llm import ann, chat, decontaminate, html_extract, langid, mixing, pii, sharding, simhash, suffix_dedup

LONG = " ".join(f"term{i}" for i in range(80))
OTHER = " ".join(f"other{i}" for i in range(80))
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ["f", "last", "whole", "rest", "_s", "_t", "q", "h", "u", "gap", "copies", "Taken", "fp", "root", "hash", "id", "item_id", "slot", "shard", "lang_pred"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, LONG, "en", "a"), (1, OTHER, "en", "a"), (1, OTHER, "en", "a"), (2, LONG, "en", "b"), (3, "plain words that nobody else has written here", "en", None),
        (None, OTHER, None, "b"), (None, "nothing names this text at all but it is read", None, "b"), (None, None, None, None), (4, "", "en", "a"),
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def clashing(rows):
    # Names of a plan's own columns, as a user's columns; distinct without regard to case.
    return rows.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)))


def test_one_row_of_each_component_stays(rows):
    kept = simhash.drop_near_duplicates(rows)
    assert kept.columns == rows.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    # Two texts under id 1 are no near copies of each other: both stay, once. One of the texts without words stays.
    want = [(1, LONG), (1, OTHER), (3, rows.filter("doc_id = 3").first().text), (4, ""), (None, "nothing names this text at all but it is read")]
    assert got == sorted(want, key=str)


def test_rows_are_judged_by_their_own_text(spark, rows):
    items = spark.createDataFrame([(1, " ".join(LONG.split()[10:40])), (None, "nothing names this text at all")], "item_id long, text string")
    for size in (1 << 23, 60):
        got = sorted(str(r.text) for r in decontaminate.decontaminate(rows, items, block_chars=size).collect())
        assert got == sorted([OTHER, OTHER, OTHER, "plain words that nobody else has written here", "None", ""])
    assert decontaminate.decontaminate(rows, items.limit(0)).count() == rows.count()


def test_without_training_rows_letters_decide(rows):
    kept = langid.drop_unidentified(rows.withColumn("lang", F.lit(None).cast("string")))
    assert kept.columns == rows.columns and kept.count() == rows.filter("text <> ''").count()


def test_one_id_on_many_rows_trains(spark):
    df = spark.createDataFrame([(7, "le chat noir", "fr", "a")] * 50 + [(8, "the black cat", "en", "a"), (9, "the red cat", "en", "a")], SCHEMA)
    got = langid.identify(df, per_language=2).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {7: 50, 8: 1, 9: 1}


@pytest.mark.parametrize(
    "stage",
    [
        langid.drop_unidentified,
        simhash.drop_near_duplicates,
        mixing.take,
        lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([(1, OTHER)], "item_id long, text string")),
    ],
    ids=["language", "simhash", "mixing", "decontamination"],
)
def test_clashing_columns_pass_through(rows, clashing, stage):
    plain, more = stage(rows), stage(clashing)
    assert more.columns == clashing.columns
    text = lambda df: sorted(str((r.doc_id, r.text)) for r in df.collect())
    assert text(plain) == text(more)


def test_clashing_columns_of_other_operators(clashing):
    n = clashing.count()
    assert mixing.mix(clashing).count() == n and sharding.place(clashing).count() == n
    assert pii.find(clashing).count() == n and suffix_dedup.remove_repeats(clashing).count() == n
    assert langid.identify(clashing).count() == n and simhash.near_duplicates(clashing).count() == n


def test_maps_and_arrays_pass_through(rows):
    nested = rows.withColumn("m", F.create_map(F.lit("k"), F.lit(1))).withColumn("a", F.array(F.lit(1.5)))
    assert simhash.drop_near_duplicates(nested).columns == nested.columns and simhash.drop_near_duplicates(nested).count() == 5
    assert mixing.take(nested).columns == nested.columns


def test_empty_tables(spark, rows):
    none = rows.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    results = [
        langid.identify(none), langid.drop_unidentified(none), simhash.near_duplicates(none), simhash.drop_near_duplicates(none),
        decontaminate.contained(none, items), decontaminate.contained(rows, items), decontaminate.decontaminate(none, items), mixing.mix(none),
        mixing.take(none), sharding.place(none), pii.find(none), suffix_dedup.remove_repeats(none),
        html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")),
        chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
        ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0),
    ]
    assert [df.count() for df in results] == [0] * len(results)


def test_all_null_columns(rows):
    nulls = rows.select(*(F.lit(None).cast(t).alias(c) for c, t in rows.dtypes))
    n = rows.count()
    assert langid.identify(nulls).count() == simhash.near_duplicates(nulls).count() == mixing.mix(nulls).count() == pii.find(nulls).count() == n
    assert simhash.drop_near_duplicates(nulls).count() == 1 and langid.drop_unidentified(nulls).isEmpty() and mixing.take(nulls).count() >= 0


def test_texts_of_one_id_with_equal_short_hashes_stay_apart(spark):
    wide = spark.range(300_000).select(F.concat(*(F.sha2(F.concat(F.lit(k), F.col("id").cast("string")), 512) for k in "ab")).alias("text"))
    pairs = wide.groupBy(F.hash("text")).agg(F.collect_list("text").alias("two")).filter("size(two) = 2").collect()
    assert pairs
    a, b = pairs[0].two
    df = spark.createDataFrame([(None, a, "en", "a"), (None, b, "en", "a"), (5, a + "and more", "en", "a")] + [(None, LONG + LONG, "en", "a")] * 40, SCHEMA)
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect()}
    n = len(LONG + LONG)
    assert got == {(None, 256, 256, 1), (None, 256, 0, 0), (5, 264, 256, 1), (None, n, n, 1)}


def test_one_id_on_many_training_rows_does_not_crowd_out_its_language(spark):
    data = [(8, "le chat noir", "fr", "a")] * 3000 + [(9, "the black cat", "en", "a")] * 3000 + [(None, "die schwarze katze", "de", "a")] * 3000
    data += [(i, "der graue hund", "de", "a") for i in range(20, 26)] + [(i, "un petit chien gris", "fr", "a") for i in range(30, 36)]
    got = {r.text: r.lang_pred for r in langid.predict(spark.createDataFrame(data, SCHEMA), langid.fit(spark.createDataFrame(data, SCHEMA), 2)).collect()}
    assert got["the black cat"] == "en" and got["der graue hund"] == "de" and got["un petit chien gris"] == "fr"
