"""Sets in long form: which items occur together, and who holds all of a list.

Rows are (owner, item). Items are numbered, an owner's set is a bit map of 64-bit words, and both questions are answered
on bit maps: equal sets are counted before any pair is formed, and containment is a comparison of words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions.columns import name

WORD_BITS = 64
#: Items whose numbers are broadcast to the rows; more of them are joined by a shuffle.
BROADCAST_ITEMS = 100_000
#: Items that one window numbers; more of them are dealt over several.
WINDOW_ITEMS = 100_000


def _word(number: Column) -> Column:
    return F.floor(number / WORD_BITS).cast("int")


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(WORD_BITS)).cast("int"))


def supports(pairs: DataFrame, owners: Sequence[str], item: str, min_support: int) -> DataFrame:
    """``item, support`` of items with at least so many owners. Repeated rows count once; null is no item."""
    once = pairs.where(F.col(name(item)).isNotNull()).select(*map(name, owners), name(item)).distinct()
    counts = once.groupBy(name(item)).agg(F.count(F.lit(1)).alias("support"))
    return counts.where(F.col("support") >= min_support)


def cooccurrence(pairs: DataFrame, owners: Sequence[str], item: str, min_support: int = 1, max_items: int = BROADCAST_ITEMS) -> DataFrame:
    """``item_a, item_b, n_both, n_a, n_b`` for every two items (a before b) that at least ``min_support`` owners share.

    An item with fewer owners than that is in no such pair, so it goes before sets are formed: an exact bound. Owners with
    equal sets are one row with a count from then on, and pairs are formed once for each different set. At most
    ``max_items`` items are allowed to remain; more of them are an error, as their number is broadcast and their pairs
    are its square.
    """
    items = supports(pairs, owners, item, max(min_support, 1))
    numbered = items.withColumn("_no", F.row_number().over(Window.orderBy(name(item))) - 1)
    allowed = F.assert_true(F.col("_no") < max_items, F.lit(f"more than {max_items} items: raise min_support"))
    numbered = numbered.where(allowed.isNull())
    held = pairs.select(*map(name, owners), F.col(name(item)).alias("_item"))
    held = held.join(F.broadcast(numbered.select(F.col(name(item)).alias("_item"), "_no")), "_item")
    words = held.groupBy(*map(name, owners), _word(F.col("_no")).alias("_w")).agg(F.bit_or(_bit(F.col("_no"))).alias("_bits"))
    sets = words.groupBy(*map(name, owners)).agg(F.sort_array(F.collect_list(F.struct("_w", "_bits"))).alias("_set"))
    different = sets.groupBy("_set").agg(F.count(F.lit(1)).alias("_owners"))
    places = F.sequence(F.lit(0), F.lit(WORD_BITS - 1))
    members = F.flatten(F.transform("_set", lambda w: F.transform(F.filter(places, lambda i: F.getbit(w["_bits"], i) == 1), lambda i: w["_w"] * WORD_BITS + i)))
    firsts = different.select("_owners", members.alias("_all")).select("_owners", "_all", F.posexplode("_all").alias("_at", "_a"))
    both = firsts.select("_owners", "_a", F.explode(F.slice("_all", F.col("_at") + 2, F.size("_all"))).alias("_b"))
    counts = both.groupBy("_a", "_b").agg(F.sum("_owners").alias("n_both")).where(F.col("n_both") >= min_support)

    def side(letter: str) -> DataFrame:
        return F.broadcast(numbered.select(F.col("_no").alias(f"_{letter}"), F.col(name(item)).alias(f"item_{letter}"), F.col("support").alias(f"n_{letter}")))

    return counts.join(side("a"), "_a").join(side("b"), "_b").select("item_a", "item_b", "n_both", "n_a", "n_b")


def _numbered(items: DataFrame) -> DataFrame:
    """``_item, _w, _bit`` for each row of ``_item``: a word's number and a bit of that word which no other item has.

    Up to ``WINDOW_ITEMS`` items are numbered in one window; more are dealt by hash, so that no window gets them all.
    """
    parts = items.agg(F.floor(F.count(F.lit(1)) / WINDOW_ITEMS) + 1).scalar()
    dealt = items.withColumn("_part", F.pmod(F.xxhash64("_item"), parts))
    placed = dealt.withColumn("_no", F.row_number().over(Window.partitionBy("_part").orderBy("_item")) - 1)
    return placed.select("_item", (F.floor(F.col("_no") / WORD_BITS) * parts + F.col("_part")).alias("_w"), _bit(F.col("_no")).alias("_bit"))


def holders(pairs: DataFrame, owners: Sequence[str], item: str, wanted: DataFrame, profile: str, short: bool = False) -> DataFrame:
    """``owners, profile`` for each owner who holds all items of a profile; ``wanted`` has rows (profile, item).

    Division by bit maps: the wanted items are numbered, for all profiles alike, so that an owner's hits are one set of
    words, however many profiles ask for them. A profile is a mask for each of its words, and the owner holds all if as
    many words contain their mask as the profile has. Any number of items and of profiles; an owner is in the
    result only if it has a row in ``pairs``. A null item is no wish and nothing that one can hold; a profile with no
    item but null is held by every owner. A ``short`` list is broadcast whatever Spark's threshold: shuffled by few
    items or words, all rows would meet in as few tasks. Others are left to the threshold.
    """
    listed = F.broadcast if short else lambda rows: rows
    wishes = wanted.select(F.col(name(profile)).alias("_p"), F.col(name(item)).alias("_item")).distinct()
    numbered = _numbered(wishes.where(F.col("_item").isNotNull()).select("_item").distinct())
    # A pair that no profile asks for sets no bit; its owner is kept for the profiles that wish nothing.
    held = pairs.select(*map(name, owners), F.col(name(item)).alias("_item")).join(listed(numbered), "_item", "left")
    bits, word = F.coalesce("_bit", F.lit(0).cast("long")), F.coalesce("_w", F.lit(0).cast("long"))
    words = held.groupBy(*map(name, owners), word.alias("_w")).agg(F.bit_or(bits).alias("_bits"))

    masks = wishes.join(numbered, "_item").groupBy("_p", "_w").agg(F.bit_or("_bit").alias("_mask"))
    open_profiles = wishes.groupBy("_p").agg(F.count("_item").alias("_items")).where("_items = 0").select("_p")
    last_word = numbered.agg(F.coalesce(F.max("_w"), F.lit(0).cast("long"))).scalar()
    every_word = F.explode(F.sequence(F.lit(0).cast("long"), last_word)).alias("_w")
    masks = masks.unionByName(open_profiles.select("_p", every_word, F.lit(0).cast("long").alias("_mask")))
    masks = masks.withColumn("_size", F.count_if(F.col("_mask") != 0).over(Window.partitionBy("_p")))

    inside = words.join(listed(masks), "_w").where(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
    found = inside.groupBy(*map(name, owners), "_p").agg(F.count_if(F.col("_mask") != 0).alias("_hits"), F.first("_size").alias("_size"))
    return found.where(F.col("_hits") == F.col("_size")).select(*map(name, owners), F.col("_p").alias(profile))
