"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base entities (email, IP address, payment card, phone) are found by pattern and checked. They are the seeds, and so are
credentials (kind `secret`): long hexadecimal words whose cue names a credential. The last word before an entity, with
the marks that stand alone behind it (`token =`), is a lexical pattern (its cue), however long it is. Every word with a
digit or an @ is a possible identifier; its occurrences tie it to cues. This graph of cues and instances is scored in
rounds: a cue's confidence for a kind is the share of its occurrences in the whole corpus that instances of this kind
follow, weighted by the instances' scores; an instance's score is the chance that not all of its cues are wrong (seeds:
1). A cue takes part once enough different seeds or instances of high score follow it, at half the confidence or more.
Instances that score high enough are identifiers of that kind wherever they occur, outside base spans; so are
credentials among the seeds.

Positions come from a replacement that puts marks round all matches and a split at the marks: the lengths of the pieces
add up to offsets in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.llm.common import written

KINDS = ("email", "ip", "card", "phone")
CONFIDENCE = 0.8
SUPPORT = 3
ROUNDS = 3
#: Found kinds, base kinds first.
ALL_KINDS = (*KINDS, "secret")
#: Words of a credential, and the cues that name one.
SECRET = r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,128}$"
SECRET_CUE = r"(key|token|secret|password|passwd|pwd)\W*$"

#: Possessive forms of the contract's patterns; a look-behind stands where a match could only begin at a run's start.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "word": r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+",
}
OPEN, CLOSE = "\x01", "\x02"
#: Stands for the white space inside a cue.
GLUE = "\x1f"
#: A word with a letter or digit, and the words without any that follow it, up to white space at the end.
LAST_CUE = r"(?<!\S)([^\s\p{L}\p{N}]*+[\p{L}\p{N}]\S*+(?:\s++[^\s\p{L}\p{N}]++(?!\S))*+)\s++$"
#: White space before a word without letter or digit.
BEFORE_MARK = r"\s(?<!\s\s)\s*+(?=[^\s\p{L}\p{N}]++(?!\S))"
#: What stands round a word's core.
LEAD, TRAIL = r"^[^\p{L}\p{N}+]++", r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a check sum of 0 modulo 10."""
    ordered = F.split(F.reverse(digits), "(?!^)(?!$)")
    doubled = F.transform(ordered, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def is_valid(kind: Column, match: Column) -> Column:
    """Whether a match of a base pattern passes its check."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    # Lengths are compared before casts, as numbers may have any number of digits.
    ip = F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    card = F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", F.length(digits).between(9, 15)).otherwise(True)


def _parts(text: Column, kind: str) -> Column:
    """Structs (kind, n, part): the text before the first match, then each match, CLOSE and the text up to the next."""
    marked = F.regexp_replace(text, PATTERNS[kind], OPEN + "$0" + CLOSE)
    return F.transform(F.split(marked, OPEN), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("n"), x.alias("part")))


def _last_cue(text: Column) -> Column:
    """The cue at the end of a text; empty if there is none or no white space behind it."""
    cue = F.regexp_replace(F.lower(F.regexp_extract(text, LAST_CUE, 1)), r"\s++", GLUE)
    return F.when(F.right(text, F.lit(1)).rlike(r"\s"), cue).otherwise("")


def cues_of(docs: DataFrame) -> DataFrame:
    """(cue): every word of the texts, with the marks behind it, as _last_cue writes them."""
    joined = F.regexp_replace(F.lower(F.col("text").cast("string")), BEFORE_MARK, GLUE)
    return docs.select(F.explode(F.split(joined, r"\s++")).alias("cue"))


def occurrences(docs: DataFrame) -> DataFrame:
    """Stored rows (row_id, doc_id, kind, start, end, match, cue): all valid base entities, and all other words with a
    digit or @ that overlap none (kind 'word', without punctuation round them). Every row of docs has one more row here,
    with a null kind.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    text = F.when(text.rlike(f"[{OPEN}{CLOSE}]"), F.translate(text, OPEN + CLOSE, "\x03\x03")).otherwise(text)
    no_part = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("n"), F.lit("").alias("part"))
    t = F.col("t")
    parts = F.when(t.rlike("[0-9@]"), F.concat(F.array(no_part), *(_parts(t, k) for k in (*KINDS, "word")))).otherwise(F.array(no_part))
    part = F.col("p.part")
    match = F.when(F.col("p.n") > 0, F.substring_index(part, CLOSE, 1)).otherwise("")
    rest = F.substring_index(part, CLOSE, -1)
    found = (
        docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
        .select("row_id", "doc_id", F.explode(parts).alias("p"))
        .select("row_id", "doc_id", "p.kind", "p.n", match.alias("match"), F.length(rest).cast("long").alias("rest"), _last_cue(rest).alias("next_cue"))
    )
    # One shuffle, by row; both windows use its partitioning.
    found = found.repartition("row_id")
    order = Window.partitionBy("row_id", "kind").orderBy("n")
    word = F.col("kind") == "word"
    core = F.regexp_replace(F.regexp_replace("match", LEAD, ""), TRAIL, "")
    lead = F.when(word, F.length(F.regexp_extract("match", LEAD, 0))).otherwise(0)
    placed = (
        found.withColumn("start", F.sum(F.length("match") + F.col("rest")).over(order) - F.col("rest") - F.length("match") + lead)
        # An entity has a cue only if white space stands before it.
        .withColumn("cue", F.lag("next_cue").over(order))
        .withColumn("match", F.when(word, core).otherwise(F.col("match")))
        .withColumn("end", F.col("start") + F.length("match"))
        .filter(F.col("kind").isNull() | (F.col("n") > 0) & is_valid(F.col("kind"), F.col("match")))
    )
    at = Window.partitionBy("row_id").orderBy("start")
    last_end = F.max(F.when(~word, F.col("end"))).over(at.rangeBetween(Window.unboundedPreceding, 0))
    next_start = F.min(F.when(~word, F.col("start"))).over(at.rangeBetween(0, Window.unboundedFollowing))
    over = F.coalesce(last_end > F.col("start"), F.lit(False)) | F.coalesce(next_start < F.col("end"), F.lit(False))
    kept = placed.withColumn("over", over).filter(F.col("kind").isNull() | ~word | ~F.col("over"))
    return written(kept.select("row_id", "doc_id", "kind", "start", "end", "match", "cue"), "occurrences")


def discovered(docs: DataFrame, found: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(match, kind): unseen identifiers, with the kind that scores best (of equals, the first by name), and credentials
    among the seeds.

    A cue takes part for a kind if at least `support` different seeds, or instances that the round before gave a score
    of `confidence` for this kind, follow it.
    """
    base = F.col("kind") != "word"
    seen = found.filter("kind IS NOT NULL")
    secret = ~base & F.col("match").rlike(SECRET) & F.col("cue").rlike(SECRET_CUE)
    secrets = written(seen.filter(secret).select("match", F.lit("secret").alias("kind")).distinct(), "secrets")
    seeds = seen.filter(base).select("match", "kind").distinct().unionByName(secrets)
    graph = written(seen.filter("cue <> ''").groupBy("cue", "match").agg(F.count(F.lit(1)).alias("n")), "graph")
    unseen = seen.filter(~base).select("match").distinct().join(graph.select("match").distinct(), "match", "left_semi")
    unseen = written(unseen.join(seeds, "match", "left_anti"), "unseen")
    certain = written(seeds.withColumn("score", F.lit(1.0)), "seeds")
    corpus = cues_of(docs)
    scores, totals = certain, None
    for _ in range(rounds):
        hits, backers = F.sum(F.col("n") * F.col("score")).alias("hits"), F.count_if(F.col("score") >= confidence).alias("backers")
        cue = written(graph.join(scores, "match").groupBy("cue", "kind").agg(hits, backers).filter(F.col("backers") >= support), "cues")
        # How often each cue that is new in this round occurs at all, over the whole corpus.
        new = cue.select("cue").distinct()
        new = written(new.join(totals, "cue", "left_anti") if totals else new, "new-cues")
        if totals is None or not new.isEmpty():
            total = corpus.join(new, "cue", "left_semi").groupBy("cue").agg(F.count(F.lit(1)).alias("total"))
            followed = graph.join(new, "cue", "left_semi").groupBy("cue").agg(F.sum("n").alias("followed"))
            total = total.join(followed, "cue", "right").select("cue", F.greatest(F.coalesce("total", F.lit(0)), "followed").alias("total"))
            totals = written(totals.unionByName(total) if totals else total, "totals")
        cue = cue.join(totals, "cue").select("cue", "kind", (F.col("hits") / F.col("total")).alias("sure"))
        cue = written(cue.filter(F.col("sure") >= confidence / 2), "cue-scores")
        # All cues wrong: the product over distinct cues, as a sum of logarithms.
        wrong = F.exp(F.sum(F.log(F.greatest(1 - F.col("sure"), F.lit(1e-12)))))
        some = graph.join(cue, "cue").groupBy("match", "kind").agg(F.round(1 - wrong, 9).alias("score"))
        scores = written(certain.unionByName(some.join(unseen, "match", "left_semi")), "scores")
    high = scores.join(unseen, "match", "left_semi").filter(F.col("score") >= confidence)
    best = high.groupBy("match").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind")).alias("best"))
    return best.select("match", F.col("best.kind").alias("kind")).unionByName(secrets)


def find(docs: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, base and found, arrays of (kind_no, start, end) in this order.

    base has the valid base entities, found the discovered ones. kind_no counts ALL_KINDS from 0; offsets are code points,
    end exclusive. Null or empty text: empty arrays. Repeated rows stay, and so do null ids. Empty input: no rows.
    """
    seen = occurrences(docs)
    more = discovered(docs, seen, confidence, support, rounds).withColumnRenamed("kind", "as_kind")
    number = lambda c: (F.array_position(F.array(*map(F.lit, ALL_KINDS)), c) - 1).cast("int")
    span = lambda kind: F.struct(number(kind).alias("kind_no"), "start", "end")
    base = F.collect_list(F.when(F.col("kind") != "word", span(F.col("kind"))))
    found = F.collect_list(F.when((F.col("kind") == "word") & F.col("as_kind").isNotNull(), span(F.col("as_kind"))))
    joined = seen.join(more, "match", "left")
    return joined.groupBy("row_id", "doc_id").agg(F.sort_array(base).alias("base"), F.sort_array(found).alias("found")).select("doc_id", "base", "found")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda s: F.get(F.array(*map(F.lit, ALL_KINDS)), s["kind_no"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
