"""Odd rows of personal data, pages, neighbours and chat: control characters, very long words and pages, clashing columns."""

import re

from pyspark.sql import functions as F

from paylens.llm import ann, html_extract, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def emails_and_ips(text):
    found = [(0, *m.span()) for m in EMAIL.finditer(text)]
    return found + [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]


def test_marks_and_long_words_in_texts_move_no_span(spark):
    texts = [
        "\x01a@b.c\x02 \x01\x01 10.0.0.1\x02 token\x01 = x1", "\x02", "\x01" * 50 + "me@host.org", "mail\x1f me@host.org \x1f 1.2.3.4",
        "x" * 10_000 + "1 me@host.org", "a" * 100_000 + "@" + "b" * 100_000 + ".c 8.8.8.8", "9" * 5_000 + " 1.1.1.1", "😀 é me@host.org 😀 300.1.1.1 1.1.1.255",
        "word " * 100_000 + "last@word.org", "@" * 5_000 + " 1.2.3.4.5.6.7.8",
    ]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, kind string, match int")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.find(rows.withColumn("row_id", F.lit("r")).withColumn("cue", F.lit(None).cast("int"))).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        # A span between control characters is judged with these as other characters.
        want = emails_and_ips(re.sub("[\x01\x02]", "\x03", text))
        assert [s for s in got[i] if s[0] < 2] == sorted(want), i


def test_very_long_page_and_clashing_columns(spark):
    words = " ".join(f"sentence {i} of the story, which goes on." for i in range(40))
    body = "".join(f"<p>{words} Part {i}.</p>" for i in range(300))
    deep = "<div>" * 3000 + f"<p>{words}</p>" + "</div>" * 3000
    pages = [
        (1, "u1", f"<html><body><nav>Home About</nav><article>{body}</article><footer>Contact us</footer></body></html>"),
        (2, "u2", f"<html><body><nav>Home</nav><article>{deep}</article></body></html>"),
        (3, None, None), (3, None, None), (None, "u4", ""), (5, "u5", "<p>" + "&amp;" * 50_000 + "</p>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    clash = df.withColumns({"text": F.lit("x"), "n_chars": F.lit("y"), "label": F.lit(1), "tag": F.lit(2)})
    plain, more = (sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html_extract.extract_pages(d).collect()) for d in (df, clash))
    assert plain == more and len(plain) == len(pages) and all(len(r[2]) == r[3] for r in plain)
    of = {r[1]: r[2] for r in plain}
    assert of["u1"].split("\n\n") == [f"{words} Part {i}." for i in range(300)]
    assert of["u2"] == words and of["u4"] == "" and [r[2] for r in plain if r[0] == "3"] == ["", ""]


def test_neighbours_with_clashing_columns(spark):
    data = [(i, [float((i * 7 + j * j) % 11 - 5) for j in range(8)]) for i in range(200)]
    data += [(200, [float("nan")] + [1.0] * 7), (201, None), (202, [0.0] * 8), (203, [1.0, None] + [1.0] * 6), (None, [1.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    more = df.withColumns({c: F.lit("x") for c in ("v", "q", "leaf", "query_id", "rank", "score", "piece_key", "dim")})
    rows = lambda d: sorted(map(tuple, ann.search(d, F.col("vec_id") % 20 == 0, k=5).collect()))
    got = rows(df)
    assert got == rows(more) and len(got) == 10 * 5
    assert not {r[0] for r in got} & {200, 201, 202, 203} and not {r[2] for r in got} & {200, 201, 202, 203}
