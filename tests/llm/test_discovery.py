"""Discovery of personal data against a plain program, and the given tables' credentials; ids of long texts."""

import os
import random
import re
from collections import defaultdict
from math import prod

import numpy as np
import pytest
import regex

from paylens.llm import chat, pii, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[^ \t\n\x0b\f\r]+"


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits)))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in text.split(".")), "phone": 9 <= len(digits) <= 15}[kind]


def named(word):
    return bool(regex.search(r"[\p{L}\p{N}]", word))


def cue_before(text):
    """The last word with a letter or digit and the marks behind it."""
    words = re.findall(WORD, text)
    if not text or re.match(WORD, text[-1]) or not any(map(named, words)):
        return ""
    at = max(i for i, w in enumerate(words) if named(w))
    return " ".join(words[at:]).lower()


def entities(text):
    """(kind, start, end, match, cue): valid base entities, and other words with a digit or @ that overlap none."""
    found = []
    for kind, pattern in BASE.items():
        last = 0
        for m in re.finditer(pattern, text):
            if valid(kind, m.group()):
                found.append((kind, m.start(), m.end(), m.group(), cue_before(text[last : m.start()]) if last or m.start() else ""))
            last = m.end()
    spans, last = [f[1:3] for f in found], 0
    for m in re.finditer(WORD, text):
        if re.search("[0-9@]", m.group()):
            core = regex.sub(r"[^\p{L}\p{N}]+$", "", regex.sub(r"^[^\p{L}\p{N}+]+", "", m.group()))
            start = m.start() + len(m.group()) - len(regex.sub(r"^[^\p{L}\p{N}+]+", "", m.group()))
            if not any(s < start + len(core) and start < e for s, e in spans):
                found.append(("word", start, start + len(core), core, cue_before(text[last : m.start()])))
            last = m.end()
    return found


def discovered(texts, confidence=0.8, support=3, rounds=3):
    seen = [e for t in texts for e in entities(t)]
    secrets = {e[3] for e in seen if e[0] == "word" and re.fullmatch(r"(?=.*\d)(?=.*[A-Fa-f])[0-9A-Fa-f]{32,128}", e[3]) and re.search(r"(key|token|secret|password|passwd|pwd)\W*$", e[4])}
    seeds = {(e[3], e[0]): 1.0 for e in seen if e[0] != "word"} | {(s, "secret"): 1.0 for s in secrets}
    total, edges = defaultdict(int), defaultdict(int)
    for text in texts:
        words = re.findall(WORD, text.lower())
        starts = [i for i, w in enumerate(words) if named(w)]
        for i, j in zip(starts, [*starts[1:], len(words)]):
            total[" ".join(words[i:j])] += 1
    for e in seen:
        if e[4]:
            edges[e[4], e[3]] += 1
    unseen = {e[3] for e in seen if e[0] == "word"} - {m for m, _ in seeds}
    scores = dict(seeds)
    for _ in range(rounds):
        hits, backers = defaultdict(float), defaultdict(int)
        for (cue, match), n in edges.items():
            for (m, kind), score in scores.items():
                if m == match:
                    hits[cue, kind] += n * score
                    backers[cue, kind] += score >= confidence
        followed = {c: sum(n for (d, _), n in edges.items() if d == c) for c, _ in edges}
        sure = {(c, k): h / max(total[c], followed[c]) for (c, k), h in hits.items() if backers[c, k] >= support}
        sure = {x: s for x, s in sure.items() if s >= confidence / 2}
        wrong = defaultdict(list)
        for cue, match in edges:
            for (c, kind), s in sure.items():
                if c == cue and match in unseen:
                    wrong[match, kind].append(max(1 - s, 1e-12))
        scores = seeds | {x: round(1 - prod(w), 9) for x, w in wrong.items()}
    best = {}
    for (match, kind), score in sorted(scores.items(), key=lambda x: (-x[1], x[0][1])):
        if match in unseen and score >= confidence:
            best.setdefault(match, kind)
    return best | dict.fromkeys(secrets, "secret")


def made_texts():
    rng = random.Random(5)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    plain = ["see", "the", "room", "été", "and", "|", "--", "note.", "to"]
    tokens, names = [hexa(40) for _ in range(4)], [f"n4me-{i}" for i in range(6)]
    said = [lambda: f'token = "{rng.choice(tokens)}"', lambda: f"mailto: user{rng.randrange(30)}@example.com", lambda: f"mailto: {rng.choice(names)}"]
    said += [lambda: f"writeto | {rng.choice(names)}!!", lambda: rng.choice(names), lambda: "host: 10.0.0." + str(rng.randrange(300)), lambda: 'TOKEN = "short-9"###']
    said += [lambda: "call +1 (407) 555-01" + str(rng.randrange(10, 99)), lambda: "commit " + hexa(40), lambda: "5 = 7", lambda: "w" * 90 + ": " + rng.choice(names)]
    made = [" ".join(rng.choice(said)() if rng.random() < 0.4 else rng.choice(plain) for _ in range(rng.randrange(1, 30))) for _ in range(70)]
    return [*made, "", "| | |" * 50, "x" * 2000 + " 9", "-" * 2000 + "9" + "-" * 2000, "| " * 1000 + "9", "a\x01b \x02c1"]


def test_discovery_matches_a_plain_program(spark):
    texts = made_texts()
    kind_of = discovered(texts)
    assert {"secret", "email"} <= set(kind_of.values()) and kind_of["short-9"] == "secret"
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        want = sorted((pii.ALL_KINDS.index(kind_of[m]), s, e) for k, s, e, m, _ in entities(text) if k == "word" and m in kind_of)
        assert [tuple(s) for s in got[i].found] == want, text[:200]


def test_very_long_words_and_cues(spark):
    n = 100_000
    long_cue = "k" * n + "-token"
    texts = [f'{long_cue} {"| " * n}"{i}{"ab" * 16}"' for i in range(3)] + ["x" * n + " 9", "-" * n + "9" + "-" * n, "| " * n + "9"]
    got = {r.doc_id: [tuple(s) for s in r.found] for r in pii.find(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    start = len(long_cue) + 2 * n + 2
    assert got == {i: [(4, start, start + 33)] if i < 3 else [] for i in range(6)}


def test_the_query_finds_the_given_credentials(spark):
    rows = queries.op10_personal_data(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    planted = 0
    for r in rows:
        want = {f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text or "", re.I)}
        assert {s for s in r.spans.split(",") if s.startswith("secret")} == want
        planted += len(want)
    assert planted


@pytest.mark.parametrize("text", ["word été 12 " * 9000, "x" * 70_000, " \n" * 30_000 + "a" + " " * 40_000, "!?" * 20_000 + "don't " * 6000 + "\x1c\x85\xa0 "])
def test_ids_of_long_texts_are_those_of_the_whole(spark, text):
    with open(chat.VOCABULARY, "rb") as file:
        codec = chat.Codec(file.read())
    assert len(text) > chat.LONG
    ids = codec.encode(text)
    assert ids == codec.encoding.encode_ordinary(text) and codec.decode(np.array(ids)) == text
