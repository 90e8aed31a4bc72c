import random
import re

import pytest

from tidelog.llm import language, licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_scan(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words, places = WORD.findall(text), []
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_scan_equals_brute_force(spark):
    rng = random.Random(2)
    parts = ["CC", " BY", "cc-by ", "general ", "Public\n", "license. ", "all ", "rights ", "Reserved", " ", "é", "x", "GNU ", ", ", "K", "0", "cc by cc by "]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    rows += [(400, None), (401, ""), (401, ""), (None, "cc by"), (402, "All rights reserved. " * 5000), (403, "cc byé cc by-nc éall rights reserved")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS labels")
    out = licences.scan_licences(docs).collect()
    got = sorted(repr((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in out)
    assert got == sorted(repr((k, *brute_scan(t))) for k, t in rows)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in out)
    assert licences.scan_licences(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text, postfix, permissive", [
    ("MIT", ["MIT"], True), ("MIT OR GPL-2.0-only", ["MIT", "GPL-2.0-only", "or"], True), ("MIT AND GPL-2.0-only", ["MIT", "GPL-2.0-only", "and"], False),
    ("GPL-2.0 WITH Classpath-exception-2.0 OR Apache-2.0 AND MIT", ["GPL-2.0", "Classpath-exception-2.0", "with", "Apache-2.0", "MIT", "and", "or"], True),
    ("(MIT OR GPL-3.0) AND GPL-2.0", ["MIT", "GPL-3.0", "or", "GPL-2.0", "and"], False), ("MIT */ more", ["MIT"], True),
])
def test_expressions(text, postfix, permissive):
    assert licences.to_postfix(text) == postfix
    assert licences.evaluate(postfix)[1] is permissive


@pytest.mark.parametrize("text", ["", "OR MIT", "MIT OR", "(MIT", "()"])
def test_malformed_expressions(text):
    assert licences.to_postfix(text) is None


def test_identifier_tag():
    found = licences.Scanner().scan("// SPDX-License-Identifier: MIT OR Apache-2.0\ncode")
    assert found["labels"] == "apache,mit" and found["permissive"] and found["expressions"] == ["MIT Apache-2.0 or"]


SYLLABLES = {"a": ["the", "ing", "tion", "re"], "b": ["ung", "sch", "eit", "ver"], "c": ["eau", "oui", "ment", "què"]}


def made(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language_model(spark):
    rng = random.Random(4)
    rows = [(k, made(rng, lang := rng.choice("abc"), 60), lang) for k in range(300)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "12 !?", "c"), (1004, "\u00bd \u2167 \u00b2", "c"), (1003, "the", None), (1003, "the", None), (None, made(rng, "b", 30), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS id")
    model = language.fit(docs)
    out = language.identify(docs, model).collect()
    assert len(out) == len(rows)
    truth = {k: lang for k, _, lang in rows[:300]}
    assert sum(r.lang_pred == truth[r.id] for r in out if r.id in truth) >= 297
    assert all(r.lang_pred == "und" and r.score == 0 for r in out if r.id in (1000, 1001, 1002, 1004))
    mixed = model.predict(made(rng, "a", 200) + " " + made(rng, "c", 100))
    assert mixed[0] == "a" and set(mixed[2]) == {"a", "c"} and 0.5 < mixed[1] < 0.8
    none = language.fit(docs.limit(0))
    assert language.identify(docs, none).where("lang_pred <> 'und'").count() == 0
    assert language.identify(docs.limit(0), model).count() == 0


def test_shares_and_choice_equal_enumeration():
    """Shares by a grid of the simplex, and the chosen languages by the penalised likelihood of every set."""
    from itertools import combinations

    import numpy as np

    rng = random.Random(13)
    model = language.Model(["a", "b", "c"], np.vstack([sum_of(made(rng, k, 3000)) for k in "abc"]))
    steps = [np.array([i, j, 100 - i - j]) / 100 for i in range(101) for j in range(101 - i)]
    checked = 0
    for lengths in [(80, 0, 0), (0, 60, 0), (60, 50, 0), (30, 0, 90), (70, 70, 70), (10, 120, 0), (200, 4, 0)]:
        text = " ".join(made(rng, k, n) for k, n in zip("abc", lengths) if n)
        bins, counts = language.histogram(text)
        p = model.p[:, bins]
        shares = model.proportions(bins, counts)
        own = np.array([shares.get(k, 0.0) for k in "abc"])
        best = {}
        for size in (1, 2, 3):
            for some in combinations(range(3), size):
                grid = [w for w in steps if not np.delete(w, some).any()]
                values = [counts @ np.log(np.maximum(w @ p, 1e-300)) for w in grid]
                best[some] = max(values), grid[int(np.argmax(values))]
        cost = language.PENALTY * np.log(counts.sum() + 1)
        chosen = max(best, key=lambda s: best[s][0] - cost * len(s))
        if sorted(best[s][0] - cost * len(s) for s in best)[-2] < best[chosen][0] - cost * len(chosen) - 2:  # no near tie
            assert set(shares) == {"abc"[k] for k in chosen}, lengths
            assert np.abs(own - best[chosen][1]).max() <= 0.02 and counts @ np.log(own @ p) >= best[chosen][0] - 0.5
            checked += 1
    assert checked >= 5


def sum_of(text):
    import numpy as np

    bins, counts = language.histogram(text)
    out = np.zeros(language.BINS)
    out[bins] = counts
    return out
