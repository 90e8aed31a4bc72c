import random

from tidelog.llm import toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for k, y in enumerate(b):
            new.append(min(row[k] + (x != y), new[k] + 1, row[k + 1] + 1))
        row = new
    return row


def test_near_equals_brute_force():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    words, stems = [word(rng.randint(3, 8)) for _ in range(12)], [word(rng.randint(4, 6)) for _ in range(4)]
    trie, met = toxicity.Trie(words, stems), 0
    stems = set(stems)
    for _ in range(3000):
        w = word(rng.randint(2, 11))
        long = [t for t in words if len(t) >= 5 and t not in stems]
        want = "near" if len(w) >= 4 and any(edits(t, w)[-1] <= 1 for t in long) else (
            "near_stem" if len(w) >= 4 and any(len(s) >= 5 and min(edits(s, w)) <= 1 for s in stems) else None)
        assert trie.near(w) == want, w
        met += want is not None
    assert met > 100


def corpus(rng, n):
    plain = ["".join(rng.choice(["ta", "ko", "mi", "re", "su"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        words, bad = [rng.choice(plain) for _ in range(rng.randint(20, 60))], rng.random() < 0.2
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "blockhead", "nitwit" + rng.choice("abcdefghijkl")]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus(random.Random(8), 800)
    odd = [(9000, None), (9001, ""), (9002, "you are a sc0undrel and a blokchead, a blockheadd"), (9003, "scoundrel " * 30000), (None, "ta"), (9004, "ta"), (9004, "ta")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "1 AS toxic", "0 AS score", "0 AS id")
    y = spark.createDataFrame(labels + [(9000, 1), (None, 1), (9001, None)], "doc_id long, toxic int").selectExpr("*", "'x' AS text")
    model = toxicity.fit(docs, y)
    assert {"scoundrel", "blockhead"} <= model.trie.words and any("nitwit".startswith(s[:6]) for s in model.trie.stems)
    out = toxicity.judge(docs, model).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    truth, got = dict(labels), {r.id: r.predicted for r in out}
    assert sum(got[k] == truth[k] for k in truth) >= 0.97 * len(truth)
    assert got[9002] == 1 and got[9003] == 1 and got[9000] == got[9001] == got[9004] == 0
    nothing = toxicity.fit(docs.limit(0), y.limit(0))
    assert toxicity.judge(docs, nothing).where("score <> 0").count() == 0
    assert toxicity.judge(docs.limit(0), model).count() == 0


def test_quotation_counts():
    model = toxicity.Model(["scoundrel"], [])
    names = toxicity.FEATURES
    quoted = model.features('ta ko said "scoundrel" to mi')
    plain = model.features("ta ko you scoundrel mi")
    assert quoted[names.index("quoted")] > 0 and quoted[names.index("reported")] > 0 and not quoted[names.index("spoken")]
    assert plain[names.index("spoken")] > 0 and not plain[names.index("quoted")]


def test_very_long_words_are_judged_like_short_ones():
    trie = toxicity.Trie(["grumpox"], ["vexil"])
    assert trie.near("grumpax") == "near" and trie.near("grumpox" + "z" * 200_000) is None and trie.near("grump" + "o" * 200_000) is None
    assert trie.near("vexal" + "z" * 200_000) == trie.near("vexalz") == "near_stem"
    model = toxicity.Model(["grumpox"], ["vexil"])
    assert model.kind("vexil" + "z" * 200_000) == "stem" and not any(len(w) > toxicity.MEMORY_LENGTH for w in model.known)


def brute_features(model, text):
    """Features by one pass over all words and their places."""
    import re

    import numpy as np

    low = text.lower()
    found = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W_]+(?:[*@$][^\W_]+)*", low)]
    counts, kinds = dict.fromkeys(toxicity.FEATURES, 0.0), set()

    def kind(w):
        if w in model.trie.words:
            return "word"
        if any(w.startswith(s) for s in model.trie.stems):
            return "stem"
        if any(len(t) >= 5 and edits(t, w)[-1] <= 1 for t in model.trie.words - model.trie.stems) and len(w) >= 4:
            return "near"
        return "near_stem" if len(w) >= 4 and any(len(s) >= 5 and min(edits(s, w)) <= 1 for s in model.trie.stems) else None

    for a, b, w in found:
        k = kind(w)
        if not k:
            continue
        kinds.add(w)
        counts[k] += 1
        before, after = low[max(0, a - 60) : a], low[b : b + 60]
        around = set(re.findall(r"[^\W_]+(?:[*@$][^\W_]+)*", before)) | set(re.findall(r"[^\W_]+(?:[*@$][^\W_]+)*", after))
        is_open = sum(before.count(q) for q in '"“„«') % 2 == 1 and any(q in after for q in "\"'“”„«»‘’")
        counts["quoted"] += bool(before and before[-1] in "\"'“”„«»‘’") or is_open
        counts["reported"] += bool(around & toxicity.REPORTS)
        counts["spoken"] += bool(around & toxicity.YOU)
    hits = sum(counts[k] for k in ("word", "stem", "near", "near_stem"))
    counts |= {"density": 1000 * hits / max(1, len(found)), "kinds": len(kinds)}
    return [float(np.log(1 + counts[k])) for k in toxicity.FEATURES] if hits else None


def test_features_and_scores_equal_brute_force():
    import math

    import numpy as np

    rng = random.Random(12)
    parts = ["scoundrel", "scoundrl", "nitwits", "nitwlt", "blockhead", "you", "said", "the", "ta", "ko", '"', "'", "“", "„", ",", ".", "word", "Du", "SCOUNDREL", "sc*undrel", "blockheads"]
    weights = np.array([-1.0, 0.5, 0.4, 0.3, 0.2, -0.8, -0.4, 0.6, 0.1, 0.2])
    means = np.linspace(0, 0.5, len(toxicity.FEATURES))
    model = toxicity.Model(["scoundrel", "blockhead"], ["nitwit"], weights, means, 0.05)
    met = 0
    for _ in range(500):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(1, 25))).replace(' " ', ' "')
        want, got = brute_features(model, text), model.features(text)
        assert (want is None) == (got is None) and (want is None or np.allclose(got, want)), text
        z = None if want is None else weights[0] + sum(w * (x - m) for w, x, m in zip(weights[1:], want, means))
        assert abs(model.score(text) - (0.05 if z is None else 1 / (1 + math.exp(-z)))) < 1e-12
        met += want is not None
    assert met > 300


def test_terms_have_no_cap():
    rows = [(f"term{k}x", False, 10, 0) for k in range(5000)]
    assert len(toxicity.choose_terms(rows, 0.1)[0]) == 5000
