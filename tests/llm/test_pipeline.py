import random
import re
from array import array

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from tidelog.llm import jaccard, language, quality  # noqa: E402

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k == 3:
            assert {r.doc_id for r in out.collect()} == set(ids(docs)) and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
            break
        assert out.schema == docs.schema
        want = {
            "quality": lambda d: [r.id for r in quality.judge(d).where("kept").collect()],
            "language": lambda d: [r.id for r in language.identify(d, language.fit(d)).where("lang_pred <> 'und' AND score >= 0.3").collect()],
            "near_duplicates": lambda d: [r.id for r in jaccard.jaccard_components(d).where("id = component_id").collect()],
        }[name](docs)
        assert ids(out) == sorted(want)
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_odd_documents(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, SF).collect()


UNLEARNED = {
    "ru": "\u0421\u044a\u0435\u0448\u044c \u0435\u0449\u0451 \u044d\u0442\u0438\u0445 \u043c\u044f\u0433\u043a\u0438\u0445 \u0431\u0443\u043b\u043e\u043a \u0434\u0430 \u0432\u044b\u043f\u0435\u0439 \u0447\u0430\u044e. " * 5,
    "pl": "Wszyscy ludzie rodz\u0105 si\u0119 wolni i r\u00f3wni pod wzgl\u0119dem swej godno\u015bci i swych praw. S\u0105 oni obdarzeni rozumem i sumieniem.",
    "consonants": "qxzvk wrtpl bdfgk xxqzt mnbvc lkjhg zxcvb trwqp " * 6,
    "hex": " ".join(f"{0x9E3779B97F4A7C15 * k % (1 << 32):08x}" for k in range(1, 50)),
}


def test_unlearned_languages_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(-1 - k, t, None, "s", len(t)) for k, t in enumerate(UNLEARNED.values())], docs.schema)
    left = ids(corpus_pipeline.language_stage(spark, docs.unionByName(more), SF))
    assert left == ids(docs)


def test_verdicts_hold_for_rows_and_not_for_ids(spark):
    def prose(k):
        return " ".join(f"{w}{k}" for w in "some prose of a kind that no other document has in its words at all here".split())

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(k, prose(k), "en", "s", 1) for k in range(40)]
    rows += [(7, "short", "en", "s", 1), (None, "short", "en", "s", 1), (None, prose(50), "en", "s", 1)]  # rejected beside kept ones
    rows += [rows[3], rows[3], (3, prose(3), "en", "t", 1), (None, prose(3), "en", "s", 1), (60, prose(3) + " ", "en", "s", 1)]  # copies of 3
    rows += [(None, prose(70), "en", "s", 1)] * 3 + [(None, prose(70), "en", "t", 1), (None, prose(71), "en", "s", 1)]  # copies without an id
    docs = spark.createDataFrame(rows, schema)
    good = corpus_pipeline.quality_stage(spark, docs, SF)
    assert sorted(map(repr, map(tuple, good.collect()))) == sorted(repr(r) for r in rows if r[1] != "short")
    found = [(r.doc_id, r.text.strip()) for r in corpus_pipeline.near_duplicate_stage(spark, good, SF).collect()]
    assert sorted(map(repr, found)) == sorted([repr((k, prose(k))) for k in range(40)] + [repr((None, prose(k))) for k in (50, 70, 71)])
    cyrillic = [(5, UNLEARNED["ru"], None, "s", 1), (None, UNLEARNED["ru"], None, "s", 1)]
    known = corpus_pipeline.language_stage(spark, good.unionByName(spark.createDataFrame(cyrillic, schema)), SF)
    assert sorted(map(repr, map(tuple, known.collect()))) == sorted(map(repr, map(tuple, good.collect())))


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def fails(text):
    w = words(text)
    seen = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    covered = {k + j for k, x in enumerate(seen) if seen.count(x) > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    letters = sum(map(len, w))
    return (len(w) < 10 or len(covered) > 0.2 * len(w) or sum((text or "").count(c) for c in "#*$%&|<>") > 0.1 * len(w)
            or len(lines) - len(set(lines)) > 0.5 * len(lines) or not 2 * len(w) <= letters <= 12 * len(w))


def passes_quality(docs):
    hosts = {}
    for d in docs:
        hosts.setdefault(d[3], []).append(fails(d[1]))
    n = len(docs)
    m = sum(map(sum, hosts.values())) / n
    v = sum(len(x) * (sum(x) / len(x)) ** 2 for x in hosts.values()) / n - m * m
    k = max(1, min(1e6, m * (1 - m) / v - 1)) if v > 1e-12 else 1e6
    return [d for d in docs if not fails(d[1]) and (sum(hosts[d[3]]) + m * k) / (len(hosts[d[3]]) + k) <= m + 0.5 * (1 - m)]


def one_of_each(docs):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d in docs for w in [words(d[1].lower())]]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    best = {}
    for g, d in sorted(zip(group, docs), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        best.setdefault(g, d)
    return list(best.values())


def test_run_equals_independent_stages(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(7)
    syllables = {"en": ["the", "ing", "ton", "re", "wh"], "de": ["ung", "sch", "eit", "ver", "ich"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    docs = [(k, text(lang, rng.choice([30, 60, 900])), lang, f"s{k % 3}", 1) for k in range(60) for lang in [rng.choice(["en", "de"])]]
    docs += [(100 + k, docs[k][1] + " more", docs[k][2], "s0", 1) for k in range(8)] + [(200 + k, f"{text('en', 30)} {'$$$ %%% ' * 10}", "en", "s1", 1) for k in range(5)]
    docs += [(300, "short text", "en", "s2", 1), (301, "same words come again " * 20, "en", "s2", 1), (302, "\n".join(["one line here"] * 2 + [text("en", 20)]), "en", "s2", 1)]
    docs += [(5, "no", "en", "s2", 1), (None, docs[9][1], "en", "s2", 1), (None, text("de", 40), "de", "s1", 1), docs[12], docs[12], (303, None, None, None, None)]
    docs += [(400 + k, text("en", 40), "en", "bad", 1) for k in range(2)] + [(410 + k, "bad", "en", "bad", 1) for k in range(120)]
    strange = [(500 + k, t, None, "s0", 1) for k, t in enumerate(UNLEARNED.values())]
    spark.createDataFrame(docs + strange, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    want = one_of_each([d for d in passes_quality(docs + strange) if d[0] not in range(500, 510)])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sorted((-1 if d[0] is None else d[0], [*library.encode(d[1], add_special_tokens=False).ids, 0]) for d in want)
    pieces, lengths = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(-1 if r.doc_id is None else r.doc_id, []).append((r.start, list(array("I", r.ids))))
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert sorted((k, [i for _, x in sorted(p) for i in x]) for k, p in pieces.items()) == tokens and max(lengths.values()) <= 1024
    assert 40 < len(want) < len(docs)
