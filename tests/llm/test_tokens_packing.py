import random
from array import array

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidelog.llm import packing, queries, tokens

ODD = ["", " ", "a", "a b", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \n b", "a\n", "\ta", "a b", "a  b", "a\x1cb", "a \x1c b", "x\x85y", "don't I'll 'tis",
       "日本語 テキスト", "é è ê", "1234 56a", "!!! ??", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "x" * 300, "ab" * 500 + " cd", "\r\n a\r\n", "🙂🙂 🙂", "a​b c"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path(queries.BPE))


@pytest.fixture(scope="module")
def encoder():
    vocab = queries.vocabulary(queries.BPE)
    v = tokens.Vocabulary(vocab)
    words = {w.encode(): v.merge(w.encode()) for w in [" the", " a", "a", "ab", " there", "there", " are"]}
    return tokens.lexicon_encoder(vocab, tokens.Lexicon.build(words))


def made(rng, n):
    return "".join(rng.choice(["the ", "there", " are", "a", "b", " ", "\n", ",", ".", "é", "ß", "7", "'s", "\t", "日", "  "]) for _ in range(n))


def test_ids_equal_the_library(library, encoder):
    rng = random.Random(3)
    ranks = packing.rank_encoder(queries.vocabulary(queries.RANKS), P.PATTERN, encoder[1].added)
    for text in [*ODD, *(made(rng, rng.randint(1, 400)) for _ in range(300))]:
        want = library.encode(text, add_special_tokens=False).ids
        assert list(array("I", encoder[0].encode(text))) == want, repr(text)
        assert list(array("I", ranks.encode(text))) == want, repr(text)


def test_long_words_merge_alike(encoder, library):
    rng, v = random.Random(5), encoder[1]
    for _ in range(50):
        word = bytes(rng.choice(b"aabcdeth") for _ in range(rng.randint(2, 120)))
        assert v._merge_long([v.byte_id[b] for b in word]) == library.encode(word.decode(), add_special_tokens=False).ids


def test_lexicon_finds_its_words_and_no_others():
    rng = random.Random(1)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))): [k, k + 1][: 1 + k % 2] for k in range(500)}
    lexicon = tokens.Lexicon(tokens.Lexicon.build(words))
    for w, ids in words.items():
        assert list(array("I", lexicon.find(w))) == ids
    for _ in range(500):
        w = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 8)))
        assert (lexicon.find(w) is not None) == (w in words)
    same = tokens.Lexicon(tokens.Lexicon.build({p + b"ing": [1] for p in (b"a", b"b", b"c")}))
    assert len(same.first) - 1 == 5  # states: the shared suffix, the start and the end
    assert tokens.Lexicon(tokens.Lexicon.build({})).find(b"a") is None


def test_round_trip_over_a_table(spark, library):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(1, ODD[1]), (None, "a b"), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS ids")
    vocab = queries.vocabulary(queries.BPE)
    out = tokens.decode_ids(tokens.encode_texts(docs, vocab, tokens.build_lexicon(docs, vocab)), vocab).collect()
    assert sorted(map(repr, ((r.id, r.text, list(array("I", r.ids))) for r in out))) == sorted(
        map(repr, ((k, t or "", library.encode(t or "", add_special_tokens=False).ids) for k, t in rows)))
    none = docs.limit(0)
    assert tokens.encode_texts(none, vocab, tokens.build_lexicon(none, vocab)).count() == 0


def check_packed(pieces, documents, caps):
    """pieces: (key, start, length, ids, doc tokens, sequence, offset)"""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p[0], []).append(p)
        by_seq.setdefault(p[5], []).append(p)
    for key, (ids, _) in documents.items():
        own = sorted(by_doc.get(key, []), key=lambda p: p[1])
        assert b"".join(p[3] for p in own) == ids and all(p[4] * 4 == len(ids) and len(p[3]) == 4 * p[2] > 0 for p in own)
        assert [p[1] for p in own] == [sum(q[2] for q in own[:k]) for k in range(len(own))]
    for own in by_seq.values():
        own.sort(key=lambda p: p[6])
        assert [p[6] for p in own] == [sum(q[2] for q in own[:k]) for k in range(len(own))]
        total = sum(p[2] for p in own)
        assert total <= caps[0] and total & (total - 1) == 0 and len(own) <= caps[1]
        assert sum(max(0, min(p[1] + p[2], documents[p[0]][1]) - p[1]) for p in own) <= caps[2]


@pytest.mark.parametrize("caps", [(64, 8, 64), (64, 2, 64), (64, 3, 10), (16, 1, 16), (8, 100, 3)])
def test_packer_keeps_limits_and_every_id(caps):
    rng = random.Random(7)
    documents = {}
    for k in range(300):
        n = rng.choice([1, 2, 5, 30, 64, 65, 200])
        documents[k] = (array("I", [rng.randrange(50000) for _ in range(n)]).tobytes(), rng.randint(0, n))
    packer, pieces = packing.Packer(*caps, pool=16), []
    for k, (ids, stop) in documents.items():
        pieces += packer.add(k, ids, len(ids) // 4, stop)
    pieces += packer.finish()
    check_packed(pieces, documents, caps)


def test_packed_table(spark, library):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(99, None), (100, "word " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS ids").repartition(3)
    out = queries.pack(docs).collect()
    want = {k: (array("I", [*library.encode(t or "", add_special_tokens=False).ids, 0]).tobytes(), 0) for k, t in rows}
    check_packed([(r.id, r.start, r.length, bytes(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in out], want, (1024, 256, 1024))
    assert queries.pack(docs.limit(0)).count() == 0


def test_pack_tokens(spark):
    rows = [(1, array("I", range(10)).tobytes(), None), (None, array("I", range(5)).tobytes(), 2), (3, b"", 0), (4, None, None)]
    out = packing.pack_tokens(spark.createDataFrame(rows, "id long, ids binary, loss_stop int").coalesce(1), max_tokens=8).collect()
    assert sum(r.length for r in out) == 15 and {r.id for r in out} == {1, None}


def test_long_chunks_are_not_remembered(encoder, library):
    text = "ab" * 3000 + " " + "cd" * 3000 + "\n" + "e" * 5000
    assert list(array("I", encoder[0].encode(text))) == library.encode(text, add_special_tokens=False).ids
    assert all(len(c) <= tokens.MEMORY_LENGTH for m in (encoder[0].head, encoder[0].tail) for c in m)


def test_three_limits_close_sequences_of_conversations(spark):
    import public_tokenizers

    from tidelog.llm import packing, queries, tokens

    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    schema = "id long, parts array<struct<text:string, loss:boolean>>"
    talks = {}
    for r in rows.orderBy("conv_id", "turn").collect():
        talks.setdefault(r.conv_id, []).append((r.text, r.role == "assistant"))
    examples = [*talks.items(), (-1, None), (-2, [(None, True), ("", None), ("x y", None)]), (-2, [("again", True)]), (None, [("no id", True)])]
    df = spark.createDataFrame(examples, schema).coalesce(2)
    added = tokens.Vocabulary(queries.vocabulary(queries.BPE)).added
    encoder = packing.rank_encoder(queries.vocabulary(queries.RANKS), public_tokenizers.PATTERN, added)
    limits = {"max_tokens": 1024, "max_segments": 6, "max_loss": 420}
    out = packing.pack_examples(df, queries.vocabulary(queries.RANKS), public_tokenizers.PATTERN, added, **limits).collect()
    want, bears = {}, {}
    for key, parts in examples:
        ids, loss = b"", []
        for text, has in parts or []:
            part = encoder.encode(text or "")
            ids, loss = ids + part, loss + [bool(has)] * (len(part) // 4)
        want.setdefault(key, []).append(ids + bytes(4))
        bears.setdefault(key, []).append(loss + [False])
    single = {k for k, v in want.items() if len(v) == 1}
    got = {}
    for r in out:
        got.setdefault(r.id, []).append((r.start, bytes(r.ids)))
    assert {k: b"".join(x for _, x in sorted(got[k])) for k in single} == {k: want[k][0] for k in single} and set(got) == set(want)
    sequences = {}
    for r in out:
        lost = sum(bears[r.id][0][r.start : r.start + r.length]) if r.id in single else 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, lost))
    closed = {"tokens": 0, "segments": 0, "loss": 0}
    for pieces in sequences.values():
        total, loss = sum(p[1] for p in pieces), sum(p[2] for p in pieces)
        assert total <= 1024 and len(pieces) <= 6 and loss <= 420 and (total == 1024 or total & (total - 1) == 0)
        closed["tokens"] += total == 1024
        closed["segments"] += total < 1024 and len(pieces) == 6
        closed["loss"] += total < 1024 and loss >= 200 and len(pieces) < 6
    assert min(closed.values()) > 0, closed


def test_every_word_is_counted(spark):
    import regex

    once = ["qa" * k for k in range(3, 40)]  # each in one piece of one text; some are longer than a lexicon's usual word
    texts = ["the cat, " + w + "! the" for w in once] + ["a\nb the", None, "", "rare (rare-rare"] + ["common " * 5] * 3
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    counts = {}
    for text in texts:
        for w in (w for piece in (text or "").split(" ") for w in regex.findall(tokens.PATTERN, " " + piece)):
            counts[w] = counts.get(w, 0) + 1
    assert set(tokens.frequent_words(docs)) >= {w for w in counts if not w.isspace()} >= {" " + w for w in once}
    # a word in many tasks counts as much as one that is as often in a single task; a long word as often as others comes after them
    spread = spark.createDataFrame([(k, f"often {'x' * 100} {'q' * (k + 1)}") for k in range(40)], "doc_id long, text string").repartition(40)
    assert tokens.frequent_words(spread, n=1) == [" often"] and set(tokens.frequent_words(spread, n=4)) == {" often", " " + "x" * 100}


def test_letters_are_letters_of_the_pattern():
    import regex

    letter = regex.compile(r"\p{L}").match
    assert all(letter(c) for c in map(chr, range(0x110000)) if c.isalpha())


def test_a_lexicon_remembers_beginnings(encoder):
    words = {w: [k] for k, w in enumerate([b"a", b"ab", b"abcd", b"abcde", b"abcdef", b"abce", b"b"])}
    lexicon = tokens.Lexicon(tokens.Lexicon.build(words))
    for _ in range(2):
        for w in [*words, b"", b"abc", b"abcdefg", b"abcdx", b"abx", b"abxxxx"]:
            found = lexicon.find(w)
            assert (None if found is None else list(array("I", found))) == words.get(w)
    assert 0 < len(lexicon.begun) <= tokens.BEGINNINGS
