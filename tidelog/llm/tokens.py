"""Byte-level BPE with a lexicon of frequent words.

All words of the corpus are counted; frequent ones are merged once and compiled into a minimal acyclic transducer: words share their prefixes and
suffixes, and the outputs on the path of a word add up to its number, which leads to its ids. Executors map the automaton
into memory. Other words are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import mmap
import struct
import tempfile
from array import array
from collections import Counter, defaultdict

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts, texts
from .shared import save, ship

#: The pre-tokenizer's pattern of this vocabulary family, a fixed value; white space is written out, as \s differs between regular-expression engines.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
LEXICON_WORDS = 100_000
#: Entries of each generation of a worker's memories of chunks and of words, and chunks that a task counts before it hands their words on.
MEMORY = 250_000
#: Longest chunk or word that is remembered.
MEMORY_LENGTH = 256
WORD_MEMORY = 100_000
COUNTED = 400_000
#: Characters of texts whose chunks a task holds at a time while counting, and chunks that it cuts into words at a time.
HELD = 1 << 26
CUT = 4096
#: Bytes of a word's beginning, and beginnings that a lexicon remembers.
_BEGUN = 4
BEGINNINGS = 50_000
#: Bytes from which a word is merged with a heap.
_LONG = 48
_NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """Vocabulary letter to byte: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and added tokens of a tokenizers file."""

    def __init__(self, data: bytes):
        spec, letters = json.loads(data), byte_letters()
        model = spec["model"]
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.added}
        self.bytes_of: list[bytes] = [b""] * (max([*model["vocab"].values(), *self.added.values()]) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = token
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (as_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merges[ids[a] << 20 | ids[b]] = rank << 20 | ids[a + b]
        # the merges of two bytes
        self.byte_ranks = [[self.merges.get(a << 20 | b, _NONE) for b in self.byte_id] for a in self.byte_id]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: again and again the pair of lowest rank is joined, the first of equals first."""
        get, byte_id, byte_ranks = self.merges.get, self.byte_id, self.byte_ranks
        ids = [byte_id[b] for b in word]
        if len(ids) > _LONG:
            return self._merge_long(ids)
        # the pairs' ranks, each with the id it makes; a merge changes its two neighbours alone
        ranks = [byte_ranks[a][b] for a, b in zip(word, word[1:])]
        while ranks and (best := min(ranks)) != _NONE:
            k = ranks.index(best)
            ids[k] = new = best & 0xFFFFF
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 20 | new, _NONE)
            if k < len(ranks):
                ranks[k] = get(new << 20 | ids[k + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n: a heap of pairs over a linked list."""
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m, k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := merges.get(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j], after[k] = m & 0xFFFFF, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (m := merges.get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]


class Lexicon:
    """A minimal acyclic transducer over bytes, read from a buffer.

    Layout: counts of states, edges, words and ids; first edge of each state (one more at the end); each edge's target with
    its final bit, its output, and its byte; first id of each word (one more at the end); ids.
    """

    _HEAD = struct.Struct("<4I")

    def __init__(self, buffer):
        view = memoryview(buffer)
        states, edges, words, ids = self._HEAD.unpack_from(view)
        at = self._HEAD.size

        def take(n: int, kind: str):
            nonlocal at
            size = n * struct.calcsize(kind)
            part = view[at : at + size].cast(kind)
            at += size
            return part

        self.first, self.target, self.output = take(states + 1, "I"), take(edges, "I"), take(edges, "I")
        self.start, self.ids, self.label = take(words + 1, "I"), take(ids, "I"), bytes(take(edges, "B"))
        self.words = words
        self.begun: dict[bytes, tuple[int, int, int] | None] = {}

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> bytes:
        """Compile words and their ids; words are inserted in order, and each finished suffix is shared."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # finished: ((byte, final, state), ...)
        sizes: list[int] = []  # words below a finished state
        path: list[list] = [[]]  # edges of the open states on the last word's path

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                key = tuple(path.pop())
                state = register.get(key)
                if state is None:
                    state = register[key] = len(states)
                    states.append(key)
                    sizes.append(sum(final + sizes[to] for _, final, to in key))
                byte, final, _ = path[-1][-1]
                path[-1][-1] = (byte, final, state)

        last = b""
        ordered = sorted(w for w in entries if w)
        for word in ordered:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            close(shared)
            for byte in word[shared:]:
                path[-1].append((byte, 0, -1))
                path.append([])
            byte, _, to = path[-2][-1]
            path[-2][-1] = (byte, 1, to)
            last = word
        close(0)
        states.append(tuple(path[0]))
        first, target, output, label = array("I"), array("I"), array("I"), bytearray()
        for edges in states:
            first.append(len(target))
            skipped = 0
            for byte, final, to in edges:
                target.append(to << 1 | final)
                output.append(skipped)
                label.append(byte)
                skipped += final + sizes[to]
        first.append(len(target))
        start, ids = array("I", [0]), array("I")
        for word in ordered:
            ids.extend(entries[word])
            start.append(len(ids))
        head = cls._HEAD.pack(len(states), len(target), len(ordered), len(ids))
        return head + b"".join(x.tobytes() for x in (first, target, output, start, ids)) + bytes(label)

    def _walk(self, word: bytes, state: int, number: int, final: int) -> tuple[int, int, int] | None:
        """State, words passed, and whether a word ends there, after the bytes of word; None if no word goes on like that."""
        first, target, label, output = self.first, self.target, self.label, self.output
        for byte in word:
            number += final
            at = label.find(byte, first[state], first[state + 1])
            if at < 0:
                return None
            number += output[at]
            state = target[at]
            state, final = state >> 1, state & 1
        return state, number, final

    def find(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit numbers, or None. Where words' first bytes lead to is remembered."""
        begun, start = self.begun, word[:_BEGUN]
        if start not in begun:
            if len(begun) >= BEGINNINGS:
                begun.clear()
            begun[start] = self._walk(start, len(self.first) - 2, 0, 0)
        found = begun[start]
        if found and len(word) > _BEGUN:
            found = self._walk(word[_BEGUN:], *found)
        if not found or not found[2]:
            return None
        return bytes(self.ids[self.start[found[1]] : self.start[found[1] + 1]])


class _Memory(dict):
    """Values by key, computed when missing. Long keys are computed each time. When it is full it becomes the old generation, from which what is used again returns."""

    def __init__(self, make, size: int = MEMORY):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(key) > MEMORY_LENGTH:
            return self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        found = self.old[key] if key in self.old else self.make(key)
        self[key] = found
        return found


class ChunkEncoder:
    """Ids of whole texts as little-endian 32-bit numbers.

    Between two characters that are not white space, a single space begins a new token and a single newline is one. So a text is cut
    there, and the ids of the chunks are remembered. A text with any other white space is encoded in one go. encode_word, if given, is
    for chunks of letters alone, which are one word.
    """

    def __init__(self, encode_plain, added: dict[str, int], newline: int, encode_word=None):
        self.plain, self.added = encode_plain, added
        # None marks chunks that cannot stand alone
        alone = lambda c: bool(c) and not c[0].isspace() and not c[-1].isspace()
        encode_word = encode_word or encode_plain
        self.head = _Memory(lambda c: encode_word(c) if c.isalpha() else encode_plain(c) if alone(c) else None)
        self.tail = _Memory(lambda c: encode_word(" " + c) if c.isalpha() else encode_plain(" " + c) if alone(c) else None)
        self.newline = struct.pack("<I", newline)
        self.split = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(added, key=len, reverse=True))) if added else None

    def encode(self, text: str) -> bytes:
        if self.split and any(t in text for t in self.added):
            parts = (p for p in self.split.split(text) if p)
            return b"".join(struct.pack("<I", self.added[p]) if p in self.added else self._encode(p) for p in parts)
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        out, tail = [], self.tail.__getitem__
        for line in text.split("\n"):
            pieces = line.split(" ")
            out.append(self.newline)
            out.append(self.head[pieces[0]])
            out.extend(map(tail, pieces[1:]))
        try:
            return b"".join(out[1:])
        except TypeError:
            return self.plain(text)


_WORKER: dict = {}


def lexicon_encoder(vocab_data: bytes, lexicon_data: bytes) -> tuple[ChunkEncoder, Vocabulary]:
    """This worker's encoder over a memory-mapped lexicon; made once and kept for later tasks."""
    key = (hash(vocab_data), hash(lexicon_data))
    if key not in _WORKER:
        _WORKER.clear()
        vocab = Vocabulary(vocab_data)
        with tempfile.TemporaryFile() as f:
            f.write(lexicon_data)
            f.flush()
            lexicon = Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        find_words = regex.compile(PATTERN).findall

        def ids_of(w: str) -> bytes:
            return lexicon.find(b := w.encode()) or array("I", vocab.merge(b)).tobytes()

        word = _Memory(ids_of, WORD_MEMORY).__getitem__
        _WORKER[key] = ChunkEncoder(lambda s: b"".join(map(word, find_words(s))), vocab.added, vocab.byte_id[10], word), vocab
    return _WORKER[key]


def frequent_words(docs: DataFrame, text_col: str = "text", n: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words (pre-tokens) of all whole texts, at most n; n bounds what is collected, as a word over _LONG characters counts
    as several, and is chosen by its count for each of them.

    Each task counts what stands between blanks, then the words of each distinct piece, those seen once included. A small histogram of the
    counts tells from which count on at most n words remain. The lexicon only saves time; no result depends on it.
    """
    ship(docs.sparkSession)

    def run(batches):
        find_words, chunks, held = regex.compile(PATTERN).findall, Counter(), 0

        def flush():
            words, alike = Counter(), defaultdict(list)
            for chunk, k in chunks.items():
                alike[k].append(chunk)
            chunks.clear()
            for k, part in alike.items():
                for at in range(0, len(part), CUT):
                    found = find_words(" " + " ".join(part[at : at + CUT]))
                    if k == 1:
                        words.update(found)
                    else:
                        for w in found:
                            words[w] += k
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

        for (part,) in texts(batches, "text"):
            for text in part:
                chunks.update((text or "").split(" "))
                held += len(text or "")
            if len(chunks) > COUNTED or held > HELD:
                yield flush()
                held = 0
        yield flush()

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("slots", F.greatest(F.ceil(F.length("word") / _LONG), F.lit(1)))
    counted = save(counted.withColumn("level", F.floor(F.log2(F.col("n") / F.col("slots")) * 16).cast("int")), "words")
    least, total = None, 0
    for row in sorted(counted.groupBy("level").agg(F.sum("slots").alias("slots")).collect(), reverse=True):
        total += row.slots
        if total > n:
            break
        least = row.level
    return [] if least is None else sorted(r.word for r in counted.where(F.col("level") >= least).select("word").collect())


def build_lexicon(docs: DataFrame, vocab_data: bytes, text_col: str = "text", n: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the corpus' frequent words."""
    vocab = Vocabulary(vocab_data)
    words = [w.encode() for w in frequent_words(docs, text_col, n)]
    return Lexicon.build({w: vocab.merge(w) for w in words})


def encode_texts(docs: DataFrame, vocab_data: bytes, lexicon_data: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids): ids as little-endian 32-bit numbers in a binary. A null or empty text has no ids; repeated rows stay.
    Tables of bounded size (vocabulary, lexicon) are broadcast."""
    sc = docs.sparkSession.sparkContext
    data = sc.broadcast((vocab_data, lexicon_data))

    def make():
        encoder, _ = lexicon_encoder(*data.value)
        return lambda ids, part: {"id": ids, "ids": [encoder.encode(t) if t else b"" for t in part]}

    id_type = docs.schema[id_col].dataType
    return map_texts(docs, id_col, text_col, f"id {id_type.simpleString()}, ids binary", pa.schema([("id", _arrow(id_type)), ("ids", pa.binary())]), make)


def decode_ids(encoded: DataFrame, vocab_data: bytes) -> DataFrame:
    """Rows (id, ids, text) from rows (id, ids). Bytes that are no UTF-8 become replacement characters. Null ids of a text give an empty one;
    rows with a null id and repeated rows stay; other columns are not read."""
    sc = encoded.sparkSession.sparkContext
    data = sc.broadcast(vocab_data)

    def make():
        table = Vocabulary(data.value).bytes_of.__getitem__
        read = lambda b: b"".join(map(table, memoryview(b).cast("I"))).decode("utf-8", "replace")
        return lambda ids, part: {"id": ids, "ids": part, "text": [read(b or b"") for b in part]}

    id_type = encoded.schema["id"].dataType
    return map_texts(encoded, "id", "ids", f"id {id_type.simpleString()}, ids binary, text string",
                     pa.schema([("id", _arrow(id_type)), ("ids", pa.binary()), ("text", pa.string())]), make)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
