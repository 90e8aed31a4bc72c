"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, and weights learned for the context of each hit."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts, texts
from .shared import held_out, sampled, save, ship

#: Bounds: labelled rows that are fitted on, and with them the terms of the lexicon; words a worker remembers.
FIT_ROWS = 30_000
MEMORY = 500_000
#: Longest word that is remembered.
MEMORY_LENGTH = 64
#: Limits for a term: toxic texts that have it, and their share (smoothed) among all texts that have it.
MIN_TEXTS = 5
MIN_SHARE = 0.7
#: Different words that make a common beginning a stem.
MIN_FORMS = 8
#: Different words before a term, and their share of the texts that have it: copies of one text are no evidence.
MIN_CONTEXTS = 4
CONTEXT_SHARE = 0.1
#: Shortest term and word that may be met misspelled, by one edit.
FUZZY_LENGTH = 5
EDITS = 1
WINDOW = 60
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W_]+(?:[*@$][^\W_]+)*")
_QUOTES = "\"'“”„«»‘’"
#: Cues around a hit: who reports a word, and who is spoken to.
REPORTS = {"said", "says", "quote", "quoted", "called", "word", "term", "wrote", "reported", "mot", "dit", "wort", "sagte", "palabra", "dijo"}
YOU = {"you", "your", "youre", "u", "du", "dich", "dein", "ihr", "tu", "toi", "vous", "ton", "te", "usted", "eres"}
FEATURES = ["word", "stem", "near", "near_stem", "quoted", "reported", "spoken", "density", "kinds"]


class Levenshtein:
    """Automaton of a word: a state is the row of distances to the word's beginnings, those above the limit cut off."""

    def __init__(self, word: str, most: int = EDITS):
        self.word, self.most, self.known = word, most, {}
        self.start = tuple(min(k, most + 1) for k in range(len(word) + 1))

    def step(self, state: tuple, char: str) -> tuple:
        key = (state, char)
        if key not in self.known:
            row, most = [min(state[0] + 1, self.most + 1)], self.most + 1
            for k, c in enumerate(self.word):
                row.append(min(state[k] + (c != char), row[k] + 1, state[k + 1] + 1, most))
            self.known[key] = tuple(row)
        return self.known[key]


class Trie:
    """Terms with their kind; a node is a dict of characters, the kind of the term that ends there under the empty string."""

    def __init__(self, words: list[str], stems: list[str]):
        self.root: dict = {}
        self.words, self.stems = set(words), set(stems)
        self.stem_lengths = sorted({len(s) for s in stems})
        self.longest = max(map(len, [*words, *stems]), default=0)
        # one edit leaves the first or the last half of a term as it was
        self.fronts, self.backs, self.stem_backs = {}, {}, {}
        for term in [*words, *stems]:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = "stem" if term in self.stems else "word"
            if len(term) >= FUZZY_LENGTH:
                h = len(term) // 2
                self.fronts.setdefault(h, set()).add(term[:h])
                if term in self.stems:
                    for at in (h - 1, h, h + 1):
                        self.stem_backs.setdefault((at, len(term) - h), set()).add(term[h:])
                else:
                    self.backs.setdefault(len(term) - h, set()).add(term[h:])

    def exact(self, word: str) -> str | None:
        if word in self.words:
            return "word"
        return "stem" if any(word[:n] in self.stems for n in self.stem_lengths if n <= len(word)) else None

    def near(self, word: str) -> str | None:
        """Kind of a term within one edit of word, or of a stem within one edit of a beginning of it.

        Words that share neither half with any term are not walked."""
        if len(word) < FUZZY_LENGTH - EDITS:
            return None
        if not (any(word[:h] in s for h, s in self.fronts.items()) or any(word[-h:] in s for h, s in self.backs.items())
                or any(word[at : at + h] in s for (at, h), s in self.stem_backs.items())):
            return None
        # what lies beyond every term and its edits can only say that no whole word is near
        automaton, found = Levenshtein(word[: self.longest + EDITS + 1]), None
        todo = [(self.root, automaton.start, 0)]
        while todo:
            node, state, depth = todo.pop()
            kind = node.get("")
            if kind and depth >= FUZZY_LENGTH:
                if kind == "word" and state[-1] <= EDITS:
                    return "near"
                if kind == "stem" and min(state) <= EDITS:
                    found = "near_stem"
            for c, child in node.items():
                if c and min(after := automaton.step(state, c)) <= EDITS:
                    todo.append((child, after, depth + 1))
        return found


class Model:
    def __init__(self, words: list[str], stems: list[str], weights: np.ndarray | None = None, means: np.ndarray | None = None, base: float = 0.0):
        self.trie = Trie(words, stems)
        self.weights, self.means, self.base = weights, means, base
        self.known: dict[str, str | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def kind(self, word: str) -> str | None:
        if word in self.known:
            return self.known[word]
        if len(word) > MEMORY_LENGTH:
            return self.trie.exact(word) or self.trie.near(word)
        if len(self.known) >= MEMORY:
            self.known.clear()
        found = self.known[word] = self.trie.exact(word) or self.trie.near(word)
        return found

    def features(self, text: str | None) -> np.ndarray | None:
        """Numbers of a text, or None where nothing is hit."""
        if not text:
            return None
        low = text.lower()
        words = _WORD.findall(low)
        distinct = set(words)
        hits = {w: k for w in distinct if (k := self.kind(w))}
        if not hits:
            return None
        n = dict.fromkeys(FEATURES, 0.0)
        for m in re.finditer(r"(?<![^\W_])(?:" + "|".join(sorted(map(re.escape, hits), key=len, reverse=True)) + r")(?![^\W_])", low):
            n[hits[m[0]]] += 1
            before, after = low[max(0, m.start() - WINDOW) : m.start()], low[m.end() : m.end() + WINDOW]
            around = {*_WORD.findall(before), *_WORD.findall(after)}
            n["quoted"] += before[-1:] in _QUOTES and before != "" or _open_quote(before) and any(q in after for q in _QUOTES)
            n["reported"] += bool(around & REPORTS)
            n["spoken"] += bool(around & YOU)
        total = sum(n[k] for k in ("word", "stem", "near", "near_stem"))
        n["density"] = 1000 * total / len(words)
        n["kinds"] = len(hits)
        return np.log1p([n[k] for k in FEATURES])

    def score(self, text: str | None) -> float:
        x = self.features(text)
        if x is None or self.weights is None:
            return self.base
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + (x - self.means) @ self.weights[1:], -30, 30))))


def _open_quote(before: str) -> bool:
    return sum(before.count(q) for q in "\"“„«") % 2 == 1


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method, with an intercept that is not drawn to 0."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def choose_terms(rows: list[tuple[str, bool, int, int]], rate: float) -> tuple[list[str], list[str]]:
    """Words and stems from (term, is a stem, toxic texts, other texts). Short stems go before what they cover."""
    good = [(term, stem, t) for term, stem, t, c in rows if (t + 2 * rate) / (t + c + 2) >= MIN_SHARE]
    stems: list[str] = []
    for term in sorted((term for term, stem, _ in good if stem), key=lambda s: (len(s), s)):
        if not term.startswith(tuple(stems)):
            stems.append(term)
    words = sorted((-t, term) for term, stem, t in good if not stem and not term.startswith(tuple(stems)))
    return [term for _, term in words], stems


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model from about fit_rows labelled rows (a documented bound), none of them held out, chosen by a hash of the id.

    Terms are words, and beginnings of 4 to 6 characters that many different words share, which occur in toxic texts
    far more than in others. The weights of hits, by kind and context, come from logistic regression on the same rows.
    Rows without a label, id or text are not used; repeated rows count each. Without toxic rows every score is 0.
    """
    ship(docs.sparkSession)
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    share = min(1.0, fit_rows / max(1, y.count()))
    y = y.where(sampled(share, "toxicity", F.col(id_col)))
    y = y.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    rows = save(rows.join(y, F.col("id") == F.col("label_id")).select("text", "toxic"), "toxic_fit")

    def stems_of(words):
        return {(w[:k], w) for w in words if len(w) > 6 for k in (4, 5, 6)}

    def count_toxic(batches):
        texts_with, forms = Counter(), set()
        for (part,) in texts(batches, "text"):
            for text in part:
                words = _WORD.findall(text.lower())
                distinct = set(words)
                stems = stems_of(distinct)
                forms |= {(w, False, before) for before, w in zip(["", *words], words)} | {(s, True, w) for s, w in stems}
                texts_with.update([(w, False) for w in distinct])
                texts_with.update({(s, True) for s, _ in stems})
        rows = [(*k, "", n) for k, n in texts_with.items()] + [(t, stem, " " + f, 0) for t, stem, f in forms]
        columns = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.bool_(), pa.string(), pa.int64()))], names=["term", "stem", "form", "n"])

    # the rows are a bounded sample, so what is collected and broadcast here is bounded by it
    totals = rows.groupBy("toxic").count().collect()
    n_toxic, n = sum(r["count"] for r in totals if r.toxic == 1), sum(r["count"] for r in totals)
    if not n_toxic:
        return Model([], [])
    seen = rows.where("toxic = 1").select("text").mapInArrow(count_toxic, "term string, stem boolean, form string, n long")
    seen = seen.groupBy("term", "stem", "form").agg(F.sum("n").alias("n")).groupBy("term", "stem").agg(
        F.sum("n").alias("t"), (F.count("*") - 1).alias("forms"))
    able = f"t >= {MIN_TEXTS} AND CASE WHEN stem THEN forms >= {MIN_FORMS} ELSE forms >= greatest({MIN_CONTEXTS}, {CONTEXT_SHARE} * t) END"
    able = {(r.term, r.stem): r.t for r in seen.where(able).collect()}
    data = docs.sparkSession.sparkContext.broadcast(frozenset(able))

    def count_others(batches):
        wanted, texts_with = data.value, Counter()
        lengths = {len(t) for t, stem in wanted if stem}
        for (part,) in texts(batches, "text"):
            for text in part:
                distinct = set(_WORD.findall(text.lower()))
                texts_with.update(wanted.intersection([(w, False) for w in distinct]))
                texts_with.update(wanted.intersection({(w[:k], True) for w in distinct for k in lengths}))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in texts_with], pa.string()), pa.array([k[1] for k in texts_with], pa.bool_()), pa.array(list(texts_with.values()), pa.int64())], names=["term", "stem", "n"])

    others = rows.where("toxic <> 1").select("text").mapInArrow(count_others, "term string, stem boolean, n long")
    others = {(r.term, r.stem): r.n for r in others.groupBy("term", "stem").agg(F.sum("n").alias("n")).collect()}
    words, stems = choose_terms([(*k, t, others.get(k, 0)) for k, t in able.items()], n_toxic / n)
    model = Model(words, stems)

    def measure(batches):
        for part, toxic in texts(batches, "text", "toxic"):
            found = [model.features(t) for t in part]
            yield pa.RecordBatch.from_arrays([pa.array([None if f is None else f.tolist() for f in found], pa.list_(pa.float64())), pa.array(toxic, pa.int32())], names=["x", "toxic"])

    seen = rows.mapInArrow(measure, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    silent = [(r.toxic, r["count"]) for r in seen if r.x is None]
    base = (sum(k for t, k in silent if t == 1) + n_toxic / n) / (sum(k for _, k in silent) + 1)
    loud = sorted((tuple(r.x), int(r.toxic == 1), r["count"]) for r in seen if r.x is not None)
    if not loud:
        return Model(words, stems, base=base)
    x = np.repeat([r[0] for r in loud], [r[2] for r in loud], axis=0)
    y = np.repeat([r[1] for r in loud], [r[2] for r in loud])
    return Model(words, stems, _logistic(x - x.mean(axis=0), y), x.mean(axis=0), base)


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, score, predicted): score between 0 and 1 for each row of docs, predicted 1 from threshold on. Null and empty texts, and
    texts without a hit, get the share of toxic texts among such texts. Repeated rows stay; other columns are not
    read. The model (bounded by the rows it is fitted on) is broadcast, and nothing is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_type

    data = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = data.value.score

        def work(ids, part):
            scores = [score(t) for t in part]
            return {"id": ids, "score": scores, "predicted": [int(s >= threshold) for s in scores]}

        return work

    kind = docs.schema[id_col].dataType
    fields = pa.schema([("id", to_arrow_type(kind)), ("score", pa.float64()), ("predicted", pa.int32())])
    return map_texts(docs, id_col, text_col, f"id {kind.simpleString()}, score double, predicted int", fields, make)
