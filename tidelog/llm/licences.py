"""Licence scans: an Aho-Corasick automaton finds phrases and tags, a shunting-yard parser reads licence expressions."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import map_texts

#: Phrases (words in order) and labels of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases and labels.
NOTICES = {
    "mit license": "mit", "permission is hereby granted free of charge": "mit", "apache license": "apache", "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd", "mozilla public license": "mpl", "creative commons": "cc",
    "public domain": "public-domain", "cc0": "cc0", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "isc license": "isc", "unlicense": "unlicense",
}
TAG = "spdx license identifier"
#: How surely a label's phrase is a licence notice, and not common words; 0 to 1.
WEIGHT = {"cc": 0.6, "public-domain": 0.5, "cc0": 0.8, "unlicense": 0.6, "reserved": 0.7}
#: Prefix of an identifier in lower case: label.
FAMILIES = {"mit": "mit", "apache": "apache", "bsd": "bsd", "lgpl": "lgpl", "agpl": "agpl", "gpl": "gpl", "mpl": "mpl", "cc0": "cc0", "cc-by-nc": "cc-by-nc",
            "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc-by": "cc-by", "isc": "isc", "unlicense": "unlicense"}
#: Families whose licences allow use with little more than a notice.
PERMISSIVE = {"mit", "apache", "bsd", "isc", "cc0", "unlicense", "cc-by", "public-domain"}

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_EXPRESSION = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    low = identifier.lower()
    return next((label for prefix, label in FAMILIES.items() if low == prefix or low.startswith((prefix + "-", prefix + "+"))), "other")


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: with binds closer than and, and closer than or. None if the expression is malformed; what follows a
    complete expression at a word that cannot continue it is left out."""
    out, stack, operand = [], [], True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if token == "(":
            if not operand:
                break
            stack.append(token)
        elif token == ")":
            if operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif low in _BINDS:
            if operand:
                return None
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            if not operand:
                break
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """Labels of all licences named, and whether the whole is permissive: or needs one side, and needs both; with names an
    exception, which takes nothing away."""
    values = []
    for token in postfix:
        if token in _BINDS:
            (b, b_free), (a, a_free) = values.pop(), values.pop()
            values.append((a, a_free) if token == "with" else (a | b, a_free or b_free if token == "or" else a_free and b_free))
        else:
            label = family(token)
            values.append(({label}, label in PERMISSIVE))
    return values[0]


class Scanner:
    """Finds all phrases in one pass over a text's words."""

    def __init__(self, base=BASE, notices=NOTICES):
        self.base, self.notices = base, notices
        self.phrases = ahocorasick.Automaton()
        for phrase in {*base, *notices, TAG}:
            self.phrases.add_word(f" {phrase} ", phrase)
        self.phrases.make_automaton()

    def scan(self, text: str | None) -> dict:
        """Words are runs of digits, letters and all characters beyond ASCII, A-Z lower-cased. UTF-8 bytes stand for characters while
        searching, as no phrase's bytes can begin inside a character."""
        raw = (text or "").encode("utf-8", "replace")
        words = raw.translate(_FOLD).split()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        hits = [(at - len(phrase) - 1, phrase) for at, phrase in self.phrases.iter(line)]
        base = sorted({at for at, p in hits if p in self.base})
        found = {self.base[p] for _, p in hits if p in self.base}
        labels = {self.notices[p] for _, p in hits if p in self.notices}
        expressions, free = [], None
        if any(p == TAG for _, p in hits):
            for m in _EXPRESSION.finditer(text):
                if postfix := to_postfix(m[1]):
                    named, permissive = evaluate(postfix)
                    labels |= named
                    free = permissive if free is None else free and permissive
                    expressions.append(" ".join(postfix))
        score = 1.0
        for label in found | labels:
            score *= 1 - (0.99 if expressions else WEIGHT.get(label, 0.9))
        place = lambda at: line.count(" ", 0, at)  # noqa: E731  # words before it: as many blanks, less the first, plus its own
        return {"n_words": len(words), "n_base": sum(p in self.base for _, p in hits), "first_word": place(base[0]) if base else None,
                "last_word": place(base[-1]) if base else None, "base_labels": ",".join(sorted(found)), "labels": ",".join(sorted(found | labels)),
                "score": 1 - score, "expressions": expressions, "permissive": free}


SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "expressions array<string>, permissive boolean")


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, number of words, base places with first and last word, labels (distinct, sorted,
    comma-joined; empty if none), score (0 without a label), licence expressions in postfix form, and whether they are permissive (null
    without one). A null or empty text has no words. Repeated rows stay; other columns are not read. Nothing is shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    def make():
        scan = Scanner().scan

        def work(ids, part):
            rows = [scan(t) for t in part]
            return {"id": ids} | {k: [r[k] for r in rows] for k in rows[0]} if rows else {}

        return work

    kind = docs.schema[id_col].dataType
    fields = pa.schema([("id", to_arrow_type(kind)), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_())])
    return map_texts(docs, id_col, text_col, f"id {kind.simpleString()}, {SCHEMA}", fields, make)
