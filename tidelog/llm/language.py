"""Language identification as a mixture: n-gram likelihoods, expectation-maximisation, penalised choice of languages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts, texts
from .shared import held_out, sampled, ship

#: Hash bins of byte trigrams.
BINS = 1 << 13
#: Bound of the labelled rows that the model is fitted on.
FIT_ROWS = 20_000
#: Log-likelihood that one more language must add, for each log of the text's trigrams.
PENALTY = 8.0
ROUNDS = 30
UNKNOWN = "und"


def histogram(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins and counts of the byte trigrams of a whole text, lower-cased, runs of non-letters as they are."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    gram = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(32 - 13)
    counts = np.bincount(gram, minlength=BINS)
    bins = np.flatnonzero(counts)
    return bins, counts[bins].astype(float)


class Model:
    """Languages and their trigram probabilities, smoothed by the probabilities over all languages."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        pooled = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * BINS)
        self.p = (counts + 200 * pooled) / (counts.sum(axis=1, keepdims=True) + 200) if languages else counts
        self.log_p = np.log(self.p)

    def proportions(self, bins: np.ndarray, counts: np.ndarray) -> dict[str, float]:
        """Languages of a text and their shares: the single best language, and more while each adds more
        log-likelihood to the mixture than the penalty."""
        p = self.p[:, bins]
        chosen = [int(np.argmax(self.log_p[:, bins] @ counts))]
        weights, mix = np.ones(1), p[chosen[0]]
        cost = PENALTY * np.log(counts.sum() + 1)
        while len(chosen) < len(self.languages):
            # the likelihood is concave in the shares: its slope towards a language bounds what that one can add
            slope = p @ (counts / mix) - counts.sum()
            slope[chosen] = -np.inf
            k = int(np.argmax(slope))
            if slope[k] <= cost:
                break
            trial = [*chosen, k]
            new = self._mixture(p[trial], counts)
            if counts @ np.log((new @ p[trial]) / mix) <= cost:
                break
            chosen, weights = trial, new
            mix = weights @ p[chosen]
        return {self.languages[k]: float(w) for k, w in zip(chosen, weights)}

    @staticmethod
    def _mixture(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expectation-maximisation for the shares of languages with known probabilities."""
        w, total = np.full(len(p), 1 / len(p)), counts.sum()
        for _ in range(ROUNDS):
            joint = w[:, None] * p
            new = (joint / joint.sum(axis=0)) @ counts / total
            if np.abs(new - w).max() < 1e-4:
                return new
            w = new
        return w

    def gain(self, bins: np.ndarray, counts: np.ndarray, shares: dict[str, float]) -> float:
        """Mean log-likelihood of a text's trigrams under the mixture less that under equal bins."""
        mix = sum(w * self.p[self.languages.index(k), bins] for k, w in shares.items())
        return float(counts @ np.log(mix * BINS) / counts.sum())

    def explain(self, text: str | None) -> tuple[str, float, dict[str, float], float | None]:
        """Language, share, shares and gain; und, 0, none and null for a text without a letter."""
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, {}, None
        found = histogram(text)
        shares = self.proportions(*found)
        best = max(shares, key=lambda k: (shares[k], k))
        return best, min(1.0, shares[best]), shares, self.gain(*found, shares)

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        return self.explain(text)[:3]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """A model from about fit_rows rows (a documented bound) with text, a language and an id that is not held out.

    Rows are taken by a hash of their id, all where there are fewer; repeated rows count each, and an empty text has nothing to count. Counts are summed by language and bin before they are
    collected: languages times BINS numbers. Without rows the model knows no language and answers und.
    """
    ship(docs.sparkSession)
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    total = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).count()
    share = min(1.0, fit_rows / max(1, total))
    usable = usable.where(sampled(share, "language", F.col(id_col)))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for part, langs in texts(batches, "text", "lang"):
            for text, lang in zip(part, langs):
                bins, counts = histogram(text)
                sums.setdefault(lang, np.zeros(BINS))[bins] += counts
        for lang, counts in sums.items():
            bins = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins)), pa.array(bins.astype(np.int32)), pa.array(counts[bins])], names=["lang", "bin", "n"])

    chosen = usable.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = chosen.mapInArrow(run, "lang string, bin int, n double").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in rows})
    counts = np.zeros((len(languages), BINS))
    for r in rows:
        counts[languages.index(r.lang), r.bin] += r.n
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """Rows (id, lang_pred, score, languages, gain): the language with the largest share, that share, all languages of the text with
    their shares, and how well they explain it: above 0 if better than equal probabilities of all trigrams would, which text in
    an unlearned language does not reach. und, 0 and a null gain for a null text or one without a letter. Repeated rows stay; other columns are not read.
    The model is broadcast: languages times BINS numbers. Rows are judged one by one; nothing is shuffled. With `carry`, a struct of the row's
    columns that has the text as its field text_col, that column stays with its row, so that rows can be kept without a join.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    data = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        explain = data.value.explain

        def work(ids, part):
            found = [explain(t) for t in part]
            return {"id": ids, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "languages": [list(f[2].items()) for f in found],
                    "gain": [f[3] for f in found]}

        return work

    kind = docs.schema[id_col].dataType
    fields = pa.schema([("id", to_arrow_type(kind)), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.map_(pa.string(), pa.float64())), ("gain", pa.float64())])
    return map_texts(docs, id_col, text_col, f"id {kind.simpleString()}, lang_pred string, score double, languages map<string,double>, gain double", fields, make, carry)
