"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over
byte bigrams and trigrams (naive Bayes log ratios of the languages with the
bit against those without) gives a signed margin; decoding chooses the
codeword with the least logistic loss over the margins, each weighted by how
well its classifier separates the training sample. A close runner-up flags the
result as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from . import words as W
from .shared import SLICE_BYTES, lean_batches, small_table

#: Hashed n-gram features.
FEATURES = 1 << 15
#: Labelled documents of each language that the classifiers are fitted on, about.
SAMPLE = 4000
#: Weight in n-grams that one text has at most in fitting, whatever its length (a parameter of the model).
TEXT_WEIGHT = 4000
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature of the bigram and of the trigram at each byte; FEATURES where none lies inside its text."""
    b = _FOLD[data]
    n = len(b)
    two, three = np.full(n, FEATURES, np.uint32), np.full(n, FEATURES, np.uint32)
    if n > 2:
        pair = b[:-1] * np.uint32(256) + b[1:]
        two[:-1] = (pair * np.uint32(2654435761)) >> np.uint32(17)
        triple = (pair[:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
        three[:-2] = ((triple ^ (triple >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(17)
        blank = (b[:-1] == 32) & (b[1:] == 32)
        two[:-1][blank] = FEATURES
        three[:-2][blank[:-1]] = FEATURES
    ends = offsets[1:]
    for back, feature in ((1, two), (1, three), (2, three)):
        at = ends - back
        feature[at[at >= offsets[:-1]]] = FEATURES
    return two, three


def codewords(n: int) -> np.ndarray:
    """n x bits of +1 and -1: all splits for up to five languages, else the most spread of some random codes.

    The bits grow with the logarithm of n, so a model's weights do, too.
    """
    if n <= 5:
        columns = [[1 if (c >> i) & 1 else -1 for i in range(n)] for c in range(1 << max(0, n - 1), (1 << n) - 1)] if n > 1 else [[1]]
        return np.array(columns).T
    rng = np.random.default_rng(7)
    bits = ceil(10 * log2(n))
    best, spread = None, -1
    for _ in range(200 if n <= 200 else 5):  # codewords of a large n are far apart anyway
        code = rng.choice([-1, 1], (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        code = code.astype(np.float32)  # products of small whole numbers are exact
        apart = int(((code.shape[1] - code @ code.T) / 2 + np.eye(n, dtype=np.float32) * bits).min())
        if apart > spread:
            best, spread = code, apart
    return best


@dataclass
class Model:
    """languages, codeword of each, feature weights (bits x FEATURES+1) and trust in each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """rows x bits: mean log ratio times the root of the number of n-grams; and whether a row has a letter."""
        offsets, data = W.text_buffer(texts)
        two, three = features(data, offsets)
        n = np.diff(np.concatenate([[0], np.cumsum((two < FEATURES).astype(np.int64) + (three < FEATURES))])[offsets])
        out = np.zeros((len(n), len(self.weights)))
        for j, w in enumerate(self.weights):
            out[:, j] = np.diff(np.concatenate([[0.0], np.cumsum(w[two] + w[three], dtype=np.float64)])[offsets])
        letter = np.zeros(256, bool)
        letter[65:91] = letter[97:123] = True
        has = np.diff(np.concatenate([[0], np.cumsum(letter[data])])[offsets]) > 0
        for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
            has[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode()))
        return out / np.sqrt(np.maximum(n, 1))[:, None], has

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score in 0..1, ambiguous) by loss-weighted decoding."""
        # A bit's loss depends on the codeword by its sign alone: two products of matrices.
        on, off = np.logaddexp(0, -margins) * self.trust, np.logaddexp(0, margins) * self.trust
        loss = on @ (self.code > 0).T.astype(np.float64) + off @ (self.code < 0).T.astype(np.float64)
        best = loss.argmin(1)
        odds = np.exp(loss.min(1, keepdims=True) - loss)
        score = 1 / odds.sum(1)
        second = np.sort(odds, 1)[:, -2] if loss.shape[1] > 1 else np.zeros(len(loss))
        return best, score, second > 0.5

    def predict(self, texts: pa.Array) -> pa.StructArray:
        n = len(texts)
        if self.languages:
            margins, has = self.margins(texts)
            best, score, unsure = self.decode(margins)
            named = np.array([*self.languages, UNKNOWN], object)[np.where(has, best, len(self.languages))]
            score, unsure = np.where(has, score, 0.0), unsure & has
        else:
            named, score, unsure = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool)
        return pa.StructArray.from_arrays([pa.array(named, pa.string()), pa.array(score), pa.array(unsure)], ["lang", "score", "ambiguous"])


def _trainable(docs: DataFrame, sample: int, salt: int) -> DataFrame:
    """(lang, t): about `sample` texts of each language, chosen by a hash of their rows' ids.

    The driver has a row for each label, as the model has.
    """
    spark, step = docs.sparkSession, 1_000_000
    counts = [(r[0], min(step, ceil(step * sample / r[1]))) for r in docs.groupBy("lang").count().collect()]
    if not counts:
        return docs.select("lang", "t")
    draw = F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(step))
    some = docs.where(draw < max(share for _, share in counts)).withColumn("draw", draw)
    shares = small_table(spark, sorted(counts), "lang string, share long")
    return some.join(F.broadcast(shares), "lang").where("draw < share").select("lang", "t")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, text_weight: int = TEXT_WEIGHT) -> Model:
    """Fit on a bounded sample of the rows with a text and a label: about `sample` of each label."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang")).where("t is not null and lang is not null")
    chosen = _trainable(rows, sample, 1)
    out = pa.schema([("lang", pa.string()), ("feature", pa.int32()), ("n", pa.float64())])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                offsets, data = W.text_buffer(batch.column(1).slice(i, 1))
                both = np.concatenate(features(data, offsets))
                seen = np.bincount(both, minlength=FEATURES + 1)[:FEATURES]
                total = seen.sum()
                if total:  # a long text says no more than a few short ones
                    lang = batch.column(0)[i].as_py()
                    sums[lang] = sums.get(lang, 0) + seen * (min(total, text_weight) / total)
        for lang, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(x[at])], schema=out)

    found = chosen.mapInArrow(count, "lang string, feature int, n double").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found.column(0).to_pylist()))
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((0, FEATURES + 1)), np.zeros(0))
    table = np.zeros((len(languages), FEATURES))
    index = {x: i for i, x in enumerate(languages)}
    table[[index[x] for x in found.column(0).to_pylist()], found.column(1).to_numpy()] = np.round(found.column(2).to_numpy(), 6)
    share = (table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * FEATURES)
    code = codewords(len(languages))
    weights = np.zeros((code.shape[1], FEATURES + 1), np.float32)
    trust = np.ones(code.shape[1])
    for j in range(code.shape[1]):
        on, off = code[:, j] > 0, code[:, j] < 0
        if on.any() and off.any():
            p, q = share[on].mean(0), share[off].mean(0)
            weights[j, :FEATURES] = np.log(p / q)
            # How far a mean text of each side lies from the other: the divergence of the two.
            trust[j] = ((p - q) * np.log(p / q)).sum()
    return Model(languages, code, weights, trust / trust.mean())


def predictor(docs: DataFrame, model: Model):
    """A column function text -> struct(lang, score, ambiguous). The model that every task gets has FEATURES weights for each bit of the code: 1 MB for four labels, 13 MB for a thousand."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("lang string, score double, ambiguous boolean")
    def predict(texts: pa.Array) -> pa.Array:
        parts, start, size = [], 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if i > start and size + n > SLICE_BYTES:
                parts.append(shipped.value.predict(texts.slice(start, i - start)))
                start, size = i, 0
            size += int(n)
        parts.append(shipped.value.predict(texts.slice(start)))
        return pa.concat_arrays(parts)

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, held_col: str = "held_out", guess_col: str = "guess") -> DataFrame:
    """docs with two more columns: held_out, and guess: struct(lang, score, ambiguous).

    Learns from rows whose crc32(id) mod `folds` is not `held`, that have a
    label and a text. A prediction reads the text alone, and all of it. A text
    that is null or has no letter is 'und' with score 0, as is every text if
    there is nothing to learn from. Of languages with equal losses the first
    by name is the guess, and the guess is flagged as ambiguous. A row with a
    null id is neither held out nor learned from. Repeated rows are predicted
    alike. Input columns named as the two (`held_col`, `guess_col`) are an
    error; give other names then. Any others pass through. An empty table
    stays empty.
    """
    clash = {c.lower() for c in docs.columns} & {held_col.lower(), guess_col.lower()}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already: give held_col and guess_col other names")
    lean_batches(docs.sparkSession)
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
    model = fit(docs.where(fold != held), id_col, text_col, lang_col)
    return docs.withColumns({held_col: F.coalesce(fold == held, F.lit(False)), guess_col: predictor(docs, model)(F.col(text_col))})
