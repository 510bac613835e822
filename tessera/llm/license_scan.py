"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Windows of a few lengths slide over the whole text; a text of fewer shingles
is one window. The lengths form a ladder whose steps grow by a quarter at
most, so that their number depends on the longest template and not on how many
there are; a template is sought by the shortest window that holds it. Each
window has one minimum per hash function, and a band is one minimum. The
templates' minima form a sorted table by (length, band), in which the windows'
minima are looked up. A window that holds 0.8 of a template's shingles shares
at least half of the union with it when aligned (0.8 m of m / 0.8 + 0.2 m
shingles for the widest), so that all BANDS bands miss with probability
2^-BANDS, about 1e-6. What a band retrieves is verified exactly: the share of
the template's shingles that occur in the window and a margin around it.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from . import words as W
from .licenses import TEMPLATES
from .shared import SLICE_BYTES, lean_batches

SHINGLE = 5
BANDS = 20
THRESHOLD = 0.8
#: Bytes of template texts at most: the table goes to every task.
TEMPLATE_BYTES = 64 << 20


def ladder(m: int) -> int:
    """The window length for a template of m shingles: the least step at or above m; steps are 1, 2, 3, 4, 5, then grow by a quarter at most."""
    step = 1
    while step < m:
        step = max(step + 1, step * 5 // 4)
    return step


class Templates:
    """Shingles and the band table of the templates; each needs five words at least."""

    def __init__(self, texts: Mapping[str, str]):
        self.names, self.shingles, self.sizes = [], [], []
        for name, text in sorted(texts.items()):
            words = W.tokenize(pa.array([text]), W.ALNUM_LOWER)
            if len(words.hash) < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            g = W.grams(words.hash, SHINGLE)
            self.names.append(name)
            self.shingles.append(np.unique(g))
            self.sizes.append(len(g))
        length = np.array([ladder(n) for n in self.sizes])
        #: By window length and band: sorted minima, and the template of each.
        self.table = {}
        for m in sorted(set(length.tolist())):
            ids = np.flatnonzero(length == m)
            for band in range(BANDS):
                low = np.array([hashed(self.shingles[i], band).min() for i in ids], np.uint64)
                order = np.argsort(low, kind="stable")
                self.table[m, band] = low[order], ids[order]
        self.lengths = sorted({m for m, _ in self.table})


def hashed(shingle: np.ndarray, band: int) -> np.ndarray:
    return W.mix(shingle ^ np.uint64((0xA0761D6478BD642F * (band + 1)) & 0xFFFFFFFFFFFFFFFF))


def _met(low: np.ndarray, start: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(templates, starts) of the windows whose minima are in a sorted table."""
    keys, ids = table
    some = np.flatnonzero(np.isin(low, keys) if len(keys) < 32 else keys[np.minimum(np.searchsorted(keys, low), len(keys) - 1)] == low)
    first, last = np.searchsorted(keys, low[some], "left"), np.searchsorted(keys, low[some], "right")
    size = last - first
    at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return ids[at], np.repeat(start[some], size)


def _retrieved(t: Templates, g: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
    """Sorted (template, window start) of all windows that agree with a template in some band."""
    if not len(g):
        return []
    found = []
    first, last = W.runs(row)
    whole = {m: np.flatnonzero(W.within(row, m)) for m in t.lengths}
    short = {m: np.flatnonzero(last - first < m) for m in t.lengths}
    for band in range(BANDS):
        h = hashed(g, band)
        lows = np.minimum.reduceat(h, first)
        for m in t.lengths:
            found.append(_met(W.sliding(h, m)[whole[m]], whole[m], t.table[m, band]))
            found.append(_met(lows[short[m]], first[short[m]], t.table[m, band]))
    who, start = (np.concatenate(x) for x in zip(*found))
    pairs = np.unique(np.stack([who, start], 1), axis=0)
    return [(int(i), int(s)) for i, s in pairs]


def scan(t: Templates, texts: pa.Array, threshold: float) -> list[list[dict]]:
    """Matches of each text: license, first_word, n_words, containment; the best window of overlapping ones."""
    words = W.tokenize(texts, W.ALNUM_LOWER)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    inside = W.within(words.row, SHINGLE)
    g = W.grams(words.hash, SHINGLE)
    at = np.flatnonzero(inside)
    g, row = g[at], words.row[at]
    base = np.concatenate([[0], np.cumsum(words.counts())])
    best: dict[tuple[int, int], list] = {}
    for i, s in _retrieved(t, g, row):
        m = ladder(t.sizes[i])
        margin = m // 4
        # The window with its margin, inside its row.
        low = max(s - margin, int(np.searchsorted(row, row[s])))
        high = min(s + m + margin, int(np.searchsorted(row, row[s], side="right")))
        hit = np.flatnonzero(np.isin(g[low:high], t.shingles[i]))
        share = len(np.unique(g[low:high][hit])) / len(t.shingles[i])
        if share < threshold:
            continue
        first, last = low + hit[0], low + hit[-1]
        spans = best.setdefault((i, int(row[s])), [])
        if spans and first <= spans[-1][1]:  # overlaps the one before: the better stays
            if share > spans[-1][2]:
                spans[-1] = (first, last, share)
        else:
            spans.append((first, last, share))
    for (i, r), spans in sorted(best.items()):
        for first, last, share in spans:
            out[r].append({"license": t.names[i], "first_word": int(at[first] - base[r]), "n_words": int(at[last] - at[first] + SHINGLE), "containment": share})
    return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] | DataFrame | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: id, license, first_word, n_words, containment.

    Words are runs of digits, letters and non-ASCII characters, A-Z folded;
    shingles are five words. Whole texts are scanned, of any length. Matches
    of one template that overlap, or are nearer to each other than a quarter of
    its length, are one, with the best containment, of equal ones the first. A text that is null, empty or has fewer than five words
    has no match. Repeated rows match alike, and rows with a null id are
    scanned as others; other columns are ignored, so their names cannot clash.
    An empty table gives an empty result. `templates`: texts by name, or a
    table (name, text) of TEMPLATE_BYTES at most.
    """
    lean_batches(docs.sparkSession)
    if isinstance(templates, DataFrame):
        size = templates.agg(F.sum(F.octet_length("name") + F.octet_length("text"))).first()[0] or 0
        if size > TEMPLATE_BYTES:
            raise ValueError(f"templates of more than {TEMPLATE_BYTES} bytes")
        templates = {r.name: r.text for r in templates.select("name", "text").collect()}
    shipped = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))

    @arrow_udf("array<struct<license: string, first_word: int, n_words: int, containment: double>>")
    def matches(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("containment", pa.float64())]))
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        out, start, size = [], 0, 0
        for i, n in enumerate(sizes):
            if i > start and size + n > SLICE_BYTES:
                out += scan(shipped.value, texts.slice(start, i - start), threshold)
                start, size = i, 0
            size += int(n)
        out += scan(shipped.value, texts.slice(start), threshold)
        return pa.array(out, kind)

    found = docs.select(F.col(id_col).alias("id"), matches(F.col(text_col)).alias("m")).where(F.size("m") > 0)
    return found.select("id", F.inline("m"))
