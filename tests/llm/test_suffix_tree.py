"""Scores of the suffix tree against a plain tree of dictionaries."""

import collections
import math
import random
import zlib

import pytest

from tessera.llm.suffix_tree import score_documents

import brute


def plain_scores(rows, depth, least=2, smoothing=8.0):
    """The score of each row, by dictionaries over all contexts up to `depth`."""
    texts = [["<s>", *brute.spaced(t, True), "</s>"] for _, t in rows]
    learned = [x for (i, _), x in zip(rows, texts) if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(w for x in learned for w in x[1:])
    n, size, ends = counts.total(), counts.total() + len(counts) + 1, len(learned)
    common = {w for w, c in counts.items() if c >= least and w != "</s>"}
    rare = max(1 / size, 1 - (sum(counts[w] + 1 for w in common) + ends + 1) / size)
    unigram = lambda w: (counts[w] + 1) / size if w in common or w == "</s>" else rare
    fold = lambda x: tuple(w if w in common or w in ("<s>", "</s>") else "" for w in x)
    states = {}

    def probability(before, w):
        p = unigram(w)
        for d in range(1, len(before) + 1):
            if (c := before[-d:]) in states:
                p = (states[c][w] + smoothing * p) / (states[c].total() + smoothing)
        return p

    for d in range(1, depth + 1):
        following = collections.defaultdict(collections.Counter)
        for x in map(fold, learned):
            for j in range(d, len(x)):
                following[x[j - d : j]][x[j]] += 1
        passed = {}
        for c, after in following.items():
            total = after.total()
            gain = sum(k * math.log(k / total / probability(c[1:], w)) for w, k in after.items())
            if total >= least and gain > 0.5 * math.log(total) * len(after):
                passed[c] = after
        states.update(passed)
    deepest = max(map(len, states), default=0)
    out = []
    for x in texts:
        y = fold(x)
        score = sum(math.log10(probability(y[max(0, j - deepest) : j], y[j])) for j in range(1, len(y)))
        out.append(score + sum(math.log10((counts[w] + 1) / size / rare) for w, z in zip(x, y) if z == ""))
    return out, deepest


def passages():
    """Texts of frequent and rare words, some with a passage in common, and copies."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    shared = [" ".join(rng.choices(words, k=12)) for _ in range(4)]
    text = lambda k: " ".join(rng.choice(words) if rng.random() < 0.9 else f"r{rng.randrange(10**6)}" for _ in range(k))
    rows = [(i, f"{text(rng.randint(0, 25))} {rng.choice(shared)} {text(rng.randint(0, 25))}") for i in range(60)]
    return rows + [(100 + i, t) for i, (_, t) in enumerate(rows[:6])] + [(200, None), (201, "la " * 30), (202, "")]


@pytest.mark.parametrize("depth", (1, 2, 5, 10))
def test_scores_equal_plain_tree(spark, depth):
    rows = passages()
    want, deepest = plain_scores(rows, depth)
    assert deepest == depth
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: r.score for r in score_documents(docs, depth=depth).collect()}
    assert len(got) == len(rows)
    for (i, _), s in zip(rows, want):
        assert math.isclose(got[i], s, rel_tol=1e-9), i


def test_a_pair_counts_in_a_corpus_of_any_size(spark):
    """Two documents in common have pairs of their own, however many others there are."""
    rng = random.Random(7)
    # Ids that are learned from.
    ids = [i for i in range(40_000) if zlib.crc32(str(i).encode()) % 7 != 2]
    twice = " ".join(f"t{i}" for i in range(20))
    shuffled = " ".join(rng.sample([f"t{i}" for i in range(20)], 20))
    noise = [(i, " ".join(f"n{rng.randrange(3000)}" for _ in range(20))) for i in ids[3:20_000]]
    rows = [(ids[0], twice), (ids[1], twice), (ids[2], shuffled), *noise]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: r for r in score_documents(docs).where(f"id <= {ids[2]}").collect()}
    assert math.isclose(got[ids[0]].base_score, got[ids[2]].base_score, rel_tol=1e-9)
    assert got[ids[0]].score > got[ids[2]].score + 5


@pytest.mark.parametrize("partitions", (1, 40))
def test_ranges_of_hot_contexts_change_no_score(spark, partitions):
    """One word is a third of all tokens and a line stands in every text, so that cuts go through their contexts."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join([*(rng.choice(["the", *rng.choices(words, k=2)]) for _ in range(rng.randint(5, 40))), "a line that all of them have"])) for i in range(120)]
    rows += [(500, None), (None, "the the the"), (None, "the w1 the"), rows[3], rows[3], (600, "the " * 5000), (2**63 - 1, "the w1 w2")]
    want, _ = plain_scores(rows, 5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, base string, kind int").repartition(7)
        got = score_documents(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = lambda pairs: sorted(((i is None, i or 0, s) for i, s in pairs))
    for (a, b, s), (c, d, t) in zip(order((r.id, r.score) for r in got), order(zip((i for i, _ in rows), want)), strict=True):
        assert (a, b) == (c, d) and math.isclose(s, t, rel_tol=1e-7)


def test_probabilities_sum_to_one():
    """After any context the tuples of all symbols share a probability of one."""
    import numpy as np

    from tessera.llm import suffix_tree as T

    rng = np.random.default_rng(5)
    m = T.Model(400, 6, 40, 4, 300, 1, 4, 2, 3)
    counts = np.array([0, 90, 80, 70, 60, 40])
    some = rng.integers(1, 5, (4, 300))
    some[1, ::2] = some[0, ::2]
    every = np.array([[1, 2, 3, x] for x in range(6)]).T
    tuples = np.concatenate([some, every], axis=1)
    n = np.concatenate([np.ones(300, np.int64), np.zeros(6, np.int64)])
    p = T.probabilities(m, np.zeros(0, np.uint64), list(tuples[:3]), tuples[3], counts[tuples[3]], n, np.zeros(306, np.int64))
    assert abs(p[-6:].sum() - 1) < 1e-12
