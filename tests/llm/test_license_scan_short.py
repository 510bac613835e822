"""Texts with fewer shingles than a template."""

import random

import pyarrow as pa
import pytest

from tessera.llm import license_scan

import brute


def test_a_template_without_its_last_word_is_found(spark):
    names = ("Apache-2.0-header", "MIT-text", "GPL-3.0-header")
    rows = [(i, license_scan.TEMPLATES[n].rsplit(" ", 1)[0]) for i, n in enumerate(names)]
    docs = spark.createDataFrame([*rows, (9, "some other words that are no license")], "doc_id long, text string").repartition(2)
    got = {(r.id, r.license): r for r in license_scan.scan_licenses(docs).collect()}
    for (i, text), name in zip(rows, names):
        found = got.pop((i, name))
        assert 0.95 < found.containment < 1 and (found.first_word, found.n_words) == (0, len(brute.alnum(text)))
    assert {k for k in got if k[1] in names or k[0] == 9} == set()


@pytest.mark.parametrize("seed", range(3))
def test_short_texts_equal_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    templates = {f"t{n}": " ".join(rng.choices(vocabulary, k=n)) for n in (5, 9, 30, 120)}
    texts = []
    for _ in range(80):
        w = templates[rng.choice(list(templates))].split()
        gone = rng.randint(0, len(w) // 3)
        w = w[rng.randint(0, gone) :][: len(w) - gone]
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w + rng.choices(vocabulary, k=rng.choice([0, 0, 2]))))
    # Also each alone, so that the slice itself is shorter than the templates.
    t = license_scan.Templates(templates)
    found = license_scan.scan(t, pa.array(texts), 0.8)
    assert found == [license_scan.scan(t, pa.array([x]), 0.8)[0] for x in texts]
    short = 0
    for text, matches in zip(texts, found):
        w = brute.alnum(text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        for name, template in templates.items():
            tw = template.split()
            want = {tuple(tw[i : i + 5]) for i in range(len(tw) - 4)}
            m = len(tw) - 4
            best = max((len(want & set(grams[max(0, s - m // 4) : s + m + m // 4])) / len(want) for s in range(max(1, len(grams) - m + 1))), default=0)
            assert (best >= 0.8) == any(x["license"] == name for x in matches)
            short += best >= 0.8 and len(grams) < m
    assert short > 5
