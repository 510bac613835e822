"""Ranked search, URL rules and hard negatives against plain versions, with nulls, ties, repeats, long rows and clashing names."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import hard_negatives, queries, ranked_search, url_rules

LOW = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def ranked(docs, items, k):
    """(item_id, rank, doc_id, score), by scoring every document."""
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, every = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            n = sum(c.values())
            m = 50 + (50 * n * n_docs) // max(every, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def corpus(seed=5, n=150):
    r = random.Random(seed)
    word = lambda: f"{r.choice('abcdeéß中')}{min(r.randrange(40), r.randrange(40))}"
    docs = [(i, " ".join(word() for _ in range(r.randrange(1, 60)))) for i in range(n)]
    docs += [(1000 + i, docs[3][1]) for i in range(70)]  # more ties than places
    docs += [(None, docs[3][1]), (7, docs[8][1]), (7, docs[8][1]), (501, None), (502, ""), (503, "... !"), (504, "A1 a1 " * 30_000 + docs[5][1]), (505, "x\x00y " + "b2-" * 50)]
    items = [(0, docs[3][1]), (1, docs[4][1] + " " + docs[5][1].upper()), (2, None), (3, "nothing known here"), (4, "a1"), (4, "b2 b2 a3"), (5, docs[20][1] * 3), (6, "!")]
    return docs, items


@pytest.mark.parametrize("k,block", [(50, 4096), (5, 2), (1, 3)])
def test_ranked_search_scores_like_a_full_scan(spark, monkeypatch, k, block):
    docs, items = corpus()
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", block)
    frame = spark.createDataFrame([(i, t, "t", 1, 2) for i, t in docs], "doc_id long, text string, doc string, n long, score long").repartition(3)
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id int, text string, block int")
    got = ranked_search.ranked_search(frame, asked, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items, k)


def test_ranked_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert not ranked_search.ranked_search(docs.limit(0), items).collect()
    assert not ranked_search.ranked_search(docs, items.limit(0)).collect()
    assert not ranked_search.ranked_search(docs.selectExpr("doc_id", "'-' as text"), items).collect()


def test_the_threshold_ends_a_search_early():
    """One document holds all terms of the query; the lists' long tails are never read."""
    n = 20_000
    queries_ = ranked_search.Queries(pa.array([1]), [["a", "b"]])
    term = np.concatenate([np.tile([0], n), [0, 1]])
    ends = np.concatenate([np.arange(n + 1), [n + 2]])
    impact = np.concatenate([np.arange(n) % 1000, [5000, 6000]])
    shard = ranked_search.Shard(2, np.arange(n + 1), np.zeros(n + 1, bool), ends, term, impact)
    best = ranked_search.Best(1, 1)
    seen = ranked_search.threshold_search(shard, queries_, best)
    assert best.doc.tolist() == [n] and best.score.tolist() == [11_000] and seen <= ranked_search.FIRST_READ + 1
    # A carried score ends the next shard in its first round; an equal one does not hide a smaller id.
    again = ranked_search.Shard(2, np.array([n, 5]), np.zeros(2, bool), np.array([0, 2, 4]), np.array([0, 1, 0, 1]), np.array([5000, 6000, 5000, 6000]))
    ranked_search.threshold_search(again, queries_, best)
    assert best.doc.tolist() == [5]


def test_whole_numbers_and_floats_add_up_alike(monkeypatch):
    r = np.random.default_rng(3)
    ends = np.concatenate([[0], np.cumsum(r.integers(0, 9, 400))])
    term = np.concatenate([np.sort(r.choice(30, e, replace=False)) for e in np.diff(ends)]).astype(np.int64)
    impact = r.integers(1, 50, len(term))
    q = ranked_search.Queries(pa.array(range(6)), [[f"w{j}" for j in sorted(set(r.integers(0, 30, 12).tolist()))] for _ in range(6)])
    results = []
    monkeypatch.setattr(ranked_search, "FIRST_READ", 1)
    for exact in (False, True):
        best = ranked_search.Best(6, 7)
        ranked_search.threshold_search(ranked_search.Shard(len(q.vocabulary.terms), np.arange(400), np.zeros(400, bool), ends, term % len(q.vocabulary.terms), impact), q, best, exact)
        results.append((best.item.tolist(), best.doc.tolist(), best.score.tolist()))
    assert results[0] == results[1]


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    held = ranked_search.Vocabulary(["aa", "bb", "cc"])
    held.hash[:] = 7
    held.alike = 3
    words = ranked_search.W.tokenize(pa.array(["bb dd cc AA"]), ranked_search.W.ALNUM_LOWER)
    words = words._replace(hash=np.full(len(words.hash), 7, np.uint64))
    assert [held.terms[i] if i >= 0 else None for i in held.numbers(words)] == ["bb", None, "cc", "aa"]


# ---- URLs ------------------------------------------------------------------


def parts(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    query = rest[len(host) + len(path) :]
    return host.translate(LOW), path, re.match(r"[^#]*", query[1:])[0] if query.startswith("?") else ""


def tokens(url):
    host, path, query = parts(url)
    names = [m for m in re.findall(r"(?:^|&)([^&=]+)", query)]
    found = [f"h:{x}" for x in host.split(".") if x] + [f"p:{x}" for x in terms(path)] + [f"q:{x.translate(LOW)}" for x in names]
    return list(dict.fromkeys(found))


def verdicts(urls, rules, support, confidence, most):
    """(id, host, path, rule, verdict, mined_rule, confidence) by counting every combination."""
    def fit(host, path):
        for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                return verdict, h + p

    seen = [(i, *parts(u)[:2], tokens(u)) for i, u in urls]
    known = [(t, fit(h, p)[0]) for _, h, p, t in seen if fit(h, p)]
    least = math.ceil(support * len(known))
    whole, part = collections.Counter(), collections.Counter()
    for t, v in known:
        for k in range(1, most + 1):
            for c in itertools.combinations(sorted(t), k):
                whole[c] += 1
                part[c, v] += 1
    made = {(c, v): (n / whole[c], n) for (c, v), n in part.items() if n >= least and n / whole[c] >= confidence}
    kept = {(c, v): x for (c, v), x in made.items() if not any((s, v) in made and made[s, v][0] >= x[0] for k in range(1, len(c)) for s in itertools.combinations(c, k))}
    out = []
    for i, host, path, t in seen:
        found = fit(host, path)
        if found:
            out.append((i, host, path, found[1], found[0], None, None))
            continue
        fits = sorted((-x[0], -x[1], len(c), " ".join(c), v == "allow", v) for (c, v), x in kept.items() if set(c) <= set(t))
        out.append((i, host, path, None, fits[0][5] if fits else "allow", fits[0][3] if fits else None, -fits[0][0] if fits else None))
    return sorted(out, key=repr)


def urls():
    r = random.Random(2)
    made = [(i, f"{r.choice(['http', 'https'])}://{r.choice(['', 'www.', 'Blog.'])}{r.choice(['ab', 'cd', 'cheap-pills', 'ef'])}.example.{r.choice(['com', 'net', 'org', 'NET'])}/{r.choice(['en', 'de', 'fr', 'es'])}/{r.randrange(500)}{r.choice(['', '.html', '?page=2&ref=x', '#top', '?utm=1#a?b'])}") for i in range(300)]
    odd = [None, "", "no scheme", "://", "x://net", "x://net/", "x://net?a/b", "x://evilnet/", "http://EXAMPLE.net/en/", "http://example.net/EN/", "http://example.net/en", "a://b://c.net/", "http://h.net:80/", "http://a.net#/x", "http://example.com/de/" + "x/" * 20_000, "http://ü.org/fr/é\nb?q\x00=1&=&&z", "http://..net/"]
    return made + [(None if j % 5 == 0 else 1000 + j, u) for j, u in enumerate(odd)] + made[:5]


@pytest.mark.parametrize("support,confidence,most", [(0.01, 0.8, 3), (0.05, 0.6, 2), (0.2, 0.95, 1)])
def test_url_rules_equal_counting_all_combinations(spark, support, confidence, most):
    rows = urls()
    frame = spark.createDataFrame([(i, u, "h", "v", 1) for i, u in rows], "page_id long, url string, host string, verdict string, row long").repartition(3)
    got = url_rules.filter_urls(frame, queries.URL_RULES, support=support, confidence=confidence, tokens=most)
    assert got.columns == ["id", "host", "path", "rule", "verdict", "mined_rule", "confidence"]
    assert sorted(map(tuple, got.collect()), key=repr) == verdicts(rows, queries.URL_RULES, support, confidence, most)


def test_url_rules_from_labels_of_ones_own(spark):
    labelled = [(f"http://{'spam' if i % 2 else 'ham'}{i % 3}.example.com/{'win' if i % 2 else 'read'}/{i}", "block" if i % 2 else "allow") for i in range(60)]
    labelled += [(None, "block"), ("http://spam0.example.com/win/1", None)]
    frame = spark.createDataFrame(labelled, "url string, label string")
    pages = spark.createDataFrame([(1, "http://new.example.com/win/9"), (2, "http://new.example.com/read/9"), (3, "http://new.example.com/other")], "page_id long, url string")
    got = {r.id: (r.verdict, r.mined_rule) for r in url_rules.filter_urls(pages, [], frame).collect()}
    assert got == {1: ("block", "p:win"), 2: ("allow", "p:read"), 3: ("allow", None)}


def test_url_rules_without_pages_or_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in url_rules.filter_urls(pages, queries.URL_RULES).collect()] == ["allow", "allow"]
    assert not url_rules.filter_urls(pages.limit(0), queries.URL_RULES).collect()


# ---- hard negatives --------------------------------------------------------


def negatives(rows, every, k, m, share=80):
    """(anchor, positive, rank, negative, scores) by all pairs."""
    ok = [(i, g, [math.floor(256 * float(x)) for x in v]) for i, v, g in rows if g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, g, v in ok:
        if i is None or i % every:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))
        good = sorted(((score(w), j) for j, h, w in ok if h == g and j != i), key=key)[:k]
        bad = sorted(((score(w), j) for j, h, w in ok if h != g), key=key)
        for p, j in good:
            inside = [(s, n) for s, n in bad if share * p <= 100 * s <= 100 * p][:m]
            out += [(i, j, r + 1, n, p, s) for r, (s, n) in enumerate(inside)]
    return sorted(out, key=repr)


def vectors(n=400, width=12, seed=4):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(4, width))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 4] * 0.2 + r.normal(size=width) * 0.2], int(i % 4)) for i in range(n)]
    rows += [(1000 + i, rows[11][1], i % 2) for i in range(60)]  # ties, more than places
    rows += [(2000, None, 1), (2100, [0.1] * width, None), (2200, [0.1] * (width - 1) + [None], 1), (2300, [float("nan")] * width, 1), (2400, [float("inf")] * width, 1)]
    rows += [(2500, [0.3, 0.2], 1), (2600, [], 2), (None, rows[20][1], 0), (None, rows[21][1], 3), (100, rows[100][1], 0)]
    return rows


@pytest.mark.parametrize("block,anchors", [(4096, 2048), (50, 2), (13, 3)])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, block, anchors):
    rows = vectors()
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", anchors)
    frame = spark.createDataFrame([(i, v, g, "x", 1) for i, v, g in rows], "vec_id long, embedding array<float>, label int, block string, score long").repartition(3)
    got = hard_negatives.mine_hard_negatives(frame, every=20)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=repr) == negatives(rows, 20, 5, 5)


def test_hard_negatives_of_nothing(spark):
    frame = spark.createDataFrame([(100, [0.1, 0.2], 1), (101, [0.1, 0.2], 1)], "vec_id long, embedding array<float>, label int")
    assert not hard_negatives.mine_hard_negatives(frame.limit(0)).collect()
    assert not hard_negatives.mine_hard_negatives(frame).collect()  # one label alone
    assert not hard_negatives.mine_hard_negatives(frame.where("vec_id = 101")).collect()  # no anchor


def test_a_component_too_large_is_an_error(spark):
    frame = spark.createDataFrame([(100, [1e9, 0.2], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="or more"):
        hard_negatives.mine_hard_negatives(frame).collect()


def test_bounds_hold_and_leave_few_rows_to_score():
    r = np.random.default_rng(1)
    x = np.floor(r.normal(size=(3000, 16)) * 60).astype(np.int64)
    codes, edges = hard_negatives.cells_of(x)
    block = hard_negatives.Block({"n": 3000, "width": 16, "ids": np.arange(3000).tobytes(), "labels": (np.arange(3000) // 1500).tobytes(), "vectors": x.astype(np.int32).tobytes(), "codes": codes.tobytes(), "edges": edges.tobytes()}, "")
    for anchor in x[:20]:
        least, most = block.bounds(anchor, 0, 3000)
        exact = x @ anchor
        assert (least <= exact).all() and (exact <= most).all()
        floor = np.sort(least)[-5]
        assert (most >= floor).sum() < 60  # of 3000
