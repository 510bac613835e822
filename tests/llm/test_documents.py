"""Operators over documents: brute force on hard tables, and on the driver's."""

import collections
import hashlib
import math
import random
import zlib

import pyarrow as pa
import pytest

from tessera.llm import license_scan, near_dedup, substring_dedup
from tessera.llm.decontaminate import find_overlap
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.language_id import identify
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.sharding import shard_documents
from tessera.llm.stages import encoder
from tessera.llm.substring_dedup import deduplicate_substrings
from tessera.llm.suffix_tree import score_documents

import brute

#: Columns whose names the operators use themselves.
CLASH = ["id", "nth", "t", "doc", "tag", "digest", "size", "fp", "node", "component", "lang", "n", "own", "first", "words"]


def table(spark, rows, clash=True):
    schema = "doc_id long, text string" + "".join(f", {c} string" for c in CLASH if clash)
    filled = [(*r, *(("x",) * (len(CLASH) - 1) + (None,) if clash else ())) for r in rows]
    return spark.createDataFrame(filled, schema).repartition(3)


def hard_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.randint(60, 200))) for _ in range(12)]
    rows = [(10 * i, t) for i, t in enumerate(base)]
    rows += [(10 * i + 1, t) for i, t in enumerate(base[:4])]  # copies
    rows += [(10 * i + 2, t.replace(" ", "\t\n ")) for i, t in enumerate(base[:3])]  # other white space
    for i, t in enumerate(base):  # a few words changed, or a passage taken over
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((10 * i + 3, " ".join(w)))
        rows.append((10 * i + 4, "new start " + " ".join(base[i - 1].split(" ")[:70]) + " end " + word()))
    rows += [(500, None), (501, ""), (502, " \n "), (503, "!!! 123"), (504, "one two three"), (505, "one two three"), (None, "no id " + base[0]), (None, None)]
    rows += [rows[3], rows[3]]  # repeated rows
    rows.append((600, " ".join(base) * 30))  # long
    rows.append((601, "z" * 200_000))  # one long word
    rows.append((602, "la " * 400))  # one word over and over
    return rows


def key(rows):
    return sorted(rows, key=repr)


def test_exact_dedup(spark):
    rows = hard_rows()
    got = exact_dedup(table(spark, rows)).collect()
    norm = [brute.SPACED.sub(lambda m: m[0], t or "") for _, t in rows]
    norm = [__import__("re").sub(r"[\x20\x09-\x0D]+", " ", t) for t in norm]
    groups = collections.defaultdict(list)
    for (i, _), t in zip(rows, norm):
        groups[t].append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, least[t], len(groups[t]), brute.sha(t)) for (i, _), t in zip(rows, norm)]
    assert key((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got) == key(want)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.id == r.keep_id for r in kept)


def test_exact_dedup_of_many_runs(spark):
    rows = [(i, f"t {i % 37}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    for fan_in in (2, 3, 8):
        got = {r.id: r.keep_id for r in exact_dedup(df, fan_in=fan_in).collect()}
        assert got == {i: i % 37 for i, _ in rows}


def test_substring_dedup(spark):
    rows = hard_rows()
    for batches in (1, 3, 5):
        got = deduplicate_substrings(table(spark, rows), batches=batches).collect()
        assert key((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == key(brute.substring_dedup(rows))
    assert all(brute.sha(r.kept) == r.kept_sha256 for r in got)


def test_fingerprint_index_compacts(spark):
    rows = [r for r in hard_rows() if r[0] is not None]
    docs = table(spark, rows, clash=False).selectExpr("doc_id as doc", "coalesce(text, '') as t")
    for fan_in, levels in ((2, [2]), (3, [0, 1]), (9, [0, 0, 0, 0])):
        index, got = substring_dedup.FingerprintIndex(spark, fan_in=fan_in), []
        for low, high in ((0, 31), (31, 62), (62, 93), (93, 1000)):
            got += index.ingest(docs.where(f"doc >= {low} and doc < {high}")).collect()
        assert sorted(level for level, _ in index.runs) == levels  # four runs of level 0 became one of level 2
        assert key((r.doc, r.n_words, r.n_removed, r.kept_sha256) for r in got) == key(brute.substring_dedup(rows))


def test_runs_are_joined_in_place(spark):
    """No run is exchanged or sorted when a batch comes or runs are compacted."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(80)))], "doc long, t string")
    index = substring_dedup.FingerprintIndex(spark, fan_in=9)
    index.ingest(docs)
    run = index._of(index.runs[0][1], substring_dedup.RUN)
    sent = docs.mapInArrow(substring_dedup._segments(1), substring_dedup._COLUMNS).mapInArrow(substring_dedup._send(50, index.buckets), substring_dedup._COLUMNS)
    joined = sent.groupBy("bucket").cogroup(run.groupBy("bucket")).applyInArrow(substring_dedup._answer(True), substring_dedup._COLUMNS)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    both = run.groupBy("bucket").cogroup(run.groupBy("bucket")).applyInArrow(substring_dedup._merge(1), substring_dedup._COLUMNS)
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()


def test_words_are_compared_before_they_go(spark, monkeypatch):
    """Windows with one hash and other words stay whole."""
    from tessera.llm import words as W

    tm = [0]
    for _ in range(10):
        tm += [1 - x for x in tm]
    long = ["".join("ab"[x ^ y] for x in tm[:1024]) for y in (0, 1)]  # alike for any polynomial modulo 2^64
    rows = [(i, " ".join([f"w{j}" for j in range(49)] + [long[i]])) for i in range(2)]
    assert [r.n_removed for r in deduplicate_substrings(table(spark, rows)).collect()] == [0, 0]
    # With a hash that takes all words for equal, segments ask for what is not there; _cut compares.
    s = substring_dedup.Segment(next(iter(_segment([rows[0]]))))
    monkeypatch.setattr(W, "grams", lambda h, k: W.np.ones(max(0, len(h) - k + 1), W.U64))
    s.windows(50)
    assert len(s.hash) == 1
    first, second = (next(iter(_segment([r], n))) for n, r in enumerate(rows))
    asked = substring_dedup.record(substring_dedup._SCHEMA, [(0, substring_dedup.REQUEST, None, None, 1 << 48, substring_dedup.squeezed(W.np.array([0])), substring_dedup.squeezed(W.np.array([1])), substring_dedup.squeezed(W.np.array([0])))], pa.Table)
    told = substring_dedup._reply(50)(pa.concat_tables([pa.Table.from_pylist([first], substring_dedup._SCHEMA), asked]))
    assert substring_dedup._cut(50)(pa.concat_tables([pa.Table.from_pylist([second], substring_dedup._SCHEMA), told])).column("n_removed").to_pylist() == [0]
    own = pa.Table.from_pylist([{**told.to_pylist()[0], "seg": 0}], substring_dedup._SCHEMA)
    assert substring_dedup._cut(50)(pa.concat_tables([pa.Table.from_pylist([first], substring_dedup._SCHEMA), own])).column("n_removed").to_pylist() == [50]


def _segment(rows, number=0):
    import zstandard

    from tessera.llm.packed import squeezed
    import numpy as np

    for i, t in rows:
        raw = t.encode()
        yield {"seg": number << 48, "kind": substring_dedup.SEGMENT, "bucket": None, "level": None, "other": None, "a": np.array([i], "<i8").tobytes(), "b": squeezed(np.array([len(raw)])), "c": zstandard.ZstdCompressor().compress(raw), "d": None}


def test_decontamination(spark):
    rows = hard_rows()
    words = rows[0][1].split(" ")
    items = [(1, " ".join(words[5:30])), (2, "One, TWO; three!"), (3, None), (4, " "), (None, " ".join(words[40:55])), (5, "absent words that nothing here has at all in any row"), (1, " ".join(words[5:30])), (6, " ".join(words[50:61]).upper())]
    test = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, fp string")
    got = find_overlap(table(spark, rows), test).collect()
    want = brute.overlap(rows, items)
    assert key((r.id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == key(want)
    assert sum(x[5] for x in want) > 5
    none = find_overlap(table(spark, rows), test.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


def test_near_duplicates(spark):
    rows = hard_rows()
    got = near_duplicates(table(spark, rows)).collect()
    group = brute.near_groups([t for _, t in rows])
    members = collections.defaultdict(list)
    for (i, t), g in zip(rows, group):
        members[g].append((i, t))
    want = sorted((i is None, i or 0, min((x for x, _ in m if x is not None), default=None) or 0) for m in members.values() for i, _ in m)
    assert sorted((r.id is None, r.id or 0, r.group_id or 0) for r in got) == want
    assert sum(r.kept for r in got) == len(members)


def test_near_duplicates_of_a_star_and_a_chain(spark):
    """A centre that all are near to, though not to each other; and a chain whose ends are far apart."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 61):
        w = list(base)
        for k in rng.sample(range(0, 200, 9), 4):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    chain = [f"c{j}" for j in range(150)]
    for i in range(12):
        rows.append((100 + i, " ".join(chain)))
        chain = chain[4:] + [f"d{i}_{j}" for j in range(4)]
    got = {r.id: r.group_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    group = brute.near_groups([t for _, t in rows])
    assert got == {i: rows[g][0] for (i, _), g in zip(rows, group)}


def test_prob_min_hash_estimates_probability_jaccard():
    rng = random.Random(2)
    a = {i: rng.randint(1, 4) for i in range(300)}
    b = {i: max(1, w + rng.choice([-1, 0, 0, 1])) for i, w in a.items() if i % 11} | {1000 + i: 1 for i in range(20)}
    import numpy as np

    rows = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
    key64 = np.array([*a, *b], np.uint64) * np.uint64(2654435761)
    weight = np.array([*a.values(), *b.values()])
    sig = near_dedup.prob_min_hash(rows, key64, weight, 2, registers=4096)
    assert abs((sig[0] == sig[1]).mean() - brute.prob_jaccard(a, b)) < 0.04
    one = near_dedup.prob_min_hash(np.array([0]), np.array([7], np.uint64), np.array([1]), 2)
    assert (one[0] == 7).all() and (one[1] == 0).all()


def test_sharding(spark):
    rows = hard_rows()
    got = shard_documents(table(spark, rows), shards=7).collect()
    assert len(got) == len(rows)
    where, size = {}, collections.Counter()
    for r in got:
        size[r.shard] += r.size
    by_id = collections.defaultdict(list)
    for i, t in rows:
        by_id[i].append(t)
    for r in got:
        assert any(r.size == len((t or "").encode()) + 16 and r.text_crc32 == zlib.crc32((t or "").encode()) for t in by_id[r.id])
        assert where.setdefault((r.text_crc32, r.size), r.shard) == r.shard  # equal texts together
    for s in size:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    groups = collections.Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 16
    first = {}
    for i, t in rows:
        first[t or ""] = min(first.get(t or "", (True, 0)), (i is not None, i or 0))
    laid = [groups[t] for t in sorted(groups, key=lambda t: (first[t], hashlib.sha256(t.encode()).digest()))]

    def fits(capacity):
        n, at = 1, 0
        for s in laid:
            n, at = (n + 1, s) if at + s > capacity else (n, at + s)
        return n <= 7

    low, high = max(laid) - 1, sum(laid)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    assert max(size.values()) == high
    assert shard_documents(table(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_smallest_capacity_is_exact(seed):
    from tessera.llm.sharding import Ends, balanced_cuts, smallest_capacity

    rng = random.Random(seed)
    for _ in range(60):
        sizes = [rng.choice([16, rng.randint(17, 3000), rng.randint(17, 90_000)]) for _ in range(rng.choice([1, 5, 40, 300]))]
        shards, ends = rng.choice([1, 3, 40]), []
        for s in sizes:
            ends.append((ends[-1] if ends else 0) + s)

        def read(shift, coarse, keys):
            found = collections.defaultdict(list)
            for e in ends:
                if keys is None or e >> coarse in keys:
                    found[e >> shift].append(e)
            return [(k, min(v), max(v)) for k, v in found.items()]

        def fits(capacity):
            n, at = 1, 0
            for s in sizes:
                n, at = (n + 1, s) if at + s > capacity else (n, at + s)
            return n <= shards

        known = Ends(ends[-1], read, 64)
        capacity = smallest_capacity(known, shards, max(sizes))
        assert fits(capacity) and (capacity == max(sizes) or not fits(capacity - 1))
        cuts = balanced_cuts(known, shards, capacity)
        assert cuts[-1] == ends[-1] and all(b - a <= capacity and b >= a for a, b in zip([0, *cuts], cuts))
        assert max(b - a for a, b in zip([0, *cuts], cuts)) == capacity  # the least that any cuts reach


def test_scoring(spark):
    rows = hard_rows()
    got = score_documents(table(spark, rows)).collect()
    counts, texts = collections.Counter(), collections.defaultdict(list)
    for i, t in rows:
        tokens = [*brute.spaced(t, True), "\0"]
        texts[i].append(tokens)
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens)
    n, v = counts.total(), len(counts)
    assert len(got) == len(rows)
    for r in got:
        base = lambda tokens: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        assert r.train_tokens == n and r.held_out == (r.id is not None and zlib.crc32(str(r.id).encode()) % 7 == 2)
        want = [(len(x), sum(counts[w] > 0 for w in x), base(x)) for x in texts[r.id]]
        assert any((a, b) == (r.n_tokens, r.n_known) and math.isclose(c, r.base_score, rel_tol=1e-9) for a, b, c in want), (r, want)
        assert r.score < 0
    assert score_documents(table(spark, [])).collect() == []


def test_the_suffix_tree_helps(spark, data):
    held = score_documents(spark.read.parquet(f"{data}/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"]


def test_language_id(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.guess.lang == r.lang for r in held) / len(held) > 0.97
    rows = [(i, t, None) for i, t in hard_rows()] + [(9000 + i, r.text, r.lang) for i, r in enumerate(docs.limit(100).collect())]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for r in identify(odd).collect():
        assert (r.guess.lang == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.guess.score <= 1
    none = identify(odd.where("lang is null")).collect()
    assert all(r.guess.lang == "und" and r.guess.score == 0 for r in none)
    assert identify(odd.limit(0)).collect() == []


def test_codewords_are_apart():
    from tessera.llm.language_id import codewords

    for n in (2, 3, 4, 5, 9, 30):
        code = codewords(n)
        assert len({tuple(c) for c in code}) == n
        apart = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        assert apart >= (2 if n == 3 else 1 if n == 2 else 4)


def test_license_scan(spark):
    apache = license_scan.TEMPLATES["Apache-2.0-header"]
    words = apache.split(" ")
    words[20] = "CHANGED"
    rows = [(1, "x " * 40 + "released UNDER the  mit license. y"), (2, "a b " + " ".join(words) + " c"), (3, "licensed under the"), (4, None), (5, ""), (None, "Licensed under CC BY-NC 4.0.\n" * 3), (6, "w " * 100_000 + apache)]
    got = license_scan.scan_licenses(table(spark, rows)).collect()
    names = collections.Counter((r.id, r.license) for r in got)
    assert names[1, "MIT"] == 1 and names[None, "CC-BY-NC-4.0"] == 3 and names[6, "Apache-2.0-header"] == 1
    near = next(r for r in got if (r.id, r.license) == (2, "Apache-2.0-header"))
    assert 0.8 <= near.containment < 1 and near.first_word == 2
    assert not any(i in (3, 4, 5) for i, _ in names)
    with pytest.raises(ValueError):
        license_scan.Templates({"short": "too short"})


@pytest.mark.parametrize("seed", range(2))
def test_license_scan_equals_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    templates = {f"t{n}": " ".join(rng.choices(vocabulary, k=n)) for n in (5, 9, 30, 120)}
    t = license_scan.Templates(templates)
    texts = []
    for _ in range(60):
        name = rng.choice(list(templates))
        w = templates[name].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 80)) + w + rng.choices(vocabulary, k=20)))
    found = license_scan.scan(t, pa.array(texts), 0.8)
    for text, matches in zip(texts, found):
        w = brute.alnum(text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        for name, template in templates.items():
            tw = template.split()
            want = {tuple(tw[i : i + 5]) for i in range(len(tw) - 4)}
            m = len(tw) - 4
            best = max((len(want & set(grams[max(0, s - m // 4) : s + m + m // 4])) / len(want) for s in range(len(grams) - m + 1)), default=0)
            assert (best >= 0.8) == any(x["license"] == name for x in matches)


def test_pieces(spark):
    rows = hard_rows()
    got = encoder(spark, digests=True)(table(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert {r.n_ids for r in got if r.doc_id in (500, 501)} == {0}
    ids = encoder(spark)(table(spark, rows)).collect()
    import sentencepiece

    from tessera.llm.stages import MODEL_PATH

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for r in ids:
        if r.doc_id != 601:  # the library takes very long for one long word
            assert r.ids in library.encode(texts[r.doc_id], num_threads=1)
