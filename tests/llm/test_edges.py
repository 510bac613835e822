"""Cases at the edges: nulls, clashing names, empty tables, very large inputs, words made to collide."""

import math
import pathlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from tessera.llm import language_id, license_scan, near_dedup, shared, stages, warc, words as W
from tessera.llm.decontaminate import find_overlap
from tessera.llm.language_id import identify
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.sharding import shard_documents
from tessera.llm.stages import encoder
from tessera.llm.substring_dedup import deduplicate_substrings

import brute

#: Names that stages or operators use for columns of their own.
NAMES = ["held_out", "guess", "_id", "_tag", "_digest", "id", "tag", "key_id", "key_tag", "keep", "nth", "t", "lang_pred", "doc", "score", "_ID_"]


def named(spark, rows):
    """documents with columns of all those names, each with a value of its own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {n} string" for n in NAMES)
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), *(f"{n}-{k}" for n in NAMES)) for k, (i, t, g) in enumerate(rows)], schema)


def collide(n=1 << 10):
    """Two words that any polynomial modulo 2^64 takes for one."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return ["".join("ab"[b ^ y] for b in bits) for y in (0, 1)]


def test_words_made_for_polynomials_differ():
    one, two = collide()
    for alphabet in (W.SPACED, W.SPACED_LOWER, W.ALNUM_LOWER):
        for n in (8, 16, 32, W.TABLED, 64, 1024):
            w = W.tokenize(pa.array([one[:n], two[:n]]), alphabet, second=True)
            assert w.hash[0] != w.hash[1] and w.hash2[0] != w.hash2[1]


def test_operators_tell_such_words_apart(spark):
    one, two = collide()
    rows = [(i, " ".join([*(f"w{j}" for j in range(3)), x])) for i, x in enumerate((one, two, one))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.group_id for r in near_duplicates(docs).collect()} == {0: 0, 1: 1, 2: 0}
    items = spark.createDataFrame([(7, two)], "item_id long, text string")
    assert {r.id: r.contaminated for r in find_overlap(docs, items).collect()} == {0: False, 1: True, 2: False}


def test_a_batch_of_any_rows_is_cut():
    texts = pa.array([f"text number {i} of many" for i in range(70_000)])
    numbers = pa.array(range(70_000), pa.int64())
    batch = pa.record_batch([numbers, numbers, numbers, texts], names=list("abcd"))
    assert max(len(s) for s in shared.slices(batch, 3)) <= shared.SLICE_ROWS
    out = pa.Table.from_batches(near_dedup._signatures(iter([batch])))
    assert len(set(zip(out.column("d1").to_pylist(), out.column("d2").to_pylist()))) == 70_000
    with pytest.raises(ValueError):
        near_dedup.shingles(W.tokenize(texts, W.SPACED_LOWER))


def bench(spark, tmp_path, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_leaks_go_by_their_own_rows(spark, tmp_path):
    leak = " ".join(f"b{i}" for i in range(12))
    d = bench(spark, tmp_path, [(1, leak)])
    rows = [(None, f"x {leak}", "en"), (None, "clean without an id", "en"), (4, f"y {leak} z", "en"), (4, "clean with a leak's id", "en"), (5, None, "en"), (6, "", None), (7, "clean", "en"), (7, "clean", "en")]
    got = stages.benchmark_leaks(spark, named(spark, rows), d).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((i or 0, t or "") for i, t, _ in rows if leak not in (t or ""))
    assert all(r.asDict()["guess"].startswith("guess-") for r in got)


@pytest.mark.parametrize("name", [n for n, _ in stages.STAGES[:-1]])
def test_stages_leave_columns_of_any_name_alone(spark, tmp_path, name):
    d = bench(spark, tmp_path, [(1, "no such words as these are in any of the rows at all")])
    rng = random.Random(3)
    text = lambda: " ".join(f"word{rng.randrange(900)}" for _ in range(30))
    rows = [(i, text(), "en" if i % 2 else "de") for i in range(12)] + [(None, text(), "en"), (None, text(), None), (30, text(), "de"), (30, text(), "de")]
    docs = named(spark, rows)
    out = dict(stages.STAGES)[name](spark, docs, d)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    key = lambda df: sorted(map(str, df.collect()))
    assert key(out) == key(docs)


@pytest.mark.parametrize("name", [n for n, _ in stages.STAGES])
def test_stages_of_nothing(spark, tmp_path, name):
    d = bench(spark, tmp_path, [(1, "some item")])
    assert dict(stages.STAGES)[name](spark, named(spark, [(1, "a", "b")]).limit(0), d).collect() == []


def test_the_last_stage_with_repeated_and_null_ids(spark):
    rows = [(1, "some text", "en"), (1, "other text", "en"), (1, "other text", "en"), (None, "no id", None), (None, None, None), (2, "", "en"), (3, "a ▁ mark", "en")]
    got = stages.piece_ids(spark, named(spark, rows), "").collect()
    assert len(got) == len(rows) and sorted(r.doc_id or 0 for r in got) == [0, 0, 1, 1, 1, 2, 3]
    assert {r.doc_id for r in got if not r.round_trip} == {3}
    assert all((len(r.ids) == 0) == (r.doc_id == 2 or not r.ids) for r in got)


def test_the_pipeline_deletes_what_it_no_longer_needs(spark, data):
    folder = pathlib.Path(shared.work_dir(spark).removeprefix("file://"))
    before, made = set(folder.iterdir()), list(shared._made[0])
    out = stages.run_stages(spark, spark.read.parquet(f"{data}/documents.parquet"), data)
    left = set(folder.iterdir()) - before
    assert out.count() > 0 and [p.name[: -33] for p in left] == ["benchmark-decontamination"]
    assert len(shared._made) == 1 and len(shared._made[0]) == len(made) + 1


def test_scratch_folders_go(spark):
    folder = pathlib.Path(shared.work_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    with shared.scratch(spark) as keep:
        kept = shared.fresh_path(spark, "kept")
        shared.materialize(spark.range(3), "kept", kept)
        shared.materialize(spark.range(3), "gone")
        keep(kept)
    assert set(folder.iterdir()) - before == {pathlib.Path(kept.removeprefix("file://"))} and spark.read.parquet(kept).count() == 3
    shared.delete_path(spark, kept)
    assert set(folder.iterdir()) == before


def test_empty_tables(spark):
    none = named(spark, [(1, "a", "b")]).limit(0)
    assert license_scan.scan_licenses(none).collect() == []
    assert deduplicate_substrings(none).collect() == []
    assert near_duplicates(none).collect() == []
    assert encoder(spark, digests=True)(none).collect() == []
    assert shard_documents(none).collect() == []
    assert find_overlap(none, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_the_greatest_id_is_an_id(spark):
    big = (1 << 63) - 1
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(big, passage), (None, passage), (5, f"a {passage}"), (-5, f"b {passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.n_removed for r in deduplicate_substrings(docs).collect()} == {-5: 0, 5: 60, big: 60, None: 60}
    assert sorted(str(r.id) for r in near_duplicates(docs).collect()) == sorted(map(str, (big, None, 5, -5)))


def test_license_templates_from_a_table(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(5000)]
    texts = {f"t{i:03d}": " ".join(rng.choices(vocabulary, k=rng.randint(5, 150))) for i in range(300)}
    table = spark.createDataFrame(list(texts.items()), "name string, text string")
    chosen = sorted(texts)[::7]
    rows = [(i, " ".join(rng.choices(vocabulary, k=40)) + " " + texts[n] + " " + " ".join(rng.choices(vocabulary, k=40))) for i, n in enumerate(chosen)]
    rows += [(1000, texts[chosen[0]]), (1000, texts[chosen[0]]), (None, texts[chosen[1]] + " x" * 60 + " " + texts[chosen[1]]), (1001, None)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()
    assert sorted((r.id, r.license, r.containment) for r in got if r.id is not None and r.id < 1000) == [(i, n, 1.0) for i, n in enumerate(chosen)]
    assert sum(r.id == 1000 for r in got) == 2 and sum(r.id is None for r in got) == 2
    t = license_scan.Templates(texts)
    assert len(t.lengths) < 25 and all(license_scan.ladder(m) <= max(m * 1.25, m + 1) for m in range(1, 500))


def plain_features(text):
    """The n-grams of a text as the features' numbers, one byte after another."""
    fold = [32] * 97 + list(range(97, 123)) + [32] * 5 + list(range(128, 256))
    for c in range(65, 91):
        fold[c] = c + 32
    b = [fold[x] for x in text.encode()]
    out = []
    for i in range(len(b) - 1):
        if len(b) > 2 and not (b[i] == b[i + 1] == 32):
            pair = b[i] * 256 + b[i + 1]
            out.append(((pair * 2654435761) & 0xFFFFFFFF) >> 17)
            if i + 2 < len(b):
                triple = ((pair * 0x85EBCA6B) ^ (b[i + 2] * 0xC2B2AE35)) & 0xFFFFFFFF
                out.append((((triple ^ (triple >> 15)) * 2246822519) & 0xFFFFFFFF) >> 17)
    return out


def test_language_id_equals_plain_classifiers(spark, data):
    docs = [r for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()]
    docs = docs[:60]
    learned = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.text is not None and r.lang is not None]
    languages = sorted({r.lang for r in learned if plain_features(r.text)})
    sums = {g: np.zeros(language_id.FEATURES) for g in languages}
    for r in learned:
        f = plain_features(r.text)
        if f:
            np.add.at(sums[r.lang], f, min(len(f), 4000) / len(f))
    share = np.array([(np.round(sums[g], 6) + 0.5) for g in languages])
    share /= share.sum(1, keepdims=True)
    code = language_id.codewords(len(languages))
    bits = [(share[code[:, j] > 0].mean(0), share[code[:, j] < 0].mean(0)) for j in range(code.shape[1])]
    trust = np.array([((p - q) * np.log(p / q)).sum() for p, q in bits])
    trust /= trust.mean()
    got = {r.doc_id: r.guess for r in identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    for r in docs:
        f = plain_features(r.text or "")
        margins = [sum(math.log(p[x] / q[x]) for x in f) / math.sqrt(max(1, len(f))) for p, q in bits]
        loss = [sum(t * math.log1p(math.exp(-c * m)) if -c * m < 500 else t * -c * m for t, c, m in zip(trust, word, margins)) for word in code]
        if not any(map(str.isalpha, r.text or "")):
            assert got[r.doc_id].lang == "und" and got[r.doc_id].score == 0
            continue
        best = min(range(len(languages)), key=loss.__getitem__)
        odds = [math.exp(min(loss) - x) for x in loss]
        assert got[r.doc_id].lang == languages[best]
        assert math.isclose(got[r.doc_id].score, 1 / sum(odds), rel_tol=1e-3, abs_tol=1e-6)
        assert got[r.doc_id].ambiguous == (sorted(odds)[-2] > 0.5)


def test_language_id_of_many_labels(spark):
    rng = random.Random(1)
    rows = []
    for k in range(1100):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 5)
        rows += [(4 * k + j, "".join(rng.choice(letters) for _ in range(300)), f"l{k}") for j in range(3)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    told = [r.lang == r.guess.lang for r in got if not r.held_out]
    assert sum(told) / len(told) > 0.7  # by chance: 0.001
    with pytest.raises(ValueError):
        identify(spark.createDataFrame([(1, "a", "b", 1)], "doc_id long, text string, lang string, Guess int"))


def test_equal_losses_are_ambiguous():
    m = language_id.Model(["a", "b"], language_id.codewords(2), np.zeros((1, language_id.FEATURES + 1), np.float32), np.ones(1))
    best, score, unsure = m.decode(np.array([[0.0], [9.0]]))
    assert best[0] == 0 and score[0] == 0.5 and unsure[0] and not unsure[1]


def test_warc_of_large_and_repeated_payloads(spark, tmp_path):
    rng = random.Random(2)
    large = "".join(rng.choices("abcdefgh <>/\n", k=6_000_000))
    rows = [(i, f"http://x/{i}", f"<p>{'hot ' * 50}</p>") for i in range(400)] + [(1000 + i, None, f"<html>{i} {rng.random()} " + "text " * 40) for i in range(300)]
    rows += [(5000, "u", large), (5001, "u", large), (5002, "u", None), (5003, None, ""), (None, "u", large[:200])]
    pages = spark.createDataFrame([(*r, "x", b"y") for r in rows], "page_id long, url string, html string, digest string, payload binary").repartition(5)
    manifest = warc.write_archives(pages, str(tmp_path / "w"))
    back = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    assert len(back) == len(rows) and back[5001].refers_to == 5000 and back[5001].payload_digest == brute.sha(large)
    assert sum(r.record_type == "revisit" for r in back.values()) == 399 + 1
    assert all(r.path.startswith("file:///") for r in manifest.collect())
    same = [warc.train_dictionary(p, "html", samples=50) for p in (pages, pages.orderBy("page_id").coalesce(1), pages.where("page_id > 10 or page_id is null"))]
    assert same[0] and same[0] == same[1] == same[2]  # neither order nor copies matter
    raw = next((tmp_path / "w").glob("*.warc.zst")).read_bytes()
    assert raw[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little") and zstandard.ZstdDecompressor().decompress(raw[8 : 8 + int.from_bytes(raw[4:8], "little")])


def test_paths_are_qualified(spark, tmp_path):
    assert shared.qualified(spark, str(tmp_path)) == f"file://{tmp_path}"
    assert shared.qualified(spark, f"file:{tmp_path}/") == f"file://{tmp_path}"


def test_texts_without_spaces_pass_through_a_bounded_window():
    """Megabytes without a space: the encoder holds a few times the longest piece, and its ids are those of the whole."""
    from tessera.llm import pieces

    v = pieces.load(stages.MODEL_PATH)
    rng = random.Random(4)
    text = "".join(rng.choices("ABCDEFGHabcdefgh0123456789+/汉字", k=1_500_000))
    e, ids, held = pieces.StreamEncoder(v), [], 0
    raw = (" " + text).encode()
    for i in range(0, len(raw), 4096):
        ids += e.feed(raw[i : i + 4096])
        held = max(held, len(e.nodes))
    assert held < 8 * v.longest and len(e.text) < 4096 + 8 * v.longest
    ids += e.finish()
    assert pieces.encode_texts(v, pa.array([text])).values.to_pylist() == ids
    assert pieces.decode_ids(v, ids) == text
    with pytest.raises(ValueError):  # a piece that reaches over a cut
        pieces.Vocabulary([None, b"a", b"a b"], np.zeros(3), False, 0, None)


def test_verified_links_are_told(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "other"])), (3, " ".join(base)), (4, "far from all of these words")]
    got = {r.id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_links == got[2].n_links == got[3].n_links == 1 and got[4].n_links == 0 and got[4].similarity is None
    assert math.isclose(got[2].similarity, brute.prob_jaccard(*(brute.shingle_counts(t) for _, t in rows[:2])))
    assert got[3].class_id == 1 and got[2].class_id == 2


def test_near_duplicates_recall(spark, data):
    """Every pair of similarity 0.8 or more of rows whose id is divisible by 20 with any other row is in one group."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    group = {r.id: r.group_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {r.doc_id: brute.shingle_counts(r.text) for r in docs}
    found = [(i, j) for i in sets if i % 20 == 0 and sets[i] for j in sets if i != j and sets[i].keys() & sets[j].keys() and brute.prob_jaccard(sets[i], sets[j]) >= 0.8]
    assert all(group[i] == group[j] for i, j in found)


def test_links_of_near_copies_do_not_depend_on_partitions(spark):
    """Forty texts, each the same 120 words with one changed: every pair is near, and what is verified is a function of the texts."""
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(40) for k in [r.randrange(120)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, five = ({x.id: (x.n_links, x.similarity, x.group_id, x.kept) for x in near_duplicates(docs.repartition(n)).collect()} for n in (1, 5))
    assert one == five and len({g for _, _, g, _ in one.values()}) == 1


def test_warc_dictionary_holds_heads_and_record_ids_differ(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<html><body>{'words of page ' * (i % 7 + 3)}{i}</body></html>") for i in range(200)] + [(3, "http://x/other", "another payload of the same page " * 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    dictionary = warc.train_dictionary(pages, "html")
    assert b"WARC/1.1\r\nWARC-Type: response" in dictionary or b"Content-Type: application/http; msgtype=response" in dictionary
    names = []
    for path in [r.path for r in warc.write_archives(pages.coalesce(1), str(tmp_path / "w")).collect()]:
        with open(path.removeprefix("file://"), "rb") as f:
            names += [re.search(rb"WARC-Record-ID: (\S+)", raw)[1] for _, raw in warc.records_of(f)]
    assert len(names) == len(set(names)) == 201
