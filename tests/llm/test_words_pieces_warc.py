"""Hashing kernels, the piece search, WARC archives, components and the pipeline."""

import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import zstandard
from hypothesis import given, settings, strategies as st

from tessera.llm import pieces, words as W
from tessera.llm.components import connected_components
from tessera.llm.stages import MODEL_PATH, STAGES
from tessera.llm.warc import DICTIONARY_MAGIC, archive_round_trip, record, records_of, write_archives

import brute


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZé中 \n\t.0-", max_size=40)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_tokens(texts):
    for alphabet, cut in ((W.SPACED, lambda t: brute.spaced(t)), (W.SPACED_LOWER, lambda t: brute.spaced(t, True)), (W.ALNUM_LOWER, brute.alnum)):
        w = W.tokenize(pa.array(texts, pa.string()), alphabet, second=True)
        want = [(i, x) for i, t in enumerate(texts) for x in cut(t)]
        fold = {} if alphabet is W.SPACED else brute.LOW
        got = [(int(r), w.data[a:b].tobytes().decode().translate(fold)) for r, a, b in zip(w.row, w.start, w.end)]
        assert got == want
        for h in (w.hash, w.hash2):
            seen = {}
            assert all(seen.setdefault(x, v) == v for (_, x), v in zip(want, h)) and len(set(seen.values())) == len(seen)


def test_grams_and_windows():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 50, 400).astype(np.uint64)
    for k in (1, 2, 3, 5, 7, 10, 50):
        seen = {}
        for i, g in enumerate(W.grams(h, k)):
            assert seen.setdefault(tuple(h[i : i + k]), g) == g
        assert len(set(seen.values())) == len(seen)
        assert (W.sliding(h, k) == [h[i : i + k].min() for i in range(401 - k)]).all()
    assert len(W.grams(h[:3], 5)) == 0 and len(W.sliding(h[:3], 5)) == 0


def unigram():
    text = ["a", "b", "c", " ", " a", "ab", "abc", "bc", " ab", "é", "cab", " c"]
    rng = random.Random(4)
    return pieces.Vocabulary([None, *(t.encode() for t in text)], np.array([0.0, *(-rng.uniform(1, 9) for _ in text)]), False, 0, None)


def test_unigram_search_equals_brute_force():
    v = unigram()
    rng = random.Random(6)
    floor = v.score[1:].min() - pieces.UNKNOWN_PENALTY
    for _ in range(300):
        text = "".join(rng.choice("abc é x") for _ in range(rng.randint(1, 30)))
        raw = (" " + text).encode()
        best, back = {0: 0.0}, {}
        for i in range(len(raw)):
            if i not in best:
                continue
            wide = pieces._char_bytes(raw[i])
            options = [(j, v.score[v.index[raw[i:j]]]) for j in range(i + 1, len(raw) + 1) if raw[i:j] in v.index]
            if not any(j == i + wide for j, _ in options):
                options.append((i + wide, floor))
            for j, s in options:
                if best[i] + s > best.get(j, -1e9):
                    best[j] = best[i] + s
        ids = pieces.encode_texts(v, pa.array([text]))[0].as_py()
        total = sum(v.score[i] if i else floor for i in ids)
        assert abs(total - best[len(raw)]) < 1e-9
        stream = pieces.StreamEncoder(v)
        out, at = [], 0
        while at < len(raw):
            n = rng.randint(1, 9)
            out += stream.feed(raw[at : at + n])
            at += n
        assert out + stream.finish() == ids


def test_stream_equals_matrix_and_commits_early():
    v = pieces.load(MODEL_PATH)
    rng = random.Random(8)
    text = " ".join("".join(rng.choice(["th", "er", "on", "ing", "é", "x", "tion"]) for _ in range(rng.randint(1, 6))) for _ in range(400))
    want = pieces.encode_texts(v, pa.array([text]))[0].as_py()
    stream, out = pieces.StreamEncoder(v), []
    raw = (" " + text).encode()
    for i in range(0, len(raw), 100):
        out += stream.feed(raw[i : i + 100])
        assert len(stream.text) < 400  # the window stays small
    assert out and out + stream.finish() == want
    assert pieces.decode_ids(v, want) == text


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, html string, url string, payload string, first string").repartition(3)


def test_warc_round_trip(spark):
    long = "<p>" + "lorem ipsum é " * 40
    rows = [(5, long, "u1"), (3, long, "u2\r\nX: y"), (9, long, None), (1, "short", "u"), (2, "short", "u"), (4, None, "n"), (6, "", "n"), (7, "a\r\n\r\nb" * 30, "n"), (None, long, "n"), (8, "WARC/1.1\r\n\r\n" * 2000, "n"), (3, long, "u2")]
    got = archive_round_trip(pages(spark, [(*r, "x", "y") for r in rows])).collect()
    want = []
    for i, html, _ in rows:
        raw = (html or "").encode()
        again = html == long and i not in (3, None)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert archive_round_trip(pages(spark, [])).collect() == []


def test_archives_start_with_a_dictionary_and_split(spark, tmp_path):
    rows = [(i, f"<html>page {i} " + "common text of all pages " * 20, "u", "", "") for i in range(200)]
    manifest = write_archives(pages(spark, rows), f"file://{tmp_path}/w", archive_bytes=3000).collect()
    assert sum(m.records for m in manifest) == 200 and len(manifest) > 3
    for m in manifest:
        raw = open(m.path.removeprefix("file://"), "rb").read()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == DICTIONARY_MAGIC and len(raw) == m.bytes
        given = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
        with open(m.path.removeprefix("file://"), "rb") as f:
            found = list(records_of(f, chunk=97))
        for offset, text in found:  # every record opens alone
            assert zstandard.ZstdDecompressor(dict_data=given).decompressobj().decompress(raw[offset:]) == text
    assert record(1, None, b"", "d", None, "t").startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(60)] + [(500, i) for i in range(501, 600)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    group = {}
    for a, b in links:
        group.setdefault(a, a), group.setdefault(b, b)
    for _ in range(len(group)):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    assert got == {n: g for n, g in group.items() if any(n in x and x[0] != x[1] for x in links)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline_equals_its_parts(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs if any(c.isalpha() for c in r.text or "")]
    seen, kept = set(), []
    for i, t in sorted(rows):
        norm = " ".join(brute.spaced(f"x{t}x"))
        if norm not in seen:
            seen.add(norm)
            kept.append((i, t))
    group = brute.near_groups([t for _, t in kept])
    kept = [x for n, (x, g) in enumerate(zip(kept, group)) if g == n]
    kept = [x for x, o in zip(kept, brute.overlap(kept, items)) if not o[5]]
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, data).collect()}
    assert sorted(got) == [i for i, _ in kept]
    v = pieces.load(MODEL_PATH)
    assert all(pieces.decode_ids(v, got[i]) == t for i, t in kept)


def test_stages_keep_columns_and_survive_odd_tables(spark, data):
    rows = [(1, "one two three four five six seven", "en", "s", 3), (1, "one two three four five six seven", "en", "s", 3), (None, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f g h i j k", None, None, None), (3, "12 34", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for table in (rows, rows[:0]):
        docs = spark.createDataFrame(table, schema)
        for name, stage in STAGES[:-1]:
            out = stage(spark, docs, data)
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            got = out.collect()
            assert len(got) <= len(table)
            if name == "exact dedup" and table:
                assert len(got) == 4  # null and empty are one text
