"""Licence scans, hard negatives and collocations against brute force, and their defined edge cases."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest

from kartlane.llm import collocations, hardneg, licenses, queries, words

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, f bigint, words string, chunk int, matches double"


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, l, 1, "x", 2, 0.5) for i, t, l in rows], DOCS)


def test_all_operators_are_registered():
    import __spark_entry__ as E
    assert {n.split("_")[0] for n in queries.NAMES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.NAMES) | {"pipeline"} <= set(E.queries())


# --- words

def test_words_of_columns(spark):
    import pyarrow as pa
    texts = [None, "", "a B\tc", "  ", "é日 x", "c", "end ", " Ünder under"]
    gap = words.bytes_in((0x20, 0x20), (0x09, 0x0D))
    for column in (pa.array(texts), pa.array(["drop", *texts]).slice(1), pa.array([], pa.string())):
        w = words.split(column, gap)
        got = [[] for _ in range(len(column))]
        for c, d in zip(w.code, w.doc):
            got[d].append(w.names[int(c)].as_py().decode())
        want = [(t or "").translate(LOW).split() for t in column.to_pylist()]
        assert got == want and list(np.diff(w.first)) == [len(x) for x in want]


# --- 11: licences

def base_places(text):
    w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    places, labels = [], set()
    for t in licenses.BASE:
        p = t.text.split()
        hit = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += hit
        labels |= {t.label} if hit else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def license_texts():
    rng = random.Random(8)
    some = ["under", "the", "mit", "license", "Apache", "version", "2", "cc", "by", "nc", "CC", "x", "é", "license,", "2.0", "by-nc"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return [None, "", " \n", "under the MIT", "license under the mit license", "CC BY-NC-4.0", "Apache License, Version 2.0",
            "under_the mit  LICENSE" * 3, " ".join(rng.choice(some) for _ in range(30000)), *texts, texts[5], texts[5]]


def test_license_base_places_against_brute_force(spark):
    rows = [(i if i % 9 else None, t, "en") for i, t in enumerate(license_texts())]
    got = licenses.summary(licenses.matches(docs(spark, rows)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:6] and str(r[1:6]))
    have = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got.collect()), key=key)
    assert have == sorted(((i, *base_places(t)) for i, t, _ in rows), key=key)
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)
    assert licenses.summary(licenses.matches(docs(spark, []))).count() == 0


def test_license_passages_need_their_alignment_and_their_key_phrases(spark):
    mit = next(t for t in licenses.PASSAGES if t.label == "mit").text
    w = mit.split()
    noise = " ".join(f"word{i}" for i in range(400))
    edited = " ".join(x for i, x in enumerate(w) if i not in (30, 41))                       # two words lost
    without = mit.replace("free of charge", "for nothing much")                              # a key phrase lost
    shuffled = " ".join(random.Random(1).sample(w, len(w)))
    rows = [(1, f"{noise} {mit.upper()} {noise}", "en"), (2, f"{noise} {edited}", "en"), (3, without, "en"), (4, shuffled, "en"),
            (5, noise, "en"), (6, " ".join(w[:len(w) // 2]), "en"), (7, "GNU General Public License, version 3", "en"),
            (8, "gnu general\npublic\tlicense", "en"), (9, f"{mit} {noise} {mit}", "en")]
    found = licenses.matches(docs(spark, rows))
    got = {r.doc_id: r for r in licenses.summary(found).collect()}
    assert {i for i, r in got.items() if "mit" in r.labels.split(",")} == {1, 2, 9}
    assert got[1].score == 1 and 0.9 < got[2].score < 1 and got[1].n_base == 0
    assert got[7].labels == "gpl,gpl-3" and got[8].labels == "gpl" and got[5].labels == got[5].base_labels == "" and got[5].score == 0
    places = {r.doc_id: [(m.first, m.length) for m in r.matches] for r in found.collect()}
    assert places[1] == [(400, len(w))] and places[9] == [(0, len(w)), (400 + len(w), len(w))]


# --- 12: hard negatives

def brute_negatives(rows):
    good = []
    for v, e, label, *_ in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        good.append((v, (label + 1) % 10 if v is not None and v % 7 == 0 else label, [math.floor(256 * x) for x in e]))
    out = []
    for i, (v, label, q) in enumerate(good):
        if v is None or v % 100:
            continue
        scores = sorted((-sum(a * b for a, b in zip(p, q)), u is None, u or 0, j, u, m)
                        for j, (u, m, p) in enumerate(good) if len(p) == len(q))
        for s in [s for s in scores if s[5] == label and s[3] != i][:5]:
            fits = [t for t in scores if t[5] != label and 30 * -s[0] <= 100 * -t[0] <= 90 * -s[0]][:10]
            out += [(v, s[4], k, t[4], -s[0], -t[0]) for k, t in enumerate(fits, 1)]
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(v, e, l, 1, "x", b"y") for v, e, l in rows],
                                 "vec_id bigint, embedding array<float>, label int, key int, d string, q binary")


@pytest.mark.parametrize("scale", [1.0, 3000.0, 4_000_000.0])
def test_hard_negatives_against_brute_force(spark, scale):
    r = np.random.default_rng(6)
    centre = r.normal(size=(6, 12))
    x = centre[r.integers(0, 6, 700)] + 0.4 * r.normal(size=(700, 12))
    x = (x * scale / 4).astype(np.float32)
    x[200:260] = x[100]                     # copies: ties of every kind
    x[300] = 0
    rows = [(int(i) * 5, [float(v) for v in x[i]], int(r.integers(0, 10))) for i in range(700)]
    rows += [(9000, None, 1), (9100, [], 1), (9101, [], 2), (9200, [float("nan")] * 12, 1), (9300, [float("inf")] * 12, 1),
             (9400, [None] + [1.0] * 11, 1), (9500, rows[0][1], None), (9600, [1.0, 2.0], 3), (9601, [1.0, 2.0], 3), (9602, [0.6, 1.2], 4),
             (None, rows[3][1], 5), (None, rows[3][1], rows[0][2]), rows[0], rows[20], rows[21], (-100, rows[7][1], 3)]
    got = hardneg.hard_negatives(vectors(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    assert hardneg.hard_negatives(vectors(spark, [])).count() == 0
    assert hardneg.hard_negatives(vectors(spark, [(100, [1.0], 1), (200, None, 1)])).count() == 0


def test_zone_maps_leave_blocks_unread_and_bounds_hold(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = (100 * (np.repeat(r.normal(size=(8, 6)), 200, 0) + 0.05 * r.normal(size=(1600, 6)))).astype(np.int64)
    low, high = x.reshape(8, 200, 6).min(1).astype(float), x.reshape(8, 200, 6).max(1).astype(float)
    least, most = hardneg.bounds(x[::50].astype(float), low, high)
    score = (x[::50] @ x.T).reshape(-1, 8, 200)
    assert (score >= least[:, :, None]).all() and (score <= most[:, :, None]).all()
    monkeypatch.setattr(hardneg, "BLOCK", 100)
    read = []
    whole = hardneg.hits
    monkeypatch.setattr(hardneg, "hits", lambda s, a, need, *more: read.append(need.count()) or whole(s, a, need, *more))
    rows = [(i, [float(v) / 256 for v in x[i]], i // 200) for i in range(1600)]
    assert sorted(map(tuple, hardneg.hard_negatives(vectors(spark, rows)).collect()), key=str) == brute_negatives(rows)
    assert sum(read[:2]) < 16 * 16 / 4      # clustered rows: an anchor's positives need few of the 16 blocks


def test_the_hilbert_curve_visits_neighbours():
    for d, bits in ((2, 4), (3, 3)):
        side = np.arange(1 << bits)
        cells = np.stack(np.meshgrid(*[side] * d), -1).reshape(-1, d)
        key = hardneg.hilbert(cells, bits)
        order = cells[np.lexsort(key.T[::-1])]
        assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# --- 13: collocations

def brute_collocations(rows, least, top):
    by, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                by[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in by.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        drop = {q[i:i + k] for q, x in cand.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * x >= 80 * cand[q[i:i + k]]}
        own = []
        for p, a in cand.items():
            if p not in drop:
                s, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                own.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def phrase_rows():
    rng = random.Random(3)
    names = [f"w{i}" for i in range(40)] + ["of", "The", "the"] * 12 + ["é日", "a b", '"q"']
    rows = []
    for i in range(500):
        t = " ".join(rng.choice(names) + rng.choice(["", "", "", "", ",", ".", "\n", "\t", " "]) for _ in range(rng.randint(0, 120)))
        rows.append((i, t + (" of the people by the people" if i % 3 == 0 else "") + (" new york city" if i % 2 else ""), rng.choice(["en", "de", None, "und"])))
    rows += [(None, None, "en"), (None, "", None), (7, "of the people by the people " * 3000, "fr"), (8, "only", "xx"), (8, "only", "xx")]
    return rows


@pytest.mark.parametrize("suffixes", [1 << 20, 1 << 11, 64])
def test_collocations_against_brute_force(spark, suffixes, monkeypatch):
    rows = phrase_rows()
    got = collocations.collocations(docs(spark, rows), least=12, top=150, suffixes=suffixes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 12, 150)
    assert collocations.collocations(docs(spark, [])).count() == 0


def test_very_long_texts_are_cut_between_pieces(spark, monkeypatch):
    import pyarrow as pa
    rows = phrase_rows()
    t = "a b. c d e" * 3
    assert collocations.shortened(pa.array([t, "x"], pa.large_string()), 8).to_pylist() == ["a b", " c d ea b", " c d ea b", " c d e", "x"]
    assert collocations.shortened(pa.array(["q" * 50], pa.large_string()), 8).to_pylist() == ["q" * 50]
    monkeypatch.setattr(collocations, "shortened", lambda c, cut=collocations.shortened: cut(c, 300))
    texts = pa.array([r[1] or "" for r in rows], pa.large_string())
    cut = collocations.shortened(texts).to_pylist()
    assert len(cut) > len(rows) and brute_collocations([(0, x, "en") for x in cut], 12, 50) == brute_collocations([(0, r[1], "en") for r in rows], 12, 50)


def test_partitions_of_the_quicksort_are_counts():
    r = np.random.default_rng(9)
    gid = np.minimum(r.zipf(1.5, 60_000), 40).astype(np.int32)
    gid[r.random(len(gid)) < 0.05] = 0
    w = collocations.windows(gid)
    hot = np.array([1, 2], np.int32)
    want = collections.Counter()
    for piece in np.split(gid, np.flatnonzero(gid == 0)):
        p = piece[piece != 0].tolist()
        for k in (2, 3, 4):
            want.update(tuple(p[i:i + k]) for i in range(len(p) - k + 1))
    whole = np.concatenate([w, collocations.hot_prefixes(w, hot)], 1)
    for small in (1, 100, 1 << 20):
        words_, f = collocations.phrase_counts(w[:4], w[4].astype(np.int64), hot, 20, small)
        assert not any(set(p) <= {0, 1, 2} and 0 in p for p in words_.tolist())
        words_, f = collocations.bucket_counts(whole, hot, 20, small)
        got = {tuple(x for x in p if x): c for p, c in zip(words_.tolist(), f.tolist())}
        assert len(got) == len(f) and got == {p: c for p, c in want.items() if c >= 20}


# --- the word cutter of the packing operator

def test_words_cut_in_one_pass_are_encoded_as_the_library_does():
    import pyarrow as pa
    import tokenizers
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from kartlane.llm.tokens import WordEncoder
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    r = random.Random(1)
    texts = ["".join(r.choice("aZé'日<|>.,1 9\n😀\x01\x00 x-_") for _ in range(r.randint(0, 80))) for _ in range(400)]
    texts += [None, "", "x" * 500, "<|endoftext|> a", "don't", "a\nb", "word, (word) word-word", "x" * 64 + " " + "y" * 65]
    for most in (1_000_000, 50):                     # with a table that forgets its words too
        enc = WordEncoder(path, most)
        for part in (texts[:200], texts[200:], texts[:200]):
            ids, bound = enc.encode(pa.array(part))
            want = tok.encode_batch([t or "" for t in part], add_special_tokens=False)
            assert [ids[a:b].tolist() for a, b in zip(bound[:-1], bound[1:])] == [w.ids for w in want]
