"""Operators against brute force, round trips and held-out labels, and their defined edge cases."""

from __future__ import annotations

import collections
import hashlib
import html
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from kartlane.llm import bpe, common, htmltext, jaccard, packing, pq, quality, simhash, tokens, toxicity, url_filter, warc  # noqa: E402

SF = "/root/testdata/sf0.01"
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def texts():
    """Nulls, empty and blank texts, one word, ties, repeated rows, a long text, unusual characters."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(n)) for n in (3, 4, 5, 30, 60, 120)]
    near = base[5].split()
    near[50] = "zzz"
    return [None, "", " \n\t ", "One", "one", "two words", *base, base[3], base[3].upper(), " ".join(near), "x" * 30000,
            " ".join(word() for _ in range(8000)), "tab\there  double  space\n\nline nbsp em <|endoftext|> don't 12345 日本語 😀 İΣ"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 7, t, "clash", 1.0) for i, t in enumerate(texts)]
    return frame(spark, rows, "doc_id bigint, text string, node string, score double")


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [], "doc_id bigint, text string")


# --- 1: URL filters

def test_url_rules_and_hosts(spark):
    urls = [(1, "http://a.EXAMPLE.net/en/1?q"), (2, "https://example.net/fr/"), (3, "http://sub.example.com/de/x#y"), (4, "ftp://x.org/fr/1"),
            (5, "http://myexample.net"), (6, None), (7, "no scheme"), (8, "http://bexample.com/de/1"), (8, "http://bexample.com/de/1")]
    pages = frame(spark, urls, "page_id bigint, url string")
    outcomes = frame(spark, [("http://bexample.com/", 0)] * 60 + [("http://x.org/", 1)] * 60 + [(None, None)], "url string, good int")
    got = sorted(map(tuple, url_filter.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == sorted([
        (1, "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "example.net", "/fr/", "net/", "block"),
        (3, "sub.example.com", "/de/x", "example.com/de/", "block"), (4, "x.org", "/fr/1", "org/fr/", "allow"),
        (5, "myexample.net", "", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "bexample.com", "/de/1", None, "block"), (8, "bexample.com", "/de/1", None, "block")], key=str)


def test_url_reputation_shrinks_to_its_domain(spark):
    bad = [("a.bad.com", 0)] * 300 + [("b.bad.com", 0)] * 300 + [("c.bad.com", None)] + [("a.good.org", 1)] * 300 + [("b.good.org", 1)] * 300
    r = {x.host: x for x in url_filter.reputation(frame(spark, bad, "host string, good int")).collect()}
    assert r["c.bad.com"].good_rate < 0.2 < 0.8 < r["a.good.org"].good_rate
    assert r["a.bad.com"].rate_high < r["c.bad.com"].rate_high
    assert url_filter.reputation(frame(spark, [], "host string, good int")).count() == 0


# --- 2: vectors

def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(900, 24))
    x[300:420] = x[7] + 0.03 * r.normal(size=(120, 24))
    x[420:460] = x[8]
    x[460:470] = 5 * x[9]
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] * 24), (2004, [None] + [1.0] * 23),
             (2005, [float("inf")] * 24), (2006, [1.0, 2.0]), (2007, [1.0, 2.0]), (None, rows[7][1])]
    got = pq.near_duplicates(frame(spark, rows, "vec_id bigint, embedding array<float>")).collect()
    assert len(got) == len(rows)
    v = np.array([rows[i][1] for i in range(900)])
    v /= np.linalg.norm(v, axis=1)[:, None]
    link = v @ v.T >= 0.95
    root = np.arange(900)
    for _ in range(900):
        new = np.array([root[link[i]].min() for i in range(900)])
        if (new == root).all():
            break
        root = new
    for g in got:
        if g.vec_id is not None and g.vec_id < 900:
            extra = int(link[g.vec_id, 7])  # the row without an id equals row 7
            assert (g.n_links, g.component_id, g.kept) == (link[g.vec_id].sum() - 1 + extra, root[g.vec_id], root[g.vec_id] == g.vec_id)
    by = {g.vec_id: g for g in got}
    assert all((by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True) for i in range(2000, 2006))
    assert by[2007].component_id == 2006 and by[2007].n_links == 1
    assert pq.near_duplicates(frame(spark, [], "vec_id bigint, embedding array<float>")).count() == 0


# --- 3: Jaccard

def brute_components(rows, words, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w)} - {()} if len(w) < words else {tuple(w[i:i + words]) for i in range(len(w) - words + 1)})
    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    both = collections.Counter((a, b) for at in where.values() for k, b in enumerate(at) for a in at[:k])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (a, b), n in both.items():
        if n * den >= num * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def mutated(n, seed):
    """Groups of texts that differ in a few words, of sizes around the threshold, and shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    passage, rows = [word() for _ in range(60)], []
    while len(rows) < n:
        size = rng.choice([2, 5, 9, 20, 60, 200])
        base = [word() for _ in range(size)] + (passage if rng.random() < 0.4 else [])
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize("words,num,den", [(4, 85, 100), (5, 80, 100)])
def test_jaccard_against_brute_force(spark, docs, texts, words, num, den):
    rows = mutated(500, 1) + [(10_000 + 7 * i, t) for i, t in enumerate(texts)]
    d = frame(spark, rows, "doc_id bigint, text string").withColumn("n", F.lit("clash")).withColumn("keys", F.lit(1))
    got = jaccard.near_duplicates(d, words, num, den).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, words, num, den)


def test_jaccard_large_clusters_are_cut_into_blocks(spark, monkeypatch):
    """Chains of near sets in clusters of many blocks and size bands."""
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(58)]
    rows = []
    for i in range(90):
        t = list(base) + [f"y{k}" for k in range(rng.choice([0, 3, 6, 9, 14]))]
        for j in rng.sample(range(58), rng.choice([1, 1, 2, 3, 5])):
            t[j] = f"x{rng.randrange(6)}"
        rows.append((i, " ".join(t)))
    got = jaccard.near_duplicates(frame(spark, rows, "doc_id bigint, text string"), 1, 85, 100).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, 1, 85, 100)


def test_jaccard_rows_without_an_id_link(spark):
    words = [f"w{i}" for i in range(80)]
    rows = [(None, " ".join(words)), (9, " ".join([*words[1:], "x"])), (None, " ".join([*words[2:], "y", "z"])), (3, "else")]
    got = jaccard.near_duplicates(frame(spark, rows, "doc_id bigint, text string")).collect()
    assert sorted(r.component_id for r in got) == [3, 9, 9, 9]


@pytest.mark.parametrize("many", [3, 1 << 16])
def test_jaccard_common_keys_do_not_decide(spark, monkeypatch, many):
    """Keys of many sets are told in parts, over several batches; no link is lost."""
    monkeypatch.setattr(jaccard, "MANY", many)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        rows = mutated(400, 5)
        got = jaccard.near_duplicates(frame(spark, rows, "doc_id bigint, text string"), 2, 80, 100).collect()
    finally:
        spark.conf.set(size, before)
    assert sorted(map(tuple, got)) == brute_components(rows, 2, 80, 100)


def test_jaccard_shared_passages_tie_no_clusters(spark, monkeypatch):
    """Texts that have passages in common are compared with their near copies, not with one another."""
    rng, seen, place = random.Random(4), [], jaccard.place
    passages = [[f"p{i}-{k}" for k in range(14)] for i in range(3)]
    rows = []
    for i in range(300):
        own = [f"w{rng.randrange(10 ** 9)}" for _ in range(rng.choice([110, 150, 260]))]
        for p in rng.sample(passages, 2):
            at = rng.randrange(len(own))
            own[at:at] = p
        rows += [(2 * i, " ".join(own))] + [(2 * i + 1, " ".join(own[3:]))] * (i % 10 == 0)
    monkeypatch.setattr(jaccard, "place", lambda found, *a: seen.append(found.count()) or place(found, *a))
    got = jaccard.near_duplicates(frame(spark, rows, "doc_id bigint, text string"), 5, 80, 100).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, 5, 80, 100)
    assert 60 <= seen[0] < 100


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_written_tables_leave_neither_shuffles_nor_used_tables(spark, monkeypatch):
    import time
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before, kept = shuffle_files(spark), []
    monkeypatch.setattr(jaccard, "materialize", lambda df: kept.append(common.materialize(df)) or kept[-1])
    rows = mutated(120, 3)
    out = jaccard.near_duplicates(frame(spark, rows, "doc_id bigint, text string"), 2, 80, 100)
    end = time.time() + 20
    while shuffle_files(spark) > before + 12 and time.time() < end:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before + 12     # of reads of few rows, such as sums; each written table had left some dozens
    left = [t for t in kept if any(os.path.isdir(f.removeprefix("file:").rsplit("/", 1)[0]) for f in t.inputFiles())]
    assert len(left) <= 3 < len(kept)              # the rows, their sets, and the links
    assert out.count() == len(rows)


def test_jaccard_empty(none):
    assert jaccard.near_duplicates(none).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5), (None, 3)] + [(i, i + 1) for i in range(400, 460)]
    got = dict(map(tuple, common.components(frame(spark, edges, "a bigint, b bigint")).collect()))
    near = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    for k in near:
        seen, todo = {k}, [k]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[k] == min(seen)


# --- 4: WARC

def test_warc_round_trip(spark):
    long = "<p>" + "ü" * 600
    rows = [(1, "http://a/", long), (5, "http://b/\r\nX: y", long), (3, None, long), (4, "u", "short"), (6, "u", "short"), (7, "u", None),
            (None, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (9, "u", "z" * 3_000_000), (5, "twice", long)]
    pages = frame(spark, rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    folder = common.shared_dir(spark)
    manifest = warc.write(warc.with_revisits(pages), folder, archive_bytes=1 << 20)
    got = warc.read(warc.normalise(manifest)).collect()
    want = []
    for k, _, h in rows:
        raw = (h or "").encode()
        other = 5 if h == long and k != 5 else None
        want.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "response" if other is None else "revisit", other,
                     bytes(raw) if other is None else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) or
                    (b"" if r.record_type == "response" else None)) for r in got), key=str) == sorted(want, key=str)
    empty = frame(spark, [], "page_id bigint, url string, html string")
    assert warc.round_trip(empty).count() == 0


def test_warc_stream_in_any_pieces(tmp_path):
    recs = [warc.record(i, "u", b"a" * i, hashlib.sha1(b"a" * i).hexdigest(), None, str(i)) for i in range(40)]
    whole = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = whole.compress(b"".join(recs[:20])) + whole.flush()
    data += b"".join((lambda z, r: z.compress(r) + z.flush())(zlib.compressobj(9, zlib.DEFLATED, 31), r) for r in recs[20:])
    (tmp_path / "x.gz").write_bytes(data)
    with open(tmp_path / "x.gz", "rb") as f:
        assert [r for _, r in warc.split_records(warc.inflate(f))] == recs
    (tmp_path / "y.gz").write_bytes(data[:-9])
    with open(tmp_path / "y.gz", "rb") as f, pytest.raises((ValueError, zlib.error)):
        list(warc.split_records(warc.inflate(f)))


# --- 5: BPE

def test_bpe_equals_the_library(docs, texts, none):
    t = tokens.load(BYTE)
    got = {r.doc_id: r for r in bpe.round_trip(docs, BYTE).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        r, plain = got[i * 7], t.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest() and back[i * 7] == plain
    assert bpe.round_trip(none, BYTE).count() == 0


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_tree_concatenation(path):
    t, rng = tokens.load(path), random.Random(1)
    alphabet = ["a", " ", "\n", "\t", "  ", "'s", "'", "!!", "1", "é", "日本", "😀", "the", "ing", "<|endoftext|>", " ", "İ", "é", "ab" * 5]
    for _ in range(400):
        few = rng.sample(alphabet, rng.choice([1, 2, 4, 8]))
        s = "".join(rng.choice(few) for _ in range(rng.choice([0, 1, 20, 100, 300])))
        for leaf in (5, 16, 64):
            assert tokens.tree_encode(t, s, leaf).tolist() == t.encode(s, add_special_tokens=False).ids, (leaf, s)


def test_units_beyond_the_table_are_learnt_anew():
    t, rng = tokens.load(BYTE), random.Random(2)
    words = ["The", "the", "it's", "they'LL", "naïve", "日本", "x1", "a" * 70, "b" * 70, "\0", "c\0d", "İ", "don't!!", "1234", "ÿ×÷", "--", "e\u0301"]
    words += ["".join(rng.choice("abcdeéß'.,1") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    texts = ["".join(rng.choice(" \n") + rng.choice(words) for _ in range(rng.choice([0, 1, 9, 60])))[rng.randint(0, 1):] for _ in range(700)]
    enc = tokens.UnitEncoder(BYTE, bpe.SEPARATOR, most=600)
    got = enc.encode([x.encode() for x in texts])
    for x, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_plain_units_are_merged_without_the_library():
    t = tokens.load(BYTE)
    texts = ["The the\nThe it's O'Reilly's\n1st naïve Straße, (x) -- 12,5%", "", "The", "don't", "a", " a\nb"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    enc = tokens.UnitEncoder(BYTE, bpe.SEPARATOR)
    enc.tok = None
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode([x.encode() for x in texts])] == want


def test_merges_need_tokens_that_give_themselves(tmp_path):
    import json
    file = json.load(open(BYTE, encoding="utf-8"))
    file["model"]["vocab"] = {c: i for i, c in enumerate(tokens.byte_alphabet())} | {"bc": 256, "ab": 257, "abc": 258}
    for last, fits in ((["ab", "c"], False), (["a", "bc"], True)):  # "abc" is a + bc always: ab + c makes no token of it
        file["model"]["merges"] = [["b", "c"], ["a", "b"], last]
        path = tmp_path / f"{fits}.json"
        path.write_text(json.dumps(file), encoding="utf-8")
        enc = tokens.UnitEncoder(str(path), bpe.SEPARATOR)
        assert (enc.merges is not None) == fits
        x = "abc cab abcab bc"
        assert np.frombuffer(enc.encode([x.encode()])[0], "<u4").tolist() == enc.tok.encode(x, add_special_tokens=False).ids


# --- 6 and 9: classifiers

def test_classifiers_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    for module, label, least in ((quality, "quality", 0.97), (toxicity, "toxic", 0.97)):
        out = module.classify(docs, labels).join(labels, "doc_id").where("held_out")
        hit, n = out.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.count("*")).first()
        assert n > 300 and hit >= least


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_rows(spark, docs, none, module, label):
    schema = f"doc_id bigint, {label} int, text string"
    unlabelled = module.classify(docs, frame(spark, [], schema)).collect()
    one_class = module.classify(docs, frame(spark, [(7 * i, 1, "x") for i in range(9)], schema)).collect()
    both = module.classify(docs, frame(spark, [(7 * i, i % 2, None) for i in range(18)] + [(None, 1, ""), (0, None, "")], schema)).collect()
    for got in (unlabelled, one_class, both):
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % (3 if label == "quality" else 5) == (label == "quality")) for r in got)
    assert module.classify(none, frame(spark, [], schema)).count() == 0


def test_quality_sees_every_byte():
    net = quality.Net()
    clean = np.frombuffer(b"abc def ghi jkl " * 70000, np.uint8)
    base = net.chunk_logits(clean)
    for at in (5, quality.BLOCK - 3, quality.BLOCK + 1, len(clean) - 9):
        changed = clean.copy()
        changed[at:at + 8] = 255
        assert not np.array_equal(net.chunk_logits(changed), base)


# --- 7: main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<!-- ad --><div class="ad">Buy <b>now</b></div><header>Site</header><article><h1>Head &amp; line</h1><p><b>Bold</b>ly   goes<br>on<p>Second &lt;p&gt;
para<aside>side</aside><form><input value="1">Form</form><div id="cookie-notice">Cookies</div><section class="comments"><p>Reader</p></section>
<ul><li>one</li><li>two</li></ul></article><footer>&copy; foot</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "http://h/", PAGE), (2, None, None), (3, "http://h/", ""), (4, "http://h/", "<article><p>cut off <b>he"), (4, "http://h/", "<article><p>cut off <b>he"),
            (5, "http://h/", "<article>a < b <em>c</em>d &am <div"), (6, "http://h/", "<article>x</article><p>outside</p>"),
            (7, "http://h/", "<body><main>just main</main>rest")]
    pages = frame(spark, rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in htmltext.extract(pages).collect())
    want = {1: "Head & line Boldly goes on Second <p> para one two", 2: "", 3: "", 4: "cut off he", 5: "a < b cd &am", 6: "x", 7: "just main"}
    assert got == sorted((k, want[k], len(want[k])) for k, _, _ in rows)
    assert htmltext.extract(frame(spark, [], "page_id bigint, url string, html string")).count() == 0


def test_host_suffix_array_decides_open_blocks(spark):
    own = [f"<div>unique words number {i} about topic {i * 31} and nothing else {i * 7}</div>" for i in range(6)]
    notice = "<div>please accept our terms of service before reading on</div>"
    rows = [(i, "http://h.org/%d" % i, f"<body>{notice}{o}<div>call us today at our office</div></body>") for i, o in enumerate(own)]
    rows += [(100 + i, "http://h.org/%d" % i, rows[0][2]) for i in range(3)]  # copies of a page are one page
    rows.append((200, "http://other.org/", rows[0][2]))  # nothing repeats on this host
    rows.append((300, "http://menu.org/a", "<article>the text</article><div>open block that the next page has too</div>"))
    rows.append((301, "http://menu.org/b", "<div>open block that the next page has too</div><div>but this one it has not got</div>"))
    got = {r.page_id: r.text for r in htmltext.extract(frame(spark, rows, "page_id bigint, url string, html string")).collect()}
    text = [re.sub("<[^>]*>", "", o) for o in own]
    assert [got[i] for i in range(6)] == text and {got[100 + i] for i in range(3)} == {text[0]}
    assert got[200] == "please accept our terms of service before reading on " + text[0] + " call us today at our office"
    assert got[300] == "the text" and got[301] == "but this one it has not got"


def test_main_text_on_the_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " ", body[1] if body else "")).split())


# --- 8: packing

def check_packing(pieces, texts, ids_of):
    at = collections.defaultdict(list)
    for p in pieces:
        at[p.sequence_id].append(p)
    total = padding = 0
    for rows in at.values():
        end = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert 0 < end <= 4096
        total, padding = total + end, padding + (4096 - end if end & (end - 1) else 0)
    assert padding == 0
    mine = collections.defaultdict(list)
    for p in pieces:
        mine[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    assert set(mine) == set(texts)
    for k, t in texts.items():
        ids, end = np.array(ids_of(t or "") + [2], "<u4"), 0
        for start, length, crc, n in sorted(mine[k]):
            assert start == end and n == len(ids) and crc == zlib.crc32(ids[start:start + length].tobytes())
            end += length
        assert end == len(ids)


def test_packing(spark, docs, texts, none):
    t = tokens.load(WORD)
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    check_packing(packing.pack(docs, WORD).collect(), {7 * i: x for i, x in enumerate(texts)}, ids)
    rows = mutated(400, 3)
    for shard in (50, 2000):
        check_packing(packing.pack(frame(spark, rows, "doc_id bigint, text string"), WORD, shard_rows=shard).collect(), dict(rows), ids)
    assert packing.pack(none, WORD).count() == 0


def test_packing_puts_like_documents_together():
    rng = np.random.default_rng(1)
    topics = [rng.integers(100 + 500 * k, 600 + 500 * k, (40, 500)).astype(np.uint16) for k in range(4)]
    order = rng.permutation(160)
    ids = [topics[i % 4][i // 4] for i in order]
    df = np.zeros(49_408)
    for x in ids:
        df[np.unique(x)] += 1
    idf = np.log1p((160 - df + 0.5) / (df + 0.5)).astype(np.float32)
    by = collections.defaultdict(list)
    for d, _, n, s, _ in packing.pack_shard(ids, idf, 500):
        by[s] += [order[d] % 4] * n
    share = np.mean([collections.Counter(v).most_common(1)[0][1] / len(v) for v in by.values()])
    assert share > 0.85


def test_pivots_of_a_batch_are_those_of_each_document(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [np.minimum(rng.geometric(0.02, n), 500).astype(np.uint16) for n in (40, 0, 300, 7, 0, 0, 25, 900, 1, 0)]
    ids, bound = np.concatenate(texts), np.append(0, np.cumsum([len(x) for x in texts]))
    terms, counts, own = packing.distinct(ids, bound)
    plain = [np.unique(x, return_counts=True) for x in texts]
    assert [terms[a:b].tolist() for a, b in zip(own, own[1:])] == [t.tolist() for t, _ in plain]
    assert counts.tolist() == [c for _, n in plain for c in n.tolist()]
    raw, to = packing.closed(ids, bound)
    assert [raw[a:b].tolist() for a, b in zip(to, to[1:])] == [[*x.tolist(), packing.CLOSE] for x in texts]
    sample = [np.unique(rng.geometric(0.02, 200).clip(max=499), return_counts=True) for _ in range(60)]
    near = packing.Pivots([(t.astype(np.int32), c.astype(np.int32)) for t, c in sample], 50)
    want = []
    for t, c in plain:
        score, best = near._scores(t.astype(np.int64), c), []
        for _ in range(2):
            best.append(int(score.argmax()) if score.max() > 0 else near.n)
            score[score.argmax()] = 0
        want.append(tuple(best))
    assert len(set(want)) > 4 and want[1] == (near.n, near.n)
    for most in (1 << 20, 1):  # all at once, and one document at a time
        monkeypatch.setattr(packing, "POSTINGS", most)
        p, q = near.nearest(terms, counts, own)
        assert list(zip(p.tolist(), q.tolist())) == want
    p, q = packing.Pivots([], 0).nearest(terms, counts, own)
    assert p.tolist() == q.tolist() == [0] * len(texts)


def test_a_full_word_table_keeps_the_words_of_the_batch():
    import pyarrow as pa
    enc, learnt = tokens.WordEncoder(WORD, most=6), []
    learn = enc._learn
    enc._learn = lambda words: (learnt.extend(words), learn(words))
    enc.encode(pa.array(["one two three"]))
    ids, bound = enc.encode(pa.array(["two four five six", None, " three "]))
    plain = tokens.load(WORD)
    assert [ids[a:b].tolist() for a, b in zip(bound, bound[1:])] == [plain.encode(x, add_special_tokens=False).ids for x in ("two four five six", "", "three")]
    assert len(learnt) == len(set(learnt)) == 6 and b"one" not in enc.cache and b"two" in enc.cache


def test_a_word_table_keeps_used_words_and_counts_their_bytes():
    import pyarrow as pa
    enc, learnt = tokens.WordEncoder(WORD, most=40), []
    learn = enc._learn
    enc._learn = lambda words: (learnt.extend(words), learn(words))
    plain = tokens.load(WORD)
    for i in range(30):  # one word comes back from the table before, the others are met once
        text = " ".join(["again", *(f"w{i}x{j}" for j in range(6))])
        ids, _ = enc.encode(pa.array([text]))
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(enc.cache) + len(enc.older) <= 42
    assert learnt.count(b"again") == 1 and len(learnt) == 181
    for i in range(12):  # words of 640 bytes count as many
        enc.encode(pa.array(["z" * 639 + chr(97 + i)]))
        assert sum(map(len, enc.cache)) + sum(map(len, enc.older)) < 64 * 40


def test_batches_are_cut_by_the_bytes_of_their_texts():
    import pyarrow as pa
    from kartlane.llm.common import pieces
    texts = ["é" * 40, None, "", "a" * 300, "b", None, "c" * 60, "d" * 30] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["row", "text"])
    for size, rows in ((100, 2000), (100, 5), (1, 2000), (1 << 20, 2000)):
        got = list(pieces([batch.slice(0, 3), batch.slice(3)], rows, text=1, size=size))
        assert [x for b in got for x in b.column(0).to_pylist()] == list(range(len(texts)))
        for b in got:
            held = [len((t or "").encode()) for t in b.column(1).to_pylist()]
            assert b.num_rows <= rows and (sum(held) <= size or sum(held) == held[0])


def test_the_memory_of_encoding_follows_no_batch_of_long_texts(monkeypatch):
    """Packing encodes at most 2 MB of texts at once, however long the rows of a batch are."""
    import pyarrow as pa
    seen, encode = [], tokens.WordEncoder.encode
    monkeypatch.setattr(tokens.WordEncoder, "encode", lambda self, c: (seen.append(sum(len(t or "") for t in c.to_pylist())), encode(self, c))[1])
    monkeypatch.setattr(packing, "shared_dir", lambda spark: "unused")

    class Docs:  # what ``pivots`` asks of a table; runs its function on one batch
        def __getattr__(self, name):
            return lambda *a, **k: self

        def mapInArrow(self, run, schema):
            self.out = list(run([pa.RecordBatch.from_arrays([pa.array(["word " * 100_000] * 12)], ["text"])]))
            return self

        def collect(self):
            return []
    docs = Docs()
    packing.pivots(docs, WORD, 12, 4)
    assert sum(seen) == 6_000_000 and max(seen) <= 1 << 21 and sum(b.num_rows for b in docs.out) == 12


def test_packing_finds_like_documents_in_many_shards(spark):
    """Topics are dealt together, repeated rows of one id are spread over shards."""
    rng = random.Random(5)
    topics = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(60)] for _ in range(8)]
    rows = [(i, " ".join(rng.choice(topics[i % 8]) for _ in range(200))) for i in range(480)]
    pieces = packing.pack(frame(spark, rows, "doc_id bigint, text string").repartition(3), WORD, shard_rows=60).collect()
    by = collections.defaultdict(collections.Counter)
    for p in pieces:
        by[p.sequence_id][p.doc_id % 8] += p.length
    assert len({p.sequence_id >> 32 for p in pieces}) >= 8
    assert sum(max(c.values()) for c in by.values()) / sum(sum(c.values()) for c in by.values()) > 0.8
    same = packing.pack(frame(spark, [(1, rows[0][1])] * 480, "doc_id bigint, text string"), WORD, shard_rows=60).collect()
    shards = collections.Counter(p.sequence_id >> 32 for p in same if p.start == 0)
    assert len(shards) == 8 and max(shards.values()) < 100


def test_words_equal_the_library():
    import pyarrow as pa
    t, enc, rng = tokens.load(WORD), tokens.WordEncoder(WORD, most=3000), random.Random(6)
    s = ["".join(rng.choice("abcdeéüABXYZ '12.!_-<|>Σİ日ß\t\n") for _ in range(rng.randint(0, 30))) for _ in range(6000)] + [None, "<|startoftext|>a b"]
    for at in range(0, len(s), 1500):
        ids, bound = enc.encode(pa.array(s[at:at + 1500], pa.string()))
        for x, a, b in zip(s[at:at + 1500], bound[:-1], bound[1:]):
            assert ids[a:b].tolist() == t.encode(x or "", add_special_tokens=False).ids, x


# --- 10: fingerprints

def test_fingerprints(spark, texts, none):
    rows = [(i * 7, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.with_edits(frame(spark, rows, "doc_id bigint, text string").withColumn("t", F.lit("clash")),
                                                   rows_per_range=4).collect()}
    order = sorted(rows, reverse=True)
    by_text = collections.defaultdict(set)
    for (k, t), (k2, t2) in zip(order, order[1:] + order[:1]):
        t, t2 = t or "", t2 or ""
        cut = len(t) // 3
        edited = t[:len(t) - cut] + t2[:cut]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        bits = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
        assert r.near_edited == bits(r.fingerprint, r.edited_fingerprint) and r.near_next == bits(r.fingerprint, got[k2].fingerprint)
        by_text[t].add(r.fingerprint)
        by_text[edited].add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert simhash.with_edits(none).count() == 0
    twice = simhash.with_edits(frame(spark, [(1, "a b c"), (1, "a b c"), (None, "d e")], "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id or 0 for r in twice) == [0, 1, 1]


@pytest.mark.parametrize("radius", [0, 3, 7])
def test_near_fingerprints_are_all_found(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(30)]
    every = [b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(0, 9))) for b in base for _ in range(6)]
    prints = [f"{x:032x}" for x in every] + [None, f"{every[0]:032x}"]
    got = {(r.a, r.b): r.distance for r in simhash.near_pairs(frame(spark, [(p,) for p in prints], "fingerprint string"), radius).collect()}
    names = sorted(set(prints[:-2]))
    want = {(a, b): (int(a, 16) ^ int(b, 16)).bit_count() for i, a in enumerate(names) for b in names[i + 1:]}
    assert got == {k: v for k, v in want.items() if v <= radius}
