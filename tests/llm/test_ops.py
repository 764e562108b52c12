import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tramline.llm import bwt, components, embeddings, fingerprint, minhash, packing, quality, sentencepiece, shared, substring, suffix, toxicity, urls, windows

WORD = r"[^\x20\x09-\x0D]+"


def texts():
    """Short documents with copies, near copies, shared passages and odd cases."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared = prose(30)
    base = prose(120)
    near = base.split()
    near[40] = "changed"
    return [
        (0, base, "x"), (1, prose(15) + "\n" + shared + " " + prose(20), "x"), (2, base, "x"), (3, " ".join(near), "x"), (4, None, None), (5, "", "x"), (6, "one two", "x"), (7, prose(5) + " " + shared, "x"),
        (8, "a " * 60, "x"), (9, "a " * 90, "x"), (10, "åäö " + prose(40) + " " + shared + "  " + shared, "x"), (6, "one two", "x"), (11, "one two three four", "x"), (None, base, "x"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    # A column of the operator's own name must survive.
    return spark.createDataFrame(texts(), "doc_id bigint, text string, runs string").persist()


def rows():
    return [(i, t or "") for i, t, _ in texts()]


def test_substring_against_brute_force(docs):
    width = 10
    first = {}
    for i, t in rows():
        w = re.findall(WORD, t)
        for k in range(len(w) - width + 1) if i is not None else ():
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    expected = Counter()
    for i, t in rows():
        w = re.findall(WORD, t)
        gone = set()
        for k in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        expected[(i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone))] += 1
    got = substring.remove_repeats(docs, width=width).select("doc_id", "dedup.*").collect()
    assert Counter(tuple(r) for r in got) == expected


def test_suffix_against_brute_force(docs):
    width = 20
    first = {}
    for i, t in rows():
        b = t.encode()
        for k in range(len(b) - width + 1) if i is not None else ():
            first[b[k : k + width]] = min(first.get(b[k : k + width], i), i)
    expected = Counter()
    for i, t in rows():
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1) if i is not None else ():
            if first[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        expected[(i, bytes(x for x, g in zip(b, gone, strict=True) if not g), len(b), sum(gone), spans)] += 1
    got = suffix.remove_repeats(docs, width=width).select("doc_id", "dedup.kept", "dedup.n_bytes", "dedup.n_removed", F.size("dedup.spans")).collect()
    assert Counter((r[0], bytes(r[1]), *r[2:]) for r in got) == expected


def test_interval_expansion_parts_equal_windows():
    rng = np.random.default_rng(3)
    raw = bytes(rng.integers(97, 100, 3000).astype(np.uint8))
    body = [raw[s : s + n] for s, n in zip(rng.integers(0, 2800, 120), rng.integers(12, 90, 120), strict=True)]
    segment, offset, kind = bwt.equal_windows(body, 12)
    seen = {}
    for s, o, k in zip(segment, offset, kind, strict=True):
        assert seen.setdefault(body[s][o : o + 12], k) == k
    assert len(set(seen.values())) == len(seen)
    assert len(segment) == sum(len(b) - 11 for b in body)


def test_sketch_never_loses_a_repeat():
    data = ("alpha beta gamma " * 40 + "delta epsilon " * 30).encode()
    values, first = substring._split(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    p = windows.anchored(values, first, 10, 5)
    count = Counter(p.anchor[windows.changes(p)].tolist())
    sketch = np.full((2, 1 << 17), 255, np.uint8)
    assert windows.maybe_repeated(sketch, np.array(list(count), np.uint64)).all()


def test_minhash_against_brute_force(docs):
    bags = {}
    for i, t in rows():
        w = re.findall(WORD, t)
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    ids = [i for i in bags if i is not None]
    low = {i: i for i in bags}
    for _ in ids:
        for a in ids:
            for b in ids:
                both = sum((bags[a] & bags[b]).values())
                if both and both / sum((bags[a] | bags[b]).values()) >= 0.8:
                    low[a] = low[b] = min(low[a], low[b])
    got = minhash.near_copies(docs).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter((i, low[i]) for i, _ in rows())
    assert {r.doc_id for r in minhash.keep_one(docs).collect()} == {i for i in low if low[i] == i}


def test_signature_is_unbiased():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    a, b = rng.integers(1, 6, 300), rng.integers(1, 6, 300)
    agree = []
    for k in range(30):
        salted = h * np.uint64(2 * k + 1)
        sig = minhash.signatures(np.repeat([0, 1], 300), np.r_[salted, salted], np.r_[a, b], 2)
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 20)] + [(30, 40), (40, 35), (50, 50)]
    got = components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {**dict.fromkeys(range(1, 21), 1), 30: 30, 35: 30, 40: 30}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_packing():
    sizes = sorted((random.Random(1).randint(1, 100) for _ in range(300)), reverse=True)
    bins, starts, capacity = packing.best_fit(sizes, (32, 64, 100), 4)
    used = Counter()
    for b, s, n in zip(bins, starts, sizes, strict=True):
        assert s == used[b]
        used[b] += n
    assert all(used[b] <= c and not any(used[b] <= d < c for d in (32, 64, 100)) for b, c in enumerate(capacity))
    assert sum(capacity) < 1.15 * sum(sizes)


def test_packing_keeps_every_token(docs):
    got = packing.pack(docs, lengths=(16, 32), shard=4).collect()
    tokens = Counter()
    for r in got:
        tokens[r.doc_id] += r.n_tokens
        assert r.bin_id is None or r["at"] + r.n_tokens <= r.capacity
    expected = Counter()
    for i, t in rows():
        expected[i] += len(re.findall(WORD, t))
    assert tokens == expected


RULES = (urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"), urls.Rule("org", "/fr/", "allow"))


def test_urls(spark):
    pages = [
        (1, "http://A.example.NET/en/1?x#y", ""), (2, "http://a.example.net/de/1", ""), (3, "http://clean.com/a", '<link href="http://b.net/x" rel="canonical">'), (4, "http://mirror.com/", '<META HTTP-EQUIV=refresh content="0; url=http://clean.com/a">'),
        (5, "http://ok.com/p/q", '<link rel=canonical href="../z">'), (6, "http://net", ""), (7, None, None), (8, "no scheme", "x"), (9, "http://notnet.com/", ""), (10, "http://w.org/fr/1", '<link rel="canonical" href="//b.net/x2">'), (11, "http://side.com/1", '<link rel="canonical" href="http://w.org/fr/1">'),
    ]
    frame = spark.createDataFrame([(*p, "extra") for p in pages], "page_id bigint, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame, RULES).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("a.example.net", "/de/1", "net/", "block")
    assert got[3][3] == got[4][3] == "block"  # along canonical and redirect to a blocked url
    assert got[5][3] == "allow" and got[9][3] == "allow"
    assert got[6] == ("net", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[10][3] == "allow" and got[11][3] == "allow"  # an explicit allow goes before a block that spreads
    assert len(got) == len(pages)


def test_sentencepiece_bpe_matches_the_library(spark, docs):
    library = pytest.importorskip("sentencepiece")
    from tramline.llm.queries import PIECE_MODEL

    model = sentencepiece.load(spark, PIECE_MODEL)
    own = library.SentencePieceProcessor(model_file=PIECE_MODEL)
    more = ["", "a", "  two  spaces ", "tab\tline\n\nend", "日本語のテキスト", "emoji 🎉🎉 ▁ mark", "x" * 300 + " y", "Ünïcödé " * 5, None]
    got = spark.createDataFrame([(t,) for t in more + [t for _, t in rows()]], "t string").withColumn("ids", sentencepiece.encode(model, "t")).withColumn("back", sentencepiece.decode(model, "ids")).collect()
    for r in got:
        assert r.ids == (None if r.t is None else own.encode(r.t)), r.t
        assert r.back == (None if r.t is None else own.decode(own.encode(r.t)))


def test_viterbi_over_the_public_pieces(spark):
    library = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2

    from tramline.llm.queries import PIECE_MODEL

    with open(PIECE_MODEL, "rb") as f:
        raw = f.read()
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(raw)
    proto.trainer_spec.model_type = sentencepiece.UNIGRAM
    other = library.SentencePieceProcessor(model_proto=proto.SerializeToString())
    own = library.SentencePieceProcessor(model_file=PIECE_MODEL)
    p = sentencepiece.parse(raw)
    texts = ["", "a", "  two  spaces ", "x" * 96 + " " + "y" * 97 + "xy" * 60, "日本語のテキスト 🎉", "Ünïcödé " * 5, "word and another word, " * 300] + [t or "" for _, t in rows()]
    (merged, edge), (best, cut) = sentencepiece.encode_batch(p, pa.array(texts), (sentencepiece.BPE, sentencepiece.UNIGRAM))
    for k, t in enumerate(texts):
        assert merged[edge[k] : edge[k + 1]].tolist() == own.encode(t)
        mine, theirs = best[cut[k] : cut[k + 1]], other.encode(t)
        assert p.score[mine].sum() >= p.score[theirs].sum()  # the library sums in single precision
        assert sentencepiece.decode_batch(p, mine, np.array([0, len(mine)])) == [own.decode(own.encode(t))]


def _twins():
    """Two different words of 1024 letters that every sum of powers takes for one."""
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_twin_words_stay_apart(spark):
    from tramline.llm.queries import PIECE_MODEL

    x, y = _twins()
    p = sentencepiece.load(spark, PIECE_MODEL)
    flat, edge = sentencepiece.encode_batch(p, pa.array([x, y]))[0]
    assert sentencepiece.decode_batch(p, flat, edge) == [x, y]
    rest = " ".join(f"w{k}" for k in range(49))
    docs_ = spark.createDataFrame([(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, x), (4, y), (5, x)], "doc_id bigint, text string")
    assert {r.doc_id: r.n for r in substring.remove_repeats(docs_).selectExpr("doc_id", "dedup.n_removed as n").collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
    assert {r.doc_id: r.class_id for r in minhash.near_copies(docs_.where("doc_id > 2")).collect()} == {3: 3, 4: 4, 5: 3}
    texts = dict(docs_.collect())
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            first.setdefault(texts[i][k : k + 50], i)
    for r in suffix.remove_repeats(docs_).selectExpr("doc_id", "dedup.n_removed as n").collect():
        t = texts[r.doc_id]
        gone = {j for k in range(len(t) - 49) if first[t[k : k + 50]] < r.doc_id for j in range(k, k + 50)}
        assert r.n == len(gone)


def test_crowded_places_are_dealt(spark, docs, monkeypatch):
    """Block bounds of a few rows change nothing in what is found."""
    whole = [sorted(map(tuple, minhash.near_copies(docs).collect()), key=repr), sorted(map(tuple, suffix.remove_repeats(docs, width=20).select("doc_id", "dedup.n_removed").collect()), key=repr)]
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(suffix, "HOT", 2)
    assert whole == [sorted(map(tuple, minhash.near_copies(docs).collect()), key=repr), sorted(map(tuple, suffix.remove_repeats(docs, width=20).select("doc_id", "dedup.n_removed").collect()), key=repr)]


def test_viterbi_against_brute_force():
    text = ["<unk>", "a", "b", "c", "ab", "bc", "abc", "ca", " ", " a", " ab"]
    score = -np.array([0, 3, 3.1, 2.9, 4, 4.2, 6.5, 5, 2, 4.5, 6])
    kind = np.array([sentencepiece.UNKNOWN] + [sentencepiece.NORMAL] * (len(text) - 1))
    p = sentencepiece.Pieces([t.encode() for t in text], score.astype(float), kind, sentencepiece.UNIGRAM, True, False)
    known = dict(zip(text[1:], score[1:], strict=True))

    def best(s):
        top = [(0.0, [])] + [(-1e9, [])] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(e):
                piece = s[b:e]
                gain = known.get(piece, score[1:].min() - 10 if e - b == 1 else None)
                if gain is not None and top[b][0] + gain > top[e][0] + 1e-9:
                    top[e] = (top[b][0] + gain, [*top[b][1], piece])
        return top[-1][0]

    for s in ("abc", "abcab cab", "bca ab c", "zab", "abcabcabc"):
        flat, _ = sentencepiece.encode_batch(p, pa.array([s]))[0]
        assert abs(sum(known.get(text[i], score[1:].min() - 10) for i in flat) - best(" " + s)) < 1e-6


def test_fingerprints(spark):
    docs_ = [(3, "One two three.\nFour five."), (1, "Same line.\nAnother line.\nThird line.\nLast one here."), (2, "Same line.\nAnother line.\nThird line.\nLast one here."), (5, None), (9, "\n".join(f"Paragraph number {k}." for k in range(200))), (9, "\n".join(f"Paragraph number {k}." for k in range(200)))]
    got = fingerprint.fingerprints(spark.createDataFrame(docs_, "doc_id bigint, text string"), keep_edited=True).collect()
    order = sorted(docs_, key=lambda d: d[0])
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        assert any(r.n_chars == len(t) and r.edited == edited and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() for r in by[i])
    assert by[1][0].fingerprint == by[2][0].fingerprint and by[1][0].near_next == 1.0
    assert 0.5 < by[9][0].near_edited < 1 and len(by[9]) == 2
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_fingerprints_peel_in_short_plans(spark, monkeypatch):
    # Every aggregate of a stage takes its memory before the first row is read.
    plans, write = [], shared.written

    def counted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("HashAggregate(keys"))
        return write(df, name)

    monkeypatch.setattr(shared, "written", counted)
    sets = [[f"Line {k} of {'all' if k < 30 else i}." for k in range(30 + 13 * i)] for i in range(5)]
    got = fingerprint.fingerprints(spark.createDataFrame([(i, "\n".join(s)) for i, s in enumerate(sets)], "doc_id bigint, text string")).collect()
    following = [len(set(s) ^ set(sets[(i + 1) % 5])) for i, s in enumerate(sets)]
    assert [r.d_next for r in sorted(got, key=lambda r: r.doc_id)] == following
    assert max(plans) <= 12


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    vectors = [b + rng.normal(scale=s, size=16) for b in base for s in (0.0, 0.02, 0.08, 0.15)]
    table = [(k, [float(x) for x in v], k % 3) for k, v in enumerate(vectors)]
    table += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, table[0][1], None), (904, table[0][1], 0), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0)]
    got = {r.vec_id: r for r in embeddings.near_copies(spark.createDataFrame(table, "vec_id bigint, embedding array<double>, label int")).collect()}
    sound = [(i, np.array(v), c) for i, v, c in table if v is not None and c is not None and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _, _ in table}
    for i, v, c in sound:
        for j, w, d in sound:
            if i != j and c == d and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i].add(j)
    low = {i: i for i in links}
    for _ in range(20):
        low = {i: min([low[i], *(low[j] for j in links[i])]) for i in links}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (len(links[i]), low[i], low[i] == i) for i in links}


def test_embedding_blocks_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(4)
    table = [(k, [float(x) for x in 1 + rng.normal(scale=0.01, size=12)], 1) for k in range(40)]
    got = embeddings.near_copies(spark.createDataFrame(table, "vec_id bigint, embedding array<double>, label int")).collect()
    assert all(r.n_links == 39 and r.component_id == 0 for r in got)


def labelled(spark):
    rng = random.Random(3)
    words = "the of and rain wind road house river stone light over under".split()
    docs_, marks = [], []
    for k in range(240):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(30, 60))).capitalize() + "."
        bad, toxic = k % 4 == 0, k % 5 == 0
        t = " | ".join(f"{w}###" for w in t.split()) if bad else t
        t = t + " wretch " + t[:20] if toxic else t
        docs_.append((k, t))
        marks.append((k, int(not bad), int(toxic)))
    docs_ += [(1000, None), (1001, ""), (None, "the road")]
    return spark.createDataFrame(docs_, "doc_id bigint, text string"), spark.createDataFrame([*marks, (3, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def test_quality_held_out(spark):
    docs_, marks = labelled(spark)
    stats = quality.statistics(docs_)
    model = quality.fit(stats, marks)
    got = {r.doc_id: r.s for r in stats.select("doc_id", quality.score_stats_column(model, "stats").alias("s")).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 243
    assert np.mean([(got[k] >= 0.7) == (k % 4 != 0) for k in range(240)]) > 0.97
    assert all(r.s == 0.5 for r in stats.select(quality.score_stats_column(quality.fit(stats, marks.where("false")), "stats").alias("s")).collect())
    x, y = quality.isotonic(np.arange(4.0), np.array([0.0, 0.5, 0.3, 1.0]), np.ones(4))
    assert (np.diff(y) >= 0).all() and np.interp(1.5, x, y) == 0.4


def test_toxicity_held_out(spark):
    docs_, marks = labelled(spark)
    model = toxicity.fit(docs_, marks)
    got = {r.doc_id: r.s for r in docs_.select("doc_id", toxicity.score_column(model, "text").alias("s")).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 243
    assert np.mean([(got[k] >= 0.5) == (k % 5 == 0) for k in range(240)]) > 0.97
    assert len(model.index) < 5000


@pytest.mark.parametrize("operate", [lambda d: substring.remove_repeats(d), lambda d: suffix.remove_repeats(d), lambda d: minhash.near_copies(d), lambda d: packing.pack(d), lambda d: fingerprint.fingerprints(d)])
def test_empty_tables(spark, operate):
    assert operate(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
