"""Plain reimplementations, the pipeline's stages, and the cases every operator defines."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tramline.llm import embeddings, fingerprint, minhash, packing, quality, sentencepiece, shared, stages, substring, suffix, textnum, toxicity, urls, windows
from tramline.llm.queries import PIECE_MODEL

WORD = r"[^\x20\x09-\x0D]+"


def shingle_bag(t):
    w = re.findall(WORD, t or "")
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def near_classes(texts):
    """{id: smallest id reachable by pairs at 0.8}; repeated ids are one document."""
    bags = [(i, shingle_bag(t)) for i, t in texts if i is not None]
    low = {i: i for i, _ in bags}
    for _ in bags:
        for i, x in bags:
            for j, y in bags:
                both = sum((x & y).values())
                if both and both / sum((x | y).values()) >= 0.8:
                    low[i] = low[j] = min(low[i], low[j])
    return low


def without_repeats(texts, width=50):
    """{id: kept words} of tables with one row an id."""
    words = {i: re.findall(WORD, t or "") for i, t in texts if i is not None}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(k, k + width)}
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


@pytest.fixture(scope="module")
def corpus():
    """(documents, labels): clean, junk and toxic texts, copies, near copies and a shared passage."""
    rng = random.Random(11)
    words = "the of and rain wind road house river stone light over under while beyond never always green".split()

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."

    passage = prose(60)
    docs, marks = [], []
    for k in range(160):
        t = prose(rng.randint(60, 120))
        bad, toxic = k % 5 == 0, k % 7 == 0
        if k % 11 == 1 and k > 11:
            t = docs[k - 11][1]
        elif k % 11 == 2 and k > 11:
            t = docs[k - 11][1].replace("rain", "snow", 1)
        elif k % 13 == 3:
            t = prose(20) + "\n" + passage + " " + prose(20)
        t = " | ".join(f"{w}###" for w in t.split()) if bad else t
        t = t + " wretch you wretch" if toxic else t
        docs.append((k, t, "en", "web", len(t)))
        marks.append((k, int(not bad), int(toxic)))
    docs += [(900, None, "en", None, None), (901, "", None, "web", 0)]
    return docs, marks


def test_ridge_weights_are_those_of_plain_equations(spark, corpus, monkeypatch):
    monkeypatch.setattr(quality, "ROWS_PER_SUM", 2)
    monkeypatch.setattr(quality, "SUMS", 3)
    docs, marks = corpus
    stats = quality.statistics(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars int"))
    table = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    model = quality.fit(stats, table)
    held = {r.doc_id for r in table.where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").collect()}
    by = {r.doc_id: r.stats for r in stats.collect()}
    own = [(by[i], y) for i, y, _ in marks if i not in held]
    x, y = np.array([s for s, _ in own]), np.array([y for _, y in own], dtype=float)
    assert np.allclose(model.centre, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0) + 1e-3)
    z = quality._features(x, model.centre, model.scale)
    penalty = np.eye(z.shape[1]) * quality.RIDGE * len(y)
    penalty[0, 0] = 0
    plain = np.linalg.lstsq(z.T @ z + penalty, z.T @ y, rcond=None)[0]
    assert np.allclose(z @ model.weights, z @ plain, atol=1e-6)


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, quality.STATS))
    z = quality._features(x, np.zeros(quality.STATS), np.ones(quality.STATS))[:, 1 + quality.STATS :] / quality.KERNEL_SCALE
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-quality.GAMMA * far)).mean() < 0.06


def test_ftrl_is_the_plain_update():
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 40, 6)).astype(np.int32) for _ in range(60)]
    y = (rng.random(60) < 0.4).astype(float)
    w, bias = toxicity.ftrl(rows, y, epochs=2)
    z, n = Counter(), Counter()

    def weight(k):
        limit = 0.0 if k == "bias" else toxicity.L1
        return 0.0 if abs(z[k]) <= limit else (np.sign(z[k]) * limit - z[k]) / ((toxicity.BETA + np.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(2):
        for own, label in zip(rows, y, strict=True):
            at = [*own.tolist(), "bias"]
            now = {k: weight(k) for k in at}
            g = (1 / (1 + np.exp(-sum(now.values()))) - label) * (toxicity.POSITIVE if label else 1)
            for k in at:
                z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / toxicity.ALPHA * now[k]
                n[k] += g * g
    assert np.isclose(bias, weight("bias"))
    assert np.allclose(w[:40], [weight(k) for k in range(40)]) and not w[40:].any()


def test_likeness_is_that_of_the_paragraph_sets(spark, corpus):
    docs = [d[:2] for d in corpus[0]] + [(950, "\n".join(f"Line {k}." for k in range(500)))]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(docs, "doc_id bigint, text string"), keep_edited=True).collect()}

    def kinds(t):
        return set(re.findall(rf"[^\n]{{{fingerprint.PIECE},}}?[.!?](?=\s|$)|[^\n]+", t)) or {""}

    order = sorted(docs)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1] or ""
        for other, near in ((got[i].edited, got[i].near_edited), (following, got[i].near_next)):
            a, b = kinds(t or ""), kinds(other)
            assert np.isclose(near, len(a & b) / len(a | b))


def test_mix_of_lengths_beats_one_length():
    rng = random.Random(2)
    sizes = sorted((min(8192, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(3000)), reverse=True)

    def total(lengths, **options):
        return sum(packing.cost(c) for c in packing.best_fit(sizes, lengths, **options)[2])

    mix = total(packing.LENGTHS)
    assert all(mix < total((c,)) for c in packing.LENGTHS if c >= sizes[0])
    assert mix < 0.95 * total(packing.LENGTHS, attention=1 << 60)  # the largest opened first, then shrunk
    assert sum(packing.best_fit(sizes)[2]) < 1.02 * sum(sizes)


def plain_best_fit(sizes, lengths, overhead, attention):
    """The rule by lists: best open bin, else the length that costs least for what it would hold."""
    bins, todo, out, touched = [], list(sizes), [], []
    for turn, size in enumerate(sizes):
        todo.remove(size)
        fits = [k for k, (c, u) in enumerate(bins) if c - u >= size]
        if fits:
            own = min(fits, key=lambda k: (bins[k][0] - bins[k][1], -touched[k]))  # of equals, the last one used
        else:

            def each(c):
                left = c - size
                for s in sorted(todo, reverse=True):
                    left -= s if s <= left else 0
                return packing.cost(c, overhead, attention) / (c - left)

            own = len(bins)
            touched.append(turn)
            bins.append((min((c for c in sorted(lengths) if c >= size), key=lambda c: (each(c), c)), 0))
        out.append(own)
        touched[own] = turn
        bins[own] = (bins[own][0], bins[own][1] + size)
    return [min(c for c in lengths if c >= u) for _, u in bins], [sum(s for s, o in zip(sizes, out, strict=True) if o == k) for k in range(len(bins))]


def test_packing_against_lists():
    rng = random.Random(5)
    for _ in range(20):
        sizes = sorted((rng.randint(1, 64) for _ in range(60)), reverse=True)
        bins, _, capacity = packing.best_fit(sizes, (16, 32, 64), 3, 100)
        held = [sum(s for s, b in zip(sizes, bins, strict=True) if b == k) for k in range(len(capacity))]
        assert sorted(zip(capacity, held, strict=True)) == sorted(zip(*plain_best_fit(sizes, (16, 32, 64), 3, 100), strict=True))


def test_stages_and_pipeline(spark, corpus, tmp_path):
    docs, marks = corpus
    schema = "doc_id bigint, text string, lang string, source string, n_chars int"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder, frame = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")

    def pairs(rows):
        return {(r.doc_id, r.text) for r in rows.collect()}

    # Quality and toxicity: the models' scores, one text at a time.
    first = stages.keep_quality(spark, frame, folder)
    model = quality.fit(quality.statistics(frame), labels)
    assert first.columns == frame.columns
    assert pairs(first) == {(d[0], d[1]) for d in docs if model.score(quality.stats_of(pa.array([d[1]], pa.string())))[0] >= 0.7}
    clean = {d[0] for d in docs if d[0] < 160 and d[0] % 5}
    assert len(clean & {i for i, _ in pairs(first)}) >= 0.97 * len(clean)
    second = stages.drop_toxic(spark, first, folder)
    model = toxicity.fit(first, labels)
    assert pairs(second) == {(i, t) for i, t in pairs(first) if model.score(pa.array([t], pa.string()))[0] < 0.5}
    # Near copies and repeats: brute force.
    third = stages.keep_one_of_near_copies(spark, second, folder)
    low = near_classes(pairs(second))
    assert third.columns == frame.columns and pairs(third) == {(i, t) for i, t in pairs(second) if low[i] == i}
    fourth = stages.cut_repeats(spark, third, folder)
    kept, before = without_repeats(pairs(third)), dict(pairs(third))
    assert fourth.columns == frame.columns
    for i, t in pairs(fourth):
        assert t == before[i] if len(kept[i]) == len(re.findall(WORD, before[i] or "")) else t == " ".join(kept[i])
    assert any(len(kept[i]) < len(re.findall(WORD, before[i] or "")) for i in kept)
    # Packing: every word once, in order, within a permitted length.
    packed = stages.pack_sequences(spark, fourth, folder).collect()
    places = {}
    for r in packed:
        places.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        if r.bin_id is not None:
            assert r.capacity in packing.LENGTHS and r["at"] + r.n_tokens <= r.capacity
    for i, t in pairs(fourth):
        n = 0
        for at, size in sorted(places[i]):
            assert at == n
            n += size
        assert n == len(re.findall(WORD, t or ""))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "MinHash near-dedup", "substring dedup", "best-fit packing"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).drop("bin_id").collect())) == Counter(map(tuple, spark.createDataFrame(packed, "bin_id long, capacity int, at int, doc_id long, piece int, first_token long, n_tokens int").drop("bin_id").collect()))


ODD = "id bigint, key bigint, key2 bigint, rep bigint, n int, at int, own int, runs string, stats double, score double, stage string, shard int, uid int, range int"


def odd_columns(frame):
    """Columns whose names the operators use inside."""
    for c in ODD.split(", "):
        name, kind = c.split()
        frame = frame.withColumn(name, F.lit(None).cast(kind))
    return frame


@pytest.mark.parametrize("stage", [f for _, f in stages.STAGES[:-1]])
def test_stages_on_empty_and_clashing_tables(spark, corpus, tmp_path, stage):
    docs, marks = corpus
    schema = "doc_id bigint, text string, lang string, source string, n_chars int"
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.createDataFrame(docs[:60], schema)
    wide = odd_columns(frame)
    plain, odd = stage(spark, frame, str(tmp_path)), stage(spark, wide, str(tmp_path))
    assert odd.columns == wide.columns
    assert {tuple(r)[:2] for r in plain.collect()} == {tuple(r)[:2] for r in odd.select(*frame.columns).collect()}
    assert stage(spark, frame.where("false"), str(tmp_path)).count() == 0


@pytest.mark.parametrize("operate", [lambda d: minhash.near_copies(d), lambda d: packing.pack(d).drop("bin_id"), lambda d: fingerprint.fingerprints(d), lambda d: quality.statistics(d), lambda d: d.select("doc_id", toxicity.score_column(toxicity.ToxicityModel(np.zeros(0, np.int32), np.zeros(0), 0.0), "text"))])
def test_extra_columns_change_nothing(spark, corpus, operate):
    frame = spark.createDataFrame([d[:2] for d in corpus[0][:30]], "doc_id bigint, text string")
    assert sorted(map(str, operate(frame).collect())) == sorted(map(str, operate(odd_columns(frame)).collect()))


def test_empty_tables_of_other_kinds(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert urls.judge(pages, [urls.Rule("net", "/", "block")]).count() == 0
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<double>, label int")
    assert embeddings.near_copies(vectors).count() == 0
    texts = spark.createDataFrame([], "doc_id bigint, text string")
    assert texts.select(sentencepiece.encode_both(sentencepiece.load(spark, PIECE_MODEL), "text")).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert len(toxicity.fit(texts, labels).index) == 0
    assert quality.fit(quality.statistics(texts), labels).score(np.zeros((1, quality.STATS)))[0] == 0.5


def test_odd_vectors(spark):
    rows = [(1, [], 0, "x"), (2, [1.0, 0.0], 0, "x"), (2, [1.0, 0.0], 0, "x"), (3, [1.0, 1e-3], 0, "x"), (4, [None, 1.0], 0, "x"), (5, [1.0, 0.0], 1, "x"), (6, [-0.0, 0.0], 0, "x")]
    got = embeddings.near_copies(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, rep string")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter([(1, 0, 1), (2, 2, 2), (2, 2, 2), (3, 2, 2), (4, 0, 4), (5, 0, 5), (6, 0, 6)])


def test_repeated_urls_and_a_common_host(spark):
    pages = [(k, f"http://many.com/{k % 3}", '<link rel="canonical" href="http://x.net/a">' if k == 0 else None, "h") for k in range(300)] + [(400 + k, None, None, "h") for k in range(100)]
    got = urls.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string, key string"), [urls.Rule("net", "/", "block")]).collect()
    assert len(got) == 400
    assert all((r.verdict == "block") == (r.page_id < 300 and r.page_id % 3 == 0) for r in got)


def test_more_anchors_than_cells(spark, monkeypatch):
    """Strings that occur once stay out of the runs when the sketch has fewer cells than anchors."""
    monkeypatch.setattr(windows, "MIN_BITS", 16)
    monkeypatch.setattr(windows, "MAX_BITS", 16)
    rng = random.Random(4)
    texts = [(k, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=6000))) for k in range(300)]
    same = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=400))
    texts += [(300, texts[0][1] + "0" + same + "1"), (301, "2" + same + "3" + texts[1][1][:2000])]
    total = sum(len(t) for _, t in texts)
    assert total * 2 / 27 > 1.8 * (1 << 16)
    held = []

    def written(df, name, write=shared.written):
        out = write(df, name)
        if name in ("runs", "segments"):
            held.append(out.agg(F.sum(F.octet_length("body"))).first()[0])
        return out

    monkeypatch.setattr(shared, "written", written)
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.n_removed for r in suffix.remove_repeats(frame).select("doc_id", "dedup.n_removed").collect()}
    assert {k: n for k, n in got.items() if n} == {300: 6000, 301: 2400}
    assert max(held) < 0.1 * total
    # Every anchor that occurs twice is among the bits, and few of the others.
    data, offsets = textnum.buffers(pa.array([t for _, t in texts]))
    p = windows.anchored(textnum.byte_values(data, 0), offsets, 50, 25)
    anchor, times = np.unique(p.anchor[windows.changes(p)], return_counts=True)
    bits = windows.repeated_anchors(frame.select("text"), suffix._split, 50, 25, 16)
    hit = windows.among_repeated(bits, anchor)
    assert hit[times > 1].all() and hit[times == 1].mean() < 0.01


def test_texts_longer_than_a_batch(spark):
    """Over 1 MiB: the pieces' seams, windows and strings across them."""
    rng = random.Random(9)
    words = [f"v{k}" for k in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(230_000))
    assert len(long) > textnum.CHUNK_BYTES
    tail = " ".join(long.split()[-400:])
    texts = [(1, long), (2, "before " + tail + " after"), (3, long), (4, "x" * 3000)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    n = len(long.split())
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(frame).select("doc_id", "dedup.*").collect()}
    assert got == {1: (n, 0), 2: (402, 400), 3: (n, n), 4: (1, 0)}
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix.remove_repeats(frame).select("doc_id", "dedup.*").collect()}
    assert got[1] == (len(long), 0) and got[3] == (len(long), len(long)) and got[4] == (3000, 0) and got[2][1] - len(tail) in (0, 1, 2)
    assert {r.doc_id: r.class_id for r in minhash.near_copies(frame).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    packed = packing.pack(frame).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {1: n, 2: 402, 3: n, 4: 1}
    model = sentencepiece.load(spark, PIECE_MODEL)
    coded = frame.select("doc_id", "text", sentencepiece.encode(model, "text").alias("ids")).withColumn("back", sentencepiece.decode(model, "ids"))
    assert coded.where("back <> text").count() == 0
    stats = {r.doc_id: r.stats for r in quality.statistics(frame).collect()}
    assert stats[1] == stats[3] and np.isclose(stats[1][1], np.log1p(n))
