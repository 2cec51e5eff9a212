"""Language models, language ID, sampled segmentations."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.llm import langid, lmscore, piecesample
from answerloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string"
EN, FR = "the quick brown fox jumps over the lazy dog and runs ", "le renard brun saute par dessus le chien paresseux "


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, (EN if k % 2 else FR) * (1 + k % 5) + str(k), "en" if k % 2 else "fr", "s") for k in range(120)]
    rows += [(200, None, "en", "s"), (201, "", None, "s"), (202, "123 !!", "fr", "s"), (None, EN, "en", "s"), (203, EN * 3000, None, "s"), (1, EN, "en", "s")]
    return spark.createDataFrame(rows, SCHEMA)


def test_language_id(docs, spark):
    model = langid.trained_model(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    for k in range(2, 120):
        assert by_id[k].lang_pred == ("en" if k % 2 else "fr") and 0.5 < by_id[k].score <= 1
    assert [by_id[k].lang_pred for k in (200, 201, 202, 203)] == ["und", "und", "und", "en"]
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("text is null or text in ('', '123 !!')").count() == 0


def test_held_out_rows_teach_nothing(docs):
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert langid.load_model(langid.trained_model(other)).languages == ["en", "fr"]


def test_language_id_without_labels(docs):
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    model = langid.trained_model(none)
    assert {r.lang_pred for r in langid.predict(none, model).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_copies_do_not_crowd_out_samples(spark, monkeypatch):
    rows = [(f"{text}{k if k < 150 else ''}", lang) for lang, text in (("en", EN), ("fr", FR)) for k in range(4000)] + [("una sola", "es")] * 2 + [("", "es")]
    seen = []
    monkeypatch.setattr(langid, "fit", lambda samples, df, n: seen.append(([s[0] for s in samples], df.max(), n)))
    langid.train(spark.createDataFrame(rows, "text string, lang string"), langid.work_dir(spark, "langid"), 300)
    assert collections.Counter(seen[0][0]) == {"en": 100, "fr": 100, "es": 1} and seen[0][1:] == (8002, 8003)


def test_ftrl_is_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    ftrl = langid.Ftrl(50, 2, l1=0.5)
    for _ in range(400):
        y = int(rng.integers(2))
        ftrl.step(np.array([y, 10 + int(rng.integers(40))]), np.array([1.0, 0.1]), y)
    w, _ = ftrl.weights()
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0] and (w[10:] == 0).mean() > 0.9
    logits = rng.normal(size=(500, 2)) * 3
    p = langid.softmax(logits / 2.0)
    y = (rng.random(500) < p[:, 1]).astype(int)
    assert langid.best_temperature(logits, y) == pytest.approx(2.0, rel=0.4)


def plain_fit(train, back, df, n_docs):
    """FTRL-proximal with elastic net in plain Python; train, back: (language, text)."""
    names = sorted({y for y, _ in train + back})
    k = len(names)
    idf = {b: math.log((1 + n_docs) / (1 + df[b])) + 1 for b in df}
    z, n = collections.defaultdict(lambda: [0.0] * k), collections.defaultdict(lambda: [0.0] * k)
    zb, nb = [0.0] * k, [0.0] * k

    def weight(zv, nv, l1, l2):
        return 0.0 if abs(zv) <= l1 else -(zv - math.copysign(l1, zv)) / ((langid.BETA + math.sqrt(nv)) / langid.ALPHA + l2)

    def features(text):
        count = collections.Counter(langid.ngram_buckets(text).tolist())
        total = sum(count.values())
        return {b: float(np.float32(c / total)) * idf[b] * langid.SCALE for b, c in count.items()}

    def logits(x):
        return [sum(v * weight(z[b][j], n[b][j], langid.L1, langid.L2) for b, v in x.items()) + weight(zb[j], nb[j], 0.0, 0.0) for j in range(k)]

    def probabilities(v):
        top = max(v)
        e = [math.exp(x - top) for x in v]
        return [x / sum(e) for x in e]

    for _ in range(langid.EPOCHS):
        for y, text in train:
            x = features(text)
            p = probabilities(logits(x))
            old = {b: [weight(z[b][j], n[b][j], langid.L1, langid.L2) for j in range(k)] for b in x}
            bias = [weight(zb[j], nb[j], 0.0, 0.0) for j in range(k)]
            for j in range(k):
                e = p[j] - (names[j] == y)
                for b, v in x.items():
                    g = v * e
                    z[b][j] += g - (math.sqrt(n[b][j] + g * g) - math.sqrt(n[b][j])) / langid.ALPHA * old[b][j]
                    n[b][j] += g * g
                zb[j] += e - (math.sqrt(nb[j] + e * e) - math.sqrt(nb[j])) / langid.ALPHA * bias[j]
                nb[j] += e * e
    return names, logits, features, probabilities


def test_model_is_that_of_plain_code(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(60):
        lang = ("en", "fr", "de")[k % 3]
        words = {"en": "the quick brown fox and dog", "fr": "le renard brun et le chien", "de": "der schnelle braune fuchs"}[lang].split()
        rows.append((k, " ".join(rng.choice(words, 6)) + f" {k}", lang))
    docs = spark.createDataFrame([(*r, "clash", 0.5, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string, score double, held_out string")
    path = langid.trained_model(docs)
    own = [(lang, text) for k, text, lang in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    model = langid.load_model(path)
    # the order of samples is that of a hash; it comes from the table itself
    from pyspark.sql import functions as F

    ranked = spark.createDataFrame(own, "lang string, text string").withColumn("rank", F.pmod(F.xxhash64("text", "lang"), F.lit(langid.RANKS))).orderBy("rank", "lang").collect()
    each = langid.SAMPLE // 3
    assert len(own) < each
    ordered = [(r.lang, r.text) for r in ranked]
    back = ordered[::5] if len(ordered) >= 50 else []
    train = [s for k, s in enumerate(ordered) if k % 5 or not back]
    df = collections.Counter(b for _, t in own for b in set(langid.ngram_buckets(t).tolist()))
    names, logits, features, probabilities = plain_fit(train, back, df, len(own))
    assert model.languages == names
    got = {r.doc_id: r for r in langid.predict(docs, path).collect()}
    for k, text, _ in rows[:20]:
        x = {b: v for b, v in features(text).items()} if set(langid.ngram_buckets(text).tolist()) <= set(df) else None
        if x is None:
            continue
        p = probabilities([v / model.temperature for v in logits(x)])
        assert got[k].lang_pred == names[p.index(max(p))] and got[k].score == pytest.approx(max(p), abs=2e-4)
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)


def test_ngram_buckets_count_every_ngram():
    def bucket(gram):
        key = 0
        for c in gram:
            key = (key << 21) | ord(c)
        return (((key + (len(gram) << 56)) * 0x9E3779B97F4A7C15) % 2**64) >> 48

    text = "Aé日😀 b"
    low = text.lower()
    want = collections.Counter(bucket(low[i : i + n]) for n in (1, 2, 3) for i in range(len(low) - n + 1))
    assert collections.Counter(langid.ngram_buckets(text).tolist()) == want


def test_rare_languages_beyond_the_bound_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    monkeypatch.setattr(langid, "SAMPLE_BUCKETS", 5)
    rows = [("some words of text" + str(k), "en") for k in range(9)] + [("quelques mots" + str(k), "fr") for k in range(5)] + [("ein wort", "de"), ("", "xx"), (None, "yy")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.train(df, langid.work_dir(spark, "few"))
    assert model.languages == ["en", "fr"]


def test_word_hashes_depend_on_the_word_only():
    h = lmscore.word_hashes(b" the cat  the\ndog the")
    assert len(h) == 5 and h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
    assert len(lmscore.word_hashes(b" \t ")) == 0


def plain_scores(rows, good, vocabulary):
    """rows: (doc_id, text); the mean losses of each by plain counters, its own text left out."""
    words, pairs = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for doc_id, text in rows:
        w = (text or "").lower().split()
        for k in (0, 1) if doc_id in good else (1,):
            words[k].update(w)
            pairs[k].update(zip(w, w[1:]))
    out = []
    for doc_id, text in rows:
        w, means = (text or "").lower().split(), []
        for k in (0, 1):
            mine = doc_id in good or k == 1
            word = words[k] - (collections.Counter(w) if mine else collections.Counter())
            pair = pairs[k] - (collections.Counter(zip(w, w[1:])) if mine else collections.Counter())
            total, loss = sum(word.values()), []
            for i, x in enumerate(w):
                single = (1 - lmscore.UNIFORM_WEIGHT) * (word[x] / total if total else 1 / vocabulary) + lmscore.UNIFORM_WEIGHT / vocabulary
                context = word[w[i - 1]] if i else 0
                p = lmscore.PAIR_WEIGHT * pair[w[i - 1], x] / context + (1 - lmscore.PAIR_WEIGHT) * single if context else single
                loss.append(-math.log(p))
            means.append(sum(loss) / len(loss) if loss else 0.0)
        out.append((doc_id, len(w), means[0], means[1], means[0] - means[1]))
    return out


def test_scores_are_those_of_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "CHUNK", 300)
    monkeypatch.setattr(lmscore, "PART", 300)
    monkeypatch.setattr(lmscore, "WORDS", 16)
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 40)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "alone Words here"), (103, rows[3][1]), (4, rows[4][1]), (None, "w1 w2 w1 w2")]
    good = {3, 4, 5, 6, 7, 102}
    labels = spark.createDataFrame([(k, 1, 0, "x") for k in good] + [(None, 1, 0, "x"), (9, 1, 1, "x"), (4, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, is_target string")
    n_words = len({w for _, t in rows for w in (t or "").lower().split()})
    for broadcast in (200_000, 0):
        monkeypatch.setattr(lmscore, "BROADCAST_IDS", broadcast)
        got = sorted(map(tuple, lmscore.cross_entropy_difference(docs.repartition(3), labels).collect()), key=str)
        want = sorted(plain_scores(rows, good, n_words), key=str)
        assert len(got) == len(want)
        for a, b in zip(sorted(got, key=lambda r: (str(r[0]), r[1], round(r[4], 9))), sorted(want, key=lambda r: (str(r[0]), r[1], round(r[4], 9)))):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9, abs=1e-12)


def test_models_score_unseen_texts(spark):
    texts = [("a b a b c", True), ("b b a", False), (None, False), ("", True), ("c c c c a", False)]
    model = lmscore.load_model(lmscore.train(spark.createDataFrame(texts, "text string, is_target boolean"), lmscore.work_dir(spark, "lm")))
    assert model.totals == (5.0, 13.0) and model.vocabulary == lmscore.WORDS
    target, background = model.losses("a b")
    u, v = lmscore.UNIFORM_WEIGHT, lmscore.WORDS
    single = (1 - u) * 2 / 5 + u / v
    assert target.tolist() == pytest.approx([-math.log(single), -math.log(lmscore.PAIR_WEIGHT * 1.0 + (1 - lmscore.PAIR_WEIGHT) * single)])
    assert len(background) == 2 and model.losses(None)[0].tolist() == []


def test_no_ngrams_share_a_count(spark, monkeypatch):
    words = [f"w{k}" for k in range(300_000)]  # more than 2 ** 18 words, and as many pairs
    rows = [(k, " ".join(words[k * 1000 : (k + 1) * 1000])) for k in range(300)] + [(None, None), (1000, "w0 w1 w0 w1"), (1001, "w5 w3"), (1001, "w5 w3")]
    labels = spark.createDataFrame([(1000, 1, 0)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(lmscore, "CHUNK", 1 << 18)
    monkeypatch.setattr(lmscore, "PART", 1 << 18)
    got = collections.defaultdict(list)
    for r in lmscore.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect():
        got[r.doc_id].append(r)
    assert collections.Counter(k for k, _ in rows) == {k: len(v) for k, v in got.items()}
    want = {k: (t, b) for k, _, t, b, _ in plain_scores([r for r in rows if r[0] in (1000, 1001)] + [(0, rows[0][1])], {1000}, 300_000)}
    # words that occur once in all are unseen without their own document
    assert got[7][0].n_tokens == 1000 and got[7][0].background_loss == pytest.approx(-math.log(lmscore.UNIFORM_WEIGHT / 300_000), rel=1e-12)
    assert got[1000][0].target_loss == pytest.approx(want[1000][0], rel=1e-12)
    assert got[0][0].target_loss == pytest.approx(want[0][0], rel=1e-12)


def test_target_like_documents_score_lower(docs, spark):
    labels = spark.createDataFrame([(k, 1 if k % 2 else 0, 0) for k in range(1, 60)] + [(61, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = lmscore.cross_entropy_difference(docs, labels).collect()
    assert len(got) == docs.count()
    score = {r.doc_id: r for r in got}
    assert np.mean([score[k].cross_entropy_difference for k in range(61, 120, 2)]) < np.mean([score[k].cross_entropy_difference for k in range(60, 120, 2)])
    assert (score[200].n_tokens, score[200].cross_entropy_difference) == (0, 0.0)
    assert lmscore.cross_entropy_difference(docs.limit(0), labels).count() == 0


@pytest.fixture(scope="module")
def sampler():
    return piecesample.PieceSampler(tokenizer_path("piece_bpe_32k.model"))


ODD = ["", "a", "  two  spaces ", "▁mark ▁", "日本語テキスト", "\n\n\t x", "😀é é", "a" * 300, "the end. the end."]


def test_segmentations_decode_to_the_text(sampler):
    data = [t.encode() for t in ODD]
    ids, n = sampler.sample(data, list(range(len(data))))
    ends = np.cumsum(n)
    assert [sampler.decode(ids[b - m : b]) for b, m in zip(ends.tolist(), n.tolist())] == data


def test_a_row_gives_the_same_pieces_in_any_batch(sampler):
    data = [f"some words about number {k} and others".encode() for k in range(20)]
    all_ids, n = sampler.sample(data, list(range(20)))
    ends = np.cumsum(n)
    for k in (0, 7, 19):
        own, _ = sampler.sample([data[k]], [k])
        assert own.tolist() == all_ids[ends[k] - n[k] : ends[k]].tolist()
    assert len({tuple(sampler.sample([data[0]], [k])[0].tolist()) for k in range(20)}) > 1


def test_samples_follow_the_lattice(sampler):
    word = b" then"
    vocab = {x: k for k, x in enumerate(sampler.text) if x and sampler.byte_id[x[0]] != k}
    weight = {}
    for r in range(len(word)):
        for c in itertools.combinations(range(1, len(word)), r):
            parts = [word[a:b] for a, b in zip((0, *c), (*c, len(word)))]
            if all(p in vocab for p in parts):
                weight[tuple(vocab[p] for p in parts)] = math.exp(sum(sampler.log_p[vocab[p]] for p in parts))
    n = 40_000
    ids, m = sampler.sample([word] * n, list(range(n)))
    ends = np.cumsum(m)
    seen = collections.Counter(tuple(ids[b - k : b].tolist()) for b, k in zip(ends.tolist(), m.tolist()))
    total = sum(weight.values())
    assert set(seen) <= set(weight) and max(abs(seen[k] / n - w / total) for k, w in weight.items()) < 0.01


def test_segmentation_query(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(50, None), (None, "x y"), (3, ODD[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = piecesample.segmentation_digests(df, tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    want = collections.Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in got) == want
    pieces = piecesample.sampled_pieces(df.where("doc_id = 3"), tokenizer_path("piece_bpe_32k.model")).collect()
    assert pieces[0].pieces == pieces[1].pieces


def test_texts_whose_hashes_collide_stay_apart(sampler):
    """Two strings after the Thue-Morse sequence and its complement: any polynomial hash modulo 2 ** 64 takes them for one."""
    bits = [bin(k).count("1") & 1 for k in range(4096)]
    data = [bytes(97 + (b ^ flip) for b in bits) for flip in (0, 1)] + [b"x" * 20_000 + "日本語".encode() * 2_000]
    ids, n = sampler.sample(data, [1, 2, 3])
    ends = np.cumsum(n)
    assert [sampler.decode(ids[b - m : b]) for b, m in zip(ends.tolist(), n.tolist())] == data


def test_segmentation_of_nothing_and_with_clashing_columns(spark):
    model = tokenizer_path("piece_bpe_32k.model")
    schema = "doc_id long, text string, pieces string, n_pieces int, lossless string"
    assert piecesample.segmentation_digests(spark.createDataFrame([], schema), model).count() == 0
    row = piecesample.segmentation_digests(spark.createDataFrame([(1, "a b", "x", 7, "y")], schema), model).first()
    assert row.lossless is True and row.n_bytes == 3
