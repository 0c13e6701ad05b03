"""Language ID, quality, toxicity and sharding against plain versions, and on held-out rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from wattframe.llm import kdshards, kneserney, langid, toxicity
from wattframe.llm.text import text_buffers


def plain_viterbi(scores, penalty):
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        step = best[None, :] - penalty * (1 - np.eye(len(best)))
        back.append(step.argmax(1))
        best = step.max(1) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return best.max(), path[::-1]


def value(scores, path, penalty):
    return sum(scores[t, p] for t, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:], strict=False))


@pytest.mark.parametrize("spread", [0.5, 3, 20])
def test_best_path_is_optimal(spread):
    rng = np.random.default_rng(int(spread * 2))
    sizes = [*rng.integers(0, 60, 30).tolist(), 1, 0, 400]
    splits = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(0, spread, (splits[-1], 4)).astype(np.float32)
    path = langid.best_path(scores, splits, 3.0)
    for a, b in zip(splits[:-1], splits[1:], strict=True):
        if b > a:
            best, _ = plain_viterbi(scores[a:b].astype(float), 3.0)
            assert value(scores[a:b].astype(float), path[a:b].tolist(), 3.0) == pytest.approx(best, abs=1e-3)


def spoken(rng, lang, n):
    parts = {"en": ["the", "wh", "ing", "ed", "sh"], "de": ["sch", "ung", "ein", "ä", "ch"], "ru": ["пр", "ст", "ов", "ни", "е"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken_docs(spark):
    rng = random.Random(3)
    rows = []
    for k in range(600):
        lang = rng.choice(["en", "de", "ru"])
        rows.append((k, spoken(rng, lang, rng.randint(5, 60)), lang, "s"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_languages_of_held_out_rows_and_spans(spark, spoken_docs):
    got = langid.identify(spoken_docs).join(spoken_docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 60 and {r.doc_id for r in held} == {k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    rng = random.Random(9)
    mixed = spoken(rng, "en", 30) + " " + spoken(rng, "ru", 20) + ". " + spoken(rng, "de", 10)
    model = langid.learn(spoken_docs)
    row = langid.label(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model, spans=True).first()
    assert [s.lang for s in row.lang_spans] == ["en", "ru", "de"] and row.lang_pred == "ru"
    assert mixed.encode()[row.lang_spans[1].start:row.lang_spans[1].end].decode().split()[0] in mixed.split()[29:32]


def test_languages_of_awkward_rows(spark, awkward, nothing):
    got = langid.identify(awkward).collect()
    und = {str(r.doc_id) for r in got if r.lang_pred == "und"}
    assert len(got) == awkward.count() and {"3", "4", "5", "8"} <= und and not und & {"1", "7", "9", "10", "11", "12"}
    labeled = langid.label(awkward, langid.learn(awkward))
    assert set(labeled.columns) == set(awkward.columns) and labeled.count() == len(got)
    assert langid.identify(nothing).count() == 0
    signs = spark.createDataFrame([(1, "€ – —"), (2, "é")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.label(signs, langid.learn(awkward)).collect()}[1] == "und"


def plain_counts(texts):
    out = defaultdict(int)
    for t in texts:
        for g in kneserney.grams(*text_buffers(pa.array([t]))).tolist():
            out[g] += 1
    return out


def test_probabilities_sum_to_one_and_follow_the_definition(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aabbbc d") for _ in range(rng.randint(1, 60))) for _ in range(80)]
    counts = plain_counts(texts)
    base = 1 << kneserney.BITS
    contexts = {g >> kneserney.BITS for g in counts}
    rows = [(c * base + w, counts.get(c * base + w, 0)) for c in contexts for w in range(base)]
    p = {r.gram: np.exp(r.logp) for r in kneserney.probabilities(spark.createDataFrame(rows, "gram long, n long")).collect()}
    assert len(p) == len(rows)
    for c in contexts:
        assert sum(p[c * base + w] for w in range(base)) == pytest.approx(1, abs=1e-9)

    seen = {kneserney.ORDER: dict(counts)}
    for order in range(kneserney.ORDER - 1, 0, -1):
        seen[order] = defaultdict(int)
        for g in seen[order + 1]:
            seen[order][g % base**order] += 1

    def plain(g, order):
        if order == 0:
            return 1 / base
        own = seen[order]
        t = [sum(n == k for n in own.values()) for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.5
        d = [min(k, max(0.05, k - (k + 1) * y * t[k] / t[k - 1])) if t[k - 1] else 0.5 for k in (1, 2, 3)]
        same = [n for h, n in own.items() if h // base == g // base]
        below = plain(g % base ** (order - 1), order - 1)
        if not same:
            return below
        n = own.get(g, 0)
        return max(0, n - (d[min(n, 3) - 1] if n else 0)) / sum(same) + sum(d[min(n, 3) - 1] for n in same) / sum(same) * below

    for g in rng.sample(sorted(p), 60):
        assert p[g] == pytest.approx(plain(g, kneserney.ORDER), rel=1e-9)


def test_quality_tells_noise_from_text(spark, spoken_docs, monkeypatch):
    monkeypatch.setattr(kneserney, "CHUNK_BYTES", 5_000)
    rng = random.Random(8)
    noise = [(1000 + k, "".join(rng.choice("#|%$xq09&") for _ in range(200)), "en", "s") for k in range(50)]
    docs = spoken_docs.union(spark.createDataFrame(noise, spoken_docs.schema)).repartition(3)
    got = kneserney.quality(docs, spoken_docs.where("doc_id < 400")).collect()
    assert len(got) == 650 and not any(r.kept for r in got if r.doc_id >= 1000)
    assert np.mean([r.kept for r in got if r.doc_id < 1000]) > 0.97
    sizes = {r.doc_id: len(r.text.encode()) for r in docs.collect()}
    assert all(r.symbols == sizes[r.doc_id] for r in got)


def test_word_probabilities_follow_the_definition_and_fold_nothing(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "A", "12", "34", "é", "è", "b,", "don't"]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    docs = spark.createDataFrame([(t, k % 3 > 0) for k, t in enumerate(texts)] + [("", True), (None, True)], "text string, trusted boolean")
    counts = kneserney.count_grams(docs).collect()
    row, words = kneserney.word_grams(*text_buffers(pa.array([*texts, "", None])))
    assert len({int(w) for w in words[:, 2]}) == 12  # a A 12 34 é è b , don ' t and the end
    want = defaultdict(int)
    for r, g in zip(row.tolist(), words.tolist(), strict=True):
        want[tuple(g)] += r % 3 > 0
    assert {(r.w1, r.w2, r.w3): r.n for r in counts} == dict(want)
    hashes = spark.createDataFrame(words[:50].tolist(), "a long, b long, c long").selectExpr("xxhash64(a, b, c) AS h").collect()
    assert [r.h for r in hashes] == kneserney.gram_hash(words[:50]).tolist()

    seen = {3: {g: n for g, n in want.items() if n}}
    for order in (2, 1):
        seen[order] = defaultdict(int)
        for g in seen[order + 1]:
            seen[order][g[1:]] += 1

    def plain(g):
        if not g:
            return 1 / (len(seen[1]) + 1)
        own = seen[len(g)]
        t = [sum(n == k for n in own.values()) for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.5
        d = [min(k, max(0.05, k - (k + 1) * y * t[k] / t[k - 1])) if t[k - 1] else 0.5 for k in (1, 2, 3)]
        same, n = [m for h, m in own.items() if h[:-1] == g[:-1]], own.get(g, 0)
        if not same:
            return plain(g[1:])
        return (max(0, n - (d[min(n, 3) - 1] if n else 0)) + sum(d[min(m, 3) - 1] for m in same) * plain(g[1:])) / sum(same)

    got = {(r.w1, r.w2, r.w3): r.p for r in kneserney._interpolated(kneserney.count_grams(docs), kneserney.WORDS, None).collect()}
    assert got.keys() == want.keys()
    for g, p in got.items():
        assert p == pytest.approx(plain(g), rel=1e-9)
    found = kneserney.perplexities(docs.selectExpr("text", "'en' AS lang", "xxhash64(text) AS doc_id"), docs.selectExpr("1L AS doc_id").limit(0)).collect()
    assert sorted(r.words for r in found) == sorted(np.bincount(row, minlength=len(texts) + 2).tolist())


def test_shards_find_the_perplexities_of_the_joins(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "A", "12", "34", "é", "b,", "don't", "w%d" % rng.randint(0, 200)]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate([*texts, "", None, texts[0], "never seen"])], "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(3)
    sure = docs.where("doc_id % 3 > 0").select("doc_id")
    marked = docs.select("text", (F.col("doc_id") % 3 > 0).alias("trusted") & ~langid.held_out(F.col("doc_id")))
    model = kneserney._interpolated(kneserney.count_grams(marked.toDF("text", "trusted")), kneserney.WORDS, None).collect()
    logp = {(r.w1, r.w2, r.w3): np.log(r.p) for r in model}
    row, words = kneserney.word_grams(*text_buffers(pa.array(texts)))
    want = defaultdict(list)
    for k, g in zip(row.tolist(), words.tolist(), strict=True):
        want[k].append(logp[tuple(g)])
    # no codes but few, several branches of frequent words, small chunks and one or many shards change nothing
    for codes, branch, shard, chunk in ((250_000, 1 << 40, 1 << 40, 3 << 20), (3, 50, 500, 2_000), (10, 100, 2_000, 700)):
        for name, value in (("CODES", codes), ("BRANCH_TOKENS", branch), ("SHARD_BYTES", shard), ("CHUNK_BYTES", chunk)):
            monkeypatch.setattr(kneserney, name, value)
        got = {r.doc_id: r for r in kneserney.perplexities(docs, sure).collect()}
        assert len(got) == len(texts) + 4 and got[150].perplexity is None and got[151].perplexity is None and got[152].perplexity == got[0].perplexity
        for k, p in want.items():
            assert got[k].words == len(p) and got[k].perplexity == pytest.approx(np.exp(-np.mean(p)), rel=1e-8)


def test_passes_deal_each_gram_once_and_packed(spark, monkeypatch):
    monkeypatch.setattr(kneserney, "SHARD_BYTES", 50_000)
    rng = random.Random(10)
    texts = [" ".join("w%d" % int(rng.paretovariate(0.7)) for _ in range(rng.randint(100, 400))) for _ in range(400)]
    docs = spark.createDataFrame([(t, k % 4 == 0, b"%16d" % k) for k, t in enumerate(texts)], "text string, learn boolean, key binary").coalesce(1)
    codes = kneserney.survey(docs)
    grams = len(kneserney.word_grams(*text_buffers(pa.array(texts)))[0])
    size = F.octet_length("codes") + F.octet_length("rare1") + F.octet_length("rare2") + F.octet_length("rare3")
    passes = [kneserney.dealt_grams(docs, codes, part, 3).where("n > 0").agg(F.sum("n").alias("n"), F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows")).first() for part in range(3)]
    assert sum(p.n for p in passes) == grams and max(p.n for p in passes) < 0.7 * grams
    assert sum(p.rows for p in passes) < grams / 1000 and sum(p.bytes for p in passes) < 9 * grams  # a row of three words and a count has 24.6 bytes in the shuffle
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    kneserney.perplexities(docs.selectExpr("text", "'en' AS lang", "1L AS doc_id").limit(5), docs.selectExpr("1L AS doc_id").limit(1)).count()
    assert spark.conf.get(name) == before


def test_quality_of_awkward_rows(awkward, nothing):
    got = kneserney.quality(awkward, awkward.where("doc_id IN (1, 2, 10)").select("doc_id")).collect()
    assert len(got) == awkward.count()
    assert all(r.perplexity is None and not r.kept and r.symbols == 0 for r in got if r.doc_id in (3, 4))
    assert all(r.kept == (r.symbols > 0) for r in kneserney.quality(awkward, nothing).collect())
    assert kneserney.quality(nothing, awkward).count() == 0


def test_toxicity_of_held_out_rows(spark):
    rng = random.Random(11)
    rows = []
    for k in range(1500):
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(rng.randint(5, 80))]
        toxic = k % 3 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), rng.choice(["vile", "foul!", "Rotten"]))
        rows.append((k, " ".join(words), rng.choice(["en", "de"]), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    got = toxicity.toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic")).join(docs.select("doc_id", F_toxic(docs)), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1500 and np.mean([r.predicted == r.truth for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def F_toxic(docs):
    return docs["toxic"].alias("truth")


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (10, 0), (10, 0), (77, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.train(awkward, labels.where("toxic = 1")) is None
    assert {r.score for r in toxicity.toxicity(awkward, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(nothing, labels).count() == 0


def test_pooling_ignores_neighbours_in_the_batch():
    net = toxicity.Network.fresh(np.random.default_rng(0))
    texts = ["one two three four", "", "vile", "a b", "", "x " * 50]
    together = net.scores(*toxicity.word_rows(*text_buffers(pa.array(texts))))
    alone = [net.scores(*toxicity.word_rows(*text_buffers(pa.array([t]))))[0] for t in texts]
    assert together == pytest.approx(alone)


def check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values()) and set(by) <= set(range(shards))
    return {s: sum(r.size for r in own) for s, own in by.items()}


def test_shards_are_even_and_keep_small_groups(spark, monkeypatch):
    monkeypatch.setattr(kdshards, "SLOT_ROWS", 50)
    rng = random.Random(12)
    rows = [(k, "x" * rng.randint(0, 900) + str(k % 700), rng.choice(["a", "a", "a", "b", None]), rng.choice(["en", "de", None])) for k in range(4000)]
    rows += [(5000 + k, "one text that a third of all rows hold " * 5, "a", "en") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    got = kdshards.kd_shards(docs, shards=24).collect()
    sizes = check_shards(got, 24)
    assert len(got) == 6000 and len(sizes) == 24 and max(sizes.values()) < 1.05 * min(sizes.values())
    text = {r[0]: r[1] for r in rows}
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    where = defaultdict(set)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 24
    assert len(check_shards(kdshards.kd_shards(docs, target_bytes=400_000).collect(), 99)) == -(-sum(sizes.values()) // 400_000)


def plain_tree(rows, shards, wide=None, first=0):
    """doc_id to shard of rows (doc_id, size, text bits, values by dimension) with different texts: weighted medians along the widest dimension."""
    spans = [(min(r[3][d] for r in rows), max(r[3][d] for r in rows)) for d in range(len(rows[0][3]))] if rows else []
    wide = wide or spans
    if shards == 1 or not rows:
        return {r[0]: first for r in rows}
    dim = max(range(len(spans)), key=lambda d: (spans[d][1] - spans[d][0]) / ((wide[d][1] - wide[d][0]) or 1.0))
    low, high = spans[dim]
    scale = (2**kdshards.PLACE_BITS - 1) / (high - low) if high > low else 0.0
    groups = defaultdict(int)
    key = lambda r: (int((r[3][dim] - low) * scale // 1), r[2])
    for r in rows:
        groups[key(r)] += r[1]
    wanted, before = sum(r[1] for r in rows) * (shards // 2) / shards, 0
    for k in sorted(groups):
        if before + groups[k] > wanted:
            last, rest = k, wanted - before
            break
        before += groups[k]
    stays = groups[last] - rest < rest
    left = [r for r in rows if key(r) < last or stays and key(r) == last]
    right = [r for r in rows if key(r) > last or not stays and key(r) == last]
    return plain_tree(left, max(1, shards // 2), wide, first) | plain_tree(right, shards - shards // 2, wide, first + shards // 2)


@pytest.mark.parametrize("shards", [3, 4])
def test_shards_equal_a_plain_tree(spark, shards):
    rng = random.Random(13)
    rows = [(k * 3 % 4001, f"{k} " + "y" * rng.randint(0, 60), rng.choice(["alpha", "beta", "beta", "omega", None]), rng.choice(["en", "de", None])) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    number = lambda s: -1.0 if s is None else float(int(s.encode()[:6].hex().ljust(12, "0"), 16))
    plain = [(d, len(t) + 8, xxhash.xxh64(t.encode(), seed=42).intdigest() % 2**kdshards.TEXT_BITS, (number(s), float(d), number(x))) for d, t, s, x in rows]
    got = kdshards.kd_shards(docs, shards=shards, dimensions=("source", "doc_id", "lang")).collect()
    assert {r.doc_id: r.shard for r in got} == plain_tree(plain, shards)


def test_shards_of_awkward_rows(awkward, nothing):
    got = kdshards.kd_shards(awkward, shards=24).collect()
    check_shards(got, 24)
    assert len(got) == awkward.count() and {r.size for r in got if r.doc_id in (3, 4)} == {8} and {r.law for r in got} == {"bytes"}
    assert kdshards.kd_shards(nothing, shards=24).count() == 0


def test_long_labelled_rows_train_and_calibrate(spark):
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice(["stone", "river", "cloud", "wind"]) for _ in range(2602)) + (" vileword" if k % 2 else " kindword"), "en", k % 2) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    got = toxicity.toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic")).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) >= 76


def test_sample_is_bounded_by_words(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 60)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda words, toxic: seen.append((sum(map(len, words)), set(toxic))) or toxicity.Network.fresh(np.random.default_rng(0)))
    rows = [(k, "vile " * 3 if k % 2 else "kind " * 3, "en", k % 2) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    assert toxicity.train(docs, docs.select("doc_id", "toxic")) is not None
    assert seen == [(60, {0.0, 1.0})]


def test_network_equals_plain_windows_and_its_gradient_is_right():
    rng = np.random.default_rng(12)
    net = toxicity.Network.fresh(rng)
    texts = ["alpha beta gamma delta", "one", "", "beta beta gamma alpha one two three"]
    words, splits = toxicity.word_rows(*text_buffers(pa.array(texts)))
    logits, pooled, _, _ = net.forward(words, splits)
    for t in range(len(texts)):
        own = words[splits[t]:splits[t + 1]]
        vectors = [net.table[a] + net.table[b] for a, b in own] + [np.zeros(toxicity.DIMS, np.float32)] * toxicity.PAD
        want = []
        for width, kernel, bias in zip(toxicity.WIDTHS, net.filters, net.biases, strict=True):
            responses = [np.concatenate(vectors[i:i + width]) @ kernel for i in range(max(len(own), 1))]
            want.append(np.maximum(np.max(responses, axis=0) + bias, 0))
        assert np.allclose(pooled[t], np.concatenate(want), atol=1e-5)
        assert logits[t] == pytest.approx(float(np.concatenate(want) @ net.weights + net.bias), abs=1e-5)
    # a first step of size RATE goes against the sign of the numeric gradient of the weighted loss
    small = [words[splits[t]:splits[t + 1]] for t in (0, 3)]
    truth = np.array([1.0, 0.0], np.float32)

    def loss(net):
        z = net.forward(np.concatenate(small), np.array([0, len(small[0]), len(small[0]) + len(small[1])]))[0].astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-z * (2 * truth - 1)))))

    before, after = toxicity.Network.fresh(np.random.default_rng(7)), toxicity.fit(small, truth, epochs=1)
    for k in range(len(before.filters)):
        moved = np.argwhere(np.abs(after.filters[k] - before.filters[k]) > 1e-3)
        for i, f in moved[:6]:
            kept = before.filters[k][i, f]
            slopes = []
            for change in (1e-2, -1e-2):
                before.filters[k][i, f] = kept + change
                slopes.append(loss(before))
            before.filters[k][i, f] = kept
            slope = (slopes[0] - slopes[1]) / 2e-2
            assert abs(slope) < 1e-4 or np.sign(slope) == -np.sign(after.filters[k][i, f] - kept)


def test_every_labelled_row_trains_and_calibrates(spark, monkeypatch):
    rng = random.Random(5)
    plain = ["stone", "river", "cloud", "wind"]
    rows = [(k, " ".join([*rng.choices(plain, k=20), "foul" if k % 2 else "fair"]), "en", k % 2) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 1)  # bounds of the sampled form don't touch it
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 1)
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 30)
    monkeypatch.setattr(toxicity, "LEARNER_BYTES", 30_000)  # several learners
    seen, deals = [], []
    inner, cuts = toxicity.epoch, toxicity.best_cuts
    monkeypatch.setattr(toxicity, "epoch", lambda rows, *a: (seen.append(rows.count()), deals.append(rows.rdd.getNumPartitions()), inner(rows, *a))[-1])
    monkeypatch.setattr(toxicity, "best_cuts", lambda rows: (seen.append(rows.where("lang = '*'").count()), cuts(rows))[-1])
    got = toxicity.toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic")).collect()
    known = sum(not r.held_out for r in got)
    assert seen[0] + seen[-1] == known and len(set(seen[:-1])) == 1 and len(seen) == toxicity.EPOCHS + 1 and deals[0] >= 4
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    assert sorted(got) == sorted(toxicity.toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic")).collect())


def test_cuts_in_slices_equal_the_plain_cut(spark):
    rng = np.random.default_rng(3)
    rows = [(str(lang), round(float(x), places), int(rng.random() < 1 / (1 + np.exp(-3 * x)))) for lang, (n, places) in enumerate([(1, 3), (2, 3), (40, 1), (500, 2), (300, 6)]) for x in rng.normal(0, 1, n)]
    got = {r.lang: r for r in toxicity.best_cuts(spark.createDataFrame(rows, "lang string, logit double, toxic int")).collect()}
    assert len(got) == 5
    for lang, found in got.items():
        logits, truth = (np.array([r[k] for r in rows if r[0] == lang]) for k in (1, 2))
        wrong = lambda cut: int(((logits > cut) != (truth > 0)).sum())  # noqa: B023, E731
        assert found.cut == pytest.approx(toxicity.best_cut(logits, truth.astype(np.float32))) and wrong(found.cut) == wrong(toxicity.best_cut(logits, truth))
        assert (found.toxic, found.clean) == ((truth > 0).sum(), (truth <= 0).sum())
