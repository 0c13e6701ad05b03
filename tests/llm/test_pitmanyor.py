"""The Pitman-Yor scores against exact sums, a plain sampler and their base."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wattframe.llm import pitmanyor as py

SF_DIR = "/root/testdata/sf0.001"
PLAIN = "doc_id long, text string"


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def kept_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def plain_base(rows):
    """rows: (doc_id, text)."""
    counts = Counter(t for d, text in rows if not kept_out(d) for t in tokens(text))
    n, kinds = sum(counts.values()), len(counts)
    out = []
    for d, text in rows:
        own = tokens(text)
        out.append((d, kept_out(d), len(own), sum(t in counts for t in own), n, sum(math.log10((counts[t] + 1) / (n + kinds + 1)) for t in own)))
    return out


class PlainModel:
    """One restaurant object each for the root, a word and a pair of words; exact Gibbs moves, one customer at a time."""

    def __init__(self, kinds, d, strength=1.0):
        self.kinds, self.d, self.strength = kinds, d, strength
        self.tables = defaultdict(lambda: defaultdict(list))

    def p(self, context, w):
        here = self.tables.get(context, {})
        own = here.get(w, [])
        total, tables = sum(map(sum, here.values())), sum(map(len, here.values()))
        below = 1 / (self.kinds + 1) if context == () else self.p(context[1:], w)
        return (sum(own) - self.d * len(own) + (self.strength + self.d * tables) * below) / (self.strength + total)

    def add(self, context, w, rng):
        here = self.tables[context]
        below = 1 / (self.kinds + 1) if context == () else self.p(context[1:], w)
        weights = [n - self.d for n in here[w]] + [(self.strength + self.d * sum(map(len, here.values()))) * below]
        k = rng.choices(range(len(weights)), weights)[0]
        if k < len(here[w]):
            here[w][k] += 1
        else:
            here[w].append(1)
            if context != ():
                self.add(context[1:], w, rng)

    def remove(self, context, w, rng):
        own = self.tables[context][w]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            if context != ():
                self.remove(context[1:], w, rng)


def invented(rng, n):
    words = [f"w{k}" for k in range(30)]
    follow = {w: rng.sample(words, 3) for w in words}
    out = []
    for _ in range(n):
        text = [rng.choice(words)]
        while rng.random() > 0.06:
            text.append(rng.choice(follow[text[-1]]) if rng.random() < 0.8 else rng.choice(words))
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("d,fresh", [(0.7, 0.5), (0.3, 2.0), (0.9, 0.05)])
def test_seating_has_the_exact_mean_number_of_tables(d, fresh):
    rng = np.random.default_rng(5)
    weights = {1: 1.0}  # generalised Stirling numbers by tables
    for c in range(1, 13):
        if c > 1:
            weights = {t: (c - 1 - d * t) * weights.get(t, 0) + weights.get(t - 1, 0) for t in range(1, c + 1)}
        mass = {t: v * fresh ** t for t, v in weights.items()}
        want = sum(t * v for t, v in mass.items()) / sum(mass.values())
        got = py.seat(np.full(6000, c), np.full(6000, fresh), d, rng, reseats=12)
        assert got.min() >= 1 and got.max() <= c and abs(got.mean() - want) < 0.06
    some = np.array([0, 1, 64, 65, 500, 2])
    got = py.seat(some, np.full(6, fresh), d, rng)
    assert got[0] == 0 and got[1] == 1 and (got[2:] >= -(-some[2:] // py.ROOM)).all() and (got <= some).all()


def test_predictive_probabilities_add_up_to_one(spark):
    texts = invented(random.Random(6), 60)
    words = sorted({w for t in texts for w in t.split()} | {"unseen"})
    # each word after the pair "w1 w2", in rows that aren't learned from
    probes = [f"w1 w2 {w}" for w in words] + ["w1 w2"]
    rows = [(k, t, True) for k, t in enumerate(texts)] + [(1000 + k, t, False) for k, t in enumerate(probes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").coalesce(1)
    corpus = py.survey(docs)
    corpus.shards = 1
    shard = py.Shard(py.dealt_tokens(docs, corpus).where("n > 0").toArrow(), corpus)
    root = np.random.default_rng(7).random(len(shard.words))
    mean = shard.sweep(root / root.sum(), np.random.default_rng(8), 4, 3)
    by_house = defaultdict(dict)
    for k, p in enumerate(mean):
        by_house[int(shard.house[k])][int(shard.word[shard.upper[k]])] = p
    full = [sum(p.values()) for p in by_house.values() if len(p) == len(shard.words)]
    assert full and all(abs(s - 1) < 1e-9 for s in full)


def test_scores_are_near_a_plain_sampler_and_above_the_base(spark):
    rng = random.Random(9)
    rows = list(enumerate(invented(rng, 400)))
    got = {r.doc_id: r for r in py.scores(spark.createDataFrame(rows, PLAIN)).collect()}
    learned = [tokens(t) for d, t in rows if not kept_out(d)]
    contexts = lambda own: [((("s", "s", *own)[k], ("s", "s", *own)[k + 1]), w) for k, w in enumerate(own)]
    model = PlainModel(len({w for own in learned for w in own}), 0.6)
    seats = [c for own in learned for c in contexts(own)]
    for c in seats:
        model.add(*c, rng)
    for _ in range(2):
        for c in seats:
            model.remove(*c, rng)
            model.add(*c, rng)
    ours = plain = base = n = 0
    for d, t in rows:
        if kept_out(d):
            own = tokens(t)
            ours, base, n = ours + got[d].score, base + got[d].base_score, n + len(own)
            plain += sum(math.log10(model.p(*c)) for c in contexts(own))
    assert abs(ours - plain) / n < 0.03 and ours > base + 0.2 * n


def test_counts_and_base_of_awkward_rows(spark, awkward, nothing):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in py.scores(awkward).collect()), key=repr)
    assert got == sorted(((*r[:-1], round(r[-1], 6)) for r in plain_base([(r.doc_id, r.text) for r in awkward.collect()])), key=repr)
    assert py.scores(nothing).count() == 0 and py.scores(nothing).columns == py.scores(awkward).columns
    out = [k for k in range(60) if kept_out(k)]
    alone = py.scores(spark.createDataFrame([(k, "nothing is learned") for k in out], PLAIN)).collect()
    assert len(alone) == len(out) and all(r.score == r.base_score == r.n_known == r.train_tokens == 0 and r.n_tokens == 4 for r in alone)


def test_documents_through_many_shards_and_chunks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    monkeypatch.setattr(py, "CHUNK_BYTES", 50_000)
    monkeypatch.setattr(py, "SHARD_TOKENS", 6_000)
    monkeypatch.setattr(py, "RESTAURANT", 500)
    first, again = ({r.doc_id: r for r in py.scores(docs).collect()} for _ in range(2))
    assert {d: r.score for d, r in first.items()} == pytest.approx({d: r.score for d, r in again.items()}, rel=1e-12)
    for d, out, n, known, total, base in plain_base([(r.doc_id, r.text) for r in docs.collect()]):
        r = first[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total) and r.base_score == pytest.approx(base, rel=1e-9)
    gain = [(r.score - r.base_score) / r.n_tokens for r in first.values() if r.held_out]
    assert np.mean(gain) > 0.1


def test_scores_do_not_depend_on_which_words_are_frequent(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(invented(random.Random(4), 150))), PLAIN).coalesce(1)
    common = {r.doc_id: r.score for r in py.scores(docs).collect()}
    monkeypatch.setattr(py, "FREQUENT", 1)  # no word has a code, so far words go as hashes, too
    assert {r.doc_id: r.score for r in py.scores(docs).collect()} == pytest.approx(common, rel=1e-6)


def test_hot_words_learn_from_all_documents(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(invented(random.Random(9), 400))), PLAIN).coalesce(2)
    whole = {r.doc_id: r for r in py.scores(docs).collect()}
    monkeypatch.setattr(py, "RESTAURANT", 40)  # every word is hot, and so are all pairs and triples
    monkeypatch.setattr(py, "SHARD_TOKENS", 1_000)
    split = {r.doc_id: r for r in py.scores(docs).collect()}
    for out in (True, False):
        own = [d for d, r in whole.items() if r.held_out == out]
        assert np.mean([abs(split[d].score - whole[d].score) / whole[d].n_tokens for d in own]) < 0.03  # sampling; parts by document: 0.07 and more


def test_parts_of_hot_words_add_up(spark, monkeypatch):
    monkeypatch.setattr(py, "RESTAURANT", 40)
    texts = [*invented(random.Random(6), 300), *["w1 w2 w1 w2 w1 w2"] * 60, "w3 " * 500]
    words = sorted({w for t in texts for w in t.split()} | {"unseen"})
    probes = [f"w1 w2 {w}" for w in words] + ["w1 w2"]
    docs = spark.createDataFrame([(k, t, True) for k, t in enumerate(texts)] + [(1000 + k, t, False) for k, t in enumerate(probes)], "doc_id long, text string, learn boolean").coalesce(1)
    corpus = py.survey(docs)
    corpus.shards = 7
    dealt = py.dealt_tokens(docs, corpus).toArrow()
    by = lambda rows, name, kinds: {k: rows.filter(py.pc.equal(rows.column(name), k)) for k in kinds}
    shards = {k: rows for k, rows in by(dealt, "shard", range(7)).items() if py.pc.sum(rows.column("n")).as_py()}
    sent = py.pa.concat_tables([py.first_round(rows, corpus) for rows in shards.values()])
    replies = py.pa.concat_tables([py.root_round(rows, corpus) for rows in by(sent, "range", range(7)).values() if rows.num_rows])
    totals = replies.filter(py.pc.equal(replies.column("shard"), -1)).to_pylist()
    everyone = {"range": -1, **{c: [sum(x) for x in zip(*(r[c] for r in totals), strict=True)] for c in ("all_guests", "all_taken")}}
    heard, sweep = [], py.Shard.sweep
    monkeypatch.setattr(py.Shard, "sweep", lambda shard, *a: heard.append((shard, mean := sweep(shard, *a))) or mean)
    for k, rows in shards.items():
        py.second_round(rows, py.pa.concat_tables([by(replies, "shard", [k])[k], py.pa.Table.from_pylist([everyone], schema=replies.schema)]), corpus)

    hashed = lambda w: {None: py.END, "^": py.START}.get(w) or py.text_tokens(*py.text_slices(py.pa.array([w])).__next__()[2:])[1][0]
    number = {w: int(np.flatnonzero(corpus.hot == hashed(w))[0]) for w in ("^", *words, None) if hashed(w) in corpus.hot}
    pairs, triples = Counter(), Counter()
    for t in texts:
        own = ["^", "^", *tokens(t)]
        for far, near, w in zip(own, own[1:], own[2:], strict=False):
            pairs[number.get(near), number.get(far)] += 1
            triples[number.get(near), number.get(far), number.get(w)] += 1
    kinds, several = len(corpus.hot), 0
    for shard, _ in heard:
        others = np.concatenate([shard.house_guests[shard.shared_houses], shard.type_guests[shard.shared_types]])
        several += np.count_nonzero(others)
        for key, own, other in zip(shard.keys.tolist(), shard.held[0], others, strict=True):
            (near, far), w = divmod(key // (kinds + 1), kinds), key % (kinds + 1)
            assert own + other == (pairs[near, far] if w == kinds else triples[near, far, w])
    assert several > 100 and max(triples.values()) > 400

    total = {}
    for shard, mean in heard:
        upper = shard.upper[shard.kind]
        for k in np.flatnonzero((shard.hot[upper] == number["w2"]) & (shard.docs >> 1 >= len(texts))):
            probe = (probes[(shard.docs[k] >> 1) - len(texts)].split() + [None])[2]
            if shard.words[shard.word[upper[k]]] == hashed(probe):
                total[probe] = mean[shard.kind[k]]
    assert len(total) == len(probes) and abs(sum(total.values()) - 1) < 0.02
