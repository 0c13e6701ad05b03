"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

Words are runs of letters and digits, and every other sign that isn't blank; nothing is folded: a word stands as 64 bits of its bytes.
Each text ends in a mark of its own.

N-grams of three words are dealt, packed by chunk of texts, to the shard of their middle word, so that counts, contexts and the continuation
counts of two words are a shard's own; a frequent middle word has several branches, dealt by the word before it, whose continuation counts are added
up and sent back. Trusted rows are dealt first: they give the discounts and the continuation counts of single words. Then all texts are read in
``PASSES`` passes, each of which deals and scores its part of the shards, so that never more than a part of the n-grams lies in the shuffle. Frequent words
have codes and their probabilities are sent to all; for other words a shard asks the table of words.

``count_grams``, ``_interpolated`` and ``probabilities`` state the same model as plain joins: tests hold the shards against them, no query uses them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm.langid import held_out
from wattframe.llm.pitmanyor import arrow, share, squeeze, unsqueeze
from wattframe.llm.text import PUNCTUATION, WHITESPACE, mix, span_hashes, text_slices, word_spans
from wattframe.session import cut_lineage

WORDS = ["w1", "w2", "w3"]
START, END = 1, 2
#: texts are read in chunks of so many bytes, or of one longer text
CHUNK_BYTES = 2 << 20
#: a threshold is the quantile of held-out trusted rows times the margin, and wider for short texts: times exp(SPREAD / sqrt(words))
QUANTILE, MARGIN, SPREAD = 0.98, 1.5, 3.0
#: up to so many trusted rows their ids are broadcast, beyond they are joined by a shuffle
BROADCAST_IDS = 1_000_000
#: at most so many words, the most frequent ones of so much text, have codes; the others go as hashes, with the same results
CODES, SAMPLE_BYTES = 250_000, 32 << 20
#: text of a shard on average, n-grams of one branch of a frequent word, and passes over the texts, each of which deals its part of the shards
SHARD_BYTES, BRANCH_TOKENS, PASSES = 20_000_000, 8_000_000, 3
#: so many n-grams at least are looked up at once
SCORED = 500_000
#: sums of logarithms are whole numbers of such parts, so that their order doesn't matter; texts have keys of so many bytes
PARTS, KEY_BYTES = 1 << 30, 16
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

#: the packed form of small alphabets, ORDER symbols of BITS in a number: the arithmetic is held against its definition in it
ORDER, BITS = 4, 6
_SIGNS = " abcdefghijklmnopqrstuvwxyz0.,;:!?'\"-()|#$%&*=/<>@_+"


def _alphabet() -> np.ndarray:
    table = np.full(256, 63, np.uint8)  # other signs and control characters
    for k, sign in enumerate(_SIGNS):
        table[ord(sign)] = table[ord(sign.upper())] = k
    table[48:58] = _SIGNS.index("0")
    table[9:14] = 0
    high = np.arange(128, 256)
    table[128:192] = len(_SIGNS) + high[:64] % 6
    table[192:256] = len(_SIGNS) + 6 + (high[64:] >> 4) % 4
    return table


_SYMBOL = _alphabet()


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte; what lies before a row's start is blank."""
    symbols = _SYMBOL[data].astype(np.int32)
    out = symbols.copy()
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for j in range(1, ORDER):
        out[j:] |= np.where(place[j:] >= j, symbols[:len(data) - j], 0) << (BITS * j)
    return out


def word_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, words): the row of each n-gram and its three words. A row has one n-gram for each word and one for its end; an empty row none."""
    begins, ends, _ = word_spans(data, offsets, PUNCTUATION)
    signs = np.flatnonzero(PUNCTUATION[data] & ~WHITESPACE[data])
    starts, ends = np.sort(np.concatenate([begins, signs])), np.sort(np.concatenate([ends, signs + 1]))
    own = np.searchsorted(offsets, starts, side="right") - 1
    full = np.flatnonzero(np.diff(offsets))
    words = np.concatenate([span_hashes(data, starts, ends).view(np.int64), np.full(len(full), END, np.int64)])
    row = np.concatenate([own, full])
    order = np.argsort(row, kind="stable")
    row, words = row[order], words[order]
    out = np.full((len(row), len(WORDS)), START, np.int64)
    out[:, -1] = words
    for j in range(1, len(WORDS)):
        same = np.flatnonzero(row[j:] == row[:-j])
        out[same + j, -1 - j] = words[same]
    return row, out


def gram_hash(words: np.ndarray) -> np.ndarray:
    """xxhash64 of the columns, as Spark has it."""
    p1, p2, p3, p4, p5 = (np.uint64(k) for k in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: x << np.uint64(k) | x >> np.uint64(64 - k)
    seed = np.full(len(words), 42, np.uint64)
    for column in words.T:
        h = seed + p5 + np.uint64(8) ^ turn(column.astype(np.uint64) * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        seed = h ^ h >> np.uint64(32)
    return seed.view(np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """w1, w2, w3, n for every n-gram of ``docs`` (text, trusted): n is how often it occurs in trusted rows, 0 if only in others."""

    limit = CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trusted = np.array(batch.column(1).to_pylist(), bool)
            for first, last, data, offsets in text_slices(batch.column(0), limit):
                row, words = word_grams(data, offsets)
                _, at, which = np.unique(gram_hash(words), return_index=True, return_inverse=True)
                n = np.bincount(which, trusted[first:last][row], minlength=len(at)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in words[at].T), pa.array(n)], names=[*WORDS, "n"])

    return docs.select("text", "trusted").mapInArrow(run, "w1 long, w2 long, w3 long, n long").groupBy(*WORDS).agg(F.sum("n").alias("n"))


def _interpolated(counts: DataFrame, words: list[str], uniform: float | None) -> DataFrame:
    """The columns ``words`` and p for every n-gram of ``counts`` (words, n).

    ``uniform`` is the probability below the order of one; if None, the words of trusted text and one that stands for all others share it.
    """
    level = {len(words): counts}
    for order in range(len(words) - 1, 0, -1):
        # how many different words stand before it in trusted text: the continuation count, 0 if it isn't seen
        level[order] = cut_lineage(level[order + 1].groupBy(*words[-order:]).agg(F.count_if(F.col("n") > 0).alias("n")))
    lower = None
    for order in range(1, len(words) + 1):
        rows, keys = level[order], words[-order:]
        seen = rows.where("n > 0")
        t = seen.agg(*[F.count_if(F.col("n") == k).alias(f"t{k}") for k in (1, 2, 3, 4)], F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).first()  # six numbers
        base = t.t1 / (t.t1 + 2 * t.t2) if t.t1 else 0.5
        discount = [min(k, max(0.05, k - (k + 1) * base * t[f"t{k + 1}"] / t[f"t{k}"])) if t[f"t{k}"] else 0.5 for k in (1, 2, 3)]
        cut = F.when(F.col("n") == 1, discount[0]).when(F.col("n") == 2, discount[1]).otherwise(discount[2])
        if order == 1:
            freed = discount[0] * t.t1 + discount[1] * t.t2 + discount[2] * (t.kinds - t.t1 - t.t2)
            rows = rows.select("*", F.lit(t.total).cast("double").alias("total"), F.lit(freed).alias("freed"), F.lit(uniform or 1.0 / (t.kinds + 1)).alias("below"))
        else:
            # saved, so that the join below deals both sides anew and can split a frequent context
            contexts = cut_lineage(seen.groupBy(*keys[:-1]).agg(F.sum("n").alias("total"), F.sum(cut).alias("freed")))
            rows = rows.join(contexts, keys[:-1], "left").join(lower.withColumnRenamed("p", "below"), keys[1:])
        own = F.coalesce(F.greatest(F.col("n") - cut, F.lit(0.0)) / F.col("total"), F.lit(0.0))
        lower = rows.select(*keys, (own + F.coalesce(F.col("freed") / F.col("total"), F.lit(1.0)) * F.col("below")).alias("p"))
        if order < len(words):
            lower = cut_lineage(lower)
    return lower


def probabilities(counts: DataFrame) -> DataFrame:
    """gram, logp for every packed n-gram of ``counts`` (gram, n), seen in trusted text or not. No trusted text leaves all symbols alike."""
    names = [f"s{k}" for k in range(ORDER)]
    split = [F.shiftright("gram", BITS * (ORDER - 1 - k)).bitwiseAND((1 << BITS) - 1).alias(c) for k, c in enumerate(names)]
    found = _interpolated(counts.select(*split, "n"), names, 1.0 / (1 << BITS))
    packed = sum(F.shiftleft(c, BITS * (ORDER - 1 - k)) for k, c in enumerate(names))
    return found.select(packed.alias("gram"), F.log("p").alias("logp"))


@dataclass
class Codes:
    """What every task knows: words that have codes (by code), in how many branches a word's contexts lie (one entry more, for words without codes), and the shards."""

    words: np.ndarray
    branches: np.ndarray
    shards: int

    def __post_init__(self):
        self.order = np.argsort(self.words).astype(np.int32)
        self.sorted = self.words[self.order]

    def __reduce__(self):
        return Codes, (self.words, self.branches, self.shards)

    def of(self, words: np.ndarray) -> np.ndarray:
        """The code of each word, ``len(self.words)`` if it has none."""
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.order[at], len(self.words))

    def shard(self, first: np.ndarray, near: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Where an n-gram lies: all that share the near word together, those of a frequent one together by the word before it."""
        place, branches = mix(near), self.branches[code]
        hot = np.flatnonzero(branches > 1)
        place[hot] = mix(place[hot] + mix(first[hot]) % branches[hot] * _SPREAD)
        return share(place, self.shards)

    def hot_shards(self) -> list[tuple[int, int]]:
        """(code, shard) of the words whose contexts lie in several branches."""
        found = []
        for code in np.flatnonzero(self.branches > 1).tolist():
            place = mix(mix(self.words[code:code + 1]) + np.arange(int(self.branches[code]), dtype=np.uint64) * _SPREAD)
            found += [(code, s) for s in np.unique(share(place, self.shards)).tolist()]
        return found


def survey(docs: DataFrame) -> Codes:
    """Codes for the most frequent words of some ``SAMPLE_BYTES`` of text, drawn by hash. Which words have codes, and how many branches, changes no result."""
    limit = CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0), limit):
                kinds, n = np.unique(word_grams(data, offsets)[1][:, -1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], names=["word", "n"])

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share_of = min(1.0, SAMPLE_BYTES / max(size, 1))
    drawn = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < math.ceil(share_of * (1 << 20)))
    often = drawn.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(CODES).toArrow()
    words = often.column("word").to_numpy().view(np.uint64)
    number = np.concatenate([[0.0, 0.0], (often.column("n").to_numpy() / share_of)[words > END]])
    words = np.concatenate([np.array([START, END], np.uint64), words[words > END]])
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Codes(words, np.append(np.maximum(1, -(-number // BRANCH_TOKENS)), 1).astype(np.uint64), max(min(partitions, 1 + size // 500_000), -(-size // SHARD_BYTES)))


def planes(*columns: np.ndarray, width: int = 4) -> bytes:
    """Whole numbers, byte by byte of their places, squeezed."""
    return squeeze(np.concatenate([c.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.ravel() for c in columns]))


def unplanes(data: bytes, columns: int, n: int, width: int = 4) -> list[np.ndarray]:
    whole = unsqueeze(data, columns * width * n, np.uint8).reshape(columns, width, n)
    return [np.ascontiguousarray(c.T).view(f"<u{width}").ravel() for c in whole]


def _delta(codes: np.ndarray) -> np.ndarray:
    return np.diff(codes, prepend=0).astype(np.int32).view(np.uint32)


def dealt_grams(docs: DataFrame, codes: Codes, part: int = 0, parts: int = 1, scored: bool = True) -> DataFrame:
    """The n-grams of ``docs`` (text, learn, key) whose shard has the remainder ``part`` by ``parts``: one row for each chunk of texts and shard.

    Its n-grams lie in order of the codes of the near word and the first one; words without codes follow as hashes. If ``scored``, each n-gram
    has twice its text's place in the chunk, plus one if it is learned from, and each chunk also has a row with the keys and the number of words of its texts, and no n-grams.
    """
    limit, rare = CHUNK_BYTES, len(codes.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            learns = batch.column(1).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in text_slices(batch.column(0), limit):
                row, words = word_grams(data, offsets)
                c3 = codes.of(np.ascontiguousarray(words[:, 2]).view(np.uint64))
                c1, c2 = np.zeros_like(c3), np.zeros_like(c3)  # the code of START
                for back, before in ((1, c2), (2, c1)):
                    same = np.flatnonzero(row[back:] == row[:-back]) + back
                    before[same] = c3[same - back]
                shard = codes.shard(words[:, 0].view(np.uint64), words[:, 1].view(np.uint64), c2)
                own = np.flatnonzero(shard % parts == part)
                order = own[np.argsort(shard[own] << 40 | c2[own].astype(np.int64) << 20 | c1[own])]
                words, c1, c2, c3, shard = words[order], c1[order], c2[order], c3[order], shard[order]
                place = 2 * row[order] + learns[first:last][row[order]]
                cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)).tolist() if len(shard) else [0]
                out = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    held = [planes(_delta(c2[a:b]), _delta(c1[a:b]), c3[a:b], *[place[a:b]] * scored)]
                    held += [words[a:b, k][c[a:b] == rare].tobytes() for k, c in enumerate((c1, c2, c3))]
                    out.append((chunk, int(shard[a]), b - a, *held))
                if scored:
                    keys = b"".join(batch.column(2).slice(first, last - first).to_pylist())
                    at = chunk % -(-codes.shards // parts) * parts + part
                    out.append((chunk, at if at < codes.shards else part, 0, planes(np.bincount(row, minlength=last - first), width=8), keys, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _DEALT, strict=True)] if out else [pa.array([], t) for _, t in _DEALT],
                                                 names=[n for n, _ in _DEALT])
                chunk += 1

    return docs.select("text", "learn", "key").mapInArrow(run, "chunk long, shard int, n int, codes binary, rare1 binary, rare2 binary, rare3 binary").repartition(codes.shards, "shard")


_DEALT = [("chunk", pa.int64()), ("shard", pa.int32()), ("n", pa.int32()), ("codes", pa.binary()), ("rare1", pa.binary()), ("rare2", pa.binary()), ("rare3", pa.binary())]


def _hashes(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint64)


class Shard:
    """Counts of the trusted n-grams of a shard, and their contexts. A word's number is its code, or follows the codes in order of hashes."""

    def __init__(self, messages: list[dict], codes: Codes, hot: list[tuple] = (), scored: bool = True):
        self.scored, self.rare = scored, len(codes.words)
        coded, rare = [np.zeros((3, 0), np.int32)], [[np.zeros(0, np.uint64)] * 3]
        for m in messages:
            c, hashes, place = self.decoded(m)
            if scored:
                learn = (place & 1) == 1
                c, hashes = c[:, learn], [h[learn[w == self.rare]] for w, h in zip(c, hashes, strict=True)]
            coded.append(c)
            rare.append(hashes)
        rare = [np.concatenate(h) for h in zip(*rare, strict=True)]
        self.hashes = np.unique(np.concatenate([*rare, *[words[~coded] for _, words, coded, _ in hot]]))
        self.none = self.rare + len(self.hashes)
        w1, w2, w3 = self.numbers(np.concatenate(coded, 1), rare)
        self.pairs, pair = np.unique(w2 << 32 | w1, return_inverse=True)
        self.grams, self.n3 = np.unique(pair << 32 | w3, return_counts=True)
        self.pair, last = self.grams >> 32, self.grams & 0xFFFFFFFF
        self.bigrams, self.n2 = np.unique(self.pairs[self.pair] >> 32 << 32 | last, return_counts=True)
        if hot:  # counts of all branches instead of the shard's own
            own = ~np.isin(self.bigrams >> 32, [near for near, *_ in hot])
            keys, n = [self.bigrams[own]], [self.n2[own]]
            for near, words, coded, count in hot:
                keys.append(near << 32 | np.where(coded, words.view(np.int64), self.number(words)))
                n.append(count)
            keys, n = np.concatenate(keys), np.concatenate(n)
            order = np.argsort(keys)
            self.bigrams, self.n2 = keys[order], n[order]

    def number(self, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, words)
        found = at < len(self.hashes)
        found[found] = self.hashes[at[found]] == words[found]
        return np.where(found, self.rare + at, self.none)

    def decoded(self, m: dict) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """The codes of the words in the n-grams of a message, the hashes of those without, and the texts' places."""
        c2, c1, c3, *place = unplanes(m["codes"], 3 + self.scored, m["n"])
        c = np.stack([np.cumsum(c1.view(np.int32), dtype=np.int32), np.cumsum(c2.view(np.int32), dtype=np.int32), c3.view(np.int32)])
        return c, [_hashes([m[k]]) for k in ("rare1", "rare2", "rare3")], place[0] if place else None

    def numbers(self, coded: np.ndarray, rare: list[np.ndarray]) -> np.ndarray:
        out = coded.astype(np.int64)
        for w, c, h in zip(out, coded, rare, strict=True):
            w[c == self.rare] = self.number(h)
        return out


_LAST = np.iinfo(np.int64).max


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the keys stand among ascending ones that end in ``_LAST``; the last place for those that don't."""
    at = np.searchsorted(keys, wanted)
    return np.where(keys[at] == wanted, at, len(keys) - 1)


def _histogram(n: np.ndarray) -> list[tuple[int, int]]:
    return [(k, int(c)) for k, c in enumerate(np.bincount(np.minimum(n, 5), minlength=6)) if c and k]


def trusted_counts(rows: pa.Table, codes: Codes) -> pa.Table:
    """near, word, coded, n: by order (near -3, -2), how many n-grams of a shard occur n = word times, 5 for more; how many different words stand before
    a word (near -1); and the same before it and behind the code ``near`` if that word's contexts lie in several shards. ``coded`` tells codes from hashes."""
    shard = Shard(rows.to_pylist(), codes, scored=False)
    near, last = shard.bigrams >> 32, shard.bigrams & 0xFFFFFFFF
    hot = codes.branches[np.minimum(near, shard.rare)] > 1
    table = np.concatenate([codes.words, shard.hashes]).view(np.int64)
    table[:shard.rare] = np.arange(shard.rare)
    words, n = np.unique(last[~hot], return_counts=True)
    few = [(-3, *h) for h in _histogram(shard.n3)] + [(-2, *h) for h in _histogram(shard.n2[~hot])]
    k, w, c = np.array(few, np.int64).reshape(-1, 3).T
    return pa.table({"near": np.concatenate([k, np.full(len(words), -1), near[hot]]), "word": np.concatenate([w, table[words], table[last[hot]]]),
                     "coded": np.concatenate([np.ones(len(k), bool), words < shard.rare, last[hot] < shard.rare]), "n": np.concatenate([c, n, shard.n2[hot]])})


@dataclass
class Level:
    """Modified Kneser-Ney discounts of an order, from how many n-grams occur once, twice, three and four times."""

    discounts: tuple[float, float, float]

    @classmethod
    def of(cls, times: dict[int, int]) -> Level:
        t = [times.get(k, 0) for k in range(5)]
        base = t[1] / (t[1] + 2 * t[2]) if t[1] else 0.5
        return cls(tuple(min(k, max(0.05, k - (k + 1) * base * t[k + 1] / t[k])) if t[k] else 0.5 for k in (1, 2, 3)))

    def cut(self, n: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.discounts])[np.minimum(n, 3)]

    def probability(self, n: np.ndarray, total: np.ndarray, freed: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Interpolated with the order below; a context that isn't seen leaves it as it is."""
        return np.where(total > 0, (n - np.minimum(self.cut(n), n) + freed * below) / np.maximum(total, 1), below)


@dataclass
class Model:
    """Discounts by order, total and freed mass of the order of one, and the probabilities of words with codes."""

    levels: list[Level]
    total: float
    freed: float
    kinds: int
    coded: np.ndarray

    def words(self, n: np.ndarray) -> np.ndarray:
        return self.levels[0].probability(n, np.full(len(n), self.total), np.full(len(n), self.freed), np.full(len(n), 1.0 / (self.kinds + 1)))


def asked_words(rows: pa.Table, codes: Codes) -> pa.Table:
    """The different last words without codes of a shard, by range of words."""
    words = np.unique(_hashes([w for w in rows.column("rare3").to_pylist() if w]))
    to = share(words, codes.shards)
    cuts = np.flatnonzero(np.diff(to, prepend=-1, append=-1)).tolist() if len(words) else [0]
    out = [(rows.column("shard")[0].as_py(), int(to[a]), b - a, planes(np.diff(words[a:b], prepend=np.uint64(0)), width=8), None) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return arrow(out, _ASKED)


_ASKED = [("shard", pa.int32()), ("range", pa.int32()), ("n", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())]
_ASKED_SQL = "shard int, range int, n int, words binary, counts binary"
_SUMS = [("chunk", pa.int64()), ("n", pa.int32()), ("docs", pa.binary()), ("sums", pa.binary())]


def answered(asked: pa.Table, words: pa.Table) -> pa.Table:
    """Continuation counts of the words that shards ask for, in their order."""
    if not asked.num_rows:
        return arrow([], _ASKED)
    known, n = words.column("word").to_numpy().view(np.uint64), words.column("n").to_numpy()
    order = np.argsort(known)
    known, n = np.append(known[order], np.uint64(0)), np.append(n[order], 0)
    out = []
    for r in asked.to_pylist():
        own = np.cumsum(unplanes(r["words"], 1, r["n"], 8)[0], dtype=np.uint64)
        at = np.minimum(np.searchsorted(known[:-1], own), len(known) - 1)
        out.append((r["shard"], r["range"], r["n"], None, planes(np.where(known[at] == own, n[at], 0))))
    return arrow(out, _ASKED)


def packed_near(rows: pa.Table) -> pa.Table:
    """The continuation counts behind one frequent word."""
    coded = rows.column("coded").to_numpy(zero_copy_only=False)
    return arrow([(-1, -1 - rows.column("near")[0].as_py(), rows.num_rows, rows.column("word").to_numpy().tobytes() + coded.tobytes(), planes(rows.column("n").to_numpy()))], _ASKED)


def scored_grams(rows: pa.Table, replies: pa.Table, codes: Codes, model: Model) -> pa.Table:
    """For each chunk of texts the sums of -log p of its n-grams in this shard, in parts of 2^-30; rows without n-grams go on."""
    rows = rows.to_pylist()
    out = [(r["chunk"], 0, r["rare1"], r["codes"]) for r in rows if not r["n"]]
    messages = [r for r in rows if r["n"]]
    if messages:
        replied = replies.sort_by("range").to_pylist()
        hot = []
        for r in (r for r in replied if r["range"] < 0):
            hot.append((-1 - r["range"], np.frombuffer(r["words"], np.uint64, r["n"]), np.frombuffer(r["words"], bool, r["n"], 8 * r["n"]), unplanes(r["counts"], 1, r["n"])[0].astype(np.int64)))
        asked = np.unique(_hashes([m["rare3"] for m in messages]))
        single = model.words(np.concatenate([np.zeros(0, np.int64), *[unplanes(r["counts"], 1, r["n"])[0] for r in replied if r["range"] >= 0]]).astype(np.int64))
        shard = Shard(messages, codes, hot)
        _, two, three = model.levels
        near, width = shard.bigrams >> 32, shard.none + 1
        total2, freed2 = np.bincount(near, shard.n2, width), np.bincount(near, two.cut(shard.n2), width)
        total3, freed3 = (np.append(np.bincount(shard.pair, v, len(shard.pairs)), 0) for v in (shard.n3, three.cut(shard.n3)))
        n2, n3 = np.append(shard.n2, 0), np.append(shard.n3, 0)
        bigrams, pairs, grams = (np.append(keys, _LAST) for keys in (shard.bigrams, shard.pairs, shard.grams))
        while messages:
            several, size = [], 0
            while messages and size < SCORED:
                several.append(messages.pop())
                size += several[-1]["n"]
            c, rare, place = zip(*[shard.decoded(m) for m in several], strict=True)
            c, rare = np.concatenate(c, 1), [np.concatenate(h) for h in zip(*rare, strict=True)]
            ends = np.cumsum([int(k.max() >> 1) + 1 for k in place])
            text = np.concatenate([(k >> 1).astype(np.int64) + e for k, e in zip(place, [0, *ends[:-1]], strict=True)])
            w1, w2, w3 = shard.numbers(c, rare)
            p = model.coded[np.minimum(c[2], shard.rare - 1)]
            p[c[2] == shard.rare] = single[np.searchsorted(asked, rare[2])]
            p = two.probability(n2[_find(bigrams, w2 << 32 | w3)], total2[w2], freed2[w2], p)
            pair = _find(pairs, w2 << 32 | w1)
            p = three.probability(n3[_find(grams, pair << 32 | w3)], total3[pair], freed3[pair], p)
            here, sums = np.bincount(text) > 0, np.bincount(text, np.rint(np.log(p) * -PARTS)).astype(np.int64)
            for m, a, b in zip(several, [0, *ends[:-1]], ends, strict=True):
                docs = np.flatnonzero(here[a:b])
                out.append((m["chunk"], len(docs), planes(np.diff(docs, prepend=0)), planes(sums[a:b][docs], width=8)))
    return arrow(out, _SUMS)


def text_sums(rows: pa.Table) -> pa.Table:
    """The texts of one chunk with the sums of all shards."""
    parts = rows.sort_by("n").to_pylist()
    keys = parts[0]["docs"]
    words = unplanes(parts[0]["sums"], 1, len(keys) // KEY_BYTES, 8)[0].astype(np.int64)
    total = np.zeros(len(words), np.int64)
    for r in parts[1:]:
        total[np.cumsum(unplanes(r["docs"], 1, r["n"])[0], dtype=np.int64)] += unplanes(r["sums"], 1, r["n"], 8)[0].astype(np.int64)
    return pa.table({"key": pa.array([keys[k:k + KEY_BYTES] for k in range(0, len(keys), KEY_BYTES)], pa.binary()), "words": words, "total": total})


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of jobs in here are dropped as soon as their result is saved."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_scores(docs: DataFrame) -> DataFrame:
    """key, words, total for every different text of ``docs`` (text, learn, key): its words and its end, and the sum of -log p in parts of 2^-30.

    Rows with ``learn`` train the model. The driver gets a probability for each word that has a code, and a few numbers.
    """
    spark, codes = docs.sparkSession, survey(docs)
    learned = dealt_grams(docs.where("learn"), codes, scored=False)
    rows = learned.groupBy("shard").applyInArrow(lambda t: trusted_counts(t, codes), "near long, word long, coded boolean, n long")
    counts = cut_lineage(rows.groupBy("near", "word", "coded").agg(F.sum("n").alias("n")))
    hot = counts.where("near >= 0")
    times = {-3: {}, -2: {}}
    for r in counts.where("near < -1").collect():  # at most ten rows
        times[r.near][r.word] = r.n
    for r in hot.groupBy(F.least("n", F.lit(5)).alias("k")).count().collect():  # at most five rows
        times[-2][r.k] = times[-2].get(r.k, 0) + r["count"]
    single = cut_lineage(counts.where("near = -1").select("word", "coded", "n").unionAll(hot.select("word", "coded", F.lit(1).cast("long").alias("n"))).groupBy("word", "coded").agg(F.sum("n").alias("n")))
    few = {r.k: r for r in single.groupBy(F.least("n", F.lit(5)).alias("k")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).collect()}  # at most five rows
    first = Level.of({k: r.kinds for k, r in few.items()})
    kinds, total = sum(r.kinds for r in few.values()), sum(r.total for r in few.values())
    model = Model([first, Level.of(times[-2]), Level.of(times[-3])], total, sum(r.kinds * float(first.cut(np.array(k))) for k, r in few.items()), kinds, np.zeros(0))
    known = single.where("coded").select("word", "n").toArrow()
    coded = np.zeros(len(codes.words), np.int64)
    coded[known.column("word").to_numpy()] = known.column("n").to_numpy()
    model.coded = model.words(coded)

    others = single.where("NOT coded").select("word", "n", F.shiftright(F.shiftrightunsigned("word", 32) * codes.shards, 32).cast("int").alias("range"))
    several = codes.hot_shards()
    if several:
        packed = cut_lineage(hot.groupBy("near").applyInArrow(packed_near, _ASKED_SQL))
    found, parts = [], min(PASSES, codes.shards)
    for part in range(parts):
        dealt = dealt_grams(docs, codes, part, parts).groupBy("shard")  # asked for twice in one query: the shuffle is made once and read twice
        asked = dealt.applyInArrow(lambda t: asked_words(t, codes), _ASKED_SQL)
        replies = asked.groupBy("range").cogroup(others.groupBy("range")).applyInArrow(answered, _ASKED_SQL)
        own = [(-1 - code, shard) for code, shard in several if shard % parts == part]
        if own:
            to = spark.createDataFrame(own, "range int, to int")
            replies = replies.unionAll(packed.join(F.broadcast(to), "range").select(F.col("to").alias("shard"), "range", "n", "words", "counts"))
        sums = dealt.cogroup(replies.groupBy("shard")).applyInArrow(lambda t, back: scored_grams(t, back, codes, model), "chunk long, n int, docs binary, sums binary")
        texts = sums.groupBy("chunk").applyInArrow(text_sums, "key binary, words long, total long")
        found.append(cut_lineage(texts.groupBy("key").agg(F.max("words").alias("words"), F.max("total").alias("total"))))  # equal texts have equal sums
    return cut_lineage(reduce(DataFrame.unionAll, found).groupBy("key").agg(F.max("words").alias("words"), F.sum("total").alias("total")))


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, trusted, symbols, words, perplexity of every row of ``docs`` (doc_id, text, lang).

    ``trusted`` holds the doc_id of trusted rows; those that aren't held out train the model. symbols are the bytes of a text, words its words
    and its end; the perplexity is by word. A null or empty text has none and a null perplexity.
    """
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    marked = docs.select("doc_id", "lang", "text").join(ids.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    marked = marked.withColumn("key", F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, KEY_BYTES))
    with _dropping_shuffles(docs.sparkSession):
        scores = text_scores(marked.select("text", (F.col("trusted") & ~held_out(F.col("doc_id"))).alias("learn"), "key"))
    rows = marked.select("key", F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "trusted", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("symbols"))
    met = rows.join(scores, "key", "left").withColumn("words", F.coalesce("words", F.lit(0)))
    return met.select("doc_id", "lang", "trusted", "symbols", "words", F.exp(F.col("total") / F.lit(float(PARTS)) / F.nullif(F.col("words"), F.lit(0))).alias("perplexity"))


def quality(docs: DataFrame, trusted: DataFrame, *, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, symbols, perplexity, threshold, kept of every row of ``docs`` (doc_id, text, lang).

    A language's threshold is ``margin`` times the ``quantile`` of perplexity of its held-out trusted rows, or of all languages' where it
    has none, and wider the fewer words a text has; without any trusted row all texts are kept. A row is kept up to its threshold. Null and empty texts have no
    perplexity and aren't kept. A null lang is a language of its own; repeated rows get equal results.
    """
    found = cut_lineage(perplexities(docs, trusted))
    sure = found.where(F.col("trusted") & held_out(F.col("doc_id")) & F.col("perplexity").isNotNull())
    cuts = sure.groupBy("lang").agg((F.percentile_approx("perplexity", quantile, 10_000) * margin).alias("own")).withColumnRenamed("lang", "_l")
    everywhere = sure.agg((F.percentile_approx("perplexity", quantile, 10_000) * margin).alias("p")).first().p  # one number
    cut = F.coalesce("own", F.lit(everywhere), F.lit(float("inf"))) * F.exp(SPREAD / F.sqrt(F.greatest("words", F.lit(1))))
    rows = found.join(cuts, F.col("lang").eqNullSafe(F.col("_l")), "left").withColumn("threshold", cut)
    return rows.select("doc_id", "lang", "symbols", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
