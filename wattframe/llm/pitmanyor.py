"""Language-model scores of texts by a hierarchical Pitman-Yor process over words.

Restaurants and their parents: the two words before a word, the one word before it, the root, and a uniform base over the words of training
text and one that stands for all others. There is one for each context, whatever its size.

Every token is dealt once, as part of a packed array, to the shard of its near word, where the restaurants of that word and of all pairs that
end in it lie together. A hot near word, with over ``RESTAURANT`` customers, is dealt to several shards by far word, with a hot far word by the word
itself, too, and with a hot word by place. So its own restaurant is seated by word, beside the root; of pairs of hot words, and of hot words after
them, each shard gets the customers and tables that the others have, so every probability comes from all customers of its context.

A sweep takes each restaurant's customers from bottom to top: they sit down one by one, are each taken up
and reseated ``RESEATS`` times (Gibbs), given the parent's predictive probabilities and the restaurant's number of tables of the sweep before, and each table sends one
customer to the parent. Customers of one word sit in rooms of ``ROOM``; a table lies in one room, so any number of customers takes bounded steps.
Shards send the tables of each word to the root, whose seating is sampled by word, and get its part of each word's probability back;
with it they sweep on, average the predictive probabilities of the last sweeps, and add their logarithms up by document.

Seats are sampled with seeds made of the shard, so a task that runs again gives the same result. Words stand as 64 bits of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.text import LOWER, WHITESPACE, mix, span_hashes, text_slices, word_spans
from wattframe.session import cut_lineage

#: at most so many words, the most frequent ones, have codes of two bytes; other words go as hashes, with the same results
FREQUENT = 50_000
#: customers of a near word, on average at most, that are dealt to one shard, and of one room
RESTAURANT, ROOM = 1_000_000, 64
#: tokens of one shard on average, and bytes of text in a chunk (or one longer text)
SHARD_TOKENS, CHUNK_BYTES = 2_000_000, 3 << 20
#: concentration of every restaurant, sweeps before the root is sampled, after it, and those of the latter that are averaged
STRENGTH, FIRST_SWEEPS, SWEEPS, AVERAGED = 1.0, 1, 3, 2
#: how often a customer is taken up and reseated in a sweep
RESEATS = 1
END = np.uint64(2)
START, START_CODE = mix(np.array([1], np.uint64))[0], 65535
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null doc_id is hashed as an empty text, and so learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def text_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of every token: a row's words with A-Z lowered, then END."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, WHITESPACE)
    rows = np.arange(len(offsets) - 1)
    row = np.repeat(rows, np.diff(first) + 1)
    words = np.full(len(row), END, np.uint64)
    last = first[1:] + rows
    inside = np.ones(len(row), bool)
    inside[last] = False
    words[inside] = span_hashes(data, starts, ends)
    return row, words


def word_counts(docs: DataFrame) -> DataFrame:
    """word, learned, n of ``docs`` (text, learn): how often a word occurs in rows that are learned from, and in all."""

    limit = CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in text_slices(batch.column(0), limit):
                row, words = text_tokens(data, offsets)
                kinds, which = np.unique(words, return_inverse=True)
                learned = np.bincount(which, learn[first:last][row], minlength=len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(learned), pa.array(np.bincount(which, minlength=len(kinds)))], names=["word", "learned", "n"])

    rows = docs.select("text", "learn").mapInArrow(run, "word long, learned long, n long")
    return rows.groupBy("word").agg(F.sum("learned").alias("learned"), F.sum("n").alias("n"))


def branched(near: np.ndarray, branch: np.ndarray) -> np.ndarray:
    """The hashes that branches of near words go by."""
    return np.where(branch > 0, mix(near + branch * _SPREAD), near)


@dataclass
class Corpus:
    """What every task knows: totals of the tokens and the frequent words (ascending) with the number of their branches."""

    learned: int
    kinds: int
    discount: float
    shards: int
    frequent: np.ndarray
    branches: np.ndarray  # by code, how many shards a near word is dealt to: 0 rare words, then the frequent ones, then the start of a text

    @property
    def hot(self) -> np.ndarray:
        """The words that have several branches; others stand for them by their number."""
        return np.concatenate([[np.uint64(0)], self.frequent, [START]])[self.branches > 1]

    def near_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """The hashes that branches of hot words go by (ascending), and the numbers of those words."""
        parts = self.branches[self.branches > 1].astype(np.int64)
        number = np.repeat(np.arange(len(parts)), parts)
        keys = branched(self.hot[number], (np.arange(len(number)) - np.repeat(np.cumsum(parts) - parts, parts)).astype(np.uint64))
        order = np.argsort(keys)
        return keys[order], number[order]


def discount(once: float, twice: float) -> float:
    """From how many types have one and two customers; 0.5 where none has."""
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once else 0.5


def survey(docs: DataFrame) -> Corpus | None:
    """The corpus of ``docs`` (text, learn), None without rows. The driver gets one row for each frequent word."""
    counts = cut_lineage(word_counts(docs))  # read several times
    t = counts.agg(F.sum("learned").alias("learned"), F.count_if(F.col("learned") > 0).alias("kinds"), F.sum("n").alias("n"),
                   F.count_if(F.col("learned") == 1).alias("once"), F.count_if(F.col("learned") == 2).alias("twice"))
    end = int(END)
    level = F.floor(F.log2("n") * 8)
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"))  # a few hundred rows
    coded = levels.withColumn("above", F.sum("words").over(Window.orderBy(F.desc("level")))).where(F.col("above") <= FREQUENT).agg(F.min("level")).scalar()
    often = counts.select("word", "n", t.select(F.struct(*t.columns)).scalar().alias("t"), F.coalesce(level >= coded, F.lit(False)).alias("coded")).where(
        F.col("coded") | (F.col("word") == end)).collect()
    if not often:
        return None
    totals, number = often[0].t, {r.word: r.n for r in often}
    words = np.sort(np.array([r.word for r in often if r.coded], np.int64).view(np.uint64))
    sizes = np.array([0, *[number[int(w)] for w in words.view(np.int64)], number[end]])
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Corpus(totals.learned, totals.kinds, discount(totals.once, totals.twice), max(min(partitions, 1 + totals.n // 100_000), -(-totals.n // SHARD_TOKENS)), words,
                  np.maximum(1, -(-sizes // RESTAURANT)).astype(np.uint64))


def ascending(keys: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit hashes: their upper bits are sorted with the places as lower bits, and the few runs that these leave open are ordered one by one."""
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    packed = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & low).view(np.int64)
    sorted_keys = keys[order]
    wrong = np.flatnonzero(sorted_keys[1:] < sorted_keys[:-1])
    if len(wrong):
        packed &= ~low
        ends = np.unique(packed[wrong])
        for a, b in zip(np.searchsorted(packed, ends).tolist(), np.searchsorted(packed, ends, side="right").tolist(), strict=True):
            order[a:b] = order[a:b][np.argsort(sorted_keys[a:b], kind="stable")]
    return order


def share(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of 64 bits a hash lies in: in the order of hashes."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def squeeze(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, n: int, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(pa.decompress(data, n * kind.itemsize, codec="zstd", asbytes=True), kind)


TOKENS = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("n", pa.int32()), ("n_near", pa.int32()), ("n_rare", pa.int32()), ("n_rare_far", pa.int32()), ("near", pa.binary()), ("runs", pa.binary()),
                    ("far", pa.binary()), ("codes", pa.binary()), ("rare", pa.binary()), ("rare_far", pa.binary()), ("docs", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
_TOKENS = ("chunk long, shard int, n int, n_near int, n_rare int, n_rare_far int, near binary, runs binary, far binary, codes binary, rare binary, rare_far binary, docs binary, "
           "ids array<long>, sizes array<long>")


def dealt_tokens(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """The tokens of ``docs`` (text, doc_id, learn) by shard: one row for each chunk of texts and shard, its tokens in order of the near word.

    A token is its near word (stated once a run), codes of the far word and the word itself (0: rare, then its hash is in ``rare_far`` or ``rare``) and twice its
    text's place in the chunk, plus one if it is learned from. Each chunk also has a row with the doc_ids and tokens of its texts, and no tokens.
    """

    limit = CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            learn = batch.column(2).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in text_slices(batch.column(0), limit):
                row, words = text_tokens(data, offsets)
                at = np.minimum(np.searchsorted(corpus.frequent, words), max(len(corpus.frequent) - 1, 0))
                codes = np.where(corpus.frequent[at] == words, at + 1, 0) if len(corpus.frequent) else np.zeros(len(words), np.int64)
                near, near_code = np.full(len(words), START, np.uint64), np.full(len(words), len(corpus.frequent) + 1)
                far, far_words = np.full(len(words), START_CODE, np.uint16), np.full(len(words), START, np.uint64)
                for back in (1, 2):
                    same = np.flatnonzero(row[back:] == row[:-back]) + back
                    if back == 1:
                        near[same], near_code[same] = words[same - 1], codes[same - 1]
                    else:
                        far[same], far_words[same] = codes[same - 2], words[same - 2]
                ids = batch.column(1).slice(first, last - first)
                hot = np.flatnonzero(corpus.branches[near_code] > 1)
                if len(hot):  # of a pair of hot words at most so many parts by word, and of one more hot word so many by place
                    parts = corpus.branches[near_code[hot]]
                    by_word = np.minimum(parts, corpus.branches[np.where(far[hot] == START_CODE, len(corpus.frequent) + 1, far[hot])])
                    by_place = np.minimum(by_word, corpus.branches[codes[hot]])
                    near[hot] = branched(near[hot], (mix(far_words[hot]) + mix(words[hot] + _SPREAD) % by_word + mix(hot.astype(np.uint64)) % by_place) % parts)
                order = ascending(near)
                near, far, codes, doc = near[order], far[order], codes[order].astype(np.uint16), (2 * row + learn[first:last][row])[order].astype(np.uint32)
                rare_words, rare_before = words[order][codes == 0], np.concatenate([[0], np.cumsum(codes == 0)])
                rare_fars, rare_fars_before = far_words[order][far == 0], np.concatenate([[0], np.cumsum(far == 0)])
                shard = share(near, corpus.shards)
                cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=corpus.shards))
                out = []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    starts = np.flatnonzero(np.concatenate([[True], near[a + 1:b] != near[a:b - 1]]))
                    rare = rare_words[rare_before[a]:rare_before[b]]
                    rare_far = rare_fars[rare_fars_before[a]:rare_fars_before[b]]
                    out.append((chunk, int(shard[a]), b - a, len(starts), len(rare), len(rare_far), squeeze(near[a:b][starts]), squeeze(np.diff(starts, append=b - a).astype(np.uint32)),
                                squeeze(far[a:b]), squeeze(codes[a:b]), squeeze(rare), squeeze(rare_far), squeeze(doc[a:b]), None, None))
                out.append((chunk, chunk % corpus.shards, 0, 0, 0, 0, *[None] * 7, ids.to_pylist(), np.bincount(row, minlength=last - first).tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), TOKENS, strict=True)], schema=TOKENS)
                chunk += 1

    return docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), "learn").mapInArrow(run, _TOKENS)


def seat(customers: np.ndarray, fresh: np.ndarray, d: float, rng: np.random.Generator, reseats: int = RESEATS) -> np.ndarray:
    """Tables of every type after its customers sat down and were each reseated ``reseats`` times; ``fresh`` is the weight of a new table, d the discount."""
    tables = (customers == 1).astype(np.int64)
    rooms = np.where(customers > 1, -(-customers // ROOM), 0)
    kind = np.repeat(np.arange(len(customers)), rooms)
    size = np.minimum(customers[kind] - (np.arange(len(kind)) - np.repeat(np.cumsum(rooms) - rooms, rooms)) * ROOM, ROOM)
    weight = fresh[kind]
    # one or two customers need no chain: they sit apart with this probability
    apart = (size == 2) & (rng.random(len(size)) * (weight + 1 - d) < weight)
    tables += np.bincount(kind, np.where(size <= 2, 1 + apart, 0), minlength=len(customers)).astype(np.int64)
    more = np.flatnonzero(size > 2)
    # rooms of alike sizes and weights together, as they need alike numbers of tables
    more = more[np.lexsort((weight[more], np.ceil(np.log2(size[more]))))]
    for lo in range(0, len(more), 1 << 15):
        own = more[lo:lo + (1 << 15)]
        own = own[np.argsort(-size[own], kind="stable")]
        tables += np.bincount(kind[own], _room_tables(size[own], weight[own].astype(np.float32), d, rng, reseats), minlength=len(customers)).astype(np.int64)
    return tables


def _room_tables(size: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator, reseats: int) -> np.ndarray:
    """Tables of rooms in order of falling size: customer j of all rooms at once."""
    width, rooms = 4, np.arange(len(size))
    sizes, chair = np.zeros((width, len(size)), np.float32), np.zeros((int(size[0]), len(size)), np.int8)  # by table and room, by customer and room
    tables, d = np.zeros(len(size), np.float32), np.float32(d)
    for again in range(reseats + 1):
        for j in range(int(size[0])):
            n = int(np.searchsorted(-size, -j, side="left"))  # rooms that have a customer j
            at, here, used, seated = rooms[:n], sizes[:, :n], tables[:n], np.float32(j)
            if again:
                here[chair[j, :n], at] -= 1
                used -= here[chair[j, :n], at] == 0
                seated = size[:n].astype(np.float32) - 1
            left = rng.random(n, np.float32) * (seated - d * used + weight[:n])
            chosen = np.zeros(n, np.int8)
            for row in here:
                left -= np.maximum(row - d, 0)
                chosen += left >= 0
            new = np.flatnonzero(chosen == width)
            if len(new):
                free = here[:, new] == 0
                slot = free.argmax(0)
                if (full := ~free.any(0)).any():
                    slot[full] = width
                    sizes, width = np.pad(sizes, ((0, width), (0, 0))), 2 * width
                    here = sizes[:, :n]
                chosen[new] = slot
                used[new] += 1
            chair[j, :n] = chosen
            here[chosen, at] += 1
    return tables


def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of ``wanted`` among ascending keys, -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], -1)


def numbers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each different key first occurs, the number of each key among them, in order of keys)."""
    order = ascending(keys)
    new, which = np.ones(len(keys), bool), np.empty(len(keys), np.int64)
    new[1:] = np.diff(keys[order]) != 0
    which[order] = np.cumsum(new) - 1
    return order[new], which


class Shard:
    """The restaurants of a shard: types are different (far, near, word) below and (near, word) above, their customers those of learned texts.

    Of a hot near word it has a part. Until ``hear`` tells of the others' parts, it is taken for the whole.
    """

    def __init__(self, rows: pa.Table, corpus: Corpus):
        self.spans = []  # (chunk, first token, last token + 1)
        rows = rows.drop_columns(["ids", "sizes"])
        total = pc.sum(rows.column("n")).as_py() or 0
        near, far, words, self.docs = (np.empty(total, kind) for kind in (np.uint64, np.uint64, np.uint64, np.uint32))
        a = 0
        for k in pc.sort_indices(rows, sort_keys=[("chunk", "ascending"), ("n", "ascending")]).to_pylist():
            r = rows.slice(k, 1).to_pylist()[0]  # one at a time, so that rows aren't in memory twice
            if not r["n"]:
                continue
            own = slice(a, a := a + r["n"])
            near[own] = np.repeat(unsqueeze(r["near"], r["n_near"], np.uint64), unsqueeze(r["runs"], r["n_near"], np.uint32))
            words[own], far[own] = (self.decoded(unsqueeze(r[codes], r["n"], np.uint16), unsqueeze(r[rare], r[f"n_{rare}"], np.uint64), corpus) for codes, rare in (("codes", "rare"), ("far", "rare_far")))
            self.docs[own] = unsqueeze(r["docs"], r["n"], np.uint32)
            self.spans.append((r["chunk"], own.start, own.stop))
        pair = mix(near + mix(words) * np.uint64(3))
        first, self.kind = numbers(mix(pair + far * _SPREAD))
        self.customers = np.bincount(self.kind, self.docs & 1, minlength=len(first)).astype(np.int64)
        near, far, words, pair = near[first], far[first], words[first], pair[first]
        doors, self.house = numbers(mix(near) + far * _SPREAD)  # the restaurant of each lower type
        first, self.upper = numbers(pair)
        upper_near, upper_words = near[first], words[first]
        first, self.street = numbers(upper_near)
        self.hot = found(*corpus.near_hashes(), upper_near[first])[self.street]  # the number of the hot near word of each upper type, or -1
        first, self.word = numbers(upper_words)
        self.words = upper_words[first]
        self.learned = self.sums(self.word, self.sums(self.upper, self.customers, len(upper_near)), len(self.words))
        self.sent = np.zeros(len(self.words), np.int64)
        # upper types of hot near words, in order of words, and pairs and triples of hot words, in order of their mixed numbers
        shared = np.flatnonzero(self.hot >= 0)
        self.shared = shared[np.lexsort((self.hot[shared], self.word[shared]))]
        self.given, self.middle = np.zeros(len(self.hot), bool), np.zeros(len(self.hot))
        order = np.argsort(corpus.hot)
        kinds, known = len(order), (corpus.hot[order], order)
        lower_hot = self.hot[self.upper]
        lower = np.flatnonzero(lower_hot >= 0)
        lower = lower[(far_hot := found(*known, far[lower])) >= 0]
        pairs = lower_hot[lower] * kinds + far_hot[far_hot >= 0]
        word_hot = found(*known, words[lower])
        is_door = np.zeros(len(near), bool)
        is_door[doors] = True
        at_door = is_door[lower]
        self.shared_houses, self.shared_types = self.house[lower[at_door]], lower[word_hot >= 0]
        self.keys = np.concatenate([pairs[at_door] * (kinds + 1) + kinds, (pairs * (kinds + 1) + word_hot)[word_hot >= 0]]).astype(np.uint64)
        self.order = np.argsort(mix(self.keys), kind="stable")
        # customers and discounts that other shards have of pairs and triples
        self.house_guests = self.house_taken = self.type_guests = self.type_taken = 0

    @staticmethod
    def decoded(codes: np.ndarray, rare: np.ndarray, corpus: Corpus) -> np.ndarray:
        """The words that codes stand for: rare ones, the frequent ones, and what lies before a text's start."""
        words = np.full(len(codes), START, np.uint64)
        words[codes == 0] = rare
        known = (codes > 0) & (codes != START_CODE)
        words[known] = corpus.frequent[codes[known].astype(np.int64) - 1] if len(corpus.frequent) else 0
        return words

    @staticmethod
    def sums(group: np.ndarray, values: np.ndarray, n: int | None = None) -> np.ndarray:
        return np.bincount(group, values, minlength=n or 0).astype(np.int64)

    def hear(self, middle: np.ndarray, guests: np.ndarray, taken: np.ndarray) -> None:
        """From all shards: the probabilities of the upper types ``shared``, and of ``keys`` (by ``order``) the customers and discounts that the other parts have."""
        self.given[self.shared], self.middle[self.shared] = True, middle
        if houses := len(self.shared_houses):
            by_key = np.zeros((2, len(self.keys)))
            by_key[:, self.order] = guests, taken
            self.house_guests, self.house_taken = np.zeros((2, int(self.house.max()) + 1))
            self.house_guests[self.shared_houses], self.house_taken[self.shared_houses] = by_key[:, :houses]
            self.type_guests, self.type_taken = np.zeros((2, len(self.customers)))
            self.type_guests[self.shared_types], self.type_taken[self.shared_types] = by_key[:, houses:]

    def sweep(self, root: np.ndarray, rng: np.random.Generator, sweeps: int, averaged: int) -> np.ndarray:
        """The average predictive probability of each lower type over the last ``averaged`` sweeps; ``root`` has that of each word at the root.

        ``sent`` is left with the tables that the last sweep sends to the root for each word, those of hot near words left out; ``above`` with what it
        sends to the upper types, ``held`` with the customers and discounts of ``keys``.
        """
        low, upper_n = (self.customers > 0).astype(np.int64), len(self.word)
        above = self.sums(self.upper, low, upper_n)
        above[self.given] = 0  # seated beside the root
        high = (above > 0).astype(np.int64)
        d_low = discount((self.customers == 1).sum(), (self.customers == 2).sum())
        d_high = discount((above == 1).sum(), (above == 2).sum())
        guests, mean = self.sums(self.house, self.customers), np.zeros(len(self.customers))

        root_here, divisor = root[self.word], (averaged * (STRENGTH + guests + self.house_guests))[self.house] if averaged else None

        def upper_fresh():
            return (STRENGTH + d_high * self.sums(self.street, high))[self.street] * root_here

        def lower_fresh(new):
            middle = (above - d_high * high + new) / (STRENGTH + self.sums(self.street, above))[self.street]
            middle[self.given] = self.middle[self.given]
            return (STRENGTH + d_low * self.sums(self.house, low) + self.house_taken)[self.house] * middle[self.upper]

        new_high = upper_fresh()
        new_low = lower_fresh(new_high)  # what a new table of each type weighs
        for k in range(sweeps):
            low = seat(self.customers, new_low, d_low, rng)
            above = self.sums(self.upper, low, upper_n)
            above[self.given] = 0
            high = seat(above, new_high, d_high, rng)
            if k < sweeps - 1 or averaged:
                new_high = upper_fresh()
                new_low = lower_fresh(new_high)
            if k >= sweeps - averaged:
                mean += (self.customers - d_low * low + (self.type_guests - self.type_taken) + new_low) / divisor
        self.above, self.sent = above, self.sums(self.word, np.where(self.hot < 0, high, 0), len(self.words))
        of_houses = guests[self.shared_houses], d_low * self.sums(self.house, low)[self.shared_houses]
        self.held = [np.concatenate(x) for x in zip(of_houses, (self.customers[self.shared_types], d_low * low[self.shared_types]), strict=True)]
        return mean


def first_round(rows: pa.Table, corpus: Corpus) -> pa.Table:
    """Sweeps under the shard's own word frequencies; for each range what it asks for.

    These are the ascending words, their tables and their learned tokens; of hot near words the number, the word's place among those words, and the tables that come from
    below; pairs and triples of hot words with their customers and discounts.
    """
    shard, number = Shard(rows, corpus), rows.column("shard")[0].as_py()
    if not len(shard.words):
        return arrow([], _SENT)
    shard.sweep((shard.learned + 1.0) / (shard.learned.sum() + len(shard.words)), np.random.default_rng([1, number]), FIRST_SWEEPS, 0)
    to = share(shard.words, corpus.shards)
    keys, (guests, taken) = shard.keys[shard.order], (v[shard.order] for v in shard.held)
    word, above, hot = shard.word[shard.shared], shard.above[shard.shared], shard.hot[shard.shared]
    cuts = [np.searchsorted(x, np.arange(corpus.shards + 1)).tolist() for x in (to, to[word], share(mix(keys), corpus.shards))]
    out = []
    for r in range(corpus.shards):
        (a, b), (c, e), (f, g) = ((x[r], x[r + 1]) for x in cuts)
        if b > a or g > f:
            out.append((number, r, b - a, e - c, g - f, squeeze(shard.words[a:b]), squeeze(shard.sent[a:b]), squeeze(shard.learned[a:b]),
                        *([squeeze(hot[c:e].astype(np.uint32)), squeeze((word[c:e] - a).astype(np.uint32)), squeeze(above[c:e])] if e > c else [None] * 3),
                        *([squeeze(keys[f:g]), squeeze(guests[f:g]), squeeze(taken[f:g])] if g > f else [None] * 3)))
    return arrow(out, _SENT)


_SENT = [("shard", pa.int32()), ("range", pa.int32()), ("n", pa.int32()), ("n_hot", pa.int32()), ("n_keys", pa.int32()), ("words", pa.binary()), ("tables", pa.binary()), ("learned", pa.binary()),
         ("hot", pa.binary()), ("place", pa.binary()), ("above", pa.binary()), ("keys", pa.binary()), ("guests", pa.binary()), ("taken", pa.binary())]
_REPLY = [("shard", pa.int32()), ("range", pa.int32()), ("n", pa.int32()), ("n_hot", pa.int32()), ("n_keys", pa.int32()), ("mass", pa.binary()), ("learned", pa.binary()),
          ("hot_mass", pa.binary()), ("guests", pa.binary()), ("taken", pa.binary()), ("all_guests", pa.list_(pa.int64())), ("all_taken", pa.list_(pa.float64()))]
_SUMS = [("chunk", pa.int64()), ("n", pa.int32()), ("docs", pa.binary()), ("score", pa.binary()), ("base", pa.binary()), ("known", pa.binary()),
         ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]


def arrow(rows: list[tuple], fields: list) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def unpacked(rows: list[dict], name: str, count: str, kind) -> np.ndarray:
    """A packed column of several rows in one array."""
    return np.concatenate([np.zeros(0, kind), *(unsqueeze(r[name], r[count], kind) for r in rows if r[count])])


def root_round(rows: pa.Table, corpus: Corpus) -> pa.Table:
    """The seating of a range of words at hot near words and at the root: to each shard what it asked for, in its order.

    These are the words' customers less discounts and their learned tokens, the customers less discounts of upper types of hot near words, and what other parts have of
    pairs and triples of hot words. One more row, of shard -1, has customers of the range at the root and at each hot near word, the tables of the root and the
    discounts of the hot near words.
    """
    asked = rows.sort_by("shard").to_pylist()
    kinds, which = np.unique(unpacked(asked, "words", "n", np.uint64), return_inverse=True)
    total = lambda which, values, n: np.bincount(which, values, minlength=n).astype(np.int64)
    guests, learned = (total(which, unpacked(asked, name, "n", np.int64), len(kinds)) for name in ("tables", "learned"))
    rng = np.random.default_rng([2, asked[0]["range"]])
    hot_n = len(corpus.hot)
    starts = np.repeat(np.cumsum([0, *(r["n"] for r in asked[:-1])]), [r["n_hot"] for r in asked])
    upper, entry = np.unique(which[starts + unpacked(asked, "place", "n_hot", np.uint32)] * max(hot_n, 1) + unpacked(asked, "hot", "n_hot", np.uint32), return_inverse=True)
    word, near = np.divmod(upper, max(hot_n, 1))
    above = total(entry, unpacked(asked, "above", "n_hot", np.int64), len(upper))
    d = round(discount((above == 1).sum(), (above == 2).sum()) * 1024) / 1024  # sums of its multiples are exact in any order
    new = (STRENGTH + d * corpus.shards * total(near, above > 0, hot_n))[near] * ((learned + 1) / (corpus.learned + corpus.kinds + 1))[word]  # all ranges have alike numbers of tables
    high = seat(above, new, d, rng)
    hot_mass = (above - d * high).astype(np.float32)[entry]
    guests += total(word, high, len(kinds))
    tables = seat(guests, np.full(len(kinds), (STRENGTH + corpus.discount * corpus.kinds) / (corpus.kinds + 1)), corpus.discount, rng)
    mass = (guests - corpus.discount * tables).astype(np.float32)
    keys, key = np.unique(unpacked(asked, "keys", "n_keys", np.uint64), return_inverse=True)
    own = [unpacked(asked, name, "n_keys", kind) for name, kind in (("guests", np.int64), ("taken", np.float64))]
    others = [np.bincount(key, v, minlength=len(keys))[key] - v for v in own]
    out, at, hot_at, key_at = [], 0, 0, 0
    for r in asked:
        n, n_hot, n_keys = r["n"], r["n_hot"], r["n_keys"]
        out.append((r["shard"], r["range"], n, n_hot, n_keys, squeeze(mass[which[at:at + n]]), squeeze(learned[which[at:at + n]]), squeeze(hot_mass[hot_at:hot_at + n_hot]) if n_hot else None,
                    *((squeeze(v[key_at:key_at + n_keys]) if n_keys else None) for v in others), None, None))
        at, hot_at, key_at = at + n, hot_at + n_hot, key_at + n_keys
    out.append((-1, asked[0]["range"], 0, 0, 0, *[None] * 5, [int(guests.sum()), *total(near, above, hot_n).tolist()], [float(tables.sum()), *(d * total(near, high, hot_n)).tolist()]))
    return arrow(out, _REPLY)


def second_round(rows: pa.Table, replies: pa.Table, corpus: Corpus) -> pa.Table:
    """Sweeps under the root's probabilities; for each chunk its documents' sums of log10 of the averages, of log10(count + 1), and known tokens."""
    if not rows.num_rows:  # nothing was dealt to this shard
        return arrow([], _SUMS)
    out = []
    for r in rows.select(["chunk", "n", "ids", "sizes"]).filter(pc.equal(rows.column("n"), 0)).to_pylist():
        out.append((r["chunk"], 0, None, None, None, None, r["ids"], r["sizes"]))
    everyone, *replied = replies.sort_by("range").to_pylist()
    if replied:
        shard = Shard(rows, corpus)
        learned = unpacked(replied, "learned", "n", np.int64)
        guests, taken = np.array(everyone["all_guests"]), np.array(everyone["all_taken"])
        root = (unpacked(replied, "mass", "n", np.float32).astype(np.float64) + (STRENGTH + corpus.discount * taken[0]) / (corpus.kinds + 1)) / (STRENGTH + guests[0])
        hot = shard.hot[shard.shared] + 1
        middle = (unpacked(replied, "hot_mass", "n_hot", np.float32).astype(np.float64) + (STRENGTH + taken[hot]) * root[shard.word[shard.shared]]) / (STRENGTH + guests[hot])
        shard.hear(middle, unpacked(replied, "guests", "n_keys", np.float64), unpacked(replied, "taken", "n_keys", np.float64))
        mean = shard.sweep(root, np.random.default_rng([3, rows.column("shard")[0].as_py()]), SWEEPS, AVERAGED)
        score, word = np.log10(mean)[shard.kind], shard.word[shard.upper][shard.kind]
        base, known = np.log10(learned + 1.0)[word], (learned > 0)[word]
        for chunk, a, b in shard.spans:
            which = shard.docs[a:b] >> 1
            docs = np.flatnonzero(np.bincount(which)).astype(np.uint32)
            sums = [np.bincount(which, v[a:b])[docs] for v in (score, base, known)]
            out.append((chunk, len(docs), squeeze(docs), squeeze(sums[0].astype(np.float32)), squeeze(sums[1]), squeeze(sums[2].astype(np.uint32)), None, None))
    return arrow(out, _SUMS)


def document_sums(rows: pa.Table) -> pa.Table:
    """The documents of one chunk, from the sums of all shards."""
    parts = rows.sort_by("n").to_pylist()
    ids, sizes = parts[0]["ids"], np.array(parts[0]["sizes"], np.int64)
    score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))
    for p in parts[1:]:
        docs = unsqueeze(p["docs"], p["n"], np.uint32)
        for total, name, kind in ((score, "score", np.float32), (base, "base", np.float64), (known, "known", np.uint32)):
            total[docs] += unsqueeze(p[name], p["n"], kind)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": sizes, "n_known": known.astype(np.int64), "base": base, "score": score})


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    Texts learn and are scored with A-Z lowered. A null or empty text is one token, its end. Rows that repeat a doc_id count each and have their own
    results; a null doc_id is learned from. If nothing is learned, the one word that stands for all others has probability 1 and all scores are 0.
    Other columns are left out. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", (~held_out(docs["doc_id"])).alias("learn"))
    corpus = survey(docs)
    if corpus is None:
        return docs.select("doc_id", "learn", *[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known", "train_tokens")], F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")).where(
            "false").withColumnRenamed("learn", "held_out")
    # asked for twice in one query, so the shuffle is made once and read twice
    dealt = dealt_tokens(docs, corpus).repartition(corpus.shards, "shard").groupBy("shard")
    sent = dealt.applyInArrow(lambda rows: first_round(rows, corpus), "shard int, range int, n int, n_hot int, n_keys int, words binary, tables binary, learned binary, "
                              "hot binary, place binary, above binary, keys binary, guests binary, taken binary")
    root = sent.groupBy("range").applyInArrow(lambda rows: root_round(rows, corpus), "shard int, range int, n int, n_hot int, n_keys int, mass binary, learned binary, hot_mass binary, "
                                              "guests binary, taken binary, all_guests array<long>, all_taken array<double>")
    # one number for the root and each hot near word
    each = root.where("shard < 0").select(F.posexplode(F.arrays_zip("all_guests", "all_taken"))).groupBy("pos").agg(F.sum("col.all_guests").alias("guests"), F.sum("col.all_taken").alias("taken"))
    whole = each.agg(F.array_sort(F.collect_list(F.struct("pos", "guests", "taken"))).alias("t"))
    everyone = docs.sparkSession.range(corpus.shards).select(F.col("id").cast("int").alias("shard"), F.lit(-1).alias("range"), whole.scalar().alias("t")).select(
        "shard", "range", F.col("t.guests").alias("all_guests"), F.col("t.taken").alias("all_taken"))
    replies = root.where("shard >= 0").drop("all_guests", "all_taken").unionByName(everyone, allowMissingColumns=True)
    sums = dealt.cogroup(replies.groupBy("shard")).applyInArrow(lambda rows, back: second_round(rows, back, corpus),
                                                                "chunk long, n int, docs binary, score binary, base binary, known binary, ids array<long>, sizes array<long>")
    found = sums.groupBy("chunk").applyInArrow(document_sums, "doc_id long, n_tokens long, n_known long, base double, score double")
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(corpus.learned + corpus.kinds + 1)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(corpus.learned).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
