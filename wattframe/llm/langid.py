"""Language identification of mixed text: script ranges, per-word scores, and Viterbi with a switching penalty.

A word's script narrows the candidates to the languages that were seen to use it. Each candidate scores the word by the log
likelihood of its byte trigrams (with a blank at both ends). The best sequence of languages over a document's words pays a penalty
for each switch; runs of one language are the spans, and the language with most bytes is the document's.

The search is exact and runs over many stretches at once: a word whose best language leads all others by more than two
penalties has that language in every best sequence, so documents are cut there into stretches that don't depend on each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.llm.text import LOWER, PUNCTUATION, ragged_index, span_hashes, text_slices, word_spans

BUCKETS = 1 << 16
#: bound of the labelled rows that are learned from, per language
SAMPLE = 10_000
PENALTY, SMOOTHING, FAR = 6.0, 0.1, -60.0
#: a language is a candidate for a script that holds at least this share of its words
SCRIPT_SHARE = 0.002
SLICE = 4 << 20
# scripts by the first byte of a word in UTF-8: ranges of code points that share it
_SCRIPT_RANGES = [(0x00, 0x7F, 0), (0xC3, 0xC9, 0), (0xCA, 0xCD, 1), (0xCD, 0xCF, 2), (0xD0, 0xD4, 3), (0xD5, 0xD6, 4), (0xD7, 0xD7, 5), (0xD8, 0xDB, 6),
                  (0xE0, 0xE0, 7), (0xE1, 0xE1, 8), (0xE3, 0xE3, 9), (0xE4, 0xE9, 10), (0xEA, 0xED, 11)]
SCRIPTS = 13
_SCRIPT = np.full(256, 12, np.uint8)
for _low, _high, _name in _SCRIPT_RANGES:
    _SCRIPT[_low:_high + 1] = _name
_SEPARATORS = PUNCTUATION | np.array([chr(b).isdigit() and b < 128 for b in range(256)])
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x languages, log likelihoods
    candidates: np.ndarray  # scripts x languages
    penalty: float = PENALTY


def _trigrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, words' ends among them) of the byte trigrams of words with a blank at both ends."""
    sizes = ends - starts
    padded = np.full(int((sizes + 2).sum()) + 2, 32, np.uint32)
    to = np.cumsum(sizes + 2) - sizes - 1
    padded[ragged_index(to, sizes)] = data[ragged_index(starts, sizes)]
    first = ragged_index(to - 1, sizes)
    code = padded[first] << np.uint32(16) | padded[first + 1] << np.uint32(8) | padded[first + 2]
    return code * np.uint32(2654435761) >> np.uint32(16), np.cumsum(sizes)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null doc_id is hashed as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, *, sample: int = SAMPLE, penalty: float = PENALTY) -> Model:
    """A model from text and lang of the rows with a non-null lang that aren't held out, about ``sample`` rows a language at most.

    Which rows those are is decided by a hash of doc_id and text, so reruns agree. Counts are summed by Spark; the driver gets at most one
    number for each language and bucket.
    """
    known = docs.where(docs["lang"].isNotNull() & ~held_out(docs["doc_id"]))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((SCRIPTS, 0), bool), penalty)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])[F.col("lang")]
    taken = known.where(F.expr("pmod(xxhash64(doc_id), 1000003)") < share * 1000003).select("lang", "text")
    number = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), BUCKETS + SCRIPTS), np.int64)
        for batch in batches:
            own = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for first, last, data, offsets in text_slices(batch.column(1)):
                data = LOWER[data]
                starts, ends, splits = word_spans(data, offsets, _SEPARATORS)
                lang = np.repeat(own[first:last], np.diff(splits))
                for k in np.unique(lang):
                    mine = lang == k
                    grams, _ = _trigrams(data, starts[mine], ends[mine])
                    sums[k, :BUCKETS] += np.bincount(grams, minlength=BUCKETS)
                    sums[k, BUCKETS:] += np.bincount(_SCRIPT[data[starts[mine]]], minlength=SCRIPTS)
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(sums[lang, bucket])], names=["k", "bucket", "n"])

    table = taken.mapInArrow(count, "k long, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((len(languages), BUCKETS + SCRIPTS))
    sums[table["k"].to_numpy(), table["bucket"].to_numpy()] = table["n"].to_numpy()
    grams, words = sums[:, :BUCKETS], sums[:, BUCKETS:]
    scores = np.log((grams + SMOOTHING) / (grams.sum(1, keepdims=True) + SMOOTHING * BUCKETS)).T.astype(np.float32)
    return Model(languages, np.ascontiguousarray(scores), (words >= SCRIPT_SHARE * np.maximum(1, words.sum(1, keepdims=True))).T & (words.T > 0), penalty)


def word_scores(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words x languages; each distinct word is scored once. Languages that don't use the word's script are far below."""
    if not len(starts) or not model.languages:
        return np.zeros((len(starts), len(model.languages)), np.float32)
    _, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    a, b = starts[first], ends[first]
    grams, upto = _trigrams(data, a, b)
    own = np.add.reduceat(model.scores[grams], np.concatenate([[0], upto[:-1]]), axis=0)
    usable = model.candidates[_SCRIPT[data[a]]]
    # a script that no language uses says nothing
    own = np.where(usable, own, np.where(usable.any(1, keepdims=True), own.min(1, keepdims=True) + np.float32(FAR), np.float32(0)))
    return own[inverse]


def best_path(scores: np.ndarray, splits: np.ndarray, penalty: float) -> np.ndarray:
    """The language number of every word in the best sequence of its document (words splits[i] to splits[i + 1])."""
    n, k = scores.shape
    if k < 2 or not n:
        return np.zeros(n, np.int64)
    top = scores.argmax(1)
    lead = np.partition(scores, k - 2, axis=1)
    sure = lead[:, k - 1] - lead[:, k - 2] > 2 * penalty
    cut = sure.copy()
    cut[splits[:-1][splits[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, n))
    path = np.empty(n, np.int64)
    path[starts] = top[starts]
    # stretches of one sure word need no search; a sure word's follower is known unless a document ends
    after = starts + sizes
    follows = np.where(np.isin(after, splits), -1, np.where(after < n, top[np.minimum(after, n - 1)], -1))
    open_ = np.flatnonzero((sizes > 1) | ~sure[starts])
    order = open_[np.argsort(-sizes[open_], kind="stable")]
    starts, sizes, follows = starts[order], sizes[order], follows[order]
    if not len(order):
        return path
    stay = np.zeros((n, k), bool)
    source = np.zeros(n, np.int64)
    value = scores[starts].astype(np.float64)
    active = len(starts)
    for t in range(1, int(sizes[0])):
        active = int(np.searchsorted(-sizes, -t, side="left"))
        at = starts[:active] + t
        v = value[:active]
        best = v.argmax(1)
        switched = v[np.arange(active), best] - penalty
        keep = v >= switched[:, None]
        stay[at] = keep
        source[at] = best
        value[:active] = np.where(keep, v, switched[:, None]) + scores[at]
    into = np.arange(k) != follows[:, None]
    state = (value - np.where((follows >= 0)[:, None] & into, penalty, 0.0)).argmax(1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        active = int(np.searchsorted(-sizes, -t, side="left"))
        at = starts[:active] + t
        path[at] = state[:active]
        if t:
            state[:active] = np.where(stay[at, state[:active]], state[:active], source[at])
    return path


def label(docs: DataFrame, model: Model, *, text: str = "text", spans: bool = False, letters: bool = False, prefix: str = "") -> DataFrame:
    """Adds lang_pred and score to ``docs``, with ``spans`` lang_spans: array of (start, end, lang) in bytes of the UTF-8 text, and with
    ``letters`` has_letter, which doesn't depend on the model.

    lang_pred is the language of most bytes; score is its share of the bytes of all words. A text that is null or has no letter
    gets ``und`` and 0, as does every text where nothing was learned; ties go to the first language in order. ``prefix``
    goes before the results' names; columns of ``docs`` that bear such a name are replaced.
    """
    made = tuple(prefix + c for c in ("lang_pred", "score", *(["lang_spans"] if spans else []), *(["has_letter"] if letters else [])))
    kept = docs.drop(*made)
    at = kept.columns.index(text)
    kinds = {"lang_pred": "string", "score": "double", "lang_spans": "array<struct<start:long,end:long,lang:string>>", "has_letter": "boolean"}
    shape = kept.selectExpr("*", *[f"CAST(NULL AS {kinds[m[len(prefix):]]}) AS {m}" for m in made]).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes for each bucket and language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            for first, last, raw, offsets in text_slices(batch.column(at), SLICE):
                data = LOWER[raw]
                starts, ends, splits = word_spans(data, offsets, _SEPARATORS)
                path = best_path(word_scores(m, data, starts, ends), splits, m.penalty)
                rows, k = last - first, len(m.languages)
                doc = np.repeat(np.arange(rows), np.diff(splits))
                size = np.bincount(doc * k + path, ends - starts, minlength=rows * k).reshape(rows, k) if k else np.zeros((rows, 1))
                total = size.sum(1)
                # words of bytes beyond ASCII need not hold a letter
                lettered = np.diff(splits) > 0
                plain = np.concatenate([[0], np.cumsum((raw >= 65) & ~PUNCTUATION[raw] & (raw < 128))])[offsets]
                for j in np.flatnonzero((plain[1:] == plain[:-1]) & lettered).tolist():
                    lettered[j] = bool(_LETTER.search(raw[offsets[j]:offsets[j + 1]].tobytes().decode("utf-8")))
                best = np.where(lettered & (k > 0), size.argmax(1), k)
                share = np.where(best < k, size.max(1) / np.maximum(total, 1), 0.0)
                out = [pa.array(names[best], pa.string()), pa.array(share)]
                if spans:
                    new = np.ones(len(path), bool)
                    new[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
                    begin = np.flatnonzero(new)
                    close = np.append(begin[1:], len(path)) - 1 if len(begin) else begin
                    rows_of = [[] for _ in range(rows)]
                    for d, a, b, lang in zip(doc[begin].tolist(), starts[begin].tolist(), ends[close].tolist(), path[begin].tolist(), strict=True):
                        if best[d] < k:
                            rows_of[d].append({"start": a - int(offsets[d]), "end": b - int(offsets[d]), "lang": m.languages[lang]})
                    out.append(pa.array(rows_of, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                if letters:
                    out.append(pa.array(lettered))
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*part.schema.names, *made])

    return kept.mapInArrow(run, shape)


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by a model learned from the rows that aren't held out."""
    model = learn(docs, **options)
    return label(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
