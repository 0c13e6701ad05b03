"""Token ids and counts of whole texts with a tokenizer of the ``tokenizers`` library.

Two facts keep this fast and bounded without changing one id:

* In byte-level BPE some places always start a new pre-token, such as white space after a visible character, so the ids
  before and after don't depend on each other. Texts are cut there into units, each distinct unit is encoded once per task
  process by the library, and the ids are gathered from the distinct ones.
* A huge text is encoded in overlapping chunks with offsets (overlap resynchronisation). Neighbouring chunks are spliced at
  a common boundary that is proven in this way; where the overlap has none, it is widened.

Null and empty texts have no tokens. Special strings inside texts are what the library's default makes of them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wattframe.llm.text import ragged_index, segment_sums, span_hashes, text_slices

TOKENIZER = "byte_bpe_50k.json"
SLICE = 3 << 20
# first bytes of characters that are no white space: visible ASCII, and all that white space beyond ASCII doesn't start with (C2, E1, E2, E3 do)
_SOLID = np.array([33 <= b < 127 or b >= 0xC3 and b not in (0xE1, 0xE2, 0xE3) for b in range(256)])
_CONTINUED = np.array([0x80 <= b < 0xC0 for b in range(256)])
_TWO = np.array([0xC3 <= b < 0xE0 for b in range(256)])
_THREE = np.array([b == 0xE0 or 0xE4 <= b < 0xF0 for b in range(256)])
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_SIGN = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_BREAK = np.array([b in b"\t\n\v\f\r" for b in range(256)])


def unit_starts(data: np.ndarray, offsets: np.ndarray, signs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Where units start: at each non-empty row's start and at proven pre-token starts; per row the number of its first unit.

    Proven whatever stands further left or right: white space after a visible character (no pre-token has white space behind
    one), a visible character after a single line break or tab (only a blank joins what follows; a longer run of white space
    is cut differently where nothing follows it), and, with ``signs``, an ASCII sign after an ASCII letter.
    """
    n = len(data)
    start = np.zeros(n, bool)
    if n > 1:
        solid = _SOLID[data]
        tail = _CONTINUED[data]
        ends = solid & ~tail  # the character that ends at this byte is visible
        ends[1:] |= tail[1:] & _TWO[data[:-1]]
        ends[2:] |= tail[2:] & tail[1:-1] & _THREE[data[:-2]]
        breaks = _BREAK[data]
        start[1:] = ends[:-1] & (breaks[1:] | (data[1:] == 32))
        start[2:] |= ends[:-2] & breaks[1:-1] & solid[2:]
        if signs:
            start[1:] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, offsets)


class Encoder:
    """Ids of many texts at once; distinct units are kept for the life of the process, at most ``keep`` of them."""

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        added = spec.get("added_tokens") or []
        self.added = [t["content"].encode() for t in added]
        #: cutting into units is proven for this form only; any other tokenizer encodes whole texts
        self.by_units = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and model.get("type") == "BPE" and not model.get("dropout")
            and not any(set(t["content"]) & set(" \t\n\v\f\r") or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )
        self.keep = keep
        self._known: dict[int, int] = {}
        self._reset()

    def _reset(self) -> None:
        self._known.clear()
        self._ids = np.zeros(1 << 20, np.uint32)
        self._at = np.zeros(self.keep + 1, np.int64)
        self._n = 0

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of whole texts by the library alone."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        lengths = np.array([len(e) for e in found], np.int64)
        ids = np.zeros(int(lengths.sum()), np.uint32)
        for e, end, n in zip(found, np.cumsum(lengths).tolist(), lengths.tolist(), strict=True):
            ids[end - n:end] = e.ids
        return ids, lengths

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of units, those that start with one blank first; they are encoded as one text and cut by the offsets."""
        last = data[ends - 1]
        clear = (_SOLID[last] & ~_CONTINUED[last]) | (_CONTINUED[last] & _TWO[data[np.maximum(ends - 2, 0)]])
        joined = (data[starts] == 32) & (ends - starts > 1) & clear
        joined[joined] = _SOLID[data[starts[joined] + 1]]
        for word in self.added:  # a text with an added token goes alone
            if word[:1] in data.tobytes():
                holds = np.concatenate([[0], np.cumsum(data == word[0])])
                joined &= holds[ends] == holds[starts]
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
        lengths, parts = np.zeros(len(starts), np.int64), []
        a, b = starts[joined], ends[joined]
        sizes = np.cumsum(b - a)
        for lo, hi in _runs(sizes, 100_000):
            raw = data[ragged_index(a[lo:hi], b[lo:hi] - a[lo:hi])]
            e = self.tokenizer.encode(raw.tobytes().decode("utf-8"), add_special_tokens=False)
            chars = np.cumsum(~_CONTINUED[raw])
            close = chars[np.cumsum(b[lo:hi] - a[lo:hi]) - 1]
            begins = np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
            lengths[lo:hi] = np.diff(np.searchsorted(begins, close), prepend=0)
            parts.append(np.array(e.ids, np.uint32))
        rest = order[len(a):]
        if len(rest):
            raw = data.tobytes()
            ids, lengths[len(a):] = self.plain([raw[x:y].decode("utf-8") for x, y in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)])
            parts.append(ids)
        self._order = order
        return np.concatenate(parts), lengths

    def encode(self, data: np.ndarray, offsets: np.ndarray, ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """(ids of all rows one after another, number of ids of each row) for UTF-8 bytes and row offsets."""
        if not self.by_units:
            raw = data.tobytes()
            found, lengths = self.plain([raw[a:b].decode("utf-8") for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            return (found if ids else None), lengths
        _, splits, per_unit, out = self.units(data, offsets, ids)
        return out, segment_sums(per_unit, splits)

    def units(self, data: np.ndarray, offsets: np.ndarray, ids: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """(byte offset of each unit, per row the number of its first unit, ids per unit, all ids)."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        raw = data.tobytes()
        starts, splits = unit_starts(data, offsets, not any(word in raw for word in self.added))
        ends = np.append(starts[1:], len(data))
        hashes, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if self._n + len(hashes) > self.keep:
            self.keep = max(self.keep, len(hashes))
            self._reset()
        known, keys = self._known, hashes.tolist()
        slots = np.fromiter((known.get(h, -1) for h in keys), np.int64, len(keys))
        new = np.flatnonzero(slots < 0)
        if len(new):
            found, lengths = self._learn(data, starts[first[new]], ends[first[new]])
            new = new[self._order]
            used = self._at[self._n]
            if used + len(found) > len(self._ids):
                self._ids = np.concatenate([self._ids[:used], np.zeros(len(self._ids) + len(found), np.uint32)])
            self._ids[used:used + len(found)] = found
            self._at[self._n + 1:self._n + 1 + len(new)] = used + np.cumsum(lengths)
            slots[new] = np.arange(self._n, self._n + len(new))
            known.update(zip(hashes[new].tolist(), range(self._n, self._n + len(new)), strict=True))
            self._n += len(new)
        begin, length = self._at[slots], self._at[slots + 1] - self._at[slots]
        per_unit = length[inverse]
        return starts, splits, per_unit, self._ids[ragged_index(begin[inverse], per_unit)] if ids else None


def _runs(ends: np.ndarray, limit: int):
    """Ranges of items of about ``limit`` in all, given running totals."""
    lo = 0
    while lo < len(ends):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="left")) + 1
        yield lo, min(hi, len(ends))
        lo = min(hi, len(ends))


@cache
def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def resync(data: np.ndarray, encoder: Encoder, chunk: int, overlap: int) -> tuple[list[np.ndarray], int]:
    """Ids of one text (UTF-8 bytes) in parts, from overlapping chunks of ``chunk`` bytes; and how often an overlap was widened.

    A chunk runs ``overlap`` bytes into the next one. Both are encoded with offsets, and spliced at a place inside the overlap,
    clear of the chunks' own edges, where both start a unit: a proven token boundary. Where there is none the overlap doubles,
    at the end to the rest of the text.
    """
    parts: list[np.ndarray] = []
    widened, start, n = 0, 0, len(data)
    clear = 4 + max([0, *map(len, encoder.added)])  # an added token that the chunk's end cuts isn't seen as one
    while start < n:
        width, next_at = overlap, min(n, start + chunk)
        while True:
            stop = min(n, next_at + width)
            while stop < n and _CONTINUED[data[stop]]:
                stop += 1
            begins, _, counts, ids = encoder.units(data[start:stop], np.array([0, stop - start]))
            if stop == n:
                return [*parts, ids], widened
            while next_at < n and _CONTINUED[data[next_at]]:
                next_at += 1
            ahead, _, _, _ = encoder.units(data[next_at:stop], np.array([0, stop - next_at]), False)
            common = np.intersect1d(begins + start, ahead[1:] + next_at)
            common = common[common < stop - clear]
            if len(common):
                cut = int(common[len(common) // 2])
                parts.append(ids[:int(counts[:np.searchsorted(begins, cut - start)].sum())])
                start = cut
                break
            widened += 1
            width *= 2
    return parts, widened


def count_tokens(docs: DataFrame, *, limit: int = 1024, tokenizer: str | None = None, text: str = "text", chunk: int = 65_536,
                 overlap: int = 1_024) -> DataFrame:
    """Adds n_bytes, n_tokens, over_limit and n_resync (overlaps widened; null for a text of one chunk) to ``docs``.

    One map over the rows, no shuffle. Texts over ``chunk`` bytes are encoded by overlap resynchronisation, so memory is
    bounded by a chunk's encoding. Null or empty texts count 0. Columns of ``docs`` that bear a result's name are replaced.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    made = ("n_bytes", "n_tokens", "over_limit", "n_resync")
    kept = docs.drop(*made)
    types = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType(), "n_resync": T.IntegerType()}
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in types.items())])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(at), SLICE):
                size = np.diff(offsets)
                huge = np.flatnonzero(size > chunk) if enc.by_units else np.zeros(0, np.int64)
                widened: list[int | None] = [None] * len(size)
                n = np.zeros(len(size), np.int64)
                small = np.setdiff1d(np.arange(len(size)), huge)
                part_data = data[ragged_index(offsets[small], size[small])] if len(huge) else data
                n[small] = enc.encode(part_data, np.concatenate([[0], np.cumsum(size[small])]), ids=False)[1]
                for k in huge.tolist():
                    parts, widened[k] = resync(data[offsets[k]:offsets[k + 1]], enc, chunk, overlap)
                    n[k] = sum(map(len, parts))
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit),
                                                  pa.array(widened, pa.int32())], names=[*part.schema.names, *types])

    return kept.mapInArrow(run, schema)


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_resync of every document."""
    return count_tokens(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit", "n_resync")
