"""Token counts and packing against the tokenizer library on whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from wattframe.llm.packing import LevelPacker, pack  # noqa: E402
from wattframe.llm.text import text_buffers  # noqa: E402
from wattframe.llm.tokens import TOKENIZER, count_tokens, encoder, resync  # noqa: E402

PATH = public_tokenizers.path(TOKENIZER)
PARTS = ["a", "b ", " '", "’", "é", "日", "  ", " ", " ", "\n", "\t", "\x85", "\x1c", " ", "1", ".", " word", "'s", "<|endoftext|>", "\U0001f600"]


def odd_texts(n, size=40, seed=3):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(PARTS, rng.integers(0, size))) for _ in range(n)]


def library_ids(texts):
    return [e.ids for e in encoder(PATH).tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_units_give_the_library_ids():
    texts = odd_texts(3000)
    ids, counts = encoder(PATH).encode(*text_buffers(pa.array(texts)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library_ids(texts)


@pytest.mark.parametrize("chunk,overlap", [(30, 4), (200, 16)])
def test_resync_gives_the_library_ids_and_widens(chunk, overlap):
    texts = odd_texts(200, 300) + ["x" * 1000 + " y z" * 50]
    found = [resync(np.frombuffer(t.encode(), np.uint8), encoder(PATH), chunk, overlap) for t in texts]
    assert [np.concatenate([np.zeros(0, np.uint32), *p]).tolist() for p, _ in found] == library_ids(texts)
    assert found[-1][1] > 0


def test_counts_keep_rows_and_replace_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "two words", None), (5, "long text " * 20_000, "z")]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), limit=1, chunk=1000, overlap=32).collect()
    want = {None: len(library_ids(["two words"])[0]), 5: len(library_ids(["long text " * 20_000])[0])}
    assert len(got) == 5
    assert all(r.n_tokens == want.get(r.doc_id, 0) and r.over_limit == (r.n_tokens > 1) for r in got)
    assert {r.doc_id: r.n_resync for r in got}[5] is not None
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_level_minimises_squares():
    rng = np.random.default_rng(0)
    p = LevelPacker(16)
    for size in rng.integers(1, 16, 300).tolist():
        def after(h):
            c = p.counts.copy()
            c[h] -= h > 0
            c[h + size] += h + size < 16
            return int((c[1:16] ** 2).sum())
        choices = [h for h in range(17 - size) if h == 0 or p.counts[h]]
        assert after(p.level(size)) == min(map(after, choices))
        p.place(None, size)


def test_pieces_cover_documents_and_fill_windows(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", "", *(" ".join(rng.choice(["one", "two ", "drei,", "é"], rng.integers(1, 900))) for _ in range(200)), "big one " * 5000]
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, start string").coalesce(2)
    rows = pack(docs, window=128, with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for k, ids in enumerate(library_ids([t or "" for t in texts])):
        own = sorted(by_doc[k], key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == [*ids, 0]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(ids) + 1 and r.length == len(r.ids) for r in own)
    fills = []
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        fills.append(at)
    assert max(fills) == 128 and sum(f < 128 for f in fills) <= 2
    assert pack(docs.limit(0)).count() == 0
