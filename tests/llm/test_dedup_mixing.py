"""Cuckoo dedup and mixing against plain versions."""

import hashlib
import random
from collections import defaultdict

import pytest

from wattframe.llm import cuckoo, mixing


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_index_follows_a_set_through_insertions_deletions_and_resizes():
    rng, index, live = random.Random(1), cuckoo.CuckooIndex(buckets=2), {}
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for _ in range(20_000):
        key = rng.choice(keys)
        if key in live and rng.random() < 0.4:
            assert index.delete(key)
            del live[key]
        elif key in live:
            assert index.get(key)[1] == live[key]
        elif rng.random() < 0.1:
            assert not index.delete(key) and index.get(key) is None
        else:
            live[key] = rng.random()
            index.insert(key, live[key])
    assert {k: v for k, v in index.entries()} == live and index.resizes > 0
    assert all(index.get(k) is not None for k in live)


def test_changes_apply_in_order(spark):
    key = [hashlib.sha256(bytes([k])).digest() for k in range(3)]
    rows = [(key[0], 0, 5, 1, 1, False), (key[0], 1, 9, 2, 2, False), (key[1], 0, 3, 3, 1, False), (key[1], 1, None, 0, 0, True), (key[1], 2, 4, 4, 1, False),
            (key[2], 0, 1, 5, 1, False), (key[2], 1, None, 0, 0, True)]
    changes = spark.createDataFrame(rows, "digest binary, step long, keep_id long, keep_row long, group_size long, removed boolean")
    got = {bytes(r.digest): (r.keep_id, r.group_size) for r in cuckoo.apply_changes(changes, 2).collect()}
    assert got == {key[0]: (9, 3), key[1]: (4, 1)}


def test_exact_dedup_of_awkward_rows(awkward, nothing):
    rows = awkward.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r.text)].append(r.doc_id)
    got = cuckoo.exact_dedup(awkward).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = [i for i in sha[r.text_sha256] if i is not None]
        assert r.group_size == len(sha[r.text_sha256]) and r.keep_id == max(ids, default=None)
        assert not r.kept or r.doc_id == r.keep_id
    stay = cuckoo.distinct_texts(awkward)
    assert stay.columns == awkward.columns
    assert sorted(lowered(r.text) for r in stay.collect()) == sorted(groups)
    assert cuckoo.exact_dedup(nothing).count() == 0 and cuckoo.distinct_texts(nothing).count() == 0


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    want, capped = dict.fromkeys(names, 0.0), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s] + 1e-9}
        if not over:
            want.update(share)
            return want
        capped |= over
        want.update({s: most * sizes[s] for s in over})


def test_mix_reaches_its_targets(spark):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randint(0, 40), rng.choice(["s1", "s2", "s2", "s3", None])) for k in range(3000)] + [(9000, "w " * 5, "s0")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = targets(sizes)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3 and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)


def test_mix_of_awkward_rows(awkward, nothing):
    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count() and sum(r.size for r in got) > 36_000
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (3, 4, 5))
    copies = mixing.mixed_documents(awkward)
    assert copies.columns == awkward.columns and copies.count() == sum(r.copies for r in got)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
