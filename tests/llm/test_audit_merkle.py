"""The filter audit and the Merkle manifest against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import pytest

from wattframe.llm import filteraudit, merkle


def plain_audit(rows, labels):
    """rows: (doc_id, text, lang)."""
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    by_part = defaultdict(list)
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                 "E": any((t or "") == text and d is not None and doc_id is not None and d < doc_id for d, t, _ in rows)}
        by_part[lang or ""].append(({f for f in fails if fails[f]}, doc_id in good, doc_id in toxic))
    out = []
    for part, own in by_part.items():
        audit, shapley = [], defaultdict(int)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                audit.append((part, "".join(order), step, len(left), len(gone), sum(f in r[0] for r in own) - len(gone), sum(r[0] == {f} for r in own),
                              sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*a, shapley[a[1][a[2] - 1]]) for a in audit]
    return sorted(out)


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    sha = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: sha(*map(field, (r[0], r[3], r[2], n, r[1])))

    def climb(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, a in enumerate(at):
                paths[k].append((a % 2, nodes[a ^ 1] if a ^ 1 < len(nodes) else None))
                at[k] = a // 2
            nodes = [sha(*nodes[k:k + 2]) for k in range(0, len(nodes), 2)]
        return nodes[0], paths

    trees = defaultdict(list)
    for r in rows:
        chosen = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        trees[r[2]].append((r[0], leaf(r, r[4]), leaf(r, r[4] + 1 if chosen else r[4])))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: climb([n[1] for n in sorted(trees[x], key=lambda n: (n[0] is not None, n[0] or 0, n[1]))]) for x in langs}
    root, onward = climb([built[x][0] for x in langs])
    out = []
    for x, up in zip(langs, onward, strict=True):
        for (doc_id, own, tampered), path in zip(sorted(trees[x], key=lambda n: (n[0] is not None, n[0] or 0, n[1])), built[x][1], strict=True):
            steps, folded = path + up, tampered
            for right, sibling in steps:
                folded = sha(folded) if sibling is None else sha(sibling, folded) if right else sha(folded, sibling)
            out.append((doc_id, own, built[x][0], root, sha(*[s for _, s in steps if s is not None]), folded, folded == root))
    return sorted(out, key=repr)


LABELS = "doc_id long, quality int, toxic int"


def test_merge_counts_the_sets_that_hold_an_id():
    rng = random.Random(3)
    for _ in range(200):
        lists = [sorted(rng.sample(range(200), rng.choice([0, 1, 5, 60, 150]))) for _ in range(rng.randint(0, 7))]
        want = defaultdict(int)
        for i in range(200):
            want[sum(1 << k for k, ids in enumerate(lists) if i in ids)] += 1
        want.pop(0, None)
        assert filteraudit.merge(lists) == want
    ids = sorted(rng.sample(range(10_000), 900))
    for goal in range(0, 10_001, 37):
        at = rng.randrange(900)
        assert filteraudit.gallop(ids, at, goal) == max(at, sum(i < goal for i in ids))


@pytest.mark.parametrize("most", [3, 1 << 16])
def test_audit_of_awkward_rows(spark, awkward, nothing, most, monkeypatch):
    monkeypatch.setattr(filteraudit, "RANGE_ROWS", most)
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (10, None, 1), (None, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame(labels, LABELS)
    got = sorted(tuple(r) for r in filteraudit.filter_audit(awkward, table).collect())
    assert got == plain_audit([(r.doc_id, r.text, r.lang) for r in awkward.collect()], [x for x in labels if x[0] is not None])
    assert len(got) == 600 * 3
    assert all(r.good_lost == 0 for r in filteraudit.filter_audit(awkward, table.limit(0)).collect())
    assert filteraudit.filter_audit(nothing, table).count() == 0


def test_audit_with_a_hot_text_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(filteraudit, "RANGE_ROWS", 50)
    rng = random.Random(4)
    texts = ["the same words again", "A" * 30, "50 % off", "word " * 120] + [" ".join(str(rng.random()) for _ in range(rng.choice([20, 110]))) + rng.choice(["", " #", " ABCDEFG" * 40]) for _ in range(300)]
    rows = [(k, texts[0] if k % 3 == 0 else rng.choice(texts), rng.choice(["en", "en", "en", "de", None])) for k in range(900)]
    labels = [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 900, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = sorted(tuple(r) for r in filteraudit.filter_audit(docs, spark.createDataFrame(labels, LABELS)).collect())
    assert got == plain_audit(rows, labels)
    lists = filteraudit.posting_lists(filteraudit.failing_rows(docs, spark.createDataFrame(labels, LABELS))).collect()
    assert max(r.n for r in lists) <= 50 and sum(r.n for r in lists) == 900
    assert all(list(r[c]) == sorted(set(r[c])) for r in lists for c in filteraudit.LISTS)


@pytest.mark.parametrize("height", range(1, 10))
def test_addresses_fill_the_array_and_keep_subtrees_together(height):
    places = merkle.layout(height)
    assert sorted(int(a) for row in places for a in row) == list(range((1 << height) - 1))
    if height > 1:  # the upper half lies first, and each tree below it in one stretch
        top, below = height // 2, height - height // 2
        assert sorted(int(a) for row in places[:top] for a in row) == list(range((1 << top) - 1))
        for j in range(1 << top):
            own = sorted(int(places[d][i]) for d in range(top, height) for i in range(j << (d - top), (j + 1) << (d - top)))
            assert own == list(range(own[0], own[0] + (1 << below) - 1))


@pytest.mark.parametrize("height", [2, 12])
def test_manifest_of_awkward_rows(awkward, nothing, height):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in awkward.collect()]
    assert sorted((tuple(r) for r in merkle.manifest(awkward, height=height).collect()), key=repr) == plain_manifest(rows)
    assert merkle.manifest(nothing).count() == 0


@pytest.mark.parametrize("height,langs", [(3, 40), (12, 1)])
def test_manifest_recurses_over_block_roots(spark, height, langs):
    rng = random.Random(height)
    rows = [(k, f"text {rng.random()}", f"é{min(rng.randrange(langs), rng.randrange(langs))}", "s", rng.choice([None, k])) for k in rng.sample(range(10_000), 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = sorted((tuple(r) for r in merkle.manifest(docs, height=height).collect()), key=repr)
    assert got == plain_manifest(rows)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)
