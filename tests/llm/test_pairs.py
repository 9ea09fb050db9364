"""SimHash and cover trees against all pairs; components against a plain search."""

import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallymill.llm import cover_tree, simhash_bk
from tallymill.llm.common import components, union_roots
from tests.llm.conftest import rows_of


def reached(n, pairs):
    """Smallest index that each reaches."""
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    return root


def plain_fingerprint(text, width):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values)) if values else 0


def test_fingerprints_agree_with_the_builtin_hash(spark):
    assert spark.sql("select xxhash64('a b c d')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("which", ["odd", "given"])
@pytest.mark.parametrize("tree_rows", [4096, 3])
def test_simhash(request, which, tree_rows):
    docs = request.getfixturevalue(which)
    got = rows_of(simhash_bk.near_duplicates(docs, 4, 4, tree_rows=tree_rows))
    texts = [(r["doc_id"], r["text"] or "") for r in rows_of(docs.select("doc_id", "text"))]
    prints = [plain_fingerprint(t, 4) for _, t in texts]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = reached(len(prints), pairs)
    ids = {}
    for (i, _), r in zip(texts, root):
        if i is not None:
            ids[r] = min(i, ids.get(r, i))
    want = sorted(((i, p, ids.get(r)) for (i, _), p, r in zip(texts, prints, root)), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in got), key=repr) == want


def test_anchors_find_near_copies_far_apart_in_bits(odd):
    got = {r["doc_id"]: r["component_id"] for r in rows_of(simhash_bk.near_duplicates(odd, 5, 13, anchors=8))}
    assert got[10] == 9 and got[5] == 4 and got[14] == 13 and got[2] == got[3] == 1


def test_keep_one(odd, nothing):
    kept = simhash_bk.keep_one(odd, 5, 13, anchors=8)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in rows_of(kept)]
    assert sorted(i for i in ids if i is not None) == [1, 4, 6, 9, 11, 12, 13] and ids.count(None) == 2
    assert rows_of(simhash_bk.keep_one(nothing)) == [] == rows_of(simhash_bk.near_duplicates(nothing))


def test_bands_lose_no_pair():
    rng = np.random.default_rng(2)
    masks = simhash_bk.bands(4)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, 4, replace=False):
            b ^= 1 << int(bit)
        assert any(a & m == b & m for m in masks)


def test_bk_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    values = [int(v) & 0xFFFFF for v in rng.integers(0, 1 << 62, 400)]
    tree = simhash_bk.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.within(q, 4)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 4]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 5), (200, 201), (201, 202), (300, 300), (7, 3), (3, 7)]
    got = {r["node"]: r["component"] for r in rows_of(components(spark.createDataFrame(pairs, "a long, b long")))}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}
    assert rows_of(components(spark.createDataFrame([], "a long, b long"))) == []
    assert union_roots(5, np.array([4, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 1]


def vectors(spark, rows):
    return spark.createDataFrame([r + ("x", "y") for r in rows], "vec_id long, embedding array<float>, label int, key string, unit string")


def test_cover_tree_odd_vectors(spark):
    nan = float("nan")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [0.0, 1.0], 1), (5, [1.0, 0.0], 2),
        (6, [1.0, 0.0], None), (7, None, 1), (8, [0.0, 0.0], 1), (9, [nan, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1),
        (None, [5.0, 0.2], 1), (12, [float("inf"), 0.0], 1), (13, [], 1), (14, [1e-30, 0.0], 1),
    ]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows_of(cover_tree.near_duplicates(vectors(spark, rows)))), key=repr)
    joined = {1, 2, 3, 14, None}
    want = []
    for i, *_ in rows:
        want.append((i, 4, 1, i == 1) if i in joined else (i, 0, i, True))
    assert got == sorted(want, key=repr)
    assert rows_of(cover_tree.near_duplicates(vectors(spark, []))) == []


def test_cover_tree_equals_all_pairs(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK_ROWS", 16)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    extra = table.select((F.col("vec_id") + 10_000).alias("vec_id"), F.transform("embedding", lambda x: x * 3).alias("embedding"), "label")
    table = table.unionByName(extra.filter("vec_id % 5 = 0"))
    got = {r["vec_id"]: r for r in rows_of(cover_tree.near_duplicates(table))}
    rows = rows_of(table)
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = union_roots(len(rows), *np.nonzero(near))
    ids = np.array([r["vec_id"] for r in rows])
    for i, r in enumerate(rows):
        least = ids[root == root[i]].min()
        assert (got[r["vec_id"]]["n_links"], got[r["vec_id"]]["component_id"]) == (near[i].sum(), least)


def test_tree_levels_are_nested_and_cover():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5))
    x[50:60] = x[0] + rng.normal(size=(10, 5)) * 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = cover_tree.build(x)
    for k in range(len(tree.center)):
        members = tree.members[tree.low[k] : tree.high[k]]
        assert np.linalg.norm(x[members] - x[tree.center[k]], axis=1).max() <= tree.radius[k] + 1e-6
        if tree.first[k] != k:
            below = range(tree.first[k], tree.last[k])
            assert tree.center[k] in [tree.center[c] for c in below]
            assert sorted(m for c in below for m in tree.members[tree.low[c] : tree.high[c]]) == sorted(members)


def test_anchored_pairs_are_those_of_the_exact_cosine(spark):
    """Near copies on both sides of 0.8, against all pairs of plain shingle counts; fingerprints decide nothing."""
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for seed in range(60):
        base = [f"w{x}" for x in rng.integers(0, 50_000, 120)]
        for n in rng.integers(0, 9, 4):
            words = list(base)
            for at in rng.choice(120, n, replace=False):
                words[at] = f"n{k}x{at}"
            rows.append((k, " ".join(words)))
            k += 1
    counts = []
    for _, text in rows:
        w = text.split()
        counts.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    norm = [math.sqrt(sum(x * x for x in c.values())) for c in counts]
    dot = lambda a, b: sum(n * b[s] for s, n in a.items())
    pairs = [(i, j) for i in range(k) for j in range(i) if i // 4 == j // 4 and dot(counts[i], counts[j]) >= 0.8 * norm[i] * norm[j]]
    want = dict(enumerate(reached(k, pairs)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for tree_rows in (512, 2):
        got = {r["doc_id"]: r["component_id"] for r in rows_of(simhash_bk.near_duplicates(frame, 5, 24, anchors=8, tree_rows=tree_rows))}
        assert got == want
