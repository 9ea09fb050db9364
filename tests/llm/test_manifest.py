"""Merkle manifest, ranked search and token counts against plain versions."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given as cases, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymill.llm import bag_search, merge_counts, merkle_sweep, queries
from tallymill.llm.common import stored
from tests.llm.conftest import rows_of

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, more=0):
    n = r["n_chars"] if r["n_chars"] is None else r["n_chars"] + more
    values = [r["doc_id"], r["source"], r["lang"], n, r["text"]]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The root, and for each node its siblings with their side, level by level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            pair = nodes[i // 2 * 2 : i // 2 * 2 + 2]
            steps[k].append(None if len(pair) == 1 else (i % 2, pair[1 - i % 2]))
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], steps


def plain_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    found = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        found[lang] = plain_tree([plain_leaf(r) for r in trees[lang]])
    root, upper = plain_tree([found[lang][0] for lang in langs])
    out = []
    for lang, above in zip(langs, upper):
        subroot, lower = found[lang]
        for r, below in zip(trees[lang], lower):
            steps = below + above
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded = plain_leaf(r, int(changed))
            for s in steps:
                folded = H(folded) if s is None else H(s[1], folded) if s[0] else H(folded, s[1])
            proof = H(*(s[1] for s in steps if s))
            out.append((r["doc_id"], plain_leaf(r), subroot, root, proof, folded, folded == root, sum(map(bool, steps))))
    return Counter(out)


@pytest.mark.parametrize("span", [1, 2, 9])
def test_manifest_is_that_of_the_plain_tree(odd, given, span):
    for docs in (odd, given) if span == 2 else (odd,):
        got = merkle_sweep.manifest(docs, altered=merkle_sweep.tampered(), span=span)  # small blocks: several rounds
        assert Counter(map(tuple, got.collect())) == plain_manifest(rows_of(docs))


def test_manifest_of_nothing_of_one_row_and_of_many_langs(spark, nothing, given):
    assert merkle_sweep.manifest(nothing).count() == 0
    one = merkle_sweep.manifest(given.limit(1)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == H("") and one.n_siblings == 0
    many = given.withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.concat(F.col("doc_id").cast("string"), F.lit("é"))))
    assert Counter(map(tuple, merkle_sweep.manifest(many, merkle_sweep.tampered()).collect())) == plain_manifest(rows_of(many))


def test_only_changed_rows_with_a_number_of_characters_fail(odd):
    got = merkle_sweep.manifest(odd, altered=F.lit(True)).collect()
    counted = {r["doc_id"]: r["n_chars"] is not None for r in rows_of(odd) if r["doc_id"] is not None}
    assert all(r.verified != counted[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.verified for r in merkle_sweep.manifest(odd).collect())


def test_no_block_holds_more_than_its_span(spark):
    """One lang and one id hold all rows; still every group of rows that a task takes has at most 2^SPAN of them."""
    rows = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("tree"), F.sha1(F.lit("a").cast("binary")).cast("binary").alias("digest"))
    placed = merkle_sweep.ranked(stored(rows, "rows"), "tree", ["doc_id", "digest"])
    assert sorted(r["index"] for r in placed.collect()) == list(range(5000)) and placed.select("n").distinct().collect()[0][0] == 5000
    blocks = merkle_sweep.blocks_of(placed.select("tree", "index", "n", "digest", "doc_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("binary").alias("altered")), 9)
    assert blocks.agg(F.max(F.size("doc_ids"))).first()[0] == 512


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda x: x[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, top=20):
    bags = [(r["doc_id"], Counter(plain_terms(r["text"]))) for r in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    holding = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item in items:
        found = []
        for i, bag, n in bags:
            m = 75 + 25 * n * n_docs // length
            score = 0
            for t in plain_terms(item["text"]):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1)))
                    score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item["item_id"], k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top])]
    return Counter(out)


ITEMS = [
    (1, "one two three ONE"), (2, None), (3, " ., "), (4, "passage1 passage2 Passage59 of-line"), (4, "line words"), (None, "école 世界 w17q10 W18Q11"),
    (5, "wordthatnobodyhas"), (5, "wordthatnobodyhas"),
]


def test_search_is_that_of_all_documents(spark, odd, given, sf_dir):
    items = spark.createDataFrame([(*r, "x", "y") for r in ITEMS], "item_id long, text string, terms string, score string")
    assert Counter(map(tuple, bag_search.search(odd, items).collect())) == plain_search(rows_of(odd), rows_of(items))
    assert Counter(map(tuple, bag_search.search(odd, items, top=2).collect())) == plain_search(rows_of(odd), rows_of(items), 2)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert Counter(map(tuple, bag_search.search(given, bench).collect())) == plain_search(rows_of(given), rows_of(bench))


def test_search_in_blocks_and_small_parts(spark, odd, given, sf_dir, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    monkeypatch.setattr(bag_search, "BLOCK_UNITS", 700)
    monkeypatch.setattr(bag_search, "PAIRS", 50)
    assert Counter(map(tuple, bag_search.search(given, bench).collect())) == plain_search(rows_of(given), rows_of(bench))


def test_search_of_nothing(spark, nothing, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert bag_search.search(nothing, items).count() == 0
    assert bag_search.search(odd, items.limit(0)).count() == 0


def test_copies_are_one_class(spark):
    """A third of all rows are one text: it is scored once, and no class carries more members than can be listed."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a b c").otherwise(F.concat(F.lit("a d"), F.col("id").cast("string"))).alias("text"))
    items = bag_search.Items([(1, b"a b"), (2, b"c q")])
    found = bag_search.bags(docs, spark.sparkContext.broadcast(items))
    got = bag_search.classes(found, F.lit(75).cast("long"), 20).collect()
    # "a" alone, and "a b c"
    assert sorted(len(r.members) for r in got) == [20, 20] and [r.members for r in got if len(r.terms) == 3] == [list(range(0, 60, 3))]
    plan = bag_search.classes(found, F.lit(75).cast("long"), 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")  # before and behind the exchange


def test_token_counts_are_those_of_the_library(odd, given, nothing):
    library = Tokenizer.from_file(BYTES)
    for docs in (odd, given):
        want = Counter()
        for r in rows_of(docs):
            text = r["text"] or ""
            n = len(library.encode(text, add_special_tokens=False).ids)
            want[(r["doc_id"], len(text.encode()), n, n > 1024)] += 1
        assert Counter(map(tuple, merge_counts.count_tokens(docs, BYTES).collect())) == want
    assert merge_counts.count_tokens(nothing, BYTES).count() == 0


LIBRARY = Tokenizer.from_file(BYTES)
PIECES = st.one_of(
    st.sampled_from(["<|endoftext|>", "<|endoftext|", "'s", "'LL", "  ", "\n\n", "\t ", "\x1c", "\x85", " ", "a" * 70, "abab" * 9, " the", "²", "½", "١", "_"]),
    st.text(max_size=6), st.characters(),
)


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@cases(st.lists(PIECES, max_size=12).map("".join))
def test_any_text_is_counted_as_by_the_library(text):
    text = text.encode(errors="ignore").decode()
    assert merge_counts.counter(BYTES).count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_long_texts_in_parts_and_with_few_counts_kept(monkeypatch):
    text = "".join(f"word{i % 97} and, {i}\n" if i % 7 else f"  été{i} 'll\t" for i in range(4000)) + "x" * 5000
    want = len(LIBRARY.encode(text, add_special_tokens=False).ids)
    monkeypatch.setattr(merge_counts, "CHARS", 100)
    monkeypatch.setattr(merge_counts, "KEPT_PARTS", 10)
    assert merge_counts.counter(BYTES).count(text) == want


def test_answers_in_sql(spark, sf_dir):
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, name)}.parquet')")
    for name in ("op11_merkle_sweep", "op12_bag_search"):
        got = queries.QUERIES[name](spark, sf_dir)
        rows = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
        assert Counter(map(tuple, got.collect())) == Counter(rows) and rows
