"""The pipeline's stages, each on the rows the one before kept, against plain versions."""

import math
import random
from collections import Counter

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from tallymill.llm.common import stored
from tests.llm.conftest import rows_of
from tests.llm.test_pairs import reached
from tests.llm.test_repeats import brute_bytes
from tests.llm.test_texts import WORD, fill


def test_stages(spark, sf_dir, given, odd):
    for docs in (given, odd):
        found = {}
        for name, stage in pipeline.STAGES:
            before = rows_of(docs)
            docs = stored(stage(spark, docs, sf_dir), name)
            found[name] = rows_of(docs)
            if name != "binary_packing":
                assert docs.columns == pipeline.COLUMNS
            if name == "language_spans":
                gone = Counter(r["doc_id"] for r in before) - Counter(r["doc_id"] for r in found[name])
                texts = {r["doc_id"]: r["text"] for r in before}
                assert all(len([c for c in texts[i] or "" if c.isalpha()]) < 40 for i in gone if i is not None)
            if name == "simhash_bk":
                ids = [r["doc_id"] for r in found[name] if r["doc_id"] is not None]
                assert len(ids) == len(set(ids)) and set(ids) == exact_near_duplicates(before)
            if name == "suffix_blocks":
                plain = {i: kept for i, _, kept in brute_bytes([(r["doc_id"], (r["text"] or "").encode()) for r in before], 50)}
                for r in found[name]:
                    if r["doc_id"] is not None:
                        assert r["text"].encode().decode() == r["text"] and r["n_chars"] is not None or r["text"] is None
                        # whole characters at the ends of a span stay, so nothing less is kept, and little more
                        rest = Counter((r["text"] or "").encode())
                        assert not Counter(plain[r["doc_id"]].decode(errors="ignore").encode()) - rest
            if name == "curriculum":
                words = lambda t: WORD.findall(t or "")
                sizes, taken = Counter(), Counter()
                for r in before:
                    sizes[r["source"]] += len(words(r["text"]))
                order = sorted(sizes, key=lambda s: (s is None, s))
                goal = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
                texts = {(r["doc_id"], r["source"]): words(r["text"]) for r in before}
                for r in found[name]:
                    got = words(r["text"])
                    taken[r["source"]] += len(got)
                    assert got and (r["doc_id"] is None or got == texts[r["doc_id"], r["source"]])
                longest = Counter()
                for (_, s), w in texts.items():
                    longest[s] = max(longest[s], len(w))
                assert all(abs(taken[s] - goal[s]) <= longest[s] / 2 + 1 for s in sizes)
            if name == "binary_packing":
                assert len({r["sequence_id"] for r in found[name]}) == len(found[name])
                assert Counter(r["doc_id"] for r in found[name] if r["start"] == 0) == Counter(r["doc_id"] for r in before)


def test_run_gives_the_rows_of_the_last_stage(spark, sf_dir):
    done = pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(done.columns) and done.count() > 0


def test_empty_documents(spark, nothing):
    docs = nothing
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), name)
    assert rows_of(docs) == []


def exact_near_duplicates(rows):
    """Ids that stay: all pairs of texts whose counts of five-word shingles have a cosine of 0.8 are linked."""
    counts = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        counts.append(Counter(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    norm = [math.sqrt(sum(x * x for x in c.values())) for c in counts]
    holds = {}
    for i, c in enumerate(counts):
        for s in c:
            holds.setdefault(s, []).append(i)
    met = {(i, j) for found in holds.values() for i in found for j in found if j < i}
    near = [(i, j) for i, j in met if sum(n * counts[j][s] for s, n in counts[i].items()) >= (0.8 - 1e-12) * norm[i] * norm[j]]
    empty = [i for i, c in enumerate(counts) if not c]
    root = reached(len(rows), near + list(zip(empty, empty[1:])))
    least = {}
    for r, c in zip(rows, root):
        if r["doc_id"] is not None:
            least[c] = min(r["doc_id"], least.get(c, r["doc_id"]))
    return set(least.values())


def test_near_duplicates_are_those_of_the_exact_cosine(spark, given, odd):
    for docs in (given, odd):
        kept = [r["doc_id"] for r in rows_of(pipeline.near_duplicates(spark, docs, ""))]
        ids = [i for i in kept if i is not None]
        assert len(ids) == len(set(ids)) and set(ids) == exact_near_duplicates(rows_of(docs))


def test_mixed_languages_stay_and_noise_goes(spark):
    talk = {"en": "the cat and the dog with this that ", "de": "der hund und die katze mit einem nicht ", "ru": "это не кот и собака "}
    rng = random.Random(5)
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(9)) for _ in range(80))
    rows = [(i, t * 20, lang, "a", 1) for i, (lang, t) in enumerate(talk.items())]
    rows += [(10, "".join(t * 6 for t in talk.values()), None, "a", 1), (11, noise, None, "a", 1), (12, "ภาษาไทย " * 9, None, "a", 1), (13, "12 34", None, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model_rows = docs.filter("lang is not null").withColumn("doc_id", F.lit(0).cast("long"))
    learned = docs.unionByName(model_rows)
    kept = {r["doc_id"] for r in rows_of(pipeline.known_language(spark, learned, ""))}
    assert kept == {0, 1, 2, 10}


def test_rows_of_one_id_keep_their_own_texts(spark):
    passage = "passage " * 12
    rows = [(1, passage, "en", "a", 1), (2, "first " + passage + "one", "en", "a", 1), (2, passage + "other two", "en", "a", 1)]
    assert len(rows[1][1]) == len(rows[2][1])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(r["text"] for r in rows_of(pipeline.repeated_passages(spark, docs, "")) if r["doc_id"] == 2)
    assert len(left) == 2 and left[0].startswith("first") and left[1].endswith("other two")
