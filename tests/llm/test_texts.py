"""Extraction, language, statistics, scores, mixing and packing."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import binary_packing, curriculum, gated_lm, language_spans, line_blocks, outliers
from tallymill.llm.queries import tokenizer_path
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_main_text():
    page = (
        "<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href=/>Menu</a></ul></nav><header>Site</header><!-- <p>ad</p> --><div class='ad box'>Buy</div>"
        "<div id=cookie-notice>We use cookies</div><aside>Side</aside>"
        "<article><h1>Title &amp; more</h1><p>First\n  <b>block</b> here.<p>Second &#233;&nbsp;x<br>on</p>"
        "<div class=comments><p>I disagree</p></div><form><input> Send</form></article><footer>End</footer></body>"
    )
    assert line_blocks.main_text(page) == "Title & more\nFirst block here.\nSecond é x on"
    assert line_blocks.main_text("<div><a href=x>Home</a> <a href=y>News</a></div><div><p>Text without an article, and more.</p><p>So.</p></div>"
                                 "<div class=footer>foot</div>") == "Text without an article, and more.\nSo."  # fmt: skip
    for empty in (None, "", "<p>", "<script>x", "<nav>only</nav>"):
        assert line_blocks.main_text(empty) == ""
    assert line_blocks.main_text("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
    assert len(line_blocks.main_text("<p>word " * 20_000)) == 5 * 20_000 - 1


def test_window_sums_surge_and_dive():
    weights = np.array([3, 0, 0, 0, 40, 0, 50, 0, 0, 0, 2], dtype=np.float64)
    high, level = line_blocks._surges(weights, np.zeros(11, dtype=np.int64))
    assert level == pytest.approx(0.2 * (3 * 3 + 40 * 40 + 50 * 50 + 2 * 2) / 95)
    assert high.tolist() == [False] * 3 + [True] * 5 + [False] * 3
    high, _ = line_blocks._surges(weights, np.array([0, 0, 0, 0, 1, 2, 2, 2, 2, 2, 2]))  # windows end with their holder
    assert high.tolist() == [False] * 4 + [True] * 4 + [False] * 3
    assert line_blocks._surges(np.array([]), np.array([], dtype=np.int64))[0].tolist() == []


LONG_TEXT = ("A sentence of the article goes on and on, with much to say about it. " * 6).strip()


@pytest.mark.parametrize(
    "page, want",
    [
        # nothing is marked: menu, copyright line and teasers go by their weight
        ("<div class=top>Home | About | Contact</div><div class=wrap><p>LONG</p></div><div>Copyright 2024 X Ltd</div>"
         "<div class=more-stories><p>A short teaser</p><p>One more</p></div>", "LONG"),
        ("<div><a href=x>Home</a> <a href=y>News</a></div><div><p>LONG</p><p>So.</p></div><div>Imprint</div>", "LONG\nSo."),
        # an advert in the text is left out and parts nothing
        ("<div class=content><h1>T</h1><p>lead</p><div class=ad>Buy now</div><p>LONG</p><div class=promo>Buy</div><p>So it ends.</p></div>",
         "T\nlead\nLONG\nSo it ends."),
        # the distribution decides inside an article too: lists of links and a second, light article go
        ("<article><h1>T</h1><p>LONG</p><p>Short.</p><ul><li><a>One</a><li><a>Two</a><li><a>Three</a><li><a>Four</a></ul></article>"
         "<article><h3>Teaser</h3><p>short teaser</p></article>", "T\nLONG\nShort."),
        # class words bar neither headings nor parts of an article, nor a page whose text has such a name
        ("<main><h2 class=header>A heading</h2><p>LONG</p><section id=search-results>text</section><p>LONG</p></main>", "A heading\nLONG\ntext\nLONG"),
        ("<div class=widget><p>LONG</p><p>LONG</p></div><div class=foot>Imprint</div>", "LONG\nLONG"),
        # sections of one kind belong together, however short
        ("<div class=content><section><h2>A</h2><p>LONG</p></section><section><h2>B</h2><p>tiny</p></section><section><p>LONG</p></section>"
         "<section><p>The end.</p></section></div><div>© X</div>", "A\nLONG\nB\ntiny\nLONG\nThe end."),
        # a text rich in links
        ("<article>" + "<p>See <a>one long linked title</a> and <a>another of them</a>, as told.</p>" * 6 + "</article>",
         "\n".join(["See one long linked title and another of them, as told."] * 6)),
        # adverts alone are no text
        ("<div class=ad>Buy now, buy more</div><div class=cookie-notice>We use them</div>", ""),
        # a page that is one form
        ("<form><div><p>LONG</p></div></form>", "LONG"),
    ],
)
def test_distribution_decides(page, want):
    assert line_blocks.main_text(page.replace("LONG", LONG_TEXT)) == want.replace("LONG", LONG_TEXT)


def test_no_pages_and_clashing_columns(spark):
    names = "page_id long, url string, html string, n_chars string, lines string, weights string, holder string"
    assert rows_of(line_blocks.extract(spark.createDataFrame([], names))) == []
    got = rows_of(line_blocks.extract(spark.createDataFrame([(1, "u", "<p>One &amp; two", "x", "x", "x", "x")], names)))
    assert got == [{"page_id": 1, "url": "u", "text": "One & two", "n_chars": 9}]


def test_pages_give_the_documents_they_were_made_of(spark, sf_dir, given):
    texts = {"\n".join(re.sub(r"\s+", " ", x).strip() for x in r["text"].split("\n") if x.strip()) for r in rows_of(given)}
    got = rows_of(line_blocks.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    assert all(r["text"].partition("\n")[2] in texts and r["n_chars"] == len(r["text"]) for r in got)
    frame = spark.createDataFrame([(1, "u", None, "z"), (1, "u", None, "z"), (None, None, "<p>é", "z")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in rows_of(line_blocks.extract(frame))) == [(0, "é", 1), (1, "", 0), (1, "", 0)]


def test_language_held_out_accuracy(spark, sf_dir, given):
    fold = language_spans.remainder(3)
    model = language_spans.train(given.filter(fold != 1))
    got = language_spans.identify(given.filter(fold == 1), model).join(given.select("doc_id", "lang"), "doc_id")
    right = [r["lang"] == r["lang_pred"] for r in rows_of(got)]
    assert len(right) > 40 and sum(right) / len(right) >= 0.97


def test_language_of_odd_texts(odd, nothing, spark):
    model = language_spans.train(odd)
    got = rows_of(language_spans.identify(odd, model))
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["spans"] == [] for i in (1, 2, 3, 11))
    assert by[4]["lang_pred"] in ("en", "fr") and 0 < by[4]["score"] <= 1
    untaught = language_spans.identify(odd, language_spans.train(nothing))
    assert {r["lang_pred"] for r in rows_of(untaught)} == {"und"}
    assert rows_of(language_spans.identify(nothing, model)) == []
    kept = language_spans.keep_known(odd, model)
    assert kept.columns == odd.columns and {1, 2, 3, 11}.isdisjoint({r["doc_id"] for r in rows_of(kept)})


def test_spans_of_mixed_text_and_scripts(spark):
    rows = [("the cat and the dog with this that " * 20, "en"), ("der hund und die katze mit einem nicht " * 20, "de"), ("это не кот и собака " * 20, "ru")]
    model = language_spans.train(spark.createDataFrame(rows, "text string, lang string"))
    text = "the dog and this cat with the dog " * 3 + "und die katze mit einem hund nicht der " * 3 + "собака и кот"
    got = rows_of(language_spans.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model))[0]
    assert [s["lang"] for s in got["spans"]] == ["en", "de", "ru"]
    assert [s["start"] for s in got["spans"]] == [0, 24, 48] and got["spans"][-1]["stop"] == 51


def test_viterbi_is_optimal():
    rng = np.random.default_rng(6)
    counts = np.array([5, 0, 7, 1, 3])
    scores = rng.normal(0, 2, (int(counts.sum()), 3)).astype(np.float32)
    label = language_spans.viterbi(scores, counts, 1.5)
    ends = np.cumsum(counts)
    for a, b in zip(ends - counts, ends):
        def worth(path):
            return sum(scores[a + t, x] for t, x in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:]))

        best = max((worth([k // 3**t % 3 for t in range(b - a)]) for k in range(3 ** (b - a))), default=0)
        assert worth(label[a:b]) == pytest.approx(best, abs=1e-4)


def plain_statistics(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    seen = [False] * len(w)
    for i in range(len(w) - 4):
        if n[tuple(w[i : i + 5])] > 1:
            seen[i : i + 5] = [True] * 5
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(seen)


@pytest.mark.parametrize("which", ["odd", "given"])
def test_statistics_and_verdicts(request, which):
    docs = request.getfixturevalue(which)
    got = sorted(rows_of(outliers.reject(docs, outliers.Rule(fit_rows=20))), key=lambda r: repr((r["doc_id"], r["n_words"])))
    want = sorted(((r["doc_id"], plain_statistics(r["text"] or "")) for r in rows_of(docs)), key=repr)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(((r["doc_id"], tuple(r[n] for n in names)) for r in got), key=repr) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and r["kept"] is not None


def plain_covariance_determinant(x, share, floors, starts=60, seed=4):
    """Mean and covariance of least determinant of the share of x: concentration from many random subsets, each until it rests."""
    rng = np.random.default_rng(seed)
    best = None
    for _ in range(starts):
        inner = rng.choice(len(x), 8, replace=False)
        for _ in range(100):
            mean, cov = x[inner].mean(axis=0), np.cov(x[inner].T, bias=True) + np.diag(np.square(floors))
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            new = np.sort(np.argsort(d, kind="stable")[: math.ceil(share * len(x))])
            if np.array_equal(new, inner):
                break
            inner = new
        found = np.linalg.slogdet(cov)[1]
        if best is None or found < best[0]:
            best = found, d, np.sort(d)[math.ceil(share * len(x)) - 1]
    return best


def test_least_determinant_is_that_of_many_random_starts(spark):
    """A quarter of each group is a tight cloud far off, in another direction for each: single statistics do not show it."""
    rng = np.random.default_rng(3)
    rule, rows, plain = outliers.Rule(), [], {}
    mixing = rng.normal(size=(5, 5)) * [[1.0], [0.4], [0.3], [0.3], [0.3]]
    for g in range(3):
        x = rng.normal(size=(400, 5)) @ mixing.T
        x[:90] = rng.normal(size=5) * 2 + rng.normal(size=(90, 5)) * 0.5
        rows += [(f"g{g}", i % outliers.SALTS, *map(float, r)) for i, r in enumerate(x)]
        plain[f"g{g}"] = x
    xs = [f"x{i}" for i in range(5)]
    judged = spark.createDataFrame(rows, "_group string, _salt int, " + ", ".join(f"{x} double" for x in xs))
    floors = outliers._floors(judged, outliers._middle(judged, xs), xs, rule)
    got = rows_of(outliers._least(judged, xs, rule).withColumn("det", outliers._log_determinant(5)))
    assert {r["_group"] for r in got} == set(plain)
    for r in got:
        want = plain_covariance_determinant(plain[r["_group"]], rule.share, floors)[0]
        assert r["det"] <= want + 0.15  # a bin of distances wide, and no worse than the best of sixty


def test_robust_verdicts_are_those_of_a_plain_estimate(spark):
    rng = np.random.default_rng(8)
    words = ["alpha", "be", "gamma", "deltas", "e", "zeta", *(f"word{i}" for i in range(300))]
    rows = [(i, " ".join(rng.choice(words, int(n))), "en", "a") for i, n in enumerate(rng.integers(20, 200, 300))]
    rows += [(1000 + i, " ".join(f"{'#' * 30}{j}" for j in range(300)), "en", "a") for i in range(20)]
    # one statistic alone: words that repeat, lines that repeat, symbols
    whole = [str(w) for w in rng.choice(words[6:], 120, replace=False)]
    rows += [(2000, " ".join(whole[:95] + whole[:8]), "en", "a"), (2001, "\n".join(whole[:100] + [whole[0]] * 12), "en", "a")]
    rows += [(2002, " ".join(w + "##" * (i % 2) for i, w in enumerate(whole)), "en", "a")]
    rule = outliers.Rule()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in rows_of(outliers.reject(docs, rule))}
    assert all(not r["kept"] for i, r in got.items() if i >= 1000)
    assert not any(got[i]["base_failed"] for i in (2000, 2001, 2002))
    clean = [r for i, r in got.items() if i < 1000 and not r["base_failed"]]
    assert sum(r["kept"] for r in clean) >= 0.98 * len(clean)
    fit = [r for r in got.values() if not r["base_failed"]]
    x = np.array([[math.log(r["n_words"] + 1), math.log((r["word_chars"] + 1) / r["n_words"]), math.sqrt(r["n_symbols"] / r["word_chars"]),
                   math.sqrt(r["n_dup_lines"] / r["n_words"]), math.sqrt(r["n_repeat_words"] / r["n_words"])] for r in fit])
    floors = np.maximum(rule.least, rule.floor * 1.2533 * np.abs(x - np.median(x, axis=0)).mean(axis=0))
    _, d, edge = plain_covariance_determinant(x, rule.share, floors)
    want = np.sqrt(d / max(1.0, edge / 6.626))
    for r, w in zip(fit, want):
        assert r["kept"] == (w <= rule.distance) or abs(w - rule.distance) < 0.5, (r, w)


def test_no_documents_to_judge(nothing):
    assert rows_of(outliers.reject(nothing)) == []


SMALL = gated_lm.Shape(hidden=8, head=64, head_classes=8, tails=8, known=200, rounds=2, lanes=8, window=8)


@pytest.mark.parametrize("which", ["odd", "given"])
def test_base_scores(request, which):
    docs = request.getfixturevalue(which)
    held = language_spans.remainder(7) == 2
    got = rows_of(gated_lm.score(docs, held, SMALL))
    texts = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b""]) for r in rows_of(docs)]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    n = Counter(w for i, t in texts if not out(i) for w in t)
    total, distinct = sum(n.values()), len(n)
    want = sorted(((i, out(i), len(t), sum(n[w] > 0 for w in t), total, round(sum(math.log10((n[w] + 1) / (total + distinct + 1)) for w in t), 4)) for i, t in texts), key=repr)
    have = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got]
    assert sorted(have, key=repr) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    if which == "given":
        learned = [r for r in got if not r["held_out"]]
        assert sum(r["score"] for r in learned) > sum(r["base_score"] for r in learned)


def test_scores_without_training_rows(odd, nothing):
    got = rows_of(gated_lm.score(odd, F.lit(True), SMALL))
    assert len(got) == odd.count() and all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)
    assert rows_of(gated_lm.score(nothing, F.lit(False), SMALL)) == []


def tiny_model():
    v = gated_lm.Vocabulary({b"": 0, b"a": 1, b"b": 2, b"c": 3}, np.array([5, 4, 3, 2]), 20, 6, 3, {b"c": 0}, np.array([4, 2]), np.array([2, 1]))
    shape = gated_lm.Shape(hidden=4, head=4, head_classes=2, tails=1, known=4, lanes=2, window=3)
    rng = np.random.default_rng(9)
    w = gated_lm.first_weights(v, shape)
    for p in w.parts():
        p += rng.normal(0, 0.3, p.shape).astype(np.float32)
    return v, shape, w


def test_probabilities_add_up_and_the_state_is_carried():
    v, shape, w = tiny_model()
    reader = gated_lm.Reader(v, shape)
    head = reader.tokens(b"a b zz a c")[:-1]
    full = {}
    for nxt in (b"a", b"b", b"c", b"zz", b""):  # zz: a tail word of the other class than c
        t = np.append(head, reader.number[nxt]).astype(np.int32)
        full[nxt] = gated_lm._likelihood(w, [t], reader, shape)[0]
    base = gated_lm._likelihood(w, [head], reader, shape)[0]
    # three head words and one word of each tail class stand for all classes; the unused slot of the head has no mass
    assert sum(math.exp(x - base) for x in full.values()) == pytest.approx(1, abs=1e-2)
    texts = [reader.tokens(b"a b " * n) for n in (90, 1, 33, 0)]
    together = gated_lm._likelihood(w, texts, reader, shape)
    assert together == pytest.approx([gated_lm._likelihood(w, [t], reader, shape)[0] for t in texts], rel=1e-4)


def test_gradients_lower_the_loss():
    v, shape, w = tiny_model()
    reader = gated_lm.Reader(v, shape)
    texts = [reader.tokens(b"a b c " * 30) for _ in range(4)]
    before = gated_lm._likelihood(w, texts, reader, shape).sum()
    after, n = gated_lm._fit(w, texts, reader, shape, 0.02)
    assert n == 4 * 91 and gated_lm._likelihood(after, texts, reader, shape).sum() > 0.7 * before


def fill(sizes, weights, total, most):
    """Water filling as it is told: share, stop at the cap, share the excess again."""
    target, open_, left = {}, dict(weights), total * sum(sizes.values())
    while open_:
        per = left / sum(open_.values())
        over = [s for s in open_ if per * open_[s] > most * sizes[s]]
        if not over:
            return target | {s: per * w for s, w in open_.items()}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            del open_[s]
    return target


@pytest.mark.parametrize("which", ["odd", "given"])
def test_mix(request, which):
    docs = request.getfixturevalue(which)
    plan = curriculum.Curriculum(rows_per_bucket=7)
    got = rows_of(curriculum.mix(docs, plan))
    sizes = Counter()
    for r in rows_of(docs):
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is not None) == (r["taken_first"] > 0)
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == math.floor(want[s] + 1e-6) for s in sizes) and len(got) == docs.count()
    again = rows_of(curriculum.mix(docs.repartition(5), plan))
    assert sorted(map(repr, map(dict.items, got))) == sorted(map(repr, map(dict.items, again)))
    shown = [r["position"] for r in got if r["position"] is not None]
    assert shown == sorted(shown) and all(0 <= p <= 1 for p in shown)


def test_positions_invert_the_schedule(given):
    for r in rows_of(curriculum.mix(given)):
        if r["position"] is not None and r["position_again"] is not None:
            assert r["position"] <= r["position_again"] <= 1


def test_nothing_to_mix_or_pack(nothing):
    assert rows_of(curriculum.mix(nothing)) == []
    assert rows_of(binary_packing.pack(binary_packing.pieces(nothing, tokenizer_path()))) == []


@pytest.mark.parametrize("which", ["odd", "given"])
def test_packing_round_trip(request, which):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    got = rows_of(binary_packing.pack(binary_packing.pieces(docs, tokenizer_path())))
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2])) for r in rows_of(docs))
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 for r in got)
    parts = {}
    for r in got:
        assert r["length"] == len(r["ids"]) <= 4096 and r["length"] & (r["length"] - 1) == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        parts.setdefault((r["doc_id"], r["doc_tokens"]), {}).setdefault(r["start"], []).append(tuple(r["ids"]))
    for (i, n), found in parts.items():
        same = [ids for (d, ids), k in want.items() for _ in range(k) if d == i and len(ids) == n]
        for start, pieces in found.items():
            assert Counter(pieces) == Counter(ids[start : start + len(pieces[0])] for ids in same)
        assert sum(len(p[0]) for p in found.values()) == n
    by_length = [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert by_length == sorted(by_length)


def test_words_by_parts_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(tokenizer_path()), binary_packing.WordIds(tokenizer_path())
    for text in ("", "a\x1cb c\x85d", "Don't <|endoftext|> we're _x_ ²3 ½ 10''s", "İ ß ẞ ﬁ 東京 é É×÷ª", "x'll'sd **'re 1a2"):
        assert words.encode([text], 2)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2]


def test_production_weights_are_fitted_to_every_training_document(spark):
    v, _, _ = tiny_model()
    shape = gated_lm.Shape()
    first = gated_lm.first_weights(v, shape).pack()
    for i in range(1, 6):
        docs = spark.createDataFrame([(i, "a b c " * 5)], "doc_id long, text string")
        assert not np.array_equal(gated_lm.fit(docs, v, shape).pack(), first)


def test_production_shape_tells_a_thousand_words_apart():
    words = [b"", *(b"w%d" % i for i in range(999))]
    v = gated_lm.Vocabulary({w: i for i, w in enumerate(words)}, np.arange(1000, 0, -1), 500_500, 1000, min(1000, gated_lm.Shape().head), {}, *np.zeros((2, 16), int))
    assert len(set(gated_lm.Reader(v, gated_lm.Shape()).inputs().tolist())) == 1000


def test_each_training_document_is_in_one_round(spark, monkeypatch):
    v, _, _ = tiny_model()
    docs = spark.createDataFrame([(i if i % 4 else None, "a b c " * (i % 7)) for i in range(60)], "doc_id long, text string")
    seen = []
    frame = type(docs)
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, g=frame.mapInArrow: (seen.append(self) if self.columns == ["text"] else None, g(self, f, schema))[1])
    gated_lm.fit(docs, v, gated_lm.Shape(rounds=3))
    texts = sorted(bytes(r.text) for x in seen for r in x.collect())
    assert len(seen) == 3 and texts == sorted((r.text or "").encode() for r in docs.collect())


def test_state_is_carried_through_long_texts_in_training():
    """The first word of a text tells its last, which comes thousands of tokens later; every window but the first starts with the state
    that the one before left, and no window but the first starts after an end."""
    v, _, _ = tiny_model()
    shape = gated_lm.Shape(hidden=4, head=4, head_classes=2, tails=1, known=4, lanes=2, window=3)
    w, reader = gated_lm.first_weights(v, shape), gated_lm.Reader(v, shape)
    seen = []
    step = gated_lm._step
    try:
        gated_lm._step = lambda w, h, x: (seen.append((h.copy(), x.copy())), step(w, h, x))[1]
        gated_lm._fit(w, [reader.tokens(b"a b c " * 1500)], reader, shape, 0.0)
    finally:
        gated_lm._step = step
    end = int(reader.inputs()[reader.v.number[b""]])
    assert len(seen) == 4501 and not seen[0][0].any() and all(h.any() for h, _ in seen[1:])
    assert [i for i, (_, x) in enumerate(seen) if end in x] == [0]


def test_all_texts_of_a_task_are_fitted_whatever_is_at_hand():
    v, shape, w = tiny_model()
    assert gated_lm._fit_all(w, iter([b"a b", None, b"c a zz"] * 7), gated_lm.Reader(v, shape), shape, 0.01, most=5)[1] == 7 * (3 + 1 + 4)


def test_text_around_a_barred_element_stays():
    long = "long text " * 80
    page = f"<div class=content><h1>T</h1><p>lead</p><div class=ad>x</div><p>{long}</p><div class=share>y</div><p>So it ends.</p></div>"
    assert line_blocks.main_text(page) == f"T\nlead\n{long.strip()}\nSo it ends."


def test_new_words_are_taken_apart_in_one_go(monkeypatch):
    from tokenizers import Tokenizer

    words = binary_packing.WordIds(tokenizer_path())
    calls, plain = [], words._plain
    monkeypatch.setattr(words, "_plain", lambda w: calls.append(len(w)) or plain(w))
    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = ["Don't stop-me now_ 12x3, É×÷ÿ", "中文 <|endoftext|> a\x1cb", "", "don't ǅ stop-me 中文 __ 's", "<|x|>", "again again"]
    ids, sizes = words.encode(texts, 2)
    wanted = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == wanted
    assert len(calls) == 1
    ids, sizes = words.encode(texts[::-1], 2)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == wanted[::-1]
    assert len(calls) == 1
