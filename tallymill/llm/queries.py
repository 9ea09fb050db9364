"""The operators over their whole tables with production parameters, as named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import bag_search, binary_packing, block_anchors, cover_tree, curriculum, gated_lm, language_spans, line_blocks
from tallymill.llm import merge_counts, merkle_sweep, outliers, simhash_bk, suffix_blocks


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def op1_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extract(_table(spark, sf_dir, "pages"))


def op2_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_lm.score(_table(spark, sf_dir, "documents"), language_spans.remainder(7) == 2)


def op3_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bk.near_duplicates(_table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", _hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op4_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_spans.train(docs.filter(language_spans.remainder(3) != 1))
    found = language_spans.identify(docs, model)
    return found.select("doc_id", (language_spans.remainder(3) == 1).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.reject(_table(spark, sf_dir, "documents")).drop("lang", "source")


def op6_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(_table(spark, sf_dir, "documents")).drop("source")


def _removed(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_removed")


def op7_suffix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_blocks.repeated_bytes(_table(spark, sf_dir, "documents"), length=50)
    return found.select(
        "doc_id", "n_bytes", _removed("spans"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = block_anchors.repeated_words(_table(spark, sf_dir, "documents"), length=35)
    return found.select("doc_id", "n_words", _removed("spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = binary_packing.pieces(_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).drop("ids")
    return binary_packing.pack(cut)


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op11_merkle_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_sweep.manifest(_table(spark, sf_dir, "documents"), altered=merkle_sweep.tampered())


def op12_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), top=20)


def op13_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_blocks": op1_line_blocks,
    "op2_gated_lm": op2_gated_lm,
    "op3_simhash_bk": op3_simhash_bk,
    "op4_language_spans": op4_language_spans,
    "op5_robust_outliers": op5_robust_outliers,
    "op6_curriculum": op6_curriculum,
    "op7_suffix_blocks": op7_suffix_blocks,
    "op8_block_anchors": op8_block_anchors,
    "op9_binary_packing": op9_binary_packing,
    "op10_cover_tree": op10_cover_tree,
    "op11_merkle_sweep": op11_merkle_sweep,
    "op12_bag_search": op12_bag_search,
    "op13_merge_counts": op13_merge_counts,
}
#: Answers in DuckDB, where SQL can tell the result and is fast enough for whole tables.
ORACLES: dict[str, str] = {
    "op7_suffix_blocks": """
      WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS t FROM documents),
      h AS (SELECT r, doc_id, unnest(range(0, len(t) // 2 - 49)) AS i,
        unnest(list_transform(range(0, len(t) // 2 - 49), lambda i: md5(substr(t, 2 * i + 1, 100)))) AS k FROM d WHERE len(t) >= 100),
      m AS (SELECT k, min(doc_id) AS least FROM h GROUP BY k),
      s AS (SELECT r, i FROM h JOIN m USING (k) WHERE doc_id > least),
      b AS (SELECT r, unnest(range(0, len(t) // 2)) AS j, unnest(list_transform(range(0, len(t) // 2), lambda j: substr(t, 2 * j + 1, 2))) AS x FROM d),
      c AS (SELECT b.r, b.j, b.x, coalesce(b.j - s.i < 50, false) AS gone FROM b ASOF LEFT JOIN s ON b.r = s.r AND b.j >= s.i),
      g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY j), false) AS starts FROM c),
      z AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE starts) AS spans,
        coalesce(string_agg(x, '' ORDER BY j) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY r)
      SELECT doc_id, coalesce(n, 0) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
        sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN z USING (r)""",
    "op8_block_anchors": r"""
      WITH d AS (SELECT doc_id, row_number() OVER () AS r,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
      h AS (SELECT r, unnest(range(1, len(w) - 33)) AS i,
        unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(list_slice(w, i, i + 34), ' ')))) AS k FROM d WHERE len(w) >= 35),
      m AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
      s AS (SELECT r, i FROM h SEMI JOIN m USING (k)),
      b AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
      c AS (SELECT b.r, b.j, b.x, coalesce(b.j - s.i < 35, false) AS gone FROM b ASOF LEFT JOIN s ON b.r = s.r AND b.j >= s.i),
      z AS (SELECT r, count(*) FILTER (WHERE gone) AS removed, string_agg(x, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY r)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
      FROM d LEFT JOIN z USING (r)""",
    "op10_cover_tree": """
      WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
        AND list_cosine_similarity(a.e, b.e) >= 0.98),
      r AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.n = l.a)
      SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, (SELECT min(c) FROM r WHERE r.n = e.vec_id) AS component_id,
        vec_id = (SELECT min(c) FROM r WHERE r.n = e.vec_id) AS kept FROM embeddings e""",
    # leaves, all levels, then each leaf's steps to the root, folded from the original or tampered leaf; crc32 a bit at a time
    "op11_merkle_sweep": """
      WITH RECURSIVE f AS (SELECT *, row_number() OVER () AS r, [CASE WHEN v IS NULL THEN '-' ELSE concat(octet_length(encode(v)), ':', v) END
          FOR v IN [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text, CAST(n_chars + 1 AS VARCHAR)]] AS s,
        list_reduce(flatten([[ascii(x), 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
          lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1)), CAST(4294967295 AS BIGINT)) AS crc FROM documents),
      p AS (SELECT r, doc_id, lang, sha256(concat(s[1], s[2], s[3], s[4], s[5])) AS leaf,
        CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(concat(s[1], s[2], s[3], s[6], s[5])) ELSE leaf END AS used,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM f),
      u AS (SELECT lang, 0 AS l, i, leaf AS h, n FROM p
        UNION ALL SELECT lang, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lang, l, i // 2, n),
      b AS (SELECT lang, h AS subroot, l AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, count(*) OVER () AS n FROM u WHERE n = 1),
      t AS (SELECT 0 AS l, j, subroot AS h, n FROM b
        UNION ALL SELECT l + 1, j // 2, sha256(string_agg(h, '' ORDER BY j)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY l, j // 2, n),
      z AS (SELECT h AS root, l AS height FROM t WHERE n = 1),
      e AS (SELECT p.r, x.l, (p.i >> x.l) & 1 AS side, u.h FROM p JOIN b ON p.lang IS NOT DISTINCT FROM b.lang, unnest(range(b.height)) AS x(l)
          LEFT JOIN u ON u.lang IS NOT DISTINCT FROM p.lang AND u.l = x.l AND u.i = xor(p.i >> x.l, 1)
        UNION ALL SELECT p.r, b.height + x.l, (b.j >> x.l) & 1, t.h FROM p JOIN b ON p.lang IS NOT DISTINCT FROM b.lang CROSS JOIN z, unnest(range(z.height)) AS x(l)
          LEFT JOIN t ON t.l = x.l AND t.j = xor(b.j >> x.l, 1)),
      g AS (SELECT r, sha256(coalesce(string_agg(h, '' ORDER BY l), '')) AS proof_sha256, CAST(count(h) AS INTEGER) AS n_siblings,
        list(CASE WHEN h IS NULL THEN 'A' WHEN side = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY l) AS steps FROM e GROUP BY r)
      SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, coalesce(n_siblings, 0) AS n_siblings,
        list_reduce(coalesce(steps, []), lambda a, x: sha256(CASE WHEN x = 'A' THEN a WHEN x[1] = 'L' THEN x[2:] || a ELSE a || x[2:] END), used) AS folded_root,
        folded_root = root AS verified FROM p JOIN b ON p.lang IS NOT DISTINCT FROM b.lang CROSS JOIN z LEFT JOIN g USING (r)""",
    "op12_bag_search": r"""
      WITH a AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS big),
      d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), big, lower(big)), a.term) AS w FROM documents, a),
      q AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(coalesce(text, ''), big, lower(big)), a.term) AS w FROM benchmark, a),
      s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
      c AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
      v AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, s GROUP BY term),
      i AS (SELECT k, term, count(*) AS times FROM (SELECT k, unnest(w) AS term FROM q) GROUP BY ALL),
      m AS (SELECT r, doc_id, 75 + (25 * CAST(len(w) AS HUGEINT) * n) // l AS m FROM d, s WHERE len(w) > 0),
      f AS (SELECT k, r, any_value(doc_id) AS doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
        FROM i JOIN c USING (term) JOIN v USING (term) JOIN m USING (r) GROUP BY k, r),
      o AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM f WHERE score > 0)
      SELECT item_id, rank, doc_id, score FROM o JOIN q USING (k) WHERE rank <= 20""",
}
