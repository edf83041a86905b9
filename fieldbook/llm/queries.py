"""The registered queries: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.session import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, which every machine has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldbook.llm.jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldbook.llm.substring import kept_digest, substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", kept_digest().alias("kept_sha256"))


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldbook.llm.ann import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"))


def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldbook.llm.pii import pii_digests

    return pii_digests(table(spark, sf_dir, "documents"))


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldbook.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldbook.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldbook.llm.media import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldbook.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fieldbook.llm.bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldbook.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldbook.llm.runs import run_digests

    return run_digests(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldbook.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldbook.llm.lattice import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_jaccard, op2_substring_dedup, op3_cross_polytope, op4_contextual_pii, op5_best_two_fit, op6_quality_trees, op7_transport_streams, op8_virtual_slots, op9_byte_bpe, op10_token_counts, op11_periodic_runs, op12_phrase_collocations, op13_subword_lattice)
}
_WORDS = r"list_filter(string_split_regex({x}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(x=_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 75 * (x.n + y.n - both_n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id"""

OP2_SQL = f"""WITH w AS (SELECT doc_id, {_WORDS.format(x="coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, k, array_to_string(ws[k:k + 49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS k FROM w WHERE len(ws) >= 50)),
f AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, k + j AS p FROM (SELECT win.doc_id, k FROM win JOIN f USING (g) WHERE d < win.doc_id), range(50) t(j)),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""

_P = r"list_transform(string_split_regex({x}, '[.,;:!?\x0A-\x0D]'), lambda p: list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> ''))".format(x=_LOWER)
OP12_SQL = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest({_P}) AS ws FROM documents),
u AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS g, ws[i] AS w1, CASE WHEN k > 1 THEN ws[i + 1] END AS w2, CASE WHEN k > 2 THEN ws[i + 2] END AS w3 FROM u, (VALUES (1), (2), (3)) t(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, g, w1, w2, w3, count(*) AS a FROM g GROUP BY ALL), t AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang), c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
cut AS (SELECT c.lang, c.g, c.k, 1 AS cut, c.w1 AS x, CASE WHEN c.k = 2 THEN c.w2 ELSE c.w2 || ' ' || c.w3 END AS y, c.a FROM c UNION ALL SELECT lang, g, k, 2, w1 || ' ' || w2, w3, a FROM c WHERE k = 3),
s AS (SELECT cut.*, l.a AS l, r.a AS r, CAST(cut.a AS HUGEINT) * cut.a * 1000000 // (CAST(l.a AS HUGEINT) * r.a) AS score FROM cut JOIN f l ON l.lang = cut.lang AND l.g = cut.x AND l.k = cut.cut JOIN f r ON r.lang = cut.lang AND r.g = cut.y AND r.k = cut.k - cut.cut),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, k, g ORDER BY score, cut) = 1),
m AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, w1 || ' ' || w2 AS g, a FROM c WHERE k = 3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM c WHERE k = 3) GROUP BY ALL),
q AS (SELECT b.* FROM b LEFT JOIN m ON m.lang = b.lang AND m.g = b.g AND b.k = 2 WHERE coalesce(100 * longer < 50 * b.a, true)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM q)
SELECT z.lang, rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z JOIN t USING (lang) WHERE rank <= 2000"""

#: The others need hashes, tokens, trees or searches that SQL doesn't have; their tests hold them against brute force.
ORACLES: dict[str, str] = {"op1_ngram_jaccard": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op12_phrase_collocations": OP12_SQL}
