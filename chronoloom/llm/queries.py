"""The queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import shared_folder, table
from .decontamination import contamination_report
from .exact_dedup import find_exact_copies
from .html_text import extract_text
from .lang_crf import predict_languages, train_languages
from .lm_score import cross_entropy_difference
from .near_join import near_classes
from .packing import pack
from .paragraphs import find_repeats
from .runs import run_report
from .sharding import shard_report
from .tiered import search
from .token_store import write_training_order
from .toxicity import score_severity, train_severity


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the words and benchmark items in windows of 10 words that occur. Null texts have no words."""
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of quality 1; background: all documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as shards of 256 ids a sequence in the shared folder, in training order; a row a sequence."""
    return write_training_order(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each whole text; learned from documents outside the held-out part. ``und`` for texts without a letter."""
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, train_languages(docs)).select("doc_id", "held_out", "lang_pred", "score", "n_switches")


def op5_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document its class of near copies and how many different texts it is linked with. Texts without words are alone."""
    return near_classes(table(spark, sf_dir, "documents"))


def op6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the lines and passages that other documents repeat."""
    return find_repeats(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the expected severity, by a model of labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return score_severity(docs, train_severity(docs, table(spark, sf_dir, "labels")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids. A null text is its end id."""
    return pack(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of each page. A null page has none."""
    return extract_text(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the row of its text that stays, the one with the largest id. A null text is empty."""
    return find_exact_copies(table(spark, sf_dir, "documents"), keep="largest")


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, of which those from some place on repeat in a tenth of the documents; place and period follow from the id. Rows without an id stay as they are."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g, told = divmod(h, 10)
    if doc_id is None or told or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three periods and 24 words at least in all documents, a tenth of which are given a repeating tail first."""
    return run_report(table(spark, sf_dir, "documents"), rewrite=repeated_tail)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    return shard_report(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for each benchmark item, over an index of all documents made for it."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), f"{shared_folder(spark)}/tiered-{uuid.uuid4().hex}").drop("tier")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_decontamination,
            op2_lm_score,
            op3_token_store,
            op4_language_id,
            op5_near_join,
            op6_paragraphs,
            op7_toxicity,
            op8_packing,
            op9_html_text,
            op10_exact_dedup,
            op11_periodic_runs,
            op12_sharding,
            op13_ranked_search,
        )
    }


ORACLE_SQL = {
    "op1_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p
        FROM b WHERE len(w) > 0)),
pos AS (
  SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p
        FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, win.n, item_id FROM pos JOIN win ON pos.k = win.k AND pos.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op11_periodic_runs": r"""
WITH raw AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, CAST(xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT))),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) AS BIGINT) AS h
  FROM documents),
cut AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS told, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM raw),
d AS (
  SELECT doc_id, n, CASE WHEN told THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) ELSE w END AS w
  FROM cut),
gram AS (
  SELECT doc_id, i, hash(array_to_string(list_slice(w, i + 1, i + 16), ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(0, n - 15)) AS i FROM d WHERE n >= 24)),
pair AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM gram x JOIN gram y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i),
isle AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q + 15 AS length
  FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pair) GROUP BY doc_id, q, island),
run AS (
  SELECT doc_id, start, length, min(q) AS period FROM isle WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
best AS (
  SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS HUGEINT) * 1000000000000 // period DESC, start, period) = 1),
told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (
  SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS t
  FROM (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS v FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(t, '')) AS collapsed_sha256, CAST(n AS BIGINT) AS n_words
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op13_ranked_search": r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM t WHERE len(w) > 0),
q AS (
  SELECT item_id, term, count(*) AS c
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
p AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM t) SEMI JOIN q USING (term) GROUP BY doc_id, n, term),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
m AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)) AS impact FROM p, s),
r AS (SELECT item_id, doc_id, CAST(sum(c * w * impact) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN m USING (term) GROUP BY item_id, doc_id HAVING sum(c * w * impact) > 0)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score
FROM r WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 10
""",
}
