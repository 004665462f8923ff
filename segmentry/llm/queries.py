"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import (
    Template,
    by_conversation,
    canonical_turns,
    format_chats,
    in_layouts,
    loss_text,
    read_turns,
)
from .common import documents
from .exact_dedup import exact_groups
from .hmm_score import score_documents
from .language_id import fit, identify
from .lexical_search import search
from .matroska import media_features, store_texts
from .minhash_dedup import near_duplicates
from .mixing import source_mix
from .packing import pack_documents
from .substring_dedup import remove_repeats
from .token_counts import document_token_counts
from .url_filter import Rule, judge_urls
from .vector_codes import compress_vectors


def op1_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from four fifths of the documents, by id; score all of them."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    held_out = F.crc32(F.col("id").cast("string")) % 5 == 1
    return score_documents(docs, train).select(
        F.col("id").alias("doc_id"), held_out.alias("held_out"), "n_tokens",
        "n_known", "train_tokens", "base_score", "score",
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir), keep="largest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


OP2_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its class, by the smallest id, and whether it stays."""
    return near_duplicates(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "class_id", "class_size", "kept"
    )


#: Target of the mix: 97 % of the greatest entropy, at most four epochs of a source.
MIX = {"entropy_share": 0.97, "max_epochs": 4.0}


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(documents(spark, sf_dir), **MIX).withColumnRenamed("id", "doc_id")


OP4_SQL = r"""
WITH RECURSIVE n AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
  FROM documents
), s AS (
  SELECT source, sum(n_tokens)::BIGINT AS tokens FROM n GROUP BY source
), t AS (
  SELECT sum(tokens)::BIGINT AS total, count(*) AS k FROM s WHERE tokens > 0
), p AS (
  SELECT source, tokens, tokens::DOUBLE / total AS share, total, k FROM s, t WHERE tokens > 0
), entropy_search(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 8.0::DOUBLE
  UNION ALL
  SELECT i + 1,
         CASE WHEN low THEN lo ELSE (lo + hi) / 2 END,
         CASE WHEN low THEN (lo + hi) / 2 ELSE hi END
  FROM (
    SELECT b.i, b.lo, b.hi,
           (SELECT -sum(w * log2(w)) FROM (
              SELECT power(share, (b.lo + b.hi) / 2)
                     / sum(power(share, (b.lo + b.hi) / 2)) OVER () AS w FROM p))
           < 0.97 * (SELECT log2(k::DOUBLE) FROM t) AS low
    FROM entropy_search b WHERE b.i < 60)
), repeat_search(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1,
         CASE WHEN low THEN lo ELSE (lo + hi) / 2 END,
         CASE WHEN low THEN (lo + hi) / 2 ELSE hi END
  FROM (
    SELECT b.i, b.lo, b.hi,
           (SELECT max(w / share) FROM (
              SELECT share, power(share, (b.lo + b.hi) / 2)
                     / sum(power(share, (b.lo + b.hi) / 2)) OVER () AS w FROM p))
           <= 4.0 AS low
    FROM repeat_search b WHERE b.i < 60)
), a AS (
  SELECT round(greatest(
           (SELECT (lo + hi) / 2 FROM entropy_search WHERE i = 60),
           (SELECT (lo + hi) / 2 FROM repeat_search WHERE i = 60)), 6) AS alpha
), w AS (
  SELECT source, tokens, total, alpha,
         round(power(share, alpha) / sum(power(share, alpha)) OVER (), 9) AS weight
  FROM p, a
), plan AS (
  SELECT source, tokens, alpha, weight,
         floor(weight * total)::BIGINT // tokens AS epochs,
         floor(weight * total)::BIGINT % tokens AS rest
  FROM w
), placed AS (
  SELECT n.doc_id, n.source, n.n_tokens, plan.*  EXCLUDE (source),
         md5('1|' || coalesce(n.source, '') || '|' || epochs || '|' || n.doc_id) AS place
  FROM n JOIN plan ON n.source IS NOT DISTINCT FROM plan.source
), run AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY place) AS upto,
         sum(n_tokens) OVER (PARTITION BY source, place) AS here
  FROM placed
)
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, alpha, weight,
       (epochs + CASE WHEN 2 * upto - here <= 2 * rest THEN 1 ELSE 0 END)::INTEGER AS copies
FROM run
UNION ALL
SELECT doc_id, source, n_tokens::BIGINT, (SELECT alpha FROM a), 0.0, 0
FROM n WHERE source IN (SELECT source FROM s WHERE tokens = 0)
"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from three quarters of the documents, by id; predict all from their text."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(docs.where(remainder != 2))
    held_out = F.crc32(F.col("id").cast("string")) % 4 == 2
    return identify(docs, model).select(
        F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score"
    )


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_texts(documents(spark, sf_dir))).withColumnRenamed("id", "doc_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35
), prints AS (
  SELECT doc_id, i, sha256(array_to_string(words[i : i + 34], ' ')) AS print FROM starts
), repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY print) AS n FROM prints) WHERE n > 1
), covered AS (
  SELECT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM repeated) GROUP BY ALL
), positions AS (
  SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w
), kept AS (
  SELECT doc_id, string_agg(words[p], ' ' ORDER BY p) AS text, count(*) AS n
  FROM positions ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words,
       (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


URL_RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page; the listed URLs are those of the pages with an id divisible by 20."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = pages.where("page_id % 20 = 0")
    return judge_urls(pages, listed, URL_RULES).withColumnRenamed("id", "page_id")


OP8_SQL = r"""
WITH r AS (
  SELECT page_id, url,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), h AS (
  SELECT page_id, url, rest,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS params
  FROM r
), c AS (
  SELECT *, CASE WHEN position('://' IN url) > 0 THEN
           regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
           || regexp_replace(path, '/+$', '')
           || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS key
  FROM h
), l AS (
  SELECT DISTINCT key FROM c WHERE page_id % 20 = 0 AND key IS NOT NULL
), j AS (
  SELECT c.*, l.key IS NOT NULL AS listed,
         CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
              WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM c LEFT JOIN l ON c.key = l.key
)
SELECT page_id, host, path, rule, listed,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return compress_vectors(vectors).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256"
    )


def _op11_round(i: int) -> str:
    """Books after one more round, from the nearest entries of the books before."""
    return f"""
near{i} AS MATERIALIZED (
  SELECT vec_id, part, x, d AS error, entry FROM (
    SELECT vec_id, p.part, x, entry,
           list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d,
           row_number() OVER (PARTITION BY vec_id, p.part ORDER BY d, entry) AS place
    FROM parts p JOIN books{i} b ON p.part = b.part) WHERE place = 1
), means{i} AS (
  SELECT part, entry, list(mean ORDER BY i) AS c FROM (
    SELECT part, entry, i, floor(sum(x[i]) / count(*))::BIGINT AS mean
    FROM near{i}, range(1, {DIMENSIONS // 4 + 1}) AS r(i) GROUP BY ALL) GROUP BY ALL
), books{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c
  FROM books{i} b LEFT JOIN means{i} m ON b.part = m.part AND b.entry = m.entry
),"""


#: Components of the vectors of ``embeddings``; only the SQL has to know.
DIMENSIONS = 64

OP11_SQL = f"""
WITH whole AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, part, v[part * {DIMENSIONS // 4} + 1 : (part + 1) * {DIMENSIONS // 4}] AS x
  FROM whole, range(4) AS r(part)
), books0 AS MATERIALIZED (
  SELECT part, entry, x AS c FROM (
    SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM parts) WHERE entry < 256
),{"".join(map(_op11_round, range(5)))}
final AS (
  SELECT vec_id, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(error)::BIGINT AS error
  FROM near4 GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books4
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM final JOIN whole USING (vec_id), digest
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return search(documents(spark, sf_dir), items).select(
        F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score"
    )


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), totals AS (
  SELECT count(*) FILTER (WHERE len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM t
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM t) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, totals GROUP BY term, n
), m AS (
  SELECT doc_id, 100 - 75 + (75 * len(terms) * n) // l AS m FROM t, totals WHERE len(terms) > 0
), q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL
), s AS (
  SELECT item_id, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in their layouts, made canonical, formatted, and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    rows = rows.unionByName(spark.createDataFrame(more, rows.schema))
    records = in_layouts(by_conversation(rows, "conv_id", "turn", "role", "text"))
    chats = format_chats(canonical_turns(records).select("id", "turns")).drop("turns")
    read = chats.select(
        "id", "formatted", read_turns(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _op13_escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in Template().controls:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP13_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, '<|im_start|>' || replace({_op13_escaped("role")}, chr(10), '\\' || chr(10)) || chr(10)
            || {_op13_escaped("text")} || '<|im_end|>' || chr(10) AS marked
  FROM r
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(marked))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hmm_score": op1_hmm_score,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_mix_sources": op4_mix_sources,
        "op5_token_counts": op5_token_counts,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_language_id": op7_language_id,
        "op8_url_filter": op8_url_filter,
        "op9_matroska": op9_matroska,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_vector_codes": op11_vector_codes,
        "op12_lexical_search": op12_lexical_search,
        "op13_chat_format": op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": OP2_SQL,
        "op4_mix_sources": OP4_SQL,
        "op8_url_filter": OP8_SQL,
        "op10_substring_dedup": OP10_SQL,
        "op11_vector_codes": OP11_SQL,
        "op12_lexical_search": OP12_SQL,
        "op13_chat_format": OP13_SQL,
    }
