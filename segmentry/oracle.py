"""DuckDB SQL for the registered queries, straight from the driver tables.

Queries over playlist text have SQL that never sees the text, so a fault of the parser
cannot hide in both.
"""

from __future__ import annotations

from segmentry import choice_queries, more_queries, stream_queries

SEGMENT = """
seg AS (
  SELECT 'u' || user_id AS track_id, user_id, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord,
         CASE WHEN event_type = 'signup' THEN 'init' ELSE 'media' END AS kind,
         CASE WHEN event_type = 'error' THEN 'dropped' ELSE 'ready' END AS status,
         value AS raw, CASE WHEN value = 0 THEN 5.0 ELSE value END AS duration,
         'https://cdn.example/' || user_id || '/' || event_id || '.ts' AS url
  FROM events
)"""

PARSED = f"""{SEGMENT}, parsed AS (
  SELECT *, CASE WHEN kind = 'media' THEN
           99 + sum(CASE WHEN kind = 'media' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ord) END AS seq,
         ord - ord % 5 AS key_at, (ord // 5) % 2 = 0 AS keyed
  FROM seg
)"""

ORACLE = {
    "media_slice": f"""
WITH {PARSED}, timed AS (
  SELECT *, sum(CASE WHEN kind = 'media' THEN duration ELSE 0 END::DECIMAL(20, 6))
              OVER (PARTITION BY user_id ORDER BY ord) AS t1 FROM parsed
), cut AS (
  SELECT *, t1 - (CASE WHEN kind = 'media' THEN duration ELSE 0 END::DECIMAL(20, 6)) AS t0 FROM timed
)
SELECT track_id, ord::INTEGER AS item_ord,
       row_number() OVER (PARTITION BY track_id ORDER BY ord) - 1 AS track_index,
       kind, seq::BIGINT AS sequence_id, url, CASE WHEN kind = 'media' THEN duration END AS duration
FROM cut WHERE CASE WHEN kind = 'media' THEN t1 > 60 AND t0 < 600 ELSE t0 < 600 END
""",
    "segment_parse": f"""
WITH {PARSED}
SELECT track_id AS playlist_id, ord::INTEGER AS seg_ord, kind, url,
       CASE WHEN kind = 'media' THEN duration END AS duration, seq::BIGINT AS sequence_id,
       CASE WHEN keyed THEN 'AES-128' END AS method,
       CASE WHEN keyed THEN 'https://cdn.example/keys/' || key_at || '?a=b,c' END AS key_id,
       CASE WHEN keyed THEN 'http' END AS key_kind,
       CASE WHEN keyed THEN lower(to_hex(key_at + 1)) END AS iv
FROM parsed
""",
    "playlist_summary": f"""
WITH {SEGMENT}
SELECT track_id AS playlist_id, true AS has_end_list,
       count(*) FILTER (kind = 'media') AS segments,
       coalesce(sum(CASE WHEN kind = 'media' THEN duration END::DECIMAL(20, 6)), 0)::DOUBLE AS total_duration,
       CASE WHEN count(*) FILTER (kind = 'media') > 0
            THEN round(sum(CASE WHEN kind = 'media' THEN duration END::DECIMAL(20, 6))::DOUBLE
                       / count(*) FILTER (kind = 'media'), 6) ELSE 'nan'::DOUBLE END AS average_duration
FROM seg GROUP BY track_id
""",
    "playlist_keys": f"""
WITH {PARSED}
SELECT DISTINCT track_id AS playlist_id, 'https://cdn.example/keys/' || ord || '?a=b,c' AS id, 'http' AS key_kind
FROM parsed WHERE keyed AND ord % 5 = 0
""",
    "playlist_errors": f"""
WITH {SEGMENT}
SELECT track_id AS playlist_id, 'a tag applies to no segment' AS error
FROM seg GROUP BY track_id HAVING count(*) FILTER (kind = 'media') > 0
""",
    "byte_range_chain": """
WITH r AS (
  SELECT l_orderkey, l_quantity::BIGINT AS length,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity,
           l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS line_no
  FROM lineitem
), o AS (
  SELECT *, (line_no - line_no % 5) * 1000
           + sum(length) OVER (PARTITION BY l_orderkey, line_no // 5 ORDER BY line_no) - length AS place
  FROM r
)
SELECT l_orderkey AS playlist_id, line_no::INTEGER AS line_no, place::BIGINT AS "offset", length,
       'bytes=' || place::BIGINT || '-' || (place + length - 1)::BIGINT AS header
FROM o
""",
    "iv_derivation": f"""
WITH {SEGMENT}, iv AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN lower(to_hex(event_id))
                        WHEN kind = 'media' THEN lower(to_hex(ord)) END AS iv FROM seg
)
SELECT event_id, iv, upper(lpad(iv, 32, '0')) AS vector FROM iv
""",
    "track_progress": f"""
WITH {SEGMENT}, t AS (
  SELECT track_id, CASE WHEN user_id % 2 = 0 THEN 1000 ELSE count(*) END AS total, count(*) AS completed,
         count(*) FILTER (status = 'ready') AS successful, count(*) FILTER (status = 'dropped') AS dropped,
         coalesce(sum(CASE WHEN status = 'ready' AND kind = 'media' THEN raw END::DECIMAL(20, 6)), 0) AS played
  FROM seg GROUP BY track_id, user_id
)
SELECT track_id, sum(total)::BIGINT AS total, sum(completed)::BIGINT AS completed, sum(successful)::BIGINT AS successful,
       sum(dropped)::BIGINT AS dropped, sum(played)::DOUBLE AS successful_duration
FROM t GROUP BY GROUPING SETS ((track_id), ())
""",
    "expected_counts": """
SELECT 'u' || c_custkey AS track_id, count(user_id) AS expected
FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY c_custkey
""",
    "attempt_outcome": """
SELECT event_id AS task_id, CASE WHEN event_id % 7 + 1 <= 5 THEN 'ready' ELSE 'dropped' END AS status,
       least(event_id % 7, 5) AS errors FROM events
""",
    "progress_eta": f"""
WITH {SEGMENT}, t AS (
  SELECT track_id, count(*) AS n, count(*) FILTER (status = 'ready') AS ok FROM seg GROUP BY track_id
), s AS (
  SELECT *, greatest(1, floor(n * 7919 / 1000 + 0.5)) AS seconds,
         greatest(0, floor((n * 7919 / n * n * 3 - n * 7919) / 1000 + 0.5))::BIGINT AS rest FROM t
)
SELECT track_id, (round((ok::DECIMAL(20, 10) / seconds::DECIMAL(20, 0)), 2)::DECIMAL(20, 2))::VARCHAR AS chunks_per_second,
       CASE WHEN rest < 60 THEN rest || 's'
            WHEN rest < 3600 THEN rest // 60 || 'm ' || rest % 60 || 's'
            ELSE rest // 3600 || 'h ' || (rest % 3600) // 60 || 'm ' || rest % 60 || 's' END AS eta
FROM s
""",
    "task_ids": f"""
WITH {SEGMENT}
SELECT event_id, track_id, row_number() OVER (ORDER BY event_id) - 1 AS task_id, ord AS track_index,
       CASE WHEN ord < 1000000 THEN lpad(ord::VARCHAR, 6, '0') ELSE ord::VARCHAR END || '_' || event_id || '.ts' AS filename
FROM seg
""",
    "contiguous_prefix": f"""
WITH {SEGMENT}, t AS (
  SELECT track_id, count(*) AS expected, coalesce(min(ord) FILTER (event_id % 37 = 5), count(*)) AS next_index
  FROM seg GROUP BY track_id
)
SELECT track_id, next_index, next_index >= expected AS complete FROM t
""",
    "output_runs": f"""
WITH {SEGMENT}, m AS (
  SELECT *, status = 'ready' AND coalesce(lag(status) OVER w, 'dropped') = 'dropped' AS starts
  FROM seg WINDOW w AS (PARTITION BY track_id ORDER BY ord)
), r AS (
  SELECT *, sum(starts::INTEGER) OVER (PARTITION BY track_id ORDER BY ord) - 1 AS run FROM m
), g AS (
  SELECT track_id, run::BIGINT AS run, count(*) AS items, md5(string_agg(event_id || ';', '' ORDER BY ord)) AS payload_md5
  FROM r WHERE status = 'ready' GROUP BY track_id, run
)
SELECT track_id, run, items, payload_md5,
       CASE WHEN count(*) OVER (PARTITION BY track_id) = 1 THEN 'out/' || track_id || '.ts'
            ELSE 'out/' || track_id || '_' || run || '.ts' END AS path
FROM g
""",
    "mux_plan": f"""
WITH {SEGMENT}, kept AS (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY event_id) AS k
  FROM seg WHERE event_id % 3 <> 0 OR status = 'ready'
), m AS (
  SELECT *, status = 'ready' AND coalesce(lag(status) OVER (PARTITION BY track_id ORDER BY k), 'dropped') = 'dropped' AS starts
  FROM kept
), a AS (
  SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'audio' ELSE 'video' END AS type, count(*) FILTER (starts) AS paths
  FROM m GROUP BY user_id
), p AS (
  SELECT user_id // 3 AS resource, bool_or(type = 'video') AS has_video, bool_or(type = 'audio') AS has_audio,
         bool_and(paths = 1) AS whole FROM a WHERE paths > 0 GROUP BY 1
)
SELECT *, has_video AND has_audio AND whole AS mux FROM p
""",
    "catalog_link": """
WITH v AS (
  SELECT c_mktsegment AS playlist_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS variant_index,
         c_nationkey AS nation FROM customer
)
SELECT playlist_id, variant_index, 'audio-' || s_suppkey AS audio_track_id,
       CASE WHEN s_suppkey IS NOT NULL THEN 'https://cdn.example/a/' || s_suppkey END AS audio_url,
       nation NOT IN (SELECT s_nationkey FROM supplier) AS missing
FROM v LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) ON nation = s_nationkey
""",
    "missing_groups": """
SELECT c_custkey, 'g' || c_nationkey AS audio_group_id FROM customer
WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
""",
    "missing_keys": """
SELECT id, p_brand FROM (SELECT p_partkey + p_size % 2 * 1000000000 AS id, p_brand FROM part)
WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
""",
    "key_upsert": """
SELECT event_type || '/' || user_id AS id, arg_max(value, event_id) AS key, max(event_id) AS version
FROM events GROUP BY event_type, user_id
""",
    "key_lookup": """
WITH i AS (
  SELECT l_partkey, CASE WHEN p_partkey IS NULL OR p_size % 4 = 0 THEN 'a key is not registered'
              WHEN p_size % 4 <> 1 THEN 'a key is not 32 hex digits'
              WHEN l_linenumber = 1 THEN 'an IV is not 1 to 32 hex digits' ELSE 'none' END AS fault
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
)
SELECT fault, count(*) AS items, count(DISTINCT l_partkey) AS keys FROM i GROUP BY fault
""",
    "default_stream": """
WITH v AS (
  SELECT c_mktsegment AS playlist_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS option_index,
         (c_custkey % 97 * 1000)::DOUBLE AS bandwidth FROM customer
)
SELECT playlist_id, 'option-' || (option_index + 1) AS option_id, option_index, bandwidth
FROM v QUALIFY row_number() OVER (PARTITION BY playlist_id ORDER BY bandwidth DESC, option_index) = 1
""",
    "stream_options": """
WITH v AS (
  SELECT c_mktsegment AS playlist_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n,
         c_custkey, c_nationkey FROM customer
), a AS (
  SELECT s_nationkey, list('audio-' || s_suppkey ORDER BY s_suppkey) AS ids FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1
), o AS (
  SELECT playlist_id, n, list_concat([CASE WHEN c_custkey % 5 = 0 THEN 'audio-primary-' ELSE 'video-' END || n], coalesce(ids, [])) AS ids
  FROM v LEFT JOIN a ON c_nationkey = s_nationkey
)
SELECT playlist_id, 'option-' || n AS option_id, len(ids)::INTEGER AS tracks, md5(array_to_string(ids, ',')) AS tracks_md5 FROM o
""",
    "compatible_selection": """
WITH r AS (SELECT l_orderkey, 't' || (l_suppkey % 7) AS track, l_partkey % 3 AS opt FROM lineitem),
s AS (SELECT l_orderkey, list(DISTINCT track) AS sel FROM r WHERE track IN ('t0', 't1', 't2', 't6') GROUP BY 1),
o AS (SELECT l_orderkey, opt, list(DISTINCT track) AS tracks FROM r GROUP BY 1, 2)
SELECT o.l_orderkey, CASE WHEN any_value(sel) IS NULL THEN 'nothing is selected'
       WHEN NOT bool_or(list_has_all(tracks, sel)) THEN 'no option has all selected tracks' END AS fault
FROM o LEFT JOIN s ON o.l_orderkey = s.l_orderkey GROUP BY o.l_orderkey
""",
    "live_dedup": """
SELECT 'c' || conv_id AS track_id, turn AS sequence_id, greatest(0, turn - 3) AS refresh, length(text)::INTEGER AS size
FROM conversations WHERE turn > 0
""",
    "ad_filter": """
WITH p AS (
  SELECT page_id, CASE WHEN page_id % 5 = 0 THEN regexp_replace(url, '/en/', '/tsad/', 'g')
                       WHEN page_id % 5 = 1 THEN regexp_replace(url, '/fr/', '/tspgsl/', 'g') ELSE url END AS url
  FROM pages
)
SELECT * FROM p WHERE url NOT LIKE '%/tspgsl/%' AND url NOT LIKE '%/tsad/%'
""",
    "url_parts": r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS protocol,
         regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
)
SELECT page_id, protocol, host, path, 'http' AS key_kind,
       lpad(page_id::VARCHAR, 6, '0') || '_' || right(regexp_extract(path, '([^/]*)$', 1), 238) AS filename FROM p
""",
    "uri_resolution": r"""
WITH p AS (
  SELECT page_id, url, regexp_extract(url, '^([a-z]+:)', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
         regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages
), d AS (SELECT *, regexp_extract(path, '^(.*/)', 1) AS dir FROM p)
SELECT page_id, 'a.ts' AS uri, origin || dir || 'a.ts' AS resolved FROM d
UNION ALL SELECT page_id, '../a.ts?q=1', origin || regexp_replace(dir, '[^/]+/$', '') || 'a.ts?q=1' FROM d
UNION ALL SELECT page_id, '/r/./b/../c.ts', origin || '/r/c.ts' FROM d
UNION ALL SELECT page_id, '//h.example/x', scheme || '//h.example/x' FROM d
UNION ALL SELECT page_id, '?q', origin || path || '?q' FROM d
UNION ALL SELECT page_id, '#f', regexp_extract(url, '^[^#]*') || '#f' FROM d
UNION ALL SELECT page_id, 'data:,x', 'data:,x' FROM d
""",
    "line_normalize": r"""
WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS raw, generate_subscripts(lines, 1) - 1 AS line_no FROM s),
t AS (SELECT doc_id, line_no, regexp_replace(raw, '^[\s\p{Z}\x{FEFF}\x0B]+|[\s\p{Z}\x{FEFF}\x0B]+$', '', 'g') AS line FROM l)
SELECT doc_id AS playlist_id, count(*) AS lines, sum(length(line))::BIGINT AS characters, max(line_no)::INTEGER AS last_line
FROM t WHERE line <> '' GROUP BY doc_id
""",
    "attribute_map": """
SELECT c_custkey, 4 AS entries, c_custkey AS bandwidth, c_name || ', a=b' AS name, '' AS flag, c_mktsegment AS segment FROM customer
""",
    "config_normalize": """
WITH o AS (
  SELECT user_id, arg_min(json_extract(props, '$.k')::BIGINT, event_id) FILTER (event_id % 3 = 0) AS k,
         count(*) FILTER (event_id % 3 = 0) AS n FROM events GROUP BY user_id
)
SELECT user_id AS owner, coalesce(k, 5) AS threads, 5::BIGINT AS source_request_attempts, 5::BIGINT AS task_attempts,
       CASE WHEN coalesce(k, 5) < 1 THEN 'a count is not a positive integer' END AS fault
FROM o
""",
    "time_fold": """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 100 * 60 + o_orderkey % 61
       WHEN 1 THEN o_orderkey % 10 * 3600 + o_orderkey % 60 * 60 + o_orderkey % 77 END AS seconds FROM orders
""",
    "fan_in": """
WITH u AS (
  SELECT 'o' || (o_custkey % 50) AS track_id, o_orderkey AS item FROM orders
  UNION ALL SELECT 'e' || (user_id % 50), event_id FROM events
)
SELECT track_id, item, row_number() OVER (PARTITION BY track_id ORDER BY item) - 1 AS track_index FROM u
""",
    "packetize": """
WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
k AS (SELECT doc_id, h, unnest(range(0, length(h) // 376)) AS i FROM h),
d AS (SELECT doc_id, i, substr(h, (i * 376 + 1)::BIGINT, 376) AS p FROM k)
SELECT doc_id AS resource_id, i AS "index",
       (('0x' || substr(p, 3, 2))::INTEGER & 31) * 256 + ('0x' || substr(p, 5, 2))::INTEGER AS pid,
       (('0x' || substr(p, 3, 2))::INTEGER & 64) <> 0 AS payload_unit_start, md5(unhex(p)) AS data_md5
FROM d
""",
    "packet_units": """
WITH e AS (
  SELECT user_id, event_id, sum((event_type = 'purchase')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS unit FROM events
)
SELECT user_id AS resource_id, unit::BIGINT AS unit, count(*) AS packets, min(event_id) AS first_index,
       md5(string_agg(event_id || ',', '' ORDER BY event_id)) AS data_md5
FROM e GROUP BY user_id, unit
""",
    "continuity": """
WITH e AS (
  SELECT user_id, event_id, event_type, event_id % 16 AS c,
         (lag(event_id % 16) OVER (PARTITION BY user_id ORDER BY event_id) + 1) % 16 AS x FROM events
)
SELECT user_id AS resource_id, event_id AS "index", c::INTEGER AS continuity, x::INTEGER AS expected
FROM e WHERE x IS NOT NULL AND event_type <> 'error' AND c <> x
""",
    "aes_cbc_roundtrip": """
SELECT doc_id, (strlen(text) // 16 + 1) * 16 AS padded_bytes, true AS same_padded, true AS same_blocks FROM documents
""",
}
ORACLE |= more_queries.ORACLE | choice_queries.ORACLE | stream_queries.ORACLE
