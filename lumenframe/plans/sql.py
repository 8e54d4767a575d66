"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

_ROUND_TRIP = "SELECT c_custkey, c_name, c_mktsegment, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, c_nationkey FROM customer"
_SAMPLES = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(greatest(0, least(4095, round((CAST(x AS DOUBLE) + 1) * 1000))) AS INTEGER)) AS samples FROM embeddings"
_WINDOW = "CASE WHEN x <= {c} - 0.5 - ({w} - 1) / 2.0 THEN 0 WHEN x > {c} - 0.5 + ({w} - 1) / 2.0 THEN 255 ELSE CAST(round(((x - ({c} - 0.5)) / ({w} - 1) + 0.5) * 255) AS INTEGER) END"
_FNV = "CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS VARCHAR)"
_READ16 = "list_transform(range(1, len(samples) + 1), lambda i: CAST((samples[i] * 23) % 65536 AS BIGINT))"

SQL = {
    **{f"part10_roundtrip_{k}": _ROUND_TRIP for k in ("explicit_le", "implicit_le", "explicit_be", "deflated_le")},
    "raw_dataset_scan": "SELECT c_custkey, c_name, 9::BIGINT AS n_elements FROM customer",
    "decode_status": """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'ok' ELSE 'error' END AS status,
       CASE c_custkey % 4 WHEN 1 THEN 'truncatedData' WHEN 2 THEN 'missingPart10Preamble' WHEN 3 THEN 'unsupportedTransferSyntax' END AS error_kind
FROM customer""",
    "hierarchy_order": """
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(trunc(l_quantity) AS INTEGER), l_linenumber, '1.2.' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey) AS place,
       l_linenumber::BIGINT AS l_linenumber FROM lineitem""",
    "series_grouping": """
SELECT '1.2.840.99.' || c_nationkey || '.' || (c_custkey % 5) AS series_uid, count(*) AS n_instances,
       string_agg('1.2.840.99.7.' || c_custkey, ',' ORDER BY c_custkey) AS sop_uids
FROM customer GROUP BY 1""",
    "deid_basic_profile": f"""
SELECT c_custkey, 'Anonymous' AS name, 'Anonymous' AS id, NULL::VARCHAR AS institution,
       '2.25.' || {_FNV.format(x="'1.2.840.99.7.' || c_custkey")} AS uid, c_nationkey + 1 AS rows
FROM customer""",
    "module_validation": """
SELECT c_custkey, 0::BIGINT AS ordinal, 'empty' AS kind, NULL::VARCHAR AS expected_vr, NULL::VARCHAR AS actual_vr FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 1, 'missing', NULL, NULL FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, 2, 'unexpectedVR', 'LO', 'SH' FROM customer
UNION ALL SELECT c_custkey, 4, 'missing', NULL, NULL FROM customer""",
    "directory_tree": """
SELECT r_regionkey + 1::BIGINT AS "offset", 0::BIGINT AS level, NULL::VARCHAR AS parent_offset FROM region
UNION ALL SELECT n_nationkey + 101, 1, (n_regionkey + 1)::VARCHAR FROM nation
UNION ALL SELECT s_suppkey + 1000, 2, (s_nationkey + 101)::VARCHAR FROM supplier""",
    "fragment_offsets": """
SELECT l_orderkey, l_linenumber, l_partkey, size,
       coalesce(sum(size + size % 2 + 8) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_quantity) AS BIGINT) AS size FROM lineitem)""",
    "fragments_to_frames": """
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey, l_linenumber, (SELECT max(m.l_linenumber // 2) FROM l m WHERE m.l_orderkey = l.l_orderkey AND m.l_linenumber % 2 = 1 AND m.l_linenumber <= l.l_linenumber)::VARCHAR AS frame
FROM l""",
    "scoped_voi": """
SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey * 10 ELSE (SELECT min(n_nationkey) + 5000 FROM nation WHERE n_nationkey % 7 = 3) END::BIGINT AS center FROM customer""",
    "window_level": f"SELECT vec_id, array_to_string(list_transform(samples, lambda x: {_WINDOW.format(c='1000.0', w='600.0')}), ',') AS pixels FROM ({_SAMPLES})",
    "auto_window": f"""
SELECT vec_id, CAST(coalesce(list_min(u) + list_max(u), 0) AS BIGINT) AS twice_center,
       CAST(CASE WHEN list_max(u) > list_min(u) THEN list_max(u) - list_min(u) ELSE 2 END AS BIGINT) AS width
FROM (SELECT vec_id, list_filter(samples, lambda x: x < 950 OR x > 1050) AS u FROM ({_SAMPLES}))""",
    "rendered_frames": f"""
WITH s AS (SELECT vec_id, samples, (list_min(samples) + list_max(samples)) / 2.0 AS c, CASE WHEN list_max(samples) > list_min(samples) THEN list_max(samples) - list_min(samples) ELSE 2 END * 1.0 AS w FROM ({_SAMPLES})),
g AS (SELECT vec_id, list_transform(samples, lambda x: {_WINDOW.format(c='c', w='w')}) AS p FROM s)
SELECT vec_id, 'ok' AS status, array_to_string(CASE WHEN vec_id % 2 = 0 THEN p ELSE list_transform(p, lambda x: 255 - x) END, ',') AS pixels FROM g""",
    "stored_values": f"SELECT vec_id, array_to_string(list_transform(samples, lambda x: (CASE WHEN (x * 13) % 4096 >= 2048 THEN (x * 13) % 4096 - 4096 ELSE (x * 13) % 4096 END) * 2 - 100), ',') AS numbers FROM ({_SAMPLES})",
    "lut_mapping": f"""
WITH m AS (SELECT vec_id, list_transform(samples, lambda x: least(greatest(x // 20 - 10, 0), 99)) AS i FROM ({_SAMPLES}))
SELECT vec_id, array_to_string(list_transform(i, lambda k: CAST(least(255, round(least(greatest(k * k - 100, 0), 4000) * 255 / 4095.0)) AS INTEGER)), ',') AS pixels FROM m""",
    "ybr_to_rgb": f"""
WITH y AS (SELECT vec_id, samples, list_transform(range(len(samples) // 3), lambda i: 3 * i + 1) AS firsts FROM ({_SAMPLES}))
SELECT vec_id, array_to_string(list_transform(firsts, lambda i: CAST(least(255, greatest(0, round((samples[i] % 256)::DOUBLE + 1.402 * ((samples[i + 2] % 256)::DOUBLE - 128)))) AS INTEGER)), ',') AS red,
       array_to_string(list_transform(firsts, lambda i: CAST(least(255, greatest(0, round((samples[i] % 256)::DOUBLE - 0.344136 * ((samples[i + 1] % 256)::DOUBLE - 128) - 0.714136 * ((samples[i + 2] % 256)::DOUBLE - 128)))) AS INTEGER)), ',') AS green,
       array_to_string(list_transform(firsts, lambda i: CAST(least(255, greatest(0, round((samples[i] % 256)::DOUBLE + 1.772 * ((samples[i + 1] % 256)::DOUBLE - 128)))) AS INTEGER)), ',') AS blue FROM y""",
    "shutter_mask": """
WITH g AS (SELECT p_partkey, p_size, i, i // 8 + 1 AS r, i % 8 + 1 AS c FROM part, range(64) t(i)),
v AS (SELECT p_partkey, i FROM g
  WHERE c BETWEEN 1 + p_size % 3 AND 8 - p_size % 2 AND r BETWEEN 1 AND 4 + p_size % 5
    AND (r - 4) * (r - 4) + (c - 4) * (c - 4) <= (3 + p_size % 3) * (3 + p_size % 3)
    AND r < 9 AND c < (9 + p_size % 4) * r / 9.0)
SELECT p_partkey, count(i) AS visible, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i), '') AS pixels FROM part LEFT JOIN v USING (p_partkey) GROUP BY p_partkey""",
    **{k: f"SELECT vec_id, 'ok' AS status, array_to_string(samples, ',') AS samples FROM ({_SAMPLES})" for k in ("rle_roundtrip", "jpeg_lossless_roundtrip", "jpeg_lossless_sv1_roundtrip", "jpeg_2000_roundtrip")},
    "jpeg_baseline_roundtrip": "SELECT vec_id, 'ok' AS status, 64::BIGINT AS n, 'true' AS close FROM embeddings",
    "range_reads": f"SELECT vec_id, 'ok' AS status, array_to_string(samples, ',') AS samples FROM ({_SAMPLES})",
    "number_lists": f"""
WITH u AS (SELECT vec_id, {_READ16} AS u FROM ({_SAMPLES})),
l AS (SELECT vec_id, u, list_transform(range(1, len(u) // 2 + 1), lambda i: u[2 * i - 1] + 65536 * u[2 * i]) AS l FROM u),
v AS (SELECT vec_id, u, l, list_transform(range(1, len(l) // 2 + 1), lambda i: l[2 * i - 1]::HUGEINT + 4294967296::HUGEINT * l[2 * i]) AS v FROM l)
SELECT vec_id, array_to_string(u, ',') AS us, array_to_string(list_transform(u, lambda x: CASE WHEN x >= 32768 THEN x - 65536 ELSE x END), ',') AS ss,
       array_to_string(l, ',') AS ul, array_to_string(list_transform(l, lambda x: CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END), ',') AS sl,
       array_to_string(v, ',') AS uv, array_to_string(list_transform(v, lambda x: CASE WHEN x >= 9223372036854775808::HUGEINT THEN x - 18446744073709551616::HUGEINT ELSE x END), ',') AS sv,
       array_to_string(list_transform(l, lambda x: (x % 65536) * 65536 + x // 65536), ',') AS at FROM v""",
    "decimal_strings": """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN '3' END AS n, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END::VARCHAR AS first,
       CASE WHEN o_orderkey % 7 <> 0 THEN -o_custkey END::VARCHAR AS last, NULL::VARCHAR AS strict, -o_custkey AS strict_last FROM orders""",
    "date_time_parts": """
SELECT event_id, year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, day(ts)::INTEGER AS day, hour(ts)::INTEGER AS hour, minute(ts)::INTEGER AS minute, second(ts)::INTEGER AS second,
       250000000::INTEGER AS nanosecond, CASE WHEN event_id % 2 = 0 THEN 34200 ELSE -18000 END::INTEGER AS offset_seconds, hour(ts)::INTEGER AS zoned_hour FROM events""",
    "person_names": """
SELECT c_custkey, c_name || '^' || c_mktsegment AS alphabetic, CASE WHEN c_custkey % 2 = 0 THEN 'i' || c_custkey END AS ideographic,
       CASE WHEN c_custkey % 6 = 0 THEN 'p=q' || c_custkey END AS phonetic FROM customer""",
    "charset_text": r"SELECT doc_id, regexp_replace(regexp_replace(text, '[^\x{20}-\x{ff}]', '?', 'g'), '[\x00 ]+$', '') AS line FROM documents",
    "private_elements": "SELECT c_custkey, c_name FROM customer",
    "last_duplicate": "SELECT l_orderkey, arg_max(p, l_linenumber) AS l_partkey FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p FROM lineitem GROUP BY ALL) GROUP BY l_orderkey",
    "dictionary_lookup": """
SELECT keyword, vr, n, n AS same FROM (SELECT count(*) AS n FROM customer),
(VALUES ('PatientName', 'PN'), ('PatientID', 'LO'), ('InstitutionName', 'LO'), ('PatientWeight', 'DS'), ('Rows', 'US'), ('StudyInstanceUID', 'UI'), ('SeriesInstanceUID', 'UI'), ('SOPInstanceUID', 'UI'), ('InstanceNumber', 'IS')) t(keyword, vr)""",
    "file_meta_check": """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'missingRequiredIdentifier' WHEN 2 THEN 'sopInstanceUIDMismatch' WHEN 3 THEN 'sopClassUIDMismatch' END AS problem FROM orders""",
    "cine_rates": """
SELECT p_partkey, CAST(round(CASE WHEN p_size % 4 = 1 THEN p_size + 1 WHEN p_size % 3 = 1 THEN p_size WHEN p_size % 3 = 0 AND p_size > 0 THEN 1000 / (p_size * 10.0) END * 1000) AS BIGINT)::VARCHAR AS millirate FROM part""",
    "frame_attributes": """
SELECT p_partkey, f::INTEGER AS frame_index, 2::BIGINT AS slope, CASE WHEN f = 0 THEN p_size ELSE p_partkey END::BIGINT AS intercept, 40::BIGINT AS center, (p_size + f)::INTEGER AS sample FROM part, range(2) t(f)""",
    "presentation_windows": f"""
WITH g AS (SELECT vec_id, list_transform(samples, lambda x: {_WINDOW.format(c='1100.0', w='300.0')}) AS p FROM ({_SAMPLES}) WHERE vec_id % 3 = 0)
SELECT vec_id, 'ok' AS status, array_to_string(CASE WHEN vec_id % 2 = 1 THEN p ELSE list_transform(p, lambda x: 255 - x) END, ',') AS pixels FROM g""",
    "json_roundtrip": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, true AS valid FROM customer",
    "negotiate_contexts": """
WITH q AS (SELECT c_custkey, c_nationkey, c_custkey % 11 = 0 AS other, c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AS known,
  'ts' || c_custkey % 4 AS a, 'ts' || c_custkey % 3 AS b FROM customer),
r AS (SELECT *, NOT other AND known AS accepted, CASE WHEN 'ts3' IN (a, b) THEN 'ts3' WHEN 'ts1' IN (a, b) THEN 'ts1' WHEN 'ts2' IN (a, b) THEN 'ts2' END AS best FROM q),
s AS (SELECT *, CASE WHEN NOT accepted THEN NULL WHEN c_nationkey % 2 = 1 THEN 'abstract_syntax_not_supported' WHEN best IS NULL THEN 'transfer_syntaxes_not_supported' ELSE 'acceptance' END AS result FROM r)
SELECT c_custkey, accepted, CASE WHEN other THEN 2 WHEN NOT known THEN 7 END::VARCHAR AS reason, result,
       CASE WHEN result = 'acceptance' THEN best WHEN accepted THEN a END AS transfer_syntax FROM s""",
    "status_category": """
SELECT event_id, CASE event_id % 13 WHEN 0 THEN 'success' WHEN 1 THEN 'pending' WHEN 2 THEN 'pending' WHEN 3 THEN 'cancel'
  WHEN 4 THEN 'warning' WHEN 5 THEN 'warning' WHEN 6 THEN 'warning' WHEN 7 THEN 'warning' WHEN 8 THEN 'warning' ELSE 'failure' END AS category FROM events""",
    "pdv_reassembly": """
WITH m AS (SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(role, '') = 'assistant' AS last FROM conversations),
n AS (SELECT *, coalesce(sum(last::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS message FROM m)
SELECT conv_id, message::BIGINT AS message, bool_or(last) AS complete, sha256(string_agg(text, '' ORDER BY turn)) AS content FROM n GROUP BY conv_id, message""",
    "pdv_roundtrip": "SELECT doc_id, true AS complete, strlen(coalesce(text, ''))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS content FROM documents",
    "find_results": """
WITH l AS (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY o_custkey)
SELECT o_custkey, coalesce(string_agg(CASE WHEN o_orderkey <> last THEN o_orderkey::VARCHAR END, ',' ORDER BY o_orderkey), '') AS identifiers, 0::INTEGER AS final_status
FROM orders JOIN l USING (o_custkey) GROUP BY o_custkey""",
    "geometry_arity": """
SELECT vec_id, CASE WHEN vec_id % 4 = 2 THEN 2 END::VARCHAR AS spacing, CASE WHEN vec_id % 5 = 3 THEN 3 END::VARCHAR AS position, CASE WHEN vec_id % 8 = 6 THEN 6 END::VARCHAR AS orientation FROM embeddings""",
    "overlay_planes": """
SELECT p_partkey, (24576 + (p_size % 4) * 2)::BIGINT AS group_number, p_size AS rows, 7::INTEGER AS columns, CASE WHEN p_size % 3 <> 0 THEN '-1,2' END AS origin FROM part WHERE p_size % 5 <> 0""",
    "sop_classes": """
SELECT uid, image_storage, sum(n)::BIGINT AS n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c
JOIN (VALUES (0, '1.2.840.10008.5.1.4.1.1.2', true), (1, '1.2.840.10008.5.1.4.1.1.4', true), (2, '1.2.840.10008.5.1.4.1.1.11.1', false), (3, '1.2.840.10008.1.1', false), (4, '1.2.840.10008.5.1.4.1.1.6.1', true)) u(k, uid, image_storage) ON u.k = c.c_nationkey % 5
GROUP BY uid, image_storage""",
    "page": "SELECT doc_id, lang, n_chars FROM documents ORDER BY lang, n_chars, doc_id LIMIT 25 OFFSET 50",
    "accepted_contexts": """
SELECT l_orderkey, (l_partkey % 3)::VARCHAR AS abstract_syntax, min(l_linenumber * 2 + 1)::BIGINT AS id, 'ts' || min(l_linenumber) AS transfer_syntax
FROM lineitem WHERE l_suppkey % 2 = 1 GROUP BY 1, 2""",
    "window_presets": """
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0 ELSE 2 END::BIGINT AS n, CASE WHEN p_size % 4 <> 0 THEN p_size * 10 END::VARCHAR AS center,
       CASE WHEN p_size % 4 <> 0 THEN p_brand END AS first, NULL::VARCHAR AS second FROM part""",
    "frame_durations": "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 33 WHEN 3 THEN 40 ELSE 50 END::BIGINT AS duration FROM lineitem",
    "private_creators": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN c_name END AS creator FROM customer",
    "derived_file_meta": """
SELECT o_orderkey, p AS problem, CASE WHEN p IS NULL THEN '1.2' END AS media_class, CASE WHEN p IS NULL THEN o_custkey::VARCHAR END AS media_instance, CASE WHEN p IS NULL THEN '1.9' END AS implementation
FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'missingSOPClassUID' WHEN o_orderkey % 3 = 0 THEN 'missingSOPInstanceUID' END AS p FROM orders)""",
    "transfer_syntaxes": """
SELECT uid, name, big_endian::VARCHAR AS big_endian, encapsulated::VARCHAR AS encapsulated, count(*) AS n FROM events
JOIN (VALUES (0, '1.2.840.10008.1.2', 'implicit_le', false, false), (1, '1.2.840.10008.1.2.2', 'explicit_be', true, false), (2, '1.2.840.10008.1.2.5', 'rle', false, true), (3, '1.2.3', 'unknown', NULL, NULL)) t(k, uid, name, big_endian, encapsulated) ON k = event_id % 4
GROUP BY ALL""",
    "nested_sequences": """
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS item, 2::INTEGER AS depth, '1.' || l_partkey AS uid FROM lineitem""",
    "float_pixels": """
SELECT p_partkey, f::INTEGER AS frame_index, CAST(round(CASE WHEN f = 0 THEN p_size ELSE p_retailprice END * 100) AS BIGINT) AS cents FROM part, range(2) t(f) WHERE p_size % 3 <> 0""",
    "json_bulk": """
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN doc_id % 10 <> 0 THEN sha256(coalesce(text, '')) END AS content FROM documents""",
    "dangling_links": """
WITH l AS (SELECT s_suppkey * 2 AS target FROM supplier UNION ALL SELECT s_suppkey + 1 FROM supplier WHERE s_suppkey % 2 = 1)
SELECT target, count(*) AS n FROM l WHERE target NOT IN (SELECT s_suppkey FROM supplier) AND target <> 0 GROUP BY target""",
}
