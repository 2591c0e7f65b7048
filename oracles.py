"""DuckDB texts that compute the registered queries from the same tables."""

from __future__ import annotations

WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

LINES = r"""
stamped AS (
  SELECT event_id, ts, user_id, event_type, json_extract_string(props, '$.k') AS k,
    8 * (user_id % 24) + CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 5 ELSE 6 END AS pri,
    CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS amount
  FROM events),
worded AS (
  SELECT *, CASE event_type
    WHEN 'error' THEN 'Request ' || event_id || ' failed with code ' || k || ' after ' || amount || ' ms'
    WHEN 'purchase' THEN 'User user' || user_id || ' paid ' || amount || ' for cart ' || k
    ELSE 'User user' || user_id || ' did ' || event_type || ' from IP 192.168.1.' || (event_id % 255) END AS msg
  FROM stamped),
lines AS (
  SELECT event_id AS seq, ts AS received_at, 'node-' || (user_id % 3) AS node_id,
    CASE
      WHEN event_id % 50 = 7 THEN 'junk line ' || event_id
      WHEN event_id % 50 = 8 THEN '<300>1 bad priority ' || event_id
      WHEN event_id % 10 = 3
        THEN '<' || pri || '>' || strftime(ts, '%b %d %H:%M:%S') || ' host' || (user_id % 17) || ' ' || event_type || ': ' || msg
      ELSE '<' || pri || '>1 '
        || CASE WHEN event_id % 40 = 0 THEN '-' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END
        || ' host' || (user_id % 17) || ' ' || event_type || ' '
        || CASE WHEN event_id % 6 = 0 THEN '-' ELSE CAST(1000 + event_id % 10 AS VARCHAR) END || ' ID47 '
        || CASE WHEN event_id % 4 = 0 THEN '-' ELSE '[ev@32473 k="' || k || '"]' END || ' ' || msg
    END AS line
  FROM worded)"""

JUDGED = r"""
cut AS (
  SELECT seq, received_at, node_id, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS l FROM lines),
matched AS (
  SELECT *, regexp_matches(l, '^[^>]*>[0-9]') AS is_rfc5424,
    regexp_extract(l, '(?s)^<([0-9]+)>([0-9]+)[ \t]+(\S*)[ \t]+(\S*)[ \t]+(\S*)[ \t]+(\S*)[ \t]+(\S*)[ \t]+(?:(-)|\[([^\]]*)\])[ \t]*(.*)$',
      ['pri','ver','ts','host','app','procid','msgid','nil','sd','msg']) AS a,
    regexp_extract(l, '(?s)^<([0-9]+)>([^ ]*)[ \t]+([^ ]*)[ \t]+([^ ]*)[ \t]+([^ ]*)[ \t]+(.*)$',
      ['pri','mon','day','tm','host','msg']) AS b
  FROM cut),
judged AS (
  SELECT *, TRY_CAST(CASE WHEN is_rfc5424 THEN a.pri ELSE b.pri END AS INTEGER) AS priority,
    CASE WHEN is_rfc5424 THEN TRY_CAST(a.ver AS INTEGER) ELSE 0 END AS ver FROM matched)"""

MESSAGES = r"""
timed AS (
  SELECT *, CASE WHEN is_rfc5424 AND regexp_matches(a.ts, '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$')
      THEN TRY_CAST(rtrim(a.ts, 'Z') AS TIMESTAMP) END AS header_ts
  FROM judged WHERE coalesce(priority <= 255, false) AND coalesce(ver <= 255, false)),
messages AS (
  SELECT seq, received_at, node_id, priority, priority // 8 AS facility, priority % 8 AS severity,
    coalesce(header_ts, received_at) AS event_ts,
    CASE WHEN header_ts IS NULL THEN 'received' ELSE 'header' END AS ts_source,
    CASE WHEN is_rfc5424 THEN nullif(a.host, '-') ELSE b.host END AS hostname,
    CASE WHEN is_rfc5424 THEN nullif(a.app, '-') END AS app_name,
    CASE WHEN is_rfc5424 THEN nullif(a.procid, '-') END AS procid,
    CASE WHEN is_rfc5424 THEN nullif(a.msgid, '-') END AS msgid,
    CASE WHEN is_rfc5424 AND a.nil <> '-' THEN a.sd END AS structured_data,
    CASE WHEN is_rfc5424 THEN a.msg ELSE b.msg END AS message, is_rfc5424
  FROM timed)"""

PARSED = f"{LINES},{JUDGED},{MESSAGES}"
BULK = "chunked AS (SELECT *, seq // 1000 AS chunk_id FROM messages)"
LIVE = """chunked AS (
  SELECT *, node_id || '/' || ((row_number() OVER (PARTITION BY node_id ORDER BY seq) - 1) // 10) AS chunk_id
  FROM messages)"""

MINED = rf"""
tokenized AS (
  SELECT *, list_filter(regexp_split_to_array(message, '{WS}+'), lambda x: x <> '') AS tokens FROM chunked),
grouped AS (
  SELECT chunk_id, len(tokens) AS token_count, list([struct_pack(tok := tokens, members := [seq])] ORDER BY seq) AS m
  FROM tokenized GROUP BY ALL),
folded AS (
  SELECT chunk_id, token_count, list_reduce(m, lambda acc, x: list_transform(
    [list_position(list_transform(acc, lambda t: len(t.tok) = 0
       OR 2 * len(list_filter(list_zip(t.tok, x[1].tok), lambda z: z[1] = z[2] OR z[1] = '<*>')) >= len(t.tok)), true)],
    lambda hit: CASE WHEN coalesce(hit, 0) = 0 THEN list_concat(acc, x)
      ELSE list_transform(acc, lambda t, i: CASE WHEN i = hit
        THEN struct_pack(tok := list_transform(list_zip(t.tok, x[1].tok), lambda z: CASE WHEN z[1] = z[2] THEN z[1] ELSE '<*>' END),
                         members := list_concat(t.members, x[1].members))
        ELSE t END) END)[1]) AS opened
  FROM grouped),
mined AS (
  SELECT chunk_id, token_count, array_to_string(t.tok, ' ') AS pattern, t.tok AS pattern_tokens,
    t.members[1] AS opened_seq, unnest(t.members) AS seq
  FROM (SELECT chunk_id, token_count, unnest(opened) AS t FROM folded))"""

RECORDS = r"""
records AS (
  SELECT c.*, m.token_count, m.pattern, md5(m.pattern) AS template_key, m.opened_seq,
    list_transform(list_filter(list_zip(c.tokens, m.pattern_tokens), lambda z: z[2] = '<*>'), lambda z: z[1]) AS variables,
    array_to_string(c.tokens, ' ') AS text
  FROM tokenized c JOIN mined m ON c.chunk_id = m.chunk_id AND c.seq = m.seq)"""

CATALOG = r"""
catalog AS (
  SELECT md5(pattern) AS template_key, pattern, any_value(token_count) AS token_count,
    len(list_filter(string_split(pattern, ' '), lambda x: x = '<*>')) AS n_wildcards,
    min(opened_seq) AS first_seq, count(*) AS n_lines
  FROM mined GROUP BY pattern)"""

STORED = r"""
stored AS (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY token_count, opened_seq, seq) - 1 AS row_pos FROM records),
uses AS (
  SELECT chunk_id, seq, row_pos, f.k AS field, f.v AS value, row_pos * 6 + f.k AS use
  FROM (SELECT chunk_id, seq, row_pos, unnest([{'k': 0, 'v': hostname}, {'k': 1, 'v': app_name}, {'k': 2, 'v': procid},
    {'k': 3, 'v': msgid}, {'k': 4, 'v': structured_data}, {'k': 5, 'v': node_id}]) AS f FROM stored)),
pool AS (
  SELECT chunk_id, value, row_number() OVER (PARTITION BY chunk_id ORDER BY first_use) - 1 AS string_id
  FROM (SELECT chunk_id, value, min(use) AS first_use FROM uses WHERE value IS NOT NULL GROUP BY ALL))"""

HEADER = "hostname, app_name, procid, msgid, structured_data"
VARIABLES = "array_to_string(variables, chr(31)) AS variables"
SHOWN_TIME = r"CASE WHEN NOT is_rfc5424 OR ts_source = 'header' THEN event_ts END"


def iso(ts: str) -> str:
    """The fraction has as many digits as it needs: none, 3 or 6."""
    micros = f"microsecond({ts}) % 1000000"
    return (
        f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {micros} = 0 THEN '' "
        f"WHEN {micros} % 1000 = 0 THEN strftime({ts}, '.%g') ELSE strftime({ts}, '.%f') END)"
    )


def hay(*columns: str) -> str:
    return "lower(concat_ws(' ', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns) + "))"


LIVE_ROWS = f"""
live AS (
  SELECT seq, received_at, node_id AS node, coalesce({iso('shown_ts')} || 'Z', '-') AS ts,
    coalesce(['emerg','alert','crit','err','warn','notice','info','debug'][severity + 1], 'unknown') AS severity_name,
    coalesce(nullif(hostname, ''), '-') AS host, coalesce(nullif(app_name, ''), '-') AS app, message
  FROM (SELECT *, {SHOWN_TIME} AS shown_ts FROM messages))"""

FRAMED = r"""
framed AS (
  SELECT seq, node_id, CASE
    WHEN seq % 11 = 4 THEN chr(13)
    WHEN seq % 3 = 0 THEN octet_length(encode(line)) || ' ' || line
    WHEN seq % 3 = 1 AND seq % 7 = 0 THEN (octet_length(encode(line)) + 5) || ' ' || line
    WHEN seq % 5 = 0 THEN (octet_length(encode(line)) + 1) || ' ' || line
    ELSE line END AS line
  FROM lines),
kinds AS (
  SELECT seq, node_id, line, CASE
    WHEN ltrim(line, chr(13)) = '' THEN 'skipped'
    WHEN line LIKE '<%' THEN 'delimited'
    WHEN NOT regexp_matches(line, '^[0-9]') THEN 'junk'
    WHEN TRY_CAST(regexp_extract(line, '^([0-9]+) ', 1) AS BIGINT)
      - octet_length(encode(regexp_extract(line, '(?s)^[0-9]+ (.*)$', 1))) IN (0, 1) THEN 'octet'
    ELSE 'octet_partial' END AS kind
  FROM framed)"""

REASON = r"""CASE
    WHEN l = '' THEN 'empty'
    WHEN NOT regexp_matches(l, '^<[0-9]+>') THEN 'bad_pri'
    WHEN NOT coalesce(TRY_CAST(regexp_extract(l, '^<([0-9]+)>', 1) AS INTEGER) <= 255, false) THEN 'pri_range'
    WHEN NOT is_rfc5424 OR NOT regexp_matches(l, '^<[0-9]+>[0-9]+[ \t]+(\S*[ \t]+){5}') THEN 'bad_header'
    WHEN NOT coalesce(TRY_CAST(regexp_extract(l, '^<[0-9]+>([0-9]+)', 1) AS INTEGER) <= 255, false) THEN 'version_range'
    ELSE 'bad_sd' END"""
OUTCOMES = f"""
outcomes AS (
  SELECT *, CASE WHEN is_rfc5424 THEN 'rfc5424' WHEN l <> '' THEN 'rfc3164' END AS protocol,
    CASE WHEN coalesce(priority <= 255, false) AND coalesce(ver <= 255, false) THEN 'ok' ELSE {REASON} END AS outcome
  FROM judged)"""

DOCUMENTS = "chunked AS (SELECT doc_id AS seq, text AS message, doc_id // 1000 AS chunk_id FROM documents)"
TURNS = "chunked AS (SELECT conv_id * 4294967296 + turn AS seq, text AS message, conv_id // 100 AS chunk_id FROM conversations)"

BULK_MINED = f"WITH {PARSED}, {BULK},{MINED}"
LIVE_MINED = f"WITH {PARSED}, {LIVE},{MINED}"
BULK_RECORDS = f"{BULK_MINED},{RECORDS}"
LIVE_RECORDS = f"{LIVE_MINED},{RECORDS}"

# Archived records under the number of their line in its node.
ARCHIVED = f"node_id, line_no AS seq, priority, {HEADER}, is_rfc5424, ts_source, pattern"
NUMBERED = """
numbered AS (
  SELECT r.*, n.line_no FROM records r
  JOIN (SELECT seq, row_number() OVER (PARTITION BY node_id ORDER BY seq) - 1 AS line_no FROM lines) n ON r.seq = n.seq)"""
LIVE_NUMBERED = f"{LIVE_RECORDS},{NUMBERED}"
BARE = """
bare AS (
  SELECT k.seq, l.received_at, k.node_id, CASE WHEN kind = 'octet' THEN regexp_extract(k.line, '(?s)^[0-9]+ (.*)$', 1) ELSE k.line END AS line
  FROM kinds k JOIN lines l ON k.seq = l.seq WHERE kind <> 'skipped')"""
FRAMED_NUMBERED = f"WITH {LINES},{FRAMED},{BARE},{JUDGED.replace('FROM lines)', 'FROM bare)')},{MESSAGES}, {LIVE},{MINED},{RECORDS},{NUMBERED}"

FAILURE_PATTERN = "Request <*> failed with code <*> after <*> ms"

RENDERED = f"""CASE WHEN is_rfc5424
      THEN '[' || node_id || '] <' || priority || '>1 ' || {iso("date_trunc('millisecond', event_ts)")} || '+00:00 ' || coalesce(hostname, '-') || ' '
        || coalesce(app_name, '-') || ' ' || coalesce(procid, '-') || ' ' || coalesce(msgid, '-')
        || ' [' || coalesce(structured_data, '-') || '] ' || text
      ELSE '[' || node_id || '] <' || priority || '>' || strftime(event_ts, '%b %d %H:%M:%S') || ' '
        || coalesce(hostname, '-') || ' ' || text END"""


def oracle_sql() -> dict[str, str]:
    messages = f"WITH {PARSED}"
    return {
        "read_lines": f"WITH {LINES} SELECT node_id, line FROM lines",
        "number_lines": f"""WITH {LINES} SELECT node_id, line,
            row_number() OVER (PARTITION BY node_id ORDER BY seq) - 1 AS seq FROM lines""",
        "stream_lines": f"WITH {LINES} SELECT node_id, line FROM lines",
        "classify_lines": f"""WITH {LINES},{FRAMED} SELECT seq, kind,
            CASE WHEN kind = 'octet' THEN regexp_extract(line, '(?s)^[0-9]+ (.*)$', 1) ELSE line END AS line FROM kinds""",
        "count_kinds": f"WITH {LINES},{FRAMED} SELECT node_id, kind, count(*) AS n_lines FROM kinds GROUP BY ALL",
        "write_archive": f"{BULK_MINED},{CATALOG} SELECT * FROM catalog",
        "read_archive": f"""{BULK_RECORDS} SELECT chunk_id, seq, node_id, epoch_us(event_ts) // 1000 AS event_ms, priority, {HEADER},
            is_rfc5424, template_key, pattern, {VARIABLES} FROM records""",
        "to_json_feed": f"""{messages} SELECT CAST(to_json(struct_pack(priority := priority, facility := facility, severity := severity,
            "timestamp" := {iso('shown_ts')} || 'Z', hostname := hostname, app_name := app_name, procid := procid, msgid := msgid,
            structured_data := structured_data, message := message, is_rfc5424 := is_rfc5424, node_id := node_id)) AS VARCHAR) AS value
            FROM (SELECT *, {SHOWN_TIME} AS shown_ts FROM messages)""",
        "parse_lines": f"""{messages} SELECT seq, node_id, priority, {HEADER}, message, is_rfc5424 FROM messages""",
        "decode_priority": f"{messages} SELECT seq, priority, facility, severity FROM messages",
        "severity_label": f"""{messages} SELECT seq, severity,
            coalesce(['emerg','alert','crit','err','warn','notice','info','debug'][severity + 1], 'unknown') AS severity_name FROM messages""",
        "event_time": f"{messages} SELECT seq, epoch_us(event_ts) AS event_us, ts_source FROM messages",
        "quarantine": f"""WITH {LINES},{JUDGED},{OUTCOMES} SELECT seq, node_id, line, protocol, outcome AS reason
            FROM outcomes WHERE outcome <> 'ok'""",
        "parse_quality": f"""WITH {LINES},{JUDGED},{OUTCOMES} SELECT node_id, protocol, outcome, count(*) AS n_lines,
            CAST(sum(octet_length(encode(line))) AS BIGINT) AS n_bytes FROM outcomes GROUP BY ALL""",
        "tag_node": f"{messages} SELECT seq, 'node-a' AS node_id, message FROM messages",
        "tag_nodes": f"""{messages}, owners AS (SELECT hostname, 'node-of-' || min(node_id) AS node_id FROM messages GROUP BY hostname)
            SELECT m.seq, m.hostname, coalesce(o.node_id, m.node_id) AS node_id FROM messages m LEFT JOIN owners o ON m.hostname = o.hostname""",
        "tokenize": rf"""{messages}, t AS (SELECT seq, list_filter(regexp_split_to_array(message, '{WS}+'), lambda x: x <> '') AS tokens FROM messages)
            SELECT seq, array_to_string(tokens, chr(31)) AS tokens, len(tokens) AS token_count FROM t""",
        "assign_chunks": f"{messages}, {LIVE} SELECT node_id, seq, chunk_id FROM chunked",
        "chunk_by_line": f"{messages}, {BULK} SELECT seq, chunk_id FROM chunked",
        "mine_templates": f"{BULK_MINED} SELECT chunk_id, token_count, pattern, opened_seq, seq FROM mined",
        "mine_templates_live": f"{LIVE_MINED} SELECT chunk_id, token_count, pattern, opened_seq, seq FROM mined",
        "mine_documents": f"WITH {DOCUMENTS},{MINED} SELECT chunk_id, token_count, pattern, opened_seq, seq FROM mined",
        "mine_conversations": f"WITH {TURNS},{MINED} SELECT chunk_id, token_count, pattern, opened_seq, seq FROM mined",
        "extract_variables": f"{BULK_RECORDS} SELECT chunk_id, seq, template_key, {VARIABLES} FROM records",
        "chunk_template_ids": f"""{LIVE_MINED} SELECT chunk_id, pattern,
            row_number() OVER (PARTITION BY chunk_id ORDER BY token_count, first_seq) - 1 AS template_id
            FROM (SELECT chunk_id, pattern, any_value(token_count) AS token_count, min(opened_seq) AS first_seq FROM mined GROUP BY chunk_id, pattern)""",
        "chunk_template_ids_imported": f"""{BULK_MINED},
            own AS (SELECT chunk_id, pattern, row_number() OVER (PARTITION BY chunk_id ORDER BY token_count, first_seq) - 1 AS pos
              FROM (SELECT chunk_id, pattern, any_value(token_count) AS token_count, min(opened_seq) AS first_seq FROM mined GROUP BY chunk_id, pattern)),
            known AS (SELECT chunk_id + 1 AS chunk_id, pattern, pos FROM own WHERE chunk_id + 1 IN (SELECT chunk_id FROM own)),
            every AS (SELECT chunk_id, pattern, 0 AS late, pos FROM known
              UNION ALL SELECT chunk_id, pattern, 1 AS late, pos FROM own o WHERE NOT EXISTS
                (SELECT 1 FROM known k WHERE k.chunk_id = o.chunk_id AND k.pattern = o.pattern))
            SELECT chunk_id, pattern, row_number() OVER (PARTITION BY chunk_id ORDER BY late, pos) - 1 AS template_id FROM every""",
        "template_catalog": f"{BULK_MINED},{CATALOG} SELECT * FROM catalog",
        "new_templates": f"""{LIVE_MINED},{CATALOG}, peer AS (SELECT DISTINCT pattern FROM mined WHERE chunk_id LIKE 'node-0/%')
            SELECT * FROM catalog WHERE pattern NOT IN (SELECT pattern FROM peer)""",
        "merge_catalogs": f"""{LIVE_MINED}, per_node AS (
              SELECT split_part(chunk_id, '/', 1) AS node_id, pattern, any_value(token_count) AS token_count,
                min(opened_seq) AS first_seq, count(*) AS n_lines FROM mined GROUP BY ALL)
            SELECT pattern, md5(pattern) AS template_key, any_value(token_count) AS token_count,
              len(list_filter(string_split(pattern, ' '), lambda x: x = '<*>')) AS n_wildcards, min(first_seq) AS first_seq,
              CAST(sum(n_lines) AS BIGINT) AS n_lines, string_agg(node_id, ',' ORDER BY node_id) AS nodes FROM per_node GROUP BY pattern""",
        "string_pool": f"{BULK_RECORDS},{STORED} SELECT chunk_id, string_id, value FROM pool",
        "encode_strings": f"""{LIVE_RECORDS},{STORED} SELECT u.chunk_id, u.seq, u.row_pos,
            max(CASE WHEN field = 0 THEN string_id END) AS hostname_id, max(CASE WHEN field = 1 THEN string_id END) AS app_name_id,
            max(CASE WHEN field = 2 THEN string_id END) AS procid_id, max(CASE WHEN field = 3 THEN string_id END) AS msgid_id,
            max(CASE WHEN field = 4 THEN string_id END) AS structured_data_id, max(CASE WHEN field = 5 THEN string_id END) AS node_id_id
            FROM uses u LEFT JOIN pool p ON u.chunk_id = p.chunk_id AND u.value = p.value GROUP BY u.chunk_id, u.seq, u.row_pos""",
        "arrival_gaps": f"""{BULK_RECORDS},{STORED} SELECT chunk_id, seq, row_pos, epoch_us(event_ts) // 1000 AS event_ms,
            epoch_us(event_ts) // 1000 - coalesce(lag(epoch_us(event_ts) // 1000) OVER (PARTITION BY chunk_id ORDER BY row_pos), 0) AS gap_ms FROM stored""",
        "times_from_gaps": f"{BULK_RECORDS},{STORED} SELECT chunk_id, seq, row_pos, epoch_us(event_ts) // 1000 AS event_ms FROM stored",
        "filter_template": f"""{BULK_RECORDS} SELECT chunk_id, seq, priority, {VARIABLES} FROM records WHERE pattern = '{FAILURE_PATTERN}'""",
        "reconstruct": f"{messages} SELECT seq, trim(regexp_replace(message, '{WS}+', ' ', 'g')) AS message FROM messages",
        "reconstruct_documents": f"SELECT doc_id AS seq, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS message FROM documents",
        "resolve_strings": f"""{messages} SELECT seq, coalesce(hostname, '-') AS hostname, coalesce(app_name, '-') AS app_name,
            coalesce(procid, '-') AS procid, coalesce(msgid, '-') AS msgid, coalesce(structured_data, '-') AS structured_data,
            coalesce(node_id, '-') AS node_id FROM messages""",
        "search": f"""{messages} SELECT seq, node_id, message FROM messages WHERE contains({hay('hostname', 'app_name', 'procid', 'msgid',
            'structured_data', 'message', 'priority', 'node_id')}, lower('ID47 EV@32473 k="7'))""",
        "render": f"""{messages} SELECT seq, {RENDERED} AS rendered FROM (SELECT *, message AS text FROM messages)""",
        "query_archive": f"""{BULK_RECORDS} SELECT seq, {RENDERED} AS rendered FROM records
            WHERE pattern = '{FAILURE_PATTERN}' AND contains({hay('hostname', 'app_name', 'procid', 'msgid', 'structured_data', 'text', 'priority', 'node_id')}, 'host1')""",
        "index_archive": f"""{BULK_RECORDS} SELECT DISTINCT template_key FROM records""",
        "search_indexed": f"""{BULK_RECORDS} SELECT seq, {RENDERED} AS rendered FROM records
            WHERE pattern = '{FAILURE_PATTERN}' AND contains({hay('hostname', 'app_name', 'procid', 'msgid', 'structured_data', 'text', 'priority', 'node_id')}, 'host1')""",
        "roundtrip_check": f"""{messages} SELECT count(*) AS n_messages, count(*) AS n_records, 0 AS n_duplicate, 0 AS n_missing, 0 AS n_extra,
            0 AS n_different FROM messages""",
        "verify_archive": f"""{messages}, kept AS (SELECT seq, node_id FROM messages WHERE seq % 997 <> 5)
            SELECT (SELECT count(*) FROM messages) AS n_messages, count(*) + count_if(seq % 1013 = 11) AS n_records,
              count_if(seq % 1013 = 11) AS n_duplicate, (SELECT count_if(seq % 997 = 5) FROM messages) AS n_missing, 0 AS n_extra,
              count_if(seq % 1009 = 3) AS n_different FROM kept""",
        "stream_archive": f"""WITH {LINES},{JUDGED},{MESSAGES}, numbered AS (
              SELECT node_id, seq, row_number() OVER (PARTITION BY node_id ORDER BY seq) - 1 AS line_no FROM lines),
            {LIVE},{MINED},{RECORDS}
            SELECT r.node_id, n.line_no AS seq, r.priority, r.hostname, r.app_name, r.procid, r.msgid, r.structured_data, r.is_rfc5424,
              r.ts_source, CASE WHEN r.ts_source = 'header' THEN epoch_us(r.event_ts) END AS event_us, r.pattern, array_to_string(r.variables, chr(31)) AS variables
            FROM records r JOIN numbered n ON r.seq = n.seq""",
        "stream_catalog": f"""{LIVE_MINED} SELECT pattern, count(*) AS n_lines FROM mined GROUP BY pattern""",
        "stream_rejects": f"""WITH {LINES},{JUDGED},{OUTCOMES} SELECT node_id, line, protocol, outcome AS reason
            FROM outcomes WHERE outcome <> 'ok'""",
        "ingest_batch": f"""{LIVE_NUMBERED} SELECT {ARCHIVED}, CASE WHEN ts_source = 'header' THEN epoch_us(event_ts) END AS event_us, {VARIABLES} FROM numbered""",
        "ingest_batches": f"""{LIVE_NUMBERED} SELECT batch_id, {ARCHIVED}, {VARIABLES}, 1 AS n_published FROM numbered, (VALUES ('01'), ('1')) AS t(batch_id)""",
        "compact_archive": f"""{LIVE_NUMBERED} SELECT batch_id, {ARCHIVED}, {VARIABLES}, 1 AS n_published FROM numbered, (VALUES ('01'), ('1')) AS t(batch_id)""",
        "ingest_framed": f"""{FRAMED_NUMBERED} SELECT {ARCHIVED}, {VARIABLES} FROM numbered""",
        "stream_framed": f"""{FRAMED_NUMBERED} SELECT {ARCHIVED}, {VARIABLES} FROM numbered""",
        "stream_tail": f"""{messages},{LIVE_ROWS} SELECT seq, ts, node, severity_name, host, app, message FROM live
            ORDER BY received_at DESC, seq DESC LIMIT 1000""",
        "stream_liveness": f"""{LIVE_RECORDS} SELECT node_id, epoch_us(max(received_at)) AS last_seen_us, count(*) AS n_lines,
            count(DISTINCT template_key) AS exact, true AS estimate_is_near FROM records GROUP BY node_id""",
        "size_report": f"""WITH {LINES}, {JUDGED}, {MESSAGES}, {BULK} SELECT (SELECT count(*) FROM lines) AS n_lines,
            (SELECT CAST(sum(octet_length(encode(line))) AS BIGINT) FROM lines) AS raw_bytes, count(DISTINCT chunk_id) AS n_chunks,
            true AS has_files, true AS is_smaller, true AS ratio_agrees, true AS savings_agree FROM chunked""",
        "live_tail": f"""{messages},{LIVE_ROWS} SELECT seq, ts, node, severity_name, host, app, message FROM live
            ORDER BY received_at DESC, seq DESC LIMIT 1000""",
        "live_search": f"""{messages},{LIVE_ROWS} SELECT seq, ts, node, severity_name, host, app, message FROM live
            WHERE contains(lower(ts || node || severity_name || host || app || message), 'errhost1')""",
        "stream_search": f"""{messages},{LIVE_ROWS} SELECT CASE WHEN app = '-' THEN '' ELSE ts END AS ts, node, severity_name, host, app, message
            FROM live WHERE contains(lower(ts || node || severity_name || host || app || message), 'infohost3')""",
        "stream_feed": f"""{messages} SELECT node_id, priority, facility, severity, {HEADER}, message, is_rfc5424,
            CASE WHEN ts_source = 'header' THEN {iso('event_ts')} || 'Z' END AS header_time FROM messages""",
        "node_liveness": f"""{LIVE_RECORDS} SELECT node_id, epoch_us(max(received_at)) AS last_seen_us, count(*) AS n_lines,
            count(DISTINCT template_key) AS n_templates FROM records GROUP BY node_id""",
        "raw_size": f"WITH {LINES} SELECT count(*) AS n_lines, CAST(sum(octet_length(encode(line))) AS BIGINT) AS raw_bytes FROM lines",
        "template_report": f"""{BULK_RECORDS} SELECT template_key, pattern, count(*) AS n_lines,
            CAST(sum(octet_length(encode(text))) AS BIGINT) AS message_bytes,
            CAST(sum(octet_length(encode(array_to_string(variables, '')))) AS BIGINT) AS variable_bytes,
            CAST(sum(octet_length(encode(text))) - sum(octet_length(encode(array_to_string(variables, '')))) - octet_length(encode(pattern)) AS BIGINT) AS saved_bytes
            FROM records GROUP BY template_key, pattern""",
        "template_report_top": f"""{BULK_RECORDS} SELECT template_key, count(*) AS n_lines, CAST(sum(octet_length(encode(text))) AS BIGINT) AS message_bytes
            FROM records GROUP BY ALL ORDER BY message_bytes DESC, template_key LIMIT 10""",
        "stream_heavy": f"""{BULK_RECORDS} SELECT template_key, count(*) AS n_lines, CAST(sum(octet_length(encode(text))) AS BIGINT) AS message_bytes
            FROM records GROUP BY ALL ORDER BY message_bytes DESC, template_key LIMIT 10""",
    }
