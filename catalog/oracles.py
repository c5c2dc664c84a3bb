"""The SQL that each registered query is checked with (DuckDB, same tables)."""

from __future__ import annotations

from .inputs import BLOCK_WORD, CARD, CONFIRM_WORD, EMAIL, IPV4_PLAIN, LICENSE, PHONE, REDACT_WORD

# The secret formats, written out once more so that the SQL does not follow the code: an assignment of a long value to a
# credential-like key, an access key id, a repository token, the first line of a private key, a signed web token.
SECRET_FORMATS = (
    r"""(?i:(?:api|access)[_-]?key|passw(?:or)?d|secret|token)["'']?[ \t]*[=:][ \t]*["'']?[0-9A-Za-z_-]{16,}["'']?""",
    r"AKIA[A-Z0-9]{16}",
    r"gh[oprsu]_[0-9A-Za-z]{36,}",
    r"-----BEGIN [ A-Z]*PRIVATE KEY-----",
    r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
)
SECRET = "|".join(SECRET_FORMATS)

# Whitespace class of trimming and blank tests.
WS = r"[\p{Z}\t-\r\x1C-\x1F]"

FILES = r"""
f AS (
  SELECT doc_id, doc_id % 50 AS request_id, '/w' AS root, text, n_chars AS size, doc_id * 1000 AS mtime_ms,
         CASE WHEN doc_id % 25 = 3 THEN 'build' ELSE 'src' END || '/' || source || '/' || lang
         || '/k' || (n_chars // 1000) || '/' || doc_id
         || CASE WHEN doc_id % 20 = 0 THEN '.jks' WHEN doc_id % 10 = 0 THEN '.kt' ELSE '.txt' END AS path
  FROM documents)"""

TURNS = r"""
u AS (
  SELECT conv_id, turn, role,
         CASE WHEN turn % 5 = 4 THEN '  /run ' || text WHEN turn = 6 THEN ' ' || chr(9) || ' ' ELSE text END AS text
  FROM conversations)"""


def evaluated(source: str = "f", blocked: str = "false") -> str:
    """The files policy as one CTE per rule; the source needs path and text."""
    return rf"""
e0 AS (SELECT *, regexp_full_match(path, '.*/[^/]*\.(jks|keystore)') AS b,
              regexp_full_match(path, '.*/src7/.*') AS src7 FROM {source}),
e1 AS (SELECT *, CASE WHEN NOT b AND NOT ({blocked}) THEN text END AS t0 FROM e0),
e2 AS (SELECT *, regexp_matches(t0, '{IPV4_PLAIN}') AS ip,
              regexp_replace(t0, '{PHONE}', '\1(\2) <phone>', 'g') AS t1 FROM e1),
e3 AS (SELECT *, regexp_replace(t1, '{EMAIL}', '<redacted:email>', 'g') AS t2 FROM e2),
e4 AS (SELECT *, CASE WHEN regexp_matches(path, '/src[0-9]*[02468]/')
                      THEN regexp_replace(t2, '{CARD}', '<redacted:card>', 'g') ELSE t2 END AS t3 FROM e3),
e5 AS (SELECT *, CASE WHEN regexp_matches(t3, '{LICENSE}')
                      THEN '<summarized by summarize-license>' ELSE t3 END AS t4 FROM e4),
e6 AS (SELECT *, CASE WHEN regexp_full_match(path, 'build/.*/es/.*') AND t4 IS NOT NULL
                      THEN '<redacted>' ELSE t4 END AS t5 FROM e5),
e7 AS (SELECT *, len(regexp_extract_all(t5, '{SECRET}')) AS secrets,
              regexp_replace(t5, '{SECRET}', '<redacted>', 'g') AS t6 FROM e6),
e8 AS (SELECT *, list_filter([
         CASE WHEN b THEN 'BLOCK|POLICY_RULE|Matched rule block-keys|block-keys' END,
         CASE WHEN src7 THEN 'CONFIRM|POLICY_RULE|Matched rule review-src7|review-src7' END,
         CASE WHEN src7 AND t0 IS NOT NULL THEN 'CONFIRM|POLICY_RULE|Matched rule review-src7|review-src7' END,
         CASE WHEN ip THEN 'CONFIRM|POLICY_RULE|Matched rule confirm-ip|confirm-ip' END,
         CASE WHEN t1 <> t0 THEN 'REDACT|POLICY_RULE|Redacted content using rule mask-phone|mask-phone' END,
         CASE WHEN t2 <> t1 THEN 'REDACT|POLICY_RULE|Redacted content using rule redact-email|redact-email' END,
         CASE WHEN t3 <> t2 THEN 'REDACT|POLICY_RULE|Redacted content using rule redact-card|redact-card' END,
         CASE WHEN regexp_matches(t3, '{LICENSE}')
              THEN 'SUMMARIZE|POLICY_RULE|Summarized content using rule summarize-license|summarize-license' END,
         CASE WHEN contains(t4, 'summarized by summarize-license')
              THEN 'CONFIRM|POLICY_RULE|Matched rule confirm-summary|confirm-summary' END,
         CASE WHEN t5 <> t4 THEN 'REDACT|POLICY_RULE|Redacted content using rule hide-built|hide-built' END,
         CASE WHEN secrets > 0 THEN 'REDACT|SECRET_DETECTOR|Redacted ' || secrets || ' secret-like value(s)|' END
       ], lambda x: x IS NOT NULL) AS found FROM e7),
ev AS (SELECT *, array_to_string(found, chr(10)) AS findings,
              CASE WHEN b THEN 'BLOCKED' WHEN t6 <> text THEN 'WRITE_SANITIZED_TEXT' ELSE 'COPY_ORIGINAL' END AS disposition
       FROM e8),
it AS (SELECT *, CASE WHEN disposition = 'WRITE_SANITIZED_TEXT' THEN t6 END AS sanitized_text FROM ev)"""


FINDING_ROWS = r"""
fr AS (
  SELECT * EXCLUDE (x), split_part(x, '|', 1) AS action, split_part(x, '|', 2) AS source,
         split_part(x, '|', 3) AS message, nullif(split_part(x, '|', 4), '') AS rule_id
  FROM (SELECT *, unnest(found) AS x, generate_subscripts(found, 1) - 1 AS finding_ord FROM it))"""

PROMPTS = rf"""
p0 AS (SELECT *, regexp_matches(text, '{BLOCK_WORD}') AS blk, regexp_matches(text, '{CONFIRM_WORD}') AS cnf,
              regexp_replace(text, '{REDACT_WORD}', '<\1>', 'g') AS t1 FROM u),
p1 AS (SELECT *, list_filter([
         CASE WHEN blk THEN 'BLOCK|POLICY_RULE|Matched rule block-word|block-word' END,
         CASE WHEN cnf THEN 'CONFIRM|POLICY_RULE|Matched rule confirm-word|confirm-word' END,
         CASE WHEN t1 <> text THEN 'REDACT|POLICY_RULE|Redacted content using rule redact-word|redact-word' END
       ], lambda x: x IS NOT NULL) AS found FROM p0)"""

# The parts' sources: text lines per shape.
SOURCES = r"""
parts AS (
  SELECT p_partkey, p_partkey % 6 AS shape, p_size AS size, p_name AS name,
         'app/' || replace(p_brand, '#', '') || '/P' || p_partkey
         || CASE WHEN p_partkey % 7 = 6 THEN '.kts' ELSE '.kt' END AS path,
         CASE p_partkey % 6
         WHEN 0 THEN ['package com.acme.pay.p' || p_partkey, '', 'data class Ledger(val id: Int) {',
                      '    fun total(): Int {', '        return ' || p_size, '    }', '}', '', 'val tail = "' || p_name || '"']
         WHEN 1 THEN ['package com.acme.pay', '', '@Deprecated("x")', '@Hidden', 'fun price() = ' || p_size,
                      'fun other() = 1', '// ' || p_name, '']
         WHEN 2 THEN ['package com.acme.pay', 'class Outer {', '    fun charge() {', '        use(' || p_size || ')', '    }',
                      '    private class Ledger {', '    }', '    val n = "' || p_name || '"', '}']
         WHEN 3 THEN ['package com.acme.pay', 'fun charge(', '    amount: Int,', '', '    rate: Int // ' || p_name,
                      ') = amount * ' || p_size, 'val x = 1']
         WHEN 4 THEN ['package com.acme.payroll', 'class Ledger {', '    val a = ' || p_size, '}']
         ELSE ['package com.acme.pay', '@Visible', 'fun shown() = ' || p_size, '// ' || p_name] END AS lines
  FROM part),
src AS (SELECT *, array_to_string(lines, chr(10)) AS text FROM parts)"""

# What each shape has to become, written out.
REDACTED = r"""
CASE WHEN path LIKE '%.kts' THEN text ELSE CASE shape
  WHEN 0 THEN 'package com.acme.pay.p' || p_partkey || chr(10) || chr(10) || '<hidden> // class Ledger' || chr(10)
              || 'val tail = "' || name || '"'
  WHEN 1 THEN 'package com.acme.pay' || chr(10) || chr(10) || '<hidden> // fun price' || 'fun other() = 1' || chr(10)
              || '// ' || name || chr(10)
  WHEN 2 THEN 'package com.acme.pay' || chr(10) || 'class Outer {' || chr(10) || '<hidden> // fun charge, class Ledger'
              || '    val n = "' || name || '"' || chr(10) || '}'
  WHEN 3 THEN 'package com.acme.pay' || chr(10) || '<hidden> // fun charge' || ') = amount * ' || size || chr(10) || 'val x = 1'
  ELSE text END END"""

PAGES = r"""
pg AS (
  SELECT *, regexp_extract(path, '^/[^/]+') AS host, regexp_extract(path, '^/[^/]+/[^/]+') AS section
  FROM (SELECT page_id, 's' || (page_id % 4) AS session,
               regexp_replace(regexp_replace(url, '^https?:/|[?#].*', '', 'g'), '/+$', '') AS path FROM pages))"""

MANIFEST = r"""
m AS (
  SELECT doc_id, path, doc_id % 13 <> 0 AS same_policy,
         CASE WHEN doc_id % 11 = 0 THEN '/w/gone/' || doc_id ELSE '/w/' || path END AS source_path,
         CASE WHEN doc_id % 7 = 0 THEN size + 1 ELSE size END AS size, mtime_ms,
         CASE WHEN doc_id % 5 = 0 THEN 'WRITE_SANITIZED_TEXT' ELSE 'COPY_ORIGINAL' END AS disposition,
         CASE WHEN doc_id % 5 = 0 THEN 'stored ' || doc_id END AS sanitized_text
  FROM f),
j AS (
  SELECT it.*, '/w/' || it.path AS source_path, m.doc_id IS NOT NULL AS cache_hit,
         CASE WHEN m.doc_id IS NOT NULL THEN m.disposition ELSE it.disposition END AS final_disposition,
         CASE WHEN m.doc_id IS NOT NULL THEN m.sanitized_text ELSE it.sanitized_text END AS final_text,
         CASE WHEN m.doc_id IS NOT NULL THEN 'REDACT|POLICY_RULE|stored|earlier' ELSE it.findings END AS final_findings
  FROM it LEFT JOIN m ON m.same_policy AND m.source_path = '/w/' || it.path AND m.size = it.size AND m.mtime_ms = it.mtime_ms)"""

EVAL = f"WITH {FILES}, {evaluated()}"
WORKSPACE = f"WITH {FILES}, kept AS (SELECT * FROM f WHERE path NOT LIKE 'build/%'), {evaluated('kept')}"

# Every directory above each file, the root '' included.
DIRECTORIES = r"""
chains AS (
  SELECT it.*, string_split(path, '/') AS parts FROM it),
spread AS (
  SELECT *, unnest(range(0, len(parts))) AS depth FROM chains),
dirs AS (
  SELECT '/w' AS root, array_to_string(parts[1:depth], '/') AS directory,
         count(*) FILTER (disposition <> 'BLOCKED') AS mirrored,
         count(*) FILTER (disposition = 'WRITE_SANITIZED_TEXT') AS redacted,
         count(*) FILTER (disposition = 'BLOCKED') AS blocked,
         count(*) FILTER (disposition = 'COPY_ORIGINAL') AS pass_through
  FROM spread GROUP BY 1, 2),
rolled AS (SELECT *, mirrored > 0 AND redacted = 0 AND blocked = 0 AS fully_safe FROM dirs)"""

LABEL = "CASE source WHEN 'SECRET_DETECTOR' THEN 'secret-detector' WHEN 'TEXT_SANITIZER_BACKEND' " \
        "THEN coalesce(rule_id, 'text-sanitizer') ELSE coalesce(rule_id, 'policy') END"

CHANGES = r"""
ch AS (
  SELECT root, doc_id, CASE WHEN doc_id % 10 = 7 THEN '/elsewhere/' || doc_id ELSE '/w/' || path END AS source_path, e.*
  FROM (SELECT *, unnest([
          {'n': 0, 'op': 'CREATE', 'body': text, 'at': mtime_ms},
          CASE WHEN doc_id % 4 = 1 THEN {'n': 1, 'op': 'MODIFY', 'body': 'new mail a.b@example.com ' || text, 'at': mtime_ms + 500} END,
          CASE WHEN doc_id % 9 = 2 THEN {'n': 2, 'op': 'DELETE', 'body': NULL, 'at': mtime_ms + 800} END,
          CASE WHEN doc_id % 5 = 0 THEN {'n': 3, 'op': 'MODIFY', 'body': 'late', 'at': mtime_ms - 500} END]) AS e FROM f)
  WHERE e IS NOT NULL),
newest AS (
  SELECT *, n * 1000000000000 + doc_id AS event_id FROM ch
  QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY "at" DESC, n DESC) = 1),
routed AS (
  SELECT doc_id, event_id, op, body AS text, source_path,
         CASE WHEN source_path LIKE '/w/%' THEN substr(source_path, 4)
              ELSE '_external/' || regexp_extract(source_path, '[^/]*$') END AS path,
         source_path NOT LIKE '/w/%' OR source_path LIKE '/w/build/%' AS ignored
  FROM newest)"""

SYNCED = f"WITH {FILES}, {CHANGES}, {evaluated('routed', 'ignored')}," + r"""
synced AS (
  SELECT *, CASE WHEN ignored THEN 'IGNORED' WHEN op = 'DELETE' OR b THEN 'REMOVED' ELSE 'UPDATED' END AS action
  FROM (SELECT * REPLACE (CASE WHEN ignored OR op = 'DELETE' THEN NULL WHEN b THEN 'BLOCKED' WHEN t6 <> text
               THEN 'WRITE_SANITIZED_TEXT' ELSE 'COPY_ORIGINAL' END AS disposition) FROM it))"""

STATUS = """CASE WHEN action = 'UPDATED' AND disposition = 'WRITE_SANITIZED_TEXT' THEN 'redacted'
                 WHEN action = 'UPDATED' THEN 'pass-through' WHEN disposition = 'BLOCKED' THEN 'blocked' END"""


def turns_out(approve: bool) -> str:
    stop = "blk" if approve else "(blk OR cnf)"
    return rf"""WITH {TURNS}, {PROMPTS},
c AS (SELECT *, regexp_matches(text, '[^\p{{Z}}\t-\r\x1C-\x1F]') AND NOT regexp_matches(text, '^{WS}*/') AS checked FROM p1)
SELECT conv_id, turn, CASE WHEN checked THEN t1 ELSE text END AS sanitized_text,
       checked AND t1 <> text AS was_redacted
FROM c WHERE NOT (checked AND {stop})"""


CONTEXT = rf"""WITH {TURNS}, {PROMPTS},
blocks AS (
  SELECT conv_id AS request_id, 0 AS section, 0 AS ord, t1 AS content FROM p1 WHERE turn = 0
  UNION ALL
  SELECT DISTINCT a.conv_id, s.section, 0, s.content
  FROM p1 a JOIN p1 o ON o.conv_id = a.conv_id AND o.turn = 0,
       (VALUES (1, chr(10) || 'These cleaned files may be read for more context:'),
               (3, chr(10) || 'Paths are relative to the cleaned workspace, which is the current directory.')) s(section, content)
  WHERE a.turn > 0 AND NOT a.blk
  UNION ALL
  SELECT a.conv_id, 2, a.turn, '- turns/' || a.conv_id || '/' || a.turn || CASE WHEN a.role = 'system' THEN '.jks' ELSE '.txt' END
  FROM p1 a JOIN p1 o ON o.conv_id = a.conv_id AND o.turn = 0
  WHERE a.turn > 0 AND NOT a.blk)"""

KINDS = r"""
ln AS (SELECT '/w' AS root, path, unnest(lines) AS line_text, generate_subscripts(lines, 1) - 1 AS line FROM src),
kn AS (SELECT *, CASE WHEN trim(line_text) = '' THEN 'blank' WHEN regexp_matches(trim(line_text), '^@[A-Za-z_]') THEN 'annotation'
             WHEN regexp_matches(trim(line_text), '^(data |private )*class [A-Za-z_]') THEN 'class'
             WHEN regexp_matches(trim(line_text), '^fun [A-Za-z_]+\(') THEN 'fun' ELSE 'other' END AS kind FROM ln)"""

# Documents' lines with offsets.
LINES = r"""
dl AS (SELECT doc_id, unnest(lines) AS line_text, generate_subscripts(lines, 1) - 1 AS line, len(lines) AS total
       FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
lo AS (SELECT *, coalesce(sum(length(line_text) + 1) OVER (PARTITION BY doc_id ORDER BY line
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM dl),
ol AS (SELECT *, start + length(line_text) + CASE WHEN line < total - 1 THEN 1 ELSE 0 END AS "end" FROM lo)"""

ORACLES = {
    "s1_read_workspace": f"""WITH {FILES}
SELECT path, octet_length(encode(coalesce(text, ''))) AS size, true AS is_text, sha256(coalesce(text, '')) AS sha FROM f WHERE path NOT LIKE 'build/%'""",

    "j1_reuse_from_tree": f"""WITH {FILES}, g AS (
  SELECT * REPLACE (coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END AS text) FROM f WHERE path NOT LIKE 'build/%'),
{evaluated("g")}
SELECT path, octet_length(encode(text)) AS size, doc_id % 7 <> 0 AS cache_hit, disposition,
       CASE WHEN NOT b THEN sha256(coalesce(sanitized_text, text)) END AS text_sha, findings FROM it""",

    "s2_files_from_table": f"""WITH {FILES}
SELECT root, '/w/' || path AS source_path, path, sha256(text) AS text_sha, size, mtime_ms FROM f""",

    "s3_rules_frame": rf"""WITH {FILES},
r(rule_ord, rule_id, action, paths, path_regex, replacement) AS (VALUES
  (0, 'allow-text', 'ALLOW', '', '\.txt$', '<redacted>'),
  (1, 'block-keys', 'BLOCK', '**/*.jks **/*.keystore', '', '<redacted>'),
  (2, 'review-src7', 'CONFIRM', '**/src7/**', '', '<redacted>'),
  (3, 'confirm-ip', 'CONFIRM', '', '', '<redacted>'),
  (4, 'mask-phone', 'REDACT', '', '', '$1($2) <phone>'),
  (5, 'redact-email', 'REDACT', '', '', '<redacted:email>'),
  (6, 'redact-card', 'REDACT', '', '/src[0-9]*[02468]/', '<redacted:card>'),
  (7, 'summarize-license', 'SUMMARIZE', '', '', '<redacted>'),
  (8, 'confirm-summary', 'CONFIRM', '', '', '<redacted>'),
  (9, 'hide-built', 'REDACT', 'build/**/es/**', '', '<redacted>')),
h AS (SELECT
  count(*) FILTER (path LIKE '%.txt') AS c0, count(*) FILTER (path LIKE '%/%.jks') AS c1,
  count(*) FILTER (path LIKE '%/src7/%') AS c2, count(*) FILTER (regexp_matches(text, '{IPV4_PLAIN}')) AS c3,
  count(*) FILTER (regexp_matches(text, '{PHONE}')) AS c4, count(*) FILTER (regexp_matches(text, '{EMAIL}')) AS c5,
  count(*) FILTER (regexp_matches(text, '{CARD}') AND regexp_matches(path, '/src[0-9]*[02468]/')) AS c6,
  count(*) FILTER (regexp_matches(text, '{LICENSE}')) AS c7,
  count(*) FILTER (contains(text, 'summarized by summarize-license')) AS c8,
  count(*) FILTER (path LIKE 'build/%/es/%') AS c9 FROM f)
SELECT 'files' AS policy_id, rule_ord::BIGINT AS rule_ord, rule_id, action, paths, path_regex, replacement,
       [c0, c1, c2, c3, c4, c5, c6, c7, c8, c9][rule_ord + 1] AS files
FROM r, h""",

    "s4_manifest_roundtrip": f"""{EVAL}
SELECT 1::BIGINT AS version, root, '/w/' || path AS source_path, size, mtime_ms, disposition,
       sha256(sanitized_text) AS sanitized_sha, findings FROM it""",

    "s5_write_staged": f"""{EVAL}
SELECT root, 'w-' || substr(sha256('/w'), 1, 12) AS workspace, path,
       CASE WHEN doc_id % 17 = 0 THEN 'COPY_ORIGINAL' ELSE disposition END AS disposition,
       CASE WHEN doc_id % 17 <> 0 THEN sha256(coalesce(sanitized_text, text)) END AS text_sha,
       CASE WHEN doc_id % 17 = 0 THEN sha256(text) END AS content_sha FROM it WHERE disposition <> 'BLOCKED'""",

    "s6_read_detector_output": r"""
WITH d AS (SELECT *, doc_id % 5 AS kind, n_chars AS n, n_chars // 2 AS h,
                  CASE WHEN n_chars % 2 = 1 THEN n_chars // 2 + 1 ELSE n_chars // 2 + 1 END AS h2 FROM documents)
SELECT doc_id, CASE WHEN kind = 0 THEN 'clean ' || lang END AS p_text,
       CASE WHEN kind = 1 THEN array_to_string(list_filter([CASE WHEN n >= 2 THEN substr(text, 1, 2) END,
            CASE WHEN h2 <= n THEN substr(text, h + 1, h2 - h) END], lambda x: x IS NOT NULL), '|') ELSE '' END AS p_values,
       CASE kind WHEN 0 THEN 'found ' || source WHEN 1 THEN CASE WHEN n >= 1 THEN 'careful' END END AS p_summary,
       CASE kind WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'unparsable' WHEN 3 THEN 'nothing' ELSE 'missing' END AS p_status,
       CASE WHEN kind IN (0, 3) THEN lang || '|' || source ELSE '' END AS l_values,
       CASE WHEN kind IN (0, 3) THEN 'Detected 5 secret-like value(s) via gitleaks' END AS l_summary,
       CASE kind WHEN 0 THEN 'ok' WHEN 1 THEN 'nothing' WHEN 2 THEN 'unparsable' WHEN 3 THEN 'ok' ELSE 'missing' END AS l_status
FROM d""",

    "p1_glob_match": rf"""WITH {FILES}
SELECT path, regexp_full_match(path, '.*/[^/]*\.jks') AS any_keys, regexp_full_match(path, '[^/]*\.txt') AS top_only,
       regexp_full_match(path, 'src/[^/]*/en/k[^/]/[^/]*') AS one_level,
       regexp_full_match(path, '.*/(src1|src2)/.*') AS "group", regexp_full_match(path, 'src/src[3-5]/.*') AS "range",
       regexp_full_match(path, 'src/src[^0-4/]/.*') OR path LIKE 'build/%' AS negated
FROM f""",

    "p2_path_regex_match": rf"""WITH {FILES}
SELECT path, path LIKE '%/src1_/%' OR (path LIKE 'build/%' AND path LIKE '%.kt') AS matched FROM f""",

    "p3_content_regex_match": f"""
SELECT doc_id, regexp_matches(text, '{EMAIL}') OR regexp_matches(text, '{CARD}') AS contact,
       regexp_matches(text, '{IPV4_PLAIN}') AS address, contains(text, 'Licensed under') OR contains(text, 'Released under') AS license
FROM documents""",

    "p4_rule_matches": f"""WITH {FILES}
SELECT path, regexp_matches(path, '/src[0-9]*[02468]/') AND regexp_matches(text, '{CARD}') AS redact_card,
       path LIKE '%/src7/%' AS review_src7, regexp_matches(text, '{IPV4_PLAIN}') AS confirm_ip FROM f""",

    "p5_path_findings": f"""WITH {FILES}
SELECT path, concat_ws(chr(10),
         CASE WHEN path LIKE '%/%.jks' THEN 'BLOCK|POLICY_RULE|Matched rule block-keys|block-keys' END,
         CASE WHEN path LIKE '%/src7/%' THEN 'CONFIRM|POLICY_RULE|Matched rule review-src7|review-src7' END) AS findings
FROM f""",

    "p6_relative_path": f"""WITH {PAGES}
SELECT page_id, CASE page_id % 5 WHEN 0 THEN substr(host, 2) || '/' || page_id WHEN 1 THEN '_external/' || page_id
       WHEN 2 THEN substr(host, 2) || '/' || page_id WHEN 3 THEN '_external/' || page_id ELSE page_id::VARCHAR END AS rel_path
FROM pg""",

    "p7_decode_text": """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(text) END AS text_sha FROM documents""",

    "p8_skip_dirs": f"""WITH {FILES}
SELECT path FROM f
WHERE NOT list_has_any(string_split(path, '/')[:-2], ['.git', '.gradle', '.idea', 'build', 'out', 'node_modules'])""",

    "p9_is_sanitizable_line": rf"""WITH {TURNS}
SELECT conv_id, turn, t <> '' AND NOT starts_with(t, '/') AS checked
FROM (SELECT *, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS t FROM u)""",

    "p11_validate_policies": r"""
WITH r AS (
  SELECT p_brand AS policy_id, CASE WHEN p_size = 50 THEN 2 ELSE 1 END AS version,
         CASE WHEN p_size % 10 = 9 THEN ' ' ELSE p_name || ' ' || p_type || ' ' || p_size END AS rule_id,
         p_size % 7 = 0 AND p_size % 5 <> 0 AND p_size % 11 <> 0 AS no_matcher, p_type = 'SMALL' AS redacts,
         CASE WHEN p_size % 6 = 0 THEN ' ' WHEN p_size % 4 = 0 THEN 'x' WHEN p_size % 8 = 1 THEN '' ELSE '<redacted>' END AS replacement
  FROM part)
SELECT policy_id, rule_id, 'duplicate_id' AS violation FROM r GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT DISTINCT policy_id, rule_id, 'unsupported_version' FROM r WHERE version <> 1
UNION ALL SELECT DISTINCT policy_id, rule_id, 'blank_id' FROM r WHERE trim(rule_id) = ''
UNION ALL SELECT DISTINCT policy_id, rule_id, 'no_matcher' FROM r WHERE no_matcher
UNION ALL SELECT DISTINCT policy_id, rule_id, 'blank_replacement' FROM r WHERE redacts AND trim(replacement) = ''""",

    "t1_apply_policy": f"""{EVAL}
SELECT path, disposition, sha256(sanitized_text) AS sanitized_sha, length(sanitized_text) AS sanitized_chars, findings FROM it""",

    "t1_apply_policy_symbols": f"""WITH {SOURCES}, r AS (SELECT *, {REDACTED} AS redacted FROM src)
SELECT path, CASE WHEN redacted <> text THEN 'WRITE_SANITIZED_TEXT' ELSE 'COPY_ORIGINAL' END AS disposition,
       CASE WHEN redacted <> text THEN redacted END AS sanitized_text,
       concat_ws(chr(10), CASE WHEN redacted <> text THEN 'REDACT|POLICY_RULE|Redacted content using rule hide-symbols|hide-symbols' END,
         CASE WHEN contains(redacted, '<hidden> // class') THEN 'CONFIRM|POLICY_RULE|Matched rule confirm-hidden|confirm-hidden' END) AS findings
FROM r""",

    "t2_redact_content": rf"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '{PHONE}', '[\0]', 'g'), '{EMAIL}', '[\0]', 'g'),
                                     '{CARD}', '[\0]', 'g')) AS sha FROM documents""",

    "t5_find_secrets": f"""
SELECT doc_id, generate_subscripts(s, 1) - 1 AS ord, unnest(s) AS secret
FROM (SELECT doc_id, regexp_extract_all(text, '{SECRET}') AS s FROM documents)""",

    "t6_redact_secrets": f"""
SELECT doc_id, found, sha256(regexp_replace(text, '{SECRET}', '<$secret>', 'g')) AS redacted,
       sha256(CASE WHEN found > 0 THEN '<summarized:secret-content>' ELSE text END) AS summarized, sha256(text) AS blocked,
       CASE WHEN found > 0 THEN 'Detected ' || found || ' secret-like value(s)' END AS message
FROM (SELECT *, len(regexp_extract_all(text, '{SECRET}')) AS found FROM documents)""",

    "t7_replace_ranges": """
SELECT doc_id, sha256(array_to_string(list_transform(range(0, n_chars, 50),
         lambda i: '#' || (i // 50) || substr(text, i + 6, 45)), '')) AS sha FROM documents""",

    "t8_redact_values": """
SELECT doc_id, sha256(replace(replace(replace(replace(text, 'then', '<x>'), lang || 'th', '<x>'), 'the', '<x>'), lang, '<x>')) AS sha
FROM documents""",

    "t9_extract_spans": """
SELECT doc_id, array_to_string(list_filter([
         CASE WHEN n_chars >= 3 THEN substr(text, 1, 3) END,
         CASE WHEN n_chars // 2 + 4 <= n_chars THEN substr(text, n_chars // 2 + 1, 4) END,
         CASE WHEN n_chars >= 1 THEN right(text, 1) END], lambda x: x IS NOT NULL), '|') AS "values"
FROM documents""",

    "t10_apply_detector": f"""
SELECT doc_id, sha256(regexp_replace(text, '{EMAIL}', '<mail>', 'g')) AS sha,
       CASE WHEN n > 0 THEN 'Detected ' || n || ' secret-like value(s) via gitleaks' END AS message,
       CASE WHEN n > 0 THEN 'gitleaks' END AS rule_id, CASE WHEN n > 0 THEN 'ok' ELSE 'nothing' END AS detector_status
FROM (SELECT *, len(regexp_extract_all(text, '{EMAIL}')) AS n FROM documents)""",

    "t11_kotlin_symbols": rf"""WITH {SOURCES},
ex(shape, kind, name, start_line, end_line) AS (VALUES
  (0, 'class', 'Ledger', 2, 6), (1, 'fun', 'price', 2, 4), (2, 'fun', 'charge', 2, 4), (2, 'class', 'Ledger', 5, 6),
  (3, 'fun', 'charge', 1, 4))
SELECT path, kind, ex.name, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line,
       coalesce(list_sum(list_transform(lines[1:start_line], lambda l: length(l) + 1)), 0)::BIGINT AS start,
       list_sum(list_transform(lines[1:end_line + 1], lambda l: length(l) + 1))::BIGINT AS "end"
FROM src JOIN ex USING (shape) WHERE path LIKE '%.kt'""",

    "t12_redact_kotlin": f"""WITH {SOURCES}
SELECT path, {REDACTED} AS redacted_text FROM src WHERE path LIKE '%.kt'""",

    "t13_assemble_context": f"""{CONTEXT}
SELECT request_id, s::BIGINT AS section, part::BIGINT AS part,
       CASE WHEN s > 0 THEN chr(10) ELSE '' END || string_agg(content, chr(10) ORDER BY ord) AS text
FROM (SELECT request_id, section AS s, ord // 4 AS part, ord, content FROM blocks) GROUP BY request_id, s, part""",

    "t13_context_lines": f"""{CONTEXT}
SELECT request_id, section::BIGINT AS section, ord::BIGINT AS ord, content FROM blocks""",

    "t14_sanitize_turns": turns_out(False),

    "j1_reuse_decisions": f"""{EVAL}, {MANIFEST}
SELECT source_path, cache_hit, final_disposition AS disposition, sha256(final_text) AS sanitized_sha,
       final_findings AS findings FROM j""",

    "j2_external_files": rf"""WITH {PAGES}, d AS (
  SELECT session, host AS directory FROM pg WHERE host LIKE '/blog.%'
  UNION SELECT session, section FROM pg WHERE section LIKE '%/fr')
SELECT DISTINCT session, path FROM pg
WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.session = pg.session AND (pg.path = d.directory OR starts_with(pg.path, d.directory || '/')))""",

    "j3_map_paths": rf"""WITH {PAGES}, mp AS (
  SELECT session, 0 AS rank, min(page_id) AS ord, host AS from_path, '/stage' AS to_path FROM pg WHERE host LIKE '/blog.%' GROUP BY session, host
  UNION ALL SELECT session, 1, min(page_id), section, '/stage/_external/' || min(page_id) FROM pg WHERE host LIKE '/www.%' GROUP BY session, section
  UNION ALL SELECT session, 1, max(page_id), host, '/stage/_external/' || max(page_id) FROM pg WHERE host LIKE '/www.%' GROUP BY session, host
  UNION ALL SELECT session, 2, min(page_id), path, '/stage/_external_files/' || min(page_id) FROM pg WHERE section LIKE '%/es' GROUP BY session, path),
best AS (
  SELECT p.session, p.path, mp.from_path, mp.to_path
  FROM (SELECT DISTINCT session, path FROM pg) p LEFT JOIN mp ON mp.session = p.session
       AND (p.path = mp.from_path OR (mp.rank < 2 AND starts_with(p.path, mp.from_path || '/')))
  QUALIFY row_number() OVER (PARTITION BY p.session, p.path ORDER BY mp.rank, mp.ord, mp.from_path) = 1)
SELECT session, path, CASE WHEN from_path IS NULL THEN '/stage/_unmapped/' || regexp_extract(path, '[^/]*$')
       ELSE to_path || substr(path, length(from_path) + 1) END AS staged_path FROM best""",

    "j4_nearest_policy": rf"""WITH {PAGES}, pol AS (
  SELECT host AS dir, host || '/llm-policy.yml' AS policy FROM pg WHERE host LIKE '%.com'
  UNION SELECT section, section || '/llm-policy.yaml' FROM pg WHERE section LIKE '%/en'),
d AS (SELECT DISTINCT path AS directory FROM pg),
near AS (
  SELECT d.directory, pol.policy FROM d JOIN pol ON d.directory = pol.dir OR starts_with(d.directory, pol.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY d.directory ORDER BY length(pol.dir) DESC) = 1),
x AS (SELECT directory, CASE WHEN directory LIKE '%1' THEN '/explicit.yaml' END AS explicit,
             CASE WHEN directory LIKE '%2' THEN '/env.yaml' END AS environment FROM d)
SELECT directory, explicit, environment, coalesce(explicit, environment, near.policy) AS policy_path
FROM x LEFT JOIN near USING (directory)""",

    "j5_rule_hits": rf"""WITH {FILES}
SELECT path, 0::BIGINT AS rule_ord, 'allow-text' AS rule_id, 'ALLOW' AS action FROM f WHERE path LIKE '%.txt'
UNION ALL SELECT path, 1, 'block-keys', 'BLOCK' FROM f WHERE path LIKE '%/%.jks'
UNION ALL SELECT path, 2, 'review-src7', 'CONFIRM' FROM f WHERE path LIKE '%/src7/%'
UNION ALL SELECT path, 3, 'confirm-ip', 'CONFIRM' FROM f WHERE regexp_matches(text, '{IPV4_PLAIN}')
UNION ALL SELECT path, 4, 'mask-phone', 'REDACT' FROM f WHERE regexp_matches(text, '{PHONE}')
UNION ALL SELECT path, 5, 'redact-email', 'REDACT' FROM f WHERE regexp_matches(text, '{EMAIL}')
UNION ALL SELECT path, 6, 'redact-card', 'REDACT' FROM f WHERE regexp_matches(text, '{CARD}') AND regexp_matches(path, '/src[0-9]*[02468]/')
UNION ALL SELECT path, 7, 'summarize-license', 'SUMMARIZE' FROM f WHERE regexp_matches(text, '{LICENSE}')
UNION ALL SELECT path, 8, 'confirm-summary', 'CONFIRM' FROM f WHERE contains(text, 'summarized by summarize-license')
UNION ALL SELECT path, 9, 'hide-built', 'REDACT' FROM f WHERE path LIKE 'build/%/es/%'""",

    "j6_block_end": rf"""WITH {SOURCES},
ex(shape, line, kind, name, end_line) AS (VALUES
  (0, 2, 'class', 'Ledger', 6), (0, 3, 'fun', 'total', 5), (1, 4, 'fun', 'price', 4), (1, 5, 'fun', 'other', 5),
  (2, 1, 'class', 'Outer', 8), (2, 2, 'fun', 'charge', 4), (2, 5, 'class', 'Ledger', 6), (3, 1, 'fun', 'charge', 4),
  (4, 1, 'class', 'Ledger', 3), (5, 2, 'fun', 'shown', 2))
SELECT path, line::BIGINT AS line, kind, ex.name, end_line::BIGINT AS end_line
FROM src JOIN ex USING (shape) WHERE path LIKE '%.kt'""",

    "j7_removed_paths": f"""{EVAL}, {MANIFEST}
SELECT source_path FROM m WHERE source_path NOT IN (SELECT '/w/' || path FROM f)""",

    "j8_invalidate_prefix": f"""{EVAL}, {MANIFEST}, gone AS (
  SELECT DISTINCT '/w/' || regexp_extract(path, '^.*/(fr|es)') AS directory FROM f WHERE regexp_matches(path, '/(fr|es)/'))
SELECT source_path, size FROM m
WHERE NOT EXISTS (SELECT 1 FROM gone WHERE m.source_path = directory OR starts_with(m.source_path, directory || '/'))""",

    "a1_request_decision": f"""{EVAL}, {FINDING_ROWS}
SELECT request_id, bool_or(action = 'BLOCK') AS is_blocked, bool_or(action = 'CONFIRM') AS requires_approval
FROM fr GROUP BY 1""",

    "a2_gate": f"""{EVAL}, {TURNS}, {PROMPTS},
a AS (SELECT request_id, b AS blk, len(list_filter(found, lambda x: starts_with(x, 'CONFIRM'))) > 0 AS cnf, false AS prompt FROM it
      UNION ALL SELECT conv_id % 50, blk, cnf, blk FROM p1),
g AS (SELECT request_id, bool_or(blk) AS is_blocked, bool_or(cnf) AS requires_approval, bool_or(prompt) AS prompt_blocked
      FROM a GROUP BY 1)
SELECT *, CASE WHEN is_blocked THEN 3 WHEN requires_approval THEN 4 ELSE 0 END::BIGINT AS request_gate,
       CASE WHEN is_blocked THEN 3 ELSE 0 END::BIGINT AS approved_gate,
       CASE WHEN prompt_blocked THEN 3 WHEN requires_approval THEN 4 ELSE 0 END::BIGINT AS workspace_gate FROM g""",

    "a3_stage_stats": f"""{EVAL}, {MANIFEST}
SELECT root, count(*) FILTER (final_disposition <> 'BLOCKED') AS mirrored,
       count(*) FILTER (final_disposition = 'WRITE_SANITIZED_TEXT') AS redacted,
       count(*) FILTER (final_disposition = 'BLOCKED') AS blocked,
       count(*) FILTER (final_disposition = 'COPY_ORIGINAL') AS pass_through, count(*) FILTER (cache_hit) AS cache_hits
FROM j GROUP BY 1""",

    "a4_directory_rollup": f"""{WORKSPACE}, {DIRECTORIES} SELECT * FROM rolled""",

    "a5_safe_subtrees": f"""{WORKSPACE}, {DIRECTORIES}
SELECT root, directory, mirrored FROM rolled r
WHERE fully_safe AND NOT EXISTS (SELECT 1 FROM rolled p WHERE p.fully_safe AND r.directory <> ''
  AND p.directory = CASE WHEN contains(r.directory, '/') THEN regexp_replace(r.directory, '/[^/]*$', '') ELSE '' END)""",

    "a6_findings_summary": f"""{EVAL}, {FINDING_ROWS}
SELECT action, source, {LABEL} AS label, count(*) AS findings FROM fr GROUP BY ALL""",

    "a8_disposition_counts": f"""{EVAL}
SELECT CASE disposition WHEN 'COPY_ORIGINAL' THEN 'allowed' WHEN 'WRITE_SANITIZED_TEXT' THEN 'redacted' ELSE 'blocked' END AS label,
       count(*) AS items FROM it GROUP BY 1""",

    "w1_annotation_groups": f"""WITH {SOURCES}, {KINDS},
g AS (SELECT *, coalesce(count(*) FILTER (kind <> 'annotation') OVER w, 0) AS island
      FROM kn WINDOW w AS (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT path, line, kind, island, min(line) OVER (PARTITION BY path, island) AS group_start FROM g""",

    "w2_line_offsets": f"""WITH {LINES} SELECT doc_id, line, start, "end" FROM ol""",

    "w3_brace_balance": """
WITH l AS (SELECT page_id, unnest(lines) AS t, generate_subscripts(lines, 1) - 1 AS line
           FROM (SELECT page_id, string_split(html, chr(10)) AS lines FROM pages)),
d AS (SELECT *, len(regexp_extract_all(t, '\\{')) - len(regexp_extract_all(t, '\\}')) AS delta FROM l)
SELECT page_id, line, delta, sum(delta) OVER (PARTITION BY page_id ORDER BY line)::BIGINT AS balance FROM d""",

    "w4_merge_ranges": f"""WITH {LINES},
r AS (SELECT doc_id, line, start, start + length(line_text) + line % 3 AS "end" FROM ol),
o AS (SELECT *, coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start,
                         false) AS joined FROM r),
i AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, line) AS island FROM o)
SELECT doc_id, min(start) AS start, max("end") AS "end", md5(string_agg('l' || line, ', ' ORDER BY start, line)) AS description_md5
FROM i GROUP BY doc_id, island""",

    "w5_number_externals": f"""WITH {PAGES},
d AS (SELECT session AS root, host || '/a b' AS path, min(page_id) AS position FROM pg GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY position) AS number FROM d)
SELECT *, '_external/' || number || '-a_b' AS staged_path FROM n""",

    "k1_top_findings": f"""{EVAL}, {FINDING_ROWS},
g AS (SELECT *, '/w/' || regexp_extract(path, '^[^/]+/[^/]+') AS top FROM fr),
n AS (SELECT *, row_number() OVER (PARTITION BY top ORDER BY string_split(path, '/'), finding_ord) AS rank,
             count(*) OVER (PARTITION BY top) AS total FROM g)
SELECT top AS root, rank, path, action, {LABEL} AS label, total - least(total, 10) AS more FROM n WHERE rank <= 10""",

    "x1_all_findings": f"""{EVAL}, {FINDING_ROWS}, {TURNS}, {PROMPTS}
SELECT request_id, 1::BIGINT AS part_ord, finding_ord, path AS target, action, source, message, rule_id FROM fr
UNION ALL
SELECT conv_id % 50, 0, ord, 'prompt:' || role, split_part(x, '|', 1), split_part(x, '|', 2), split_part(x, '|', 3),
       nullif(split_part(x, '|', 4), '')
FROM (SELECT *, unnest(found) AS x, generate_subscripts(found, 1) - 1 AS ord FROM p1)""",

    "r1_sync_stream": f"""{SYNCED}
SELECT source_path AS path, event_id, {STATUS} AS status, sha256(t6) AS text_sha FROM synced WHERE action = 'UPDATED'""",

    "r1_sync_manifest": f"""{SYNCED}
SELECT source_path AS path, length(text) AS size, disposition,
       CASE WHEN disposition = 'WRITE_SANITIZED_TEXT' THEN sha256(t6) END AS sanitized_sha, true AS cache_hit
FROM synced WHERE NOT ignored AND op <> 'DELETE'""",
    "workspace_run": f"""{WORKSPACE}
SELECT root, path, disposition, doc_id % 7 <> 0 AS cache_hit, sha256(coalesce(sanitized_text, text)) AS text_sha
FROM it WHERE disposition <> 'BLOCKED'""",
    "j3_map_includes": rf"""WITH {PAGES}, mp AS (
  SELECT session, 0 AS rank, min(page_id) AS ord, host AS from_path, '/stage' AS to_path FROM pg WHERE host LIKE '/blog.%' GROUP BY session, host
  UNION ALL SELECT session, 1, min(page_id), section, '/stage/_external/' || min(page_id) FROM pg WHERE host LIKE '/www.%' GROUP BY session, section
  UNION ALL SELECT session, 1, max(page_id), host, '/stage/_external/' || max(page_id) FROM pg WHERE host LIKE '/www.%' GROUP BY session, host),
w AS (SELECT DISTINCT session, unnest([path, section, host, '/']) AS path FROM pg),
best AS (
  SELECT w.session, w.path, mp.from_path, mp.to_path
  FROM w LEFT JOIN mp ON mp.session = w.session
       AND (w.path = mp.from_path OR (mp.rank = 0 AND starts_with(w.path, mp.from_path || '/')))
  QUALIFY row_number() OVER (PARTITION BY w.session, w.path ORDER BY mp.rank, mp.ord, mp.from_path) = 1)
SELECT session, path, CASE WHEN from_path IS NOT NULL THEN to_path || substr(path, length(from_path) + 1)
       WHEN path = '/' THEN '/' ELSE '/stage/_external/' || regexp_extract(path, '[^/]*$') END AS staged_path FROM best""",
    "r1_sync_batch": f"""{SYNCED}
SELECT source_path AS path, event_id, op, action, {STATUS} AS status, disposition,
       CASE WHEN ignored OR op = 'DELETE' THEN '' ELSE findings END AS findings FROM synced""",

    "r2_sanitize_stream": turns_out(True),

    "r3_collapse_changes": """
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, event_id DESC) = 1""",

    "u1_register_detector": rf"""{EVAL},
c AS (SELECT *, disposition = 'BLOCKED' AS b, coalesce(sanitized_text, text) AS now FROM it),
a AS (SELECT *, CASE WHEN b THEN 0 ELSE len(regexp_extract_all(now, '[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}')) END AS n,
             regexp_replace(now, '[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}', '<redacted>', 'g') AS r FROM c)
SELECT path, CASE WHEN b THEN 'BLOCKED' WHEN r <> text THEN 'WRITE_SANITIZED_TEXT' ELSE 'COPY_ORIGINAL' END AS disposition,
       CASE WHEN NOT b AND r <> text THEN sha256(r) END AS sanitized_sha,
       findings || CASE WHEN n > 0 THEN CASE WHEN findings = '' THEN '' ELSE chr(10) END
           || 'REDACT|TEXT_SANITIZER_BACKEND|' || n || ' address(es)|addresses' ELSE '' END AS findings FROM a""",
    "j5_symbol_rule_hits": """
SELECT 'app/' || replace(p_brand, '#', '') || '/P' || p_partkey || '.kt' AS path, 0::BIGINT AS rule_ord, 'hide-symbols' AS rule_id,
       'REDACT' AS action FROM part WHERE p_partkey % 6 <= 3 AND p_partkey % 7 <> 6""",
    "t1_apply_policy_detectors": rf"""WITH {FILES},
d AS (SELECT f.*, d.lang, d.source, f.doc_id % 5 AS kind, regexp_replace(f.text, '{EMAIL}', '<redacted:email>', 'g') AS t1
      FROM f JOIN documents d ON d.doc_id = f.doc_id),
l AS (SELECT *, CASE WHEN kind IN (0, 3) THEN replace(replace(t1, source, '<redacted>'), lang, '<redacted>') ELSE t1 END AS t2,
             substr(text, 1, 2) AS v1, substr(text, CAST(size // 2 AS INT) + 1, 1) AS v2 FROM d),
v AS (SELECT *, size >= 2 AND regexp_matches(v1, '[^ \n]') AS has1, regexp_matches(v2, '[^ \n]') AS has2 FROM l),
p AS (SELECT *, CASE WHEN has1 THEN replace(t2, v1, '<redacted>') ELSE t2 END AS t2b FROM v),
z AS (SELECT *, CASE WHEN kind = 0 AND t2 = text THEN 'clean ' || lang WHEN kind = 1 THEN
                  CASE WHEN has2 THEN replace(t2b, v2, '<redacted>') ELSE t2b END ELSE t2 END AS t3 FROM p)
SELECT path, CASE WHEN t3 <> text THEN 'WRITE_SANITIZED_TEXT' ELSE 'COPY_ORIGINAL' END AS disposition,
       CASE WHEN t3 <> text THEN sha256(t3) END AS sanitized_sha,
       concat_ws(chr(10), CASE WHEN t1 <> text THEN 'REDACT|POLICY_RULE|Redacted content using rule redact-email|redact-email' END,
           CASE WHEN t2 <> t1 THEN 'REDACT|TEXT_SANITIZER_BACKEND|Detected 5 secret-like value(s) via gitleaks|gitleaks' END,
           CASE WHEN t3 <> t2 THEN 'REDACT|TEXT_SANITIZER_BACKEND|' || CASE WHEN kind = 0 THEN 'found ' || source ELSE 'careful' END
                || '|privacy-filter' END) AS findings,
       CASE kind WHEN 1 THEN 'nothing' WHEN 2 THEN 'unparsable' WHEN 4 THEN 'missing'
            ELSE CASE WHEN t1 = text THEN 'ok' ELSE 'stale' END END AS leaks_status,
       CASE kind WHEN 2 THEN 'unparsable' WHEN 3 THEN 'nothing' WHEN 4 THEN 'missing'
            ELSE CASE WHEN t2 = text THEN 'ok' ELSE 'stale' END END AS privacy_status FROM z""",
}

ORACLES["r1_sync_state"] = ORACLES["r1_sync_batch"]

ORACLES["j5_rule_table"] = f"""WITH {FILES}, r AS (
  SELECT item_id AS rule_ord, 'item-' || item_id AS rule_id, 'BLOCK' AS action, item_id % 4 = 1 AS in_src, item_id % 3 = 0 AS even,
         array_to_string(w[1:4], ' ') AS p, CASE WHEN item_id % 5 = 0 THEN array_to_string(w[9:12], ' ') END AS q
  FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)
  UNION ALL SELECT 1000000 + c_custkey, 'customer-' || c_custkey, 'REDACT', false, false, c_name, NULL FROM customer)
SELECT path, rule_ord, rule_id, action FROM f JOIN r ON (contains(text, p) OR contains(text, q))
  AND (NOT in_src OR path LIKE 'src/%') AND (NOT even OR regexp_matches(path, '/src[0-9]*[02468]/'))"""

ORACLES["t5_secret_formats"] = """
SELECT name AS format, count(*) AS texts, count(*) FILTER (kind < 5) AS found, count(*) AS as_expected
FROM documents JOIN (VALUES (0, 'assignment'), (1, 'access key'), (2, 'repository token'), (3, 'private key'), (4, 'web token'), (5, 'near miss')) f(kind, name)
  ON f.kind = doc_id % 6 GROUP BY name"""
