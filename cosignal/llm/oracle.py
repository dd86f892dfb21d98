"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from cosignal.llm import chat, line_dedup, mixing
from cosignal.llm.queries import CONTROL_TEXT, URL_HOST_RULES
from cosignal.llm.url_rules import DEFAULT_PATTERNS

BLANKS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP2 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_quote(CONTROL_TEXT)}
  UNION ALL SELECT -1, 1, 'assistant', {_quote(CONTROL_TEXT)}),
safe AS (
  SELECT *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS t,
         replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n') AS r FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = '{chat.TRAINED_ROLE}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{chat.TRAINED_ROLE}'), '')) AS loss_sha256,
       CAST(sum({len(chat.START)} + length(r) + 1 + length(t) + {len(chat.END) + 1}) AS BIGINT) AS formatted_chars
FROM safe GROUP BY conv_id
"""

OP3 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens
  FROM documents),
src AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS docs FROM docs GROUP BY source),
live AS (SELECT *, tokens / (SELECT sum(tokens) FROM src) AS share FROM src WHERE tokens > 0),
facts AS (SELECT count(*) AS n, max(tokens) AS high, min(tokens) AS low,
                 {mixing.TARGET_ENTROPY} * ln(count(*)) AS wanted FROM live),
steps(i, low, high) AS (
  SELECT 0, CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN e.h >= f.wanted THEN (s.low + s.high) / 2 ELSE s.low END,
         CASE WHEN e.h >= f.wanted THEN s.high ELSE (s.low + s.high) / 2 END
  FROM steps s, facts f, LATERAL (
    SELECT ln(sum(pow(share, (s.low + s.high) / 2)))
           - (s.low + s.high) / 2 * sum(pow(share, (s.low + s.high) / 2) * ln(share))
             / sum(pow(share, (s.low + s.high) / 2)) AS h FROM live) e
  WHERE i < {mixing.STEPS}),
alpha AS (
  SELECT CASE WHEN n < 2 THEN 1.0 ELSE least(1.0, ceil(greatest((SELECT low FROM steps WHERE i = {mixing.STEPS}),
         CASE WHEN high / low > {mixing.MAX_PASSES} THEN 1 - ln({mixing.MAX_PASSES}) / ln(high / low) ELSE 0 END) * 1e6) / 1e6) END AS a
  FROM facts),
power AS (SELECT source, tokens, docs, pow(share, a) AS p FROM live, alpha),
mass AS (SELECT sum(p) AS m, max(tokens / p) AS most FROM power),
budgets AS (
  SELECT s.source, s.tokens, s.docs, coalesce(p / m, 0.0) AS weight,
         CASE WHEN s.tokens > 0 THEN CAST(greatest(s.tokens, floor(p * most + 1e-6)) AS BIGINT) ELSE 0 END AS budget
  FROM src s LEFT JOIN power USING (source), mass),
planned AS (
  SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS passes,
         CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest,
         CAST(ceil(docs / {mixing.BLOCK_DOCS}) AS BIGINT) AS blocks FROM budgets),
dealt AS (
  SELECT d.doc_id, d.source, d.tokens, p.weight, p.passes, p.rest, p.blocks, p.tokens AS all_tokens, p.budget,
         e.epoch, md5('{mixing.MIX_SEED}|' || e.epoch || '|' || coalesce(d.source, '') || '|' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS order_key
  FROM docs d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source,
       LATERAL (SELECT unnest(range(0, p.passes + 1)) AS epoch) e),
placed AS (
  SELECT *, CAST('0x' || substr(order_key, 1, 8) AS BIGINT) / pow(2.0, 32) AS f FROM dealt),
counted AS (
  SELECT *, CASE WHEN epoch = passes THEN
           sum(tokens) OVER (PARTITION BY source, epoch ORDER BY CAST(floor(f * blocks) AS BIGINT), order_key) ELSE 0 END AS running
  FROM placed)
SELECT doc_id, source, epoch, order_key, CAST(floor(f * blocks) AS BIGINT) AS block, tokens,
       round(least((epoch + f) / greatest(1.0, budget / greatest(all_tokens, 1)), 1 - 1e-9), 9) AS position,
       round(weight, 9) AS weight, round(a, 6) AS alpha
FROM counted, alpha WHERE epoch < passes OR (running <= rest AND rest > 0)
"""

OP8 = f"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, url, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h, coalesce(rest, '') AS rest FROM parts),
places AS (
  SELECT page_id, url, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM cut),
host_rules(h, p, action) AS (VALUES {', '.join(str(r) for r in URL_HOST_RULES)}),
pattern_rules(name, pattern, action) AS (VALUES {', '.join(f"({_quote(r.name)}, {_quote(r.pattern.replace(chr(92) + 'Z', chr(92) + 'z'))}, {_quote(r.action)})" for r in DEFAULT_PATTERNS)}),
by_host AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM places JOIN host_rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
by_pattern AS (
  SELECT page_id, min(name) AS rule, arg_min(action, name) AS action
  FROM places JOIN pattern_rules ON regexp_matches(coalesce(url, ''), pattern) GROUP BY page_id)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.action, q.action, 'allow') AS verdict,
       CASE WHEN b.rule IS NULL THEN q.rule END AS pattern_rule
FROM places LEFT JOIN by_host b USING (page_id) LEFT JOIN by_pattern q USING (page_id)
"""

OP10 = f"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, trim(line, {BLANKS}) AS k FROM lines),
boilerplate AS (
  SELECT k, min(doc_id) AS home FROM keyed WHERE k <> '' GROUP BY k
  HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
marked AS (
  SELECT keyed.*, b.k IS NOT NULL AND doc_id IS DISTINCT FROM b.home AS gone
  FROM keyed LEFT JOIN boilerplate b ON keyed.k = b.k)
SELECT doc_id, count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
       length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_chars,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP11 = """
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM given),
placed AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
         greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
         array_to_string(u[b + 1:], '') AS suf
  FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

ORACLE = {"op2_chat_format": OP2, "op3_mix_sources": OP3, "op8_url_rules": OP8, "op10_line_dedup": OP10,
          "op11_fill_middle": OP11}
