"""DuckDB SQL of the queries that SQL can state."""

SQL: dict[str, str] = {}

SQL["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS NOT NULL AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM m"""

SQL["op4_host_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) > 7),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM h) WHERE n > 1),
rw AS (SELECT doc_id, CAST(count(DISTINCT i + k) AS BIGINT) AS n FROM r, range(8) AS s(k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dl AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT doc_id, line, count(*) AS n FROM ln
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
b AS (SELECT d.doc_id, d.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
       CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines,
       coalesce(rw.n, 0) AS n_repeat_words
      FROM d JOIN w USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
ho AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS DOUBLE) AS x FROM f WHERE source IS NOT NULL GROUP BY source),
mm AS (SELECT count(*) AS k, sum(n) AS nn, (sum(x) + 0.5) / (sum(n) + 1.0) AS mu, sum(n * n) AS sq FROM ho),
sc AS (SELECT sum(n * pow(x / n - mu, 2)) AS sc, any_value(mu) AS mu, any_value(k) AS k, any_value(nn - sq / nn - (k - 1)) AS room FROM ho, mm),
rh AS (SELECT mu, CASE WHEN k > 1 AND room > 0 THEN (sc / (mu * (1 - mu)) - (k - 1)) / room ELSE 0 END AS rho FROM sc),
pr AS (SELECT mu, greatest(8.0, 1 / least(greatest(rho, 1e-6), 0.999999) - 1) AS wt FROM rh),
bad AS (SELECT source FROM ho, pr WHERE (x + mu * wt) / (n + wt) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(source IN (SELECT source FROM bad), false) AS host_rejected,
       NOT base_failed AND NOT coalesce(source IN (SELECT source FROM bad), false) AS kept
FROM f"""

SQL["op7_minhash"] = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 2], ' ')) AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

SQL["op12_chat_format"] = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m(role, before, after) AS (VALUES ('system', '<<SYS>>', '<</SYS>>'), ('user', '[INST] ', ' [/INST]'), ('assistant', '<s>', '</s>')),
f AS (SELECT t.*, before || regexp_replace(text, '(<)(\\*/?s>|\\*<SYS>>|\\*</SYS>>)|(\[)(\\*/?INST\]|\\*ROLE=|\\*/ROLE\])', '\1\3\\\2\4', 'g') || after AS formatted,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before_role FROM t LEFT JOIN m USING (role))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars,
       bool_and((coalesce(before_role, 'assistant'), role) IN (('assistant', 'user'), ('user', 'assistant'), ('system', 'user'))
                OR (before_role IS NULL AND role = 'system')) AS accepted
FROM f GROUP BY conv_id"""
