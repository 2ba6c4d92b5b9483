"""SQL, as DuckDB runs it, for the queries whose results SQL can express on whole tables."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ESCAPED = r"regexp_replace(regexp_replace(replace({}, '\', '\e'), '<(/?s>|</?SYS>>|\|)', '\\l\1', 'g'), '\[(/?INST\])', '\\b\1', 'g')"

_DRAW = "('0x' || substr(g, {}, 8))::BIGINT"

SQL = {
    "op1_decontaminate": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
 i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_ITEM_WORDS} AS w FROM benchmark),
 pat AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS p FROM i, LATERAL unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(k) WHERE len(w) > 0),
 win AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS p FROM d, (SELECT DISTINCT n FROM pat) s, LATERAL unnest(range(1, len(w) - n + 2)) t(k)),
 hit AS (SELECT r, k, n, item FROM win JOIN pat USING (n, p)),
 cov AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM hit, LATERAL unnest(range(n)) u(j) GROUP BY 1),
 own AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY 1)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN cov USING (r) LEFT JOIN own USING (r)""",
    "op5_suffix_dedup": """WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
 win AS (SELECT r, k, hash(b[k:k + 199]) AS h1, hash(b[k:k + 199] || '\\x01'::BLOB) AS h2 FROM d, LATERAL unnest(range(1, octet_length(b) - 198)) t(k)),
 often AS (SELECT h1, h2 FROM win GROUP BY ALL HAVING count(*) > 1),
 dup AS (SELECT r, k FROM win SEMI JOIN often USING (h1, h2)),
 isl AS (SELECT r, k, sum(fresh) OVER (PARTITION BY r ORDER BY k) AS g FROM (SELECT r, k, CASE WHEN k <= lag(k) OVER (PARTITION BY r ORDER BY k) + 200 THEN 0 ELSE 1 END AS fresh FROM dup)),
 run AS (SELECT r, g, min(k) AS a, max(k) + 199 AS z FROM isl GROUP BY ALL),
 gap AS (SELECT r, a AS e, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS s FROM run UNION ALL SELECT d.r, octet_length(b) + 1, coalesce((SELECT max(z) FROM run WHERE run.r = d.r), 0) + 1 FROM d),
 kept AS (SELECT r, string_agg(hex(b[s:e - 1]), '' ORDER BY s) AS x FROM gap JOIN d USING (r) WHERE s < e GROUP BY 1),
 cut AS (SELECT r, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM run GROUP BY 1)
 SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(x, ''))) AS kept_sha256
 FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)""",
    "op9_substring_dedup": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
 win AS (SELECT r, k, md5(array_to_string(w[k:k + 34], ' ')) AS p FROM d, LATERAL unnest(range(1, len(w) - 33)) t(k)),
 dup AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY p) AS n FROM win) WHERE n > 1),
 cut AS (SELECT DISTINCT r, k + j AS i FROM dup, LATERAL unnest(range(35)) u(j)),
 word AS (SELECT r, i, w[i] AS x FROM d, LATERAL unnest(range(1, len(w) + 1)) t(i)),
 kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS x FROM word ANTI JOIN cut USING (r, i) GROUP BY 1)
 SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(x, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op10_chat_format": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
 m AS (SELECT *, length(role || chr(10) || {_ESCAPED.format("text")}) + length(replace({_ESCAPED.format("role")}, chr(10), '\\n')) - length(role) + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END AS size,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM c),
 s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM m)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, (sum(upto) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars FROM s GROUP BY conv_id""",
    "op11_fill_in_middle": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS g FROM documents),
 u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, {_DRAW.format(1)} AS a, {_DRAW.format(9)} AS b, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_DRAW.format(17)} % 100 >= 90 AS plain, {_DRAW.format(25)} % 100 < 20 AS spm FROM d),
 c AS (SELECT *, len(w) AS n, least(a % (len(w) + 1), b % (len(w) + 1)) AS lo, greatest(a % (len(w) + 1), b % (len(w) + 1)) AS hi FROM u),
 s AS (SELECT *, coalesce(array_to_string(w[1:lo], ''), '') AS p, coalesce(array_to_string(w[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(w[hi + 1:n], ''), '') AS s FROM c)
 SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
 sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s""",
}
