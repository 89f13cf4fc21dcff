"""The queries that SQL can express, for DuckDB over the same tables; written apart from the operators."""

OP2 = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sizes GROUP BY source
), weighted AS (
  SELECT *, number % 3 + 1 AS weight, 3 * source_size AS most, sum(source_size) OVER () AS everything FROM sources
), levels AS (
  SELECT *, (everything - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighted WINDOW o AS (ORDER BY most::DOUBLE / weight, number)
), targets AS (
  SELECT source, source_size, least(most::DOUBLE, max(level) OVER () * weight) AS target FROM levels
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, round(t.target)::BIGINT AS goal,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('0:' || s.doc_id), s.doc_id ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - start - source_size)) + greatest(0, least(size, goal - start - 2 * source_size)))::BIGINT AS taken
FROM placed
"""

OP5 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) AS n FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  sum(n + length('<turn role="') + length('">') + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP6 = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY text)
"""

OP8 = r"""
WITH rows AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.v, r.v)::BIGINT AS score FROM rows q JOIN rows r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP12 = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
    left(sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS id
  FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT conv_id::BIGINT AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS k, id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM turns
), convs AS (
  SELECT c, c - c % 20 AS base,
    xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]), lambda a, b:
      list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM numbered)
), rebuilt AS (
  SELECT c, 0 AS part, k, id, words FROM convs JOIN numbered ON conv_id = base AND k <= h
  UNION ALL SELECT c, 1, k, id, words FROM convs JOIN numbered ON conv_id = c AND k > h
), placed AS (
  SELECT c, words, row_number() OVER own AS depth, string_agg(id, '/') OVER own AS path FROM rebuilt WINDOW own AS (PARTITION BY c ORDER BY part, k ROWS UNBOUNDED PRECEDING)
), members AS (
  SELECT c, depth, path, words, depth = max(depth) OVER (PARTITION BY c) AS ends FROM placed
  UNION ALL SELECT c, 0, '', 0, c NOT IN (SELECT c FROM placed) FROM convs
), nodes AS (
  SELECT path, any_value(depth)::BIGINT AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM members GROUP BY path
), tree AS (
  SELECT n.*, CASE WHEN depth > 0 THEN left(path, greatest(0, 33 * (depth - 1) - 1)) END AS above FROM nodes n
), kids AS (SELECT above AS path, count(*) AS n_children FROM tree WHERE above IS NOT NULL GROUP BY above
), figures AS (SELECT tree.*, coalesce(n_children, 0) AS n_children FROM tree LEFT JOIN kids USING (path)
), sums AS (
  SELECT left(path, greatest(0, 33 * d - 1)) AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM figures) GROUP BY 1
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM figures f JOIN sums s USING (path) LEFT JOIN nodes p ON p.path = f.above
"""

ORACLE = {"op2_source_mix": OP2, "op5_chat_format": OP5, "op6_exact_dedup": OP6, "op8_exact_top_k": OP8, "op12_conversation_trie": OP12}
