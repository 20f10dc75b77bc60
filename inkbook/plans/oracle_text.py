"""Oracle SQL: text audits. DuckDB's regex engine has no look-around, so the
claim cases are stated from how each claim text is built (FIXTURES.md §2.1)."""
from inkbook.plans.oracle import cte, q

cte("claims", """
SELECT claim_id, v, c, CAST(v AS VARCHAR) AS vs,
       CASE c WHEN 0 THEN 'Order total is £' || CAST(v AS VARCHAR) || ' for this customer'
              WHEN 1 THEN 'Roughly £' || CAST(v AS VARCHAR) || ' was billed to this customer'
              WHEN 2 THEN 'Order total — £' || CAST(v AS VARCHAR)
              WHEN 3 THEN 'Review the order of £' || CAST(v + 1 AS VARCHAR) || ' with its customer'
              WHEN 4 THEN 'Order JOB_' || CAST(v AS VARCHAR) || ' closed'
              ELSE 'Order total is £' || CAST(v AS VARCHAR) || '.00 exactly' END AS text
FROM (SELECT o_orderkey AS claim_id, CAST(floor(o_totalprice) AS BIGINT) AS v, o_orderkey % 6 AS c
      FROM orders) t
""")

cte("claim_tokens", """
SELECT claim_id, CAST(1 AS BIGINT) AS pos,
       CASE c WHEN 3 THEN '£' || CAST(v + 1 AS VARCHAR) WHEN 5 THEN '£' || vs || '.00' ELSE '£' || vs END AS token,
       CASE c WHEN 3 THEN CAST(v + 1 AS VARCHAR) ELSE vs END AS canonical
FROM claims WHERE c <> 4
""", "claims")

q("numeric_tokens", "SELECT claim_id, pos, token FROM claim_tokens", "claim_tokens")
q("canonical_figure", "SELECT claim_id, token, canonical FROM claim_tokens", "claim_tokens")
q("figure_violations", "SELECT claim_id, pos, token, canonical FROM claim_tokens WHERE canonical <> (SELECT vs FROM claims x WHERE x.claim_id = claim_tokens.claim_id)", "claim_tokens", "claims")
q("hedged_figures", "SELECT claim_id, c = 1 AS hedged FROM claims", "claims")
q("banned_characters", "SELECT claim_id, c = 2 AS banned FROM claims", "claims")
q("text_quality", """
SELECT claim_id, CAST(length(text) AS BIGINT) AS n_chars,
       CAST(CASE c WHEN 0 THEN 7 WHEN 1 THEN 7 WHEN 2 THEN 4 WHEN 3 THEN 8 WHEN 4 THEN 3 ELSE 5 END AS BIGINT) AS n_words,
       length(text) < 180 AS too_thin, c = 3 AS imperative
FROM claims""", "claims")
q("text_quality_documents", r"""
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars,
       CAST(len(regexp_extract_all(coalesce(text, ''), '\S+')) AS BIGINT) AS n_words,
       length(t) < 180 AS too_thin,
       regexp_matches(lower(t), '^(?:feed|review|set|agree|implement|adjust|investigate|put|start|use|turn|move|check|give|run|make) ') AS imperative
FROM (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents) d""")
q("audit_verdict", """
SELECT claim_id, c NOT IN (1, 2, 3) AS accepted,
       CASE c WHEN 1 THEN 'text: hedged a figure with an approximation'
              WHEN 2 THEN 'text: contains a banned character'
              WHEN 3 THEN 'text: quotes figures not in the data (£' || CAST(v + 1 AS VARCHAR) || ')'
              ELSE '' END AS problems
FROM claims""", "claims")
