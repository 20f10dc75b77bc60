"""DuckDB SQL of the training-data operators that SQL can express."""
from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11 = f"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                      '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM piece),
gram AS (
  SELECT lang, k, w[i] AS w1, CASE WHEN k > 1 THEN w[i + 1] ELSE '' END AS w2,
         CASE WHEN k > 2 THEN w[i + 2] ELSE '' END AS w3
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), (SELECT unnest([1, 2, 3]) AS k)
  WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, w1, w2, w3, count(*)::HUGEINT AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
one AS (SELECT lang, w1, f FROM f WHERE k = 1),
two AS (SELECT lang, w1, w2, f FROM f WHERE k = 2),
three AS (SELECT lang, w1, w2, w3, f FROM f WHERE k = 3 AND f >= 10),
cut AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS j, p.f AS l, q.f AS r
  FROM two t JOIN one p ON p.lang = t.lang AND p.w1 = t.w1 JOIN one q ON q.lang = t.lang AND q.w1 = t.w2
  WHERE t.f >= 10 AND NOT EXISTS (
    SELECT 1 FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) x
    WHERE x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 AND 100 * x.f >= 50 * t.f)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, p.f, q.f
  FROM three t JOIN one p ON p.lang = t.lang AND p.w1 = t.w1
  JOIN two q ON q.lang = t.lang AND q.w1 = t.w2 AND q.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, p.f, q.f
  FROM three t JOIN two p ON p.lang = t.lang AND p.w1 = t.w1 AND p.w2 = t.w2
  JOIN one q ON q.lang = t.lang AND q.w1 = t.w3),
kept AS (
  SELECT *, (1000000::HUGEINT * a * a) // (l * r) AS score FROM cut
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
       score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

OP12 = """
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc)),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM doc)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, (SELECT unnest(range(0, 20)) AS j)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

ORACLE: dict[str, str] = {"op11_collocations": OP11, "op12_passages": OP12}
