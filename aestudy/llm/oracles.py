"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

URL_FILTER = r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), keyed AS (
  SELECT *, host || regexp_replace(path, '/+$', '') AS key FROM parts
), listed AS (
  SELECT DISTINCT key FROM keyed
  WHERE host <> '' AND regexp_matches(url, '(?i)^[^:]*://[^/?#]*(casino|pills|bets|adult|spam)')
), rules(rule_host, rule_path, decides) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fitting AS (
  SELECT k.page_id, k.host, k.path,
         arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(decides, length(rule_host || rule_path)) AS decides
  FROM (SELECT DISTINCT page_id, host, path FROM keyed) k JOIN rules
    ON (k.host = rule_host OR ends_with(k.host, '.' || rule_host)) AND starts_with(k.path, rule_path)
  GROUP BY 1, 2, 3
)
SELECT k.page_id, k.host, k.path, f.rule,
       coalesce(f.decides, CASE WHEN l.key IS NOT NULL AND k.host <> '' THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed k
LEFT JOIN fitting f ON k.page_id IS NOT DISTINCT FROM f.page_id AND k.host = f.host AND k.path = f.path
LEFT JOIN listed l ON k.key = l.key
"""

EXACT_DEDUP = """
WITH hashed AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY t)
"""

#: The checksum is worked out byte by byte from its table; near words share what deleting one letter leaves.
SPELLING_TRIE = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), steps AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
), lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM runs GROUP BY 1, 2
), coded AS (
  SELECT w, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
      lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)]
                      ELSE [CAST(195 AS BIGINT), CAST(unicode(ch) - 64 AS BIGINT)] END)) AS bytes
  FROM lowered
), summed AS (
  SELECT w, n, xor(list_reduce(bytes, lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1]), CAST(4294967295 AS BIGINT)),
                   CAST(4294967295 AS BIGINT)) AS h
  FROM coded, steps
), spelt AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n
  FROM summed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3
), cuts AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), met AS (
  SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word
), ranked AS (
  SELECT m.word, m.near, o.n AS near_n, count(*) OVER (PARTITION BY m.word) AS n_near,
         row_number() OVER (PARTITION BY m.word ORDER BY o.n DESC, m.near) AS place
  FROM met m JOIN words o ON m.near = o.word
), formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.place = 1
), chains(word, reached, hops) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL
  SELECT c.word, f.form, c.hops + 1 FROM chains c JOIN formed f ON c.reached = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(reached, hops) AS root FROM chains GROUP BY 1
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r USING (word)
"""


def ball_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Plain k-means: every part is compared with every entry in every round."""
    steps = [
        """kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q,
         row_number() OVER (ORDER BY vec_id) AS place
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""pieces AS (
  SELECT vec_id, label, place, part, q[part * len(q) // {parts} + 1 : (part + 1) * len(q) // {parts}] AS x
  FROM kept, (SELECT range AS part FROM range({parts}))
)""",
        f"books0 AS (SELECT part, place - 1 AS entry, x AS c FROM pieces WHERE place <= {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""near{r} AS (
  SELECT p.vec_id, p.label, p.part, p.x,
         min({{'d': list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.entry}}) AS best
  FROM pieces p JOIN books{r} b USING (part) GROUP BY p.vec_id, p.label, p.part, p.x
)"""
        )
        if r < rounds:
            steps.append(
                f"""means{r} AS (
  SELECT part, entry, list(v ORDER BY i) AS c FROM (
    SELECT part, best.e AS entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS v
    FROM (SELECT part, best, x, unnest(range(1, len(x) + 1)) AS i FROM near{r}) GROUP BY 1, 2, 3
  ) GROUP BY 1, 2
), books{r + 1} AS (
  SELECT part, entry, coalesce(m.c, b.c) AS c FROM books{r} b LEFT JOIN means{r} m USING (part, entry)
)"""
            )
    steps.append(
        f"""coded AS (
  SELECT vec_id, label, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY 1, 2
), digest AS (
  SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books{rounds}
)"""
    )
    return "WITH " + ", ".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, digest
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": URL_FILTER, "op4_exact_dedup": EXACT_DEDUP, "op11_spelling_trie": SPELLING_TRIE, "op12_ball_codes": ball_codes_sql()}
