"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from .secrets import BASE, RULES

# Words as decontamination takes them, of one table; then the windows of the benchmark, and where they occur.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
items AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM items),
starts AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d JOIN sizes ON len(w) >= n),
found AS (SELECT doc_id, i, s.n, item_id FROM starts s JOIN items t ON t.n = s.n AND t.win = array_to_string(s.w[s.i:s.i + s.n - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN met USING (doc_id)
"""

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
wins AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS lo FROM wins GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM wins JOIN firsts USING (h) WHERE doc_id > lo),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ps, k)), lambda k: w[k]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""


def _secrets() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    parts = []
    for n, rule in enumerate(RULES):
        # RE2 folds more than ASCII when it ignores case, so cases are spelled out.
        pattern = rule.pattern
        if rule.kind == "assign":
            named = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
            pattern = pattern.replace("(?i:(password|passwd|secret|token|api_?key))", f"({named})")
        p = quoted(pattern)
        parts.append(
            f"SELECT doc_id, {n} AS kind_no, '{rule.kind}' AS kind, string_split_regex(text, {p}) AS between, regexp_extract_all(text, {p}) AS met, regexp_extract_all(text, {p}, {rule.group}) AS value, {rule.least} AS least FROM d WHERE regexp_matches(text, {p})"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
runs AS ({' UNION ALL '.join(parts)}),
rows AS (SELECT doc_id, kind_no, kind, least, unnest(range(1, len(met) + 1)) AS i, between, met, value FROM runs),
measured AS (SELECT doc_id, kind_no, kind, least, i, length(between[i]) AS gap, length(met[i]) AS size, length(value[i]) AS n FROM rows),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, kind_no ORDER BY i) AS stop FROM measured),
spans AS (SELECT doc_id, kind_no, kind, CAST(stop - size AS BIGINT) AS start, kind || ':' || CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM placed WHERE n >= least),
lists AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
  string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind IN {BASE}) AS base, string_agg(span, ',' ORDER BY start, kind_no) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN lists USING (doc_id)
"""


SECRETS = _secrets()
