"""DuckDB SQL over the whole tables, one statement a query."""

import re

from .licenses import PHRASES, TEMPLATES, Automaton

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANK = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
p AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS s
      FROM (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
v AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
f AS (SELECT doc_id, i, p.m AS m, item FROM v JOIN p ON v.s = p.s AND v.m = p.m),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM f) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

_NGRAMS = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}
OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS w FROM documents),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT unnest({list(_NGRAMS)}) AS n) WHERE len(w) >= n)),
r AS (SELECT doc_id, n, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, n, s) > 1),
k AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS j FROM r),
c AS (SELECT doc_id, n, count(*) AS words, CAST(sum(len(w[j])) AS BIGINT) AS chars FROM k JOIN d USING (doc_id) GROUP BY ALL),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_BLANK}')),
z AS (SELECT doc_id, count(*) AS n_dup_lines, CAST(sum(len(array_to_string(regexp_extract_all(line, '{_BLANK}'), ''))) AS BIGINT) AS dup_line_chars FROM l WHERE nth > 1 GROUP BY 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_line_chars, 0) AS dup_line_chars,
      coalesce((SELECT words FROM c WHERE c.doc_id = d.doc_id AND n = 8), 0) AS n_repeat_words,
      {", ".join(f"coalesce((SELECT chars FROM c WHERE c.doc_id = d.doc_id AND n = {n}), 0) AS dup_{n}gram_chars" for n in _NGRAMS)}
      FROM d LEFT JOIN z USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * n_symbols <= 10 * n_words AND 100 * dup_line_chars <= 30 * word_chars AND {" AND ".join(f"100 * dup_{n}gram_chars <= {p} * word_chars" for n, p in _NGRAMS.items())} AS kept FROM b
"""

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS w FROM documents),
v AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
k AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r),
g AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM k GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce((SELECT string_agg(x, ' ' ORDER BY j) FROM (SELECT unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j) WHERE NOT list_contains(js, j)), '') END) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_BLANK}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS x FROM d),
n AS (SELECT doc_id, CAST(len(x) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(x)) AS v FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS root, doc_id AS node FROM n UNION SELECT r.root, u.b FROM r JOIN u ON u.a = r.node)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN (SELECT node, min(root) AS c FROM r GROUP BY 1) m ON m.node = n.doc_id
"""



def _template(label: str, markup: str) -> str:
    """Where the label's template is accepted (doc_id, b, n), with words from 1. A template is a regular
    expression over words that each follow a space; greedy matches are the longest."""
    a, pattern = Automaton(markup), ""
    for part in re.findall(r"\[\[.*?\]\]|<<\d+>>|[^\s\[<]+", markup):
        pattern += rf"(?: [^ ]+){{0,{part[2:-2]}}}" if part.startswith("<<") else f"(?: {part[2:-2]})?" if part.startswith("[[") else f" {part}"
    anchor, k = a.anchor.decode(), a.anchor.count(b" ") + 1
    found = f"""SELECT '{label}' AS label, doc_id, i, b, regexp_extract(' ' || array_to_string(w[b:b + {a.most - 1}], ' ') || ' ', '^{pattern} ') AS m
      FROM (SELECT doc_id, w, i, unnest(range(greatest(1, i - {a.before}), i + 1)) AS b FROM
        (SELECT doc_id, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM d WHERE contains(s, ' {anchor} ')) WHERE array_to_string(w[i:i + {k - 1}], ' ') = '{anchor}')"""
    return f"SELECT label, doc_id, b, len(m) - len(replace(m, ' ', '')) - 1 AS n FROM ({found}) WHERE m <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY b) = 1"


def _phrase(phrase: str, label: str) -> str:
    k = phrase.count(" ") + 1
    return f"SELECT '{label}' AS label, doc_id, i AS b, {k} AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM d WHERE contains(s, ' {phrase} ')) WHERE array_to_string(w[i:i + {k - 1}], ' ') = '{phrase}'"


OP8 = rf"""
WITH d AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents)),
p AS ({" UNION ALL ".join(_phrase(x, y) for x, y in PHRASES.items())}),
t AS ({" UNION ALL ".join(_template(x, y) for x, y in TEMPLATES.items())}),
a AS (SELECT * FROM p UNION ALL SELECT * FROM t),
pb AS (SELECT doc_id, count(*) AS n_base, min(b) - 1 AS first_word, max(b) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY 1),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM a GROUP BY 1),
c AS (SELECT doc_id, count(DISTINCT j) AS inside FROM (SELECT doc_id, unnest(range(b, b + n)) AS j FROM a) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(inside, 0) / greatest(len(w), 1) AS score
FROM d LEFT JOIN pb ON pb.doc_id = d.doc_id LEFT JOIN al ON al.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

ORACLE_SQL = {"op8_license_scan": OP8, "op1_decontamination": OP1, "op2_substring_dedup": OP2, "op5_near_dedup": OP5, "op9_quality_rules": OP9}
