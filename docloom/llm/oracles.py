"""SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from .op7_url_filter import LOWER, RULES, UPPER

WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, r.c FROM r JOIN both_ways b ON b.x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS o FROM win GROUP BY s),
bad AS (SELECT win.doc_id, win.i FROM win JOIN m ON m.s = win.s WHERE m.o < win.doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM bad)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
r AS (SELECT word.doc_id, count(*) AS n, count(g.p) AS k, string_agg(word.x, ' ' ORDER BY word.p) FILTER (WHERE g.p IS NULL) AS kept
      FROM word LEFT JOIN gone g ON g.doc_id = word.doc_id AND g.p = word.p GROUP BY word.doc_id)
SELECT d.doc_id, coalesce(r.n, 0) AS n_words, coalesce(r.k, 0) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""


def _rules() -> tuple[str, str]:
    rule, said = [], []
    for kind, text in sorted(RULES, key=lambda r: -len(r[1])):
        h, slash, p = text.partition("/")
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash + p}')"
        rule.append(f"WHEN {fits} THEN '{text}'")
        said.append(f"WHEN {fits} THEN '{kind}'")
    return f"CASE {' '.join(rule)} END", f"CASE {' '.join(said)} END"


_RULE, _SAID = _rules()

def _round(k: int) -> str:
    """One level of the template tree: rows r{k} (host, segs, rest, node, pages, n, g, share, text, template) to r{k + 1}."""
    beyond = "abs({g} / {n} - {s}) > 1.64 * sqrt({s} * (1 - {s}) / {n})"
    return f"""
nodes{k} AS (SELECT node, sum(pages) AS total, min(rest) AS a, max(rest) AS b FROM r{k} GROUP BY node HAVING min(rest) <> max(rest) AND sum(n) > 1),
on{k} AS (SELECT r.*, total, c, coalesce(rest[c + 1], chr(1)) AS seg, rest[c + 2:] AS behind, text || list_aggregate(list_prepend('', list_transform(rest[1:c], lambda x: '/' || x)), 'string_agg', '') AS here
 FROM r{k} r JOIN (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS c FROM nodes{k}) USING (node)),
kids{k} AS (SELECT node, seg, sum(pages) AS pages, sum(n) AS n, sum(g) AS g, any_value(total) AS total, any_value(share) AS share FROM on{k} GROUP BY node, seg),
rate{k} AS (SELECT node, sum(g) / sum(n) AS rate FROM kids{k} WHERE pages * pages < total AND seg <> chr(1) AND n > 0 GROUP BY node),
side{k} AS (SELECT *, CASE WHEN pages * pages >= total OR seg = chr(1) THEN '=' || seg WHEN n = 0 OR NOT ({beyond.format(g="g", n="n", s="rate")}) THEN '*' WHEN g / n < rate THEN '*<' ELSE '*>' END AS sibling FROM kids{k} LEFT JOIN rate{k} USING (node)),
sib{k} AS (SELECT node, sibling, sum(n) AS n, sum(g) AS g, any_value(share) AS share FROM side{k} GROUP BY node, sibling HAVING sum(n) > 0),
lag{k} AS (SELECT *, lag(n) OVER w AS ln, lag(g) OVER w AS lg FROM sib{k} WINDOW w AS (PARTITION BY node, sibling = '=' || chr(1) ORDER BY g / n, sibling)),
new{k} AS (SELECT *, (g + lg) / (n + ln) AS both, CASE WHEN abs(g / n - lg / ln) > 1.64 * sqrt((g + lg) / (n + ln) * (1 - (g + lg) / (n + ln)) * (1 / n + 1 / ln)) THEN 1 ELSE 0 END AS fresh FROM lag{k}),
run{k} AS (SELECT *, sum(fresh) OVER (PARTITION BY node, sibling = '=' || chr(1) ORDER BY g / n, sibling ROWS UNBOUNDED PRECEDING) AS run FROM new{k}),
pool{k} AS (SELECT *, sum(g) OVER w / sum(n) OVER w AS pooled FROM run{k} WINDOW w AS (PARTITION BY node, sibling = '=' || chr(1), run)),
alone{k} AS (SELECT *, {beyond.format(g="g", n="n", s="pooled")} AS alone FROM pool{k}),
br{k} AS (SELECT *, CASE WHEN alone THEN n ELSE sum(n) FILTER (NOT alone) OVER w END AS bn, CASE WHEN alone THEN g ELSE sum(g) FILTER (NOT alone) OVER w END AS bg, sum(n) OVER (PARTITION BY node) AS whole,
 CASE WHEN alone OR count(*) FILTER (NOT alone) OVER w = 1 THEN sibling ELSE min(sibling) FILTER (NOT alone) OVER w || '|…' END AS label FROM alone{k} WINDOW w AS (PARTITION BY node, sibling = '=' || chr(1), run)),
own{k} AS (SELECT node, sibling, label, bn < whole AND {beyond.format(g="bg", n="bn", s="share")} AS own, (bg + 4.0 * share) / (bn + 4.0) AS smooth FROM br{k}),
way{k} AS (SELECT s.node, s.seg, coalesce(label, s.sibling) AS label, coalesce(own, false) AS own, CASE WHEN own THEN smooth ELSE share END AS share FROM side{k} s LEFT JOIN own{k} o ON o.node = s.node AND o.sibling = s.sibling),
step{k} AS (SELECT o.host, segs, behind AS rest, o.node || chr(2) || label AS node, pages, n, g, w.share, here || '/' || replace(CASE WHEN label[1] = '=' THEN label[2:] ELSE label END, chr(1), '') AS text, template, own, o.seg FROM on{k} o JOIN way{k} w ON w.node = o.node AND w.seg = o.seg),
r{k + 1} AS (SELECT host, segs, rest, node, pages, n, g, share, text, CASE WHEN NOT own THEN template WHEN seg = chr(1) THEN text ELSE text || '/**' END AS template FROM step{k}
 UNION ALL SELECT r.host, segs, rest, r.node, pages, n, g, share, text, template FROM r{k} r WHERE node NOT IN (SELECT node FROM nodes{k}))"""


#: Rounds that the paths of the given pages need at most: they have two segments.
ROUNDS = 4

URLS = f"""
WITH u AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT *, {_RULE} AS rule, {_SAID} AS said, CASE WHEN regexp_matches(path, '[^/]') THEN string_split(regexp_replace(path, '^/+|/+$', '', 'g'), '/') ELSE []::VARCHAR[] END AS segs FROM u),
doc AS (SELECT page_id, try_cast(regexp_extract(url, '^[^?#]*/([0-9]+)(?:\\.[A-Za-z]+)?/?(?:[?#].*)?$', 1) AS BIGINT) AS doc_id FROM pages),
known AS (SELECT page_id, avg((quality * (1 - toxic))::DOUBLE) AS good FROM doc JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY page_id),
paths AS (SELECT host, segs, count(*) AS pages, count(good)::DOUBLE AS n, coalesce(sum(good), 0.0) AS g FROM p LEFT JOIN known USING (page_id) GROUP BY host, segs),
base AS (SELECT coalesce(sum(g) / nullif(sum(n), 0), 1.0) AS b FROM paths),
hosts AS (SELECT host, (sum(g) + 4.0 * (SELECT b FROM base)) / (sum(n) + 4.0) AS share FROM paths GROUP BY host),
r0 AS (SELECT host, segs, segs AS rest, host AS node, pages, n, g, share, '' AS text, '/**' AS template FROM paths JOIN hosts USING (host)),
{",".join(_round(k) for k in range(ROUNDS))}
SELECT page_id, p.host, path, rule, coalesce(said, CASE WHEN share < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, round(share, 9) AS purity FROM p JOIN r{ROUNDS} r ON r.host = p.host AND r.segs = p.segs
"""

#: Lines as what stands between line feeds: a last empty piece is no unit, and pieces but the last end in a line feed.
FILL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS p, sha256(concat('7:', doc_id)) AS h FROM documents),
c AS (SELECT *, len(p) - CASE WHEN p[len(p)] = '' THEN 1 ELSE 0 END AS n, [CAST('0x' || substr(h, 8 * k - 7, 8) AS UBIGINT) FOR k IN [1, 2, 3, 4]] AS d FROM t),
f AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1))::BIGINT AS a, greatest(d[1] % (n + 1), d[2] % (n + 1))::BIGINT AS b,
  CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
s AS (SELECT doc_id, text, n, form, array_to_string(p[1:a], chr(10)) || CASE WHEN a > 0 AND a < len(p) THEN chr(10) ELSE '' END AS x,
  array_to_string(p[a + 1:b], chr(10)) || CASE WHEN b > a AND b < len(p) THEN chr(10) ELSE '' END AS y, array_to_string(p[b + 1:], chr(10)) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(text) AS restored_sha256 FROM s
"""

ORACLES = {"op1_ngram_jaccard_join": JACCARD, "op5_substring_dedup": SUBSTRINGS, "op7_url_filters": URLS, "op11_fill_in_middle": FILL}
