"""Registered queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from .decontaminate import op7_benchmark_decontamination
from .jaccard import op3_ngram_jaccard_join
from .licenses import op8_license_scan
from .merkle import op13_merkle_manifest
from .mixing import op10_mix_sources
from .negatives import op11_hard_negatives
from .quality import op6_quality_rules
from .secrets import op9_secret_scan
from .sketches import op12_minhash_near_dedup
from .substrings import op1_substring_dedup
from .templates import op2_html_main_text
from .toxicity import op5_toxicity
from .warc import op4_warc_archives

QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_html_main_text, op3_ngram_jaccard_join, op4_warc_archives, op5_toxicity, op6_quality_rules,
    op7_benchmark_decontamination, op8_license_scan, op9_secret_scan, op10_mix_sources, op11_hard_negatives,
    op12_minhash_near_dedup, op13_merkle_manifest)}

_OP10 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, source, t,
        len(list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
        regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS body FROM d),
k AS (SELECT doc_id, source, size,
        -ln((('0x' || left(md5('1:' || coalesce(doc_id::VARCHAR, '') || ':' || t), 12))::BIGINT + 1.0) / (281474976710656 + 1.0))
          / CASE WHEN length(body) > 0 THEN greatest(0.1, length(regexp_replace(body, '\P{L}+', '', 'g')) / length(body)) ELSE 0.1 END AS key
      FROM m),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM k GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][i % 3 + 1]::DOUBLE AS w FROM s),
-- the level l at which sum(least(2 size, l w)) is 150 % of all words lies between two sources' own levels
l AS (SELECT arg_min((1.5 * (SELECT sum(source_size) FROM w) - lo.full) / lo.open, lo.own) AS level FROM (
        SELECT a.i, coalesce(sum(CASE WHEN b.source_size / b.w < a.source_size / a.w THEN 2.0 * b.source_size END), 0) AS full,
               sum(CASE WHEN b.source_size / b.w >= a.source_size / a.w THEN b.w END) AS open,
               any_value(a.source_size / a.w) AS own FROM w a, w b GROUP BY a.i) lo
      WHERE 2 * lo.own > (1.5 * (SELECT sum(source_size) FROM w) - lo.full) / lo.open),
t AS (SELECT source, source_size, least(2.0 * source_size, (SELECT level FROM l) * w)::DOUBLE AS target FROM w),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
        floor(e.target)::BIGINT - e.epochs * e.source_size
          - (sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key) - k.size) AS room
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(room, 0)))::BIGINT AS taken FROM r
"""

_OP11 = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM r a JOIN r b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""


def _near_duplicates(k: int, num: int, den: int, more: str = "") -> str:
    """Exact classes of documents that shingle similarities connect."""
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: {gram})) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS v, doc_id AS c FROM s UNION SELECT b.y, r.c FROM reach r JOIN edges b ON b.x = r.v),
c AS (SELECT v, min(c) AS component_id FROM reach GROUP BY v)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, component_id{more} FROM s JOIN c ON c.v = s.doc_id
"""


_OP13 = """
WITH RECURSIVE d AS (SELECT doc_id, source, text,
        list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
          lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
            lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS inverse,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
          || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
      FROM documents),
f AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN xor(inverse, 4294967295) % 5 = 0
             THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS forged
      FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM f),
up AS (SELECT source, 0 AS lvl, pos, n, leaf AS node FROM g
       UNION ALL
       SELECT source, any_value(lvl) + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY source, pos // 16),
subs AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, pos, n, subroot AS node FROM subs
        UNION ALL
        SELECT any_value(lvl) + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY pos // 16),
-- a step is what stands left and right of a node in its run, with a bar in its place
steps AS (SELECT a.source, a.lvl, a.pos, string_agg(CASE WHEN b.pos = a.pos THEN '|' ELSE b.node END, '' ORDER BY b.pos) AS step
          FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY a.source, a.lvl, a.pos),
topsteps AS (SELECT a.lvl, a.pos, string_agg(CASE WHEN b.pos = a.pos THEN '|' ELSE b.node END, '' ORDER BY b.pos) AS step
          FROM top a JOIN top b ON a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY a.lvl, a.pos),
low AS (SELECT g.source, g.pos, list(s.step ORDER BY s.lvl) AS path FROM g JOIN steps s
          ON g.source IS NOT DISTINCT FROM s.source AND s.pos = g.pos // (16 ** s.lvl)::BIGINT GROUP BY g.source, g.pos),
high AS (SELECT u.source, list(s.step ORDER BY s.lvl) AS path FROM subs u JOIN topsteps s ON s.pos = u.pos // (16 ** s.lvl)::BIGINT GROUP BY u.source),
p AS (SELECT g.doc_id, g.leaf, g.forged, u.subroot, list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path
      FROM g JOIN subs u ON g.source IS NOT DISTINCT FROM u.source
      LEFT JOIN low ON low.source IS NOT DISTINCT FROM g.source AND low.pos = g.pos
      LEFT JOIN high ON high.source IS NOT DISTINCT FROM g.source),
r AS (SELECT doc_id, leaf, subroot, (SELECT node FROM top WHERE n = 1) AS root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
        list_reduce(list_prepend(coalesce(forged, leaf), path), lambda acc, s: sha256(replace(s, '|', acc))) AS folded_root FROM p)
SELECT *, folded_root = root AS verified FROM r
"""

ORACLE = {"op10_mix_sources": _OP10, "op11_hard_negatives": _OP11, "op12_minhash_near_dedup": _near_duplicates(3, 85, 100, ", s.doc_id = component_id AS kept"),
          "op13_merkle_manifest": _OP13}
