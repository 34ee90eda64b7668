"""DuckDB statements for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import string

#: Separators are space and 0x09-0x0D.
_SPLIT = "list_filter(string_split_regex(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_REACH = """e AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), component AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)"""

#: Windows of 50 words that an earlier document has, what they cover, and what is left.
OP2 = f"""WITH w AS (SELECT doc_id, {_SPLIT.format(text="text")} AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
   h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM i), least AS (SELECT h, min(doc_id) AS a FROM h GROUP BY 1),
   gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM h JOIN least USING (h) WHERE a < doc_id), g AS (SELECT doc_id, list(k) AS k FROM gone GROUP BY 1),
   word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM w), kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS kept FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
   SELECT w.doc_id, len(w) AS n_words, coalesce(len(g.k), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON w.doc_id = g.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id"""

#: Links between vectors of one label at a cosine of 0.98.
OP3 = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
   links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.v) = len(q.v) WHERE list_cosine_similarity(p.v, q.v) >= 0.98), {_REACH}, n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
   SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM v LEFT JOIN component ON vec_id = component.a LEFT JOIN n ON vec_id = n.a"""

#: The same as OP2 over bytes, written as two hexadecimal digits each.
OP4 = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), i AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM t WHERE length(x) >= 100),
   h AS (SELECT doc_id, i, hash(substr(x, i * 2 + 1, 100)) AS h FROM i), least AS (SELECT h, min(doc_id) AS a FROM h GROUP BY 1), hit AS (SELECT doc_id, i FROM h JOIN least USING (h) WHERE a < doc_id),
   cut AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit), run AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM cut),
   span AS (SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM run GROUP BY doc_id, r), edge AS (SELECT *, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS after, row_number() OVER (PARTITION BY doc_id ORDER BY lo DESC) AS last FROM span),
   kept AS (SELECT e.doc_id, string_agg(substr(x, after * 2 + 1, (lo - after) * 2), '' ORDER BY lo) || max(CASE WHEN last = 1 THEN substr(x, hi * 2 + 1) ELSE '' END) AS kept, count(*) AS n_spans, sum(hi - lo) AS n_removed FROM edge e JOIN t ON e.doc_id = t.doc_id GROUP BY 1)
   SELECT t.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id"""

#: Links between documents whose sets of three-word shingles are alike by 85 in a hundred.
OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format(text=f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} AS w FROM documents),
   s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
   u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s), c AS (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n + q.n) AS n, count(*) AS i FROM u p JOIN u q ON p.x = q.x AND p.doc_id < q.doc_id AND 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n) GROUP BY 1, 2),
   links AS (SELECT a, b FROM c WHERE 100 * i >= 85 * (n - i)), {_REACH} SELECT doc_id, len(s) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM s LEFT JOIN component ON doc_id = component.a"""


def _assigned(k: int) -> str:
    """Common tables of round ``k``: every vector's nearest centroid (the smaller number on a tie) and squared distance."""
    square = "CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    return f"a{k} AS (SELECT vec_id, any_value(v.v) AS v, min(struct_pack(d := {square}, c := c)) AS m FROM v CROSS JOIN c{k} c GROUP BY vec_id)"


def _moved(k: int) -> str:
    """Common tables of the centroids after round ``k``: exact floors of the means, or where they were."""
    return f"""s{k} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(v) AS x, unnest(range(64)) AS i FROM a{k}) GROUP BY 1, 2),
   n{k} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{k} GROUP BY 1), c{k + 1} AS (SELECT c, coalesce(n{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN n{k} USING (c))"""


#: Three rounds over 16 centroids, then the last assignment.
OP12 = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
   c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16), {", ".join(f"{_assigned(k)}, {_moved(k)}" for k in range(3))}, {_assigned(3)}
   SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON c3.c = a3.m.c"""

STATEMENTS = {"op2_fm_substring_dedup": OP2, "op3_collision_counting": OP3, "op4_suffix_merge_dedup": OP4, "op10_minhash": OP10, "op12_centroid_clustering": OP12}
