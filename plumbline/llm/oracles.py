"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from plumbline.llm.secrets import BASE, RULES
from plumbline.llm.warc import BASE32_DIGITS

#: 0x-prefixed ten-digit parts of the SHA-1, each giving eight characters of base 32.
_BASE32 = f"""
    array_to_string(list_transform(range(32), lambda i:
      substr('{BASE32_DIGITS}', 1 + ((('0x' || substr(sha1(h), 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)
    ), '')"""

WARC = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    l AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
    SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
      CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> last THEN last END AS refers_to
    FROM p JOIN l USING (h)
"""

EMBEDDINGS = """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
        AND list_cosine_similarity(a.e, b.e) >= 0.93),
    reach(vec_id, other) AS (
      SELECT vec_id, vec_id FROM embeddings
      UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
    c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1),
    n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
    SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept
    FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MINHASH = f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (
      SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN
          list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
    e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
    links AS (
      SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    reach(doc_id, other) AS (
      SELECT doc_id, doc_id FROM documents
      UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
    c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
    SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.doc_id = s.doc_id
"""


def _found(number: int) -> str:
    """Matches of a rule with the text before each; positions are sums of these lengths."""
    rule = RULES[number]
    pattern = f"(?s:(.*?))({rule.pattern})".replace("'", "''")
    part = lambda group: f"regexp_extract_all(t, '{pattern}', {group})"
    return f"""
      SELECT doc_id, {number} AS rule, i, gap, found, value FROM (
        SELECT doc_id, unnest({part(1)}) AS gap, unnest({part(2)}) AS found, unnest({part(2 + rule.group)}) AS value,
          unnest(range(len({part(2)}))) AS i FROM d)"""


SECRETS = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({' UNION ALL '.join(_found(n) for n in range(len(RULES)))}),
    p AS (SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id, rule ORDER BY i) AS stop FROM m),
    k AS (
      SELECT doc_id, rule, (stop - length(found))::BIGINT AS start, stop::BIGINT AS stop, {[r.kind for r in RULES]}[rule + 1] AS kind
      FROM p WHERE length(value) >= {[r.least for r in RULES]}[rule + 1]),
    a AS (
      SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES[:BASE])},
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) FILTER (rule < {BASE}) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) AS spans
      FROM k GROUP BY 1)
    SELECT d.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES[:BASE])},
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

SUBSTRINGS = """
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
    x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM s),
    f AS (SELECT x, min(doc_id) AS first FROM x GROUP BY x),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM x JOIN f USING (x) WHERE first < doc_id),
    r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
      sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
    FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""


def _vector_codes(rounds: int = 4, parts: int = 4, entries: int = 256, scale: int = 1024) -> str:
    def nearest(book: str) -> str:
        """The nearest entry of each part: squared distances in whole numbers, ties to the lower entry."""
        return f"""
          SELECT vec_id, k, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
            SELECT p.vec_id, p.k, b.e, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
            FROM p JOIN {book} b ON b.k = p.k) GROUP BY vec_id, k"""

    steps = "".join(f"""
    a{r} AS MATERIALIZED ({nearest(f"b{r}")}),
    s{r} AS MATERIALIZED (SELECT k, e, i, (sum(v)::BIGINT - ((sum(v)::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS f
      FROM (SELECT p.k, a.e, unnest(range(len(p.x))) AS i, unnest(p.x) AS v FROM p JOIN a{r} a ON a.vec_id = p.vec_id AND a.k = p.k) GROUP BY ALL),
    b{r + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(n.x, b.x) AS x FROM b{r} b
      LEFT JOIN (SELECT k, e, list(f::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY k, e) n ON n.k = b.k AND n.e = b.e),""" for r in range(rounds))
    return f"""
    WITH v AS MATERIALIZED (
      SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor({scale} * x)::BIGINT) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (
      SELECT vec_id, k, x[k * (len(x) // {parts}) + 1:(k + 1) * (len(x) // {parts})] AS x FROM v, range({parts}) r(k)),
    b0 AS MATERIALIZED (
      SELECT k, e, x FROM p JOIN (
        SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < {entries}) USING (vec_id)),{steps}
    z AS MATERIALIZED ({nearest(f"b{rounds}")}),
    c AS (SELECT vec_id, string_agg(printf('%02x', e::INTEGER), '' ORDER BY k) AS code, sum(d)::BIGINT AS error FROM z GROUP BY vec_id),
    h AS (
      SELECT sha256(string_agg(x, ',' ORDER BY k, e)) AS codebooks_sha256
      FROM (SELECT k, e, array_to_string(x, ',') AS x FROM b{rounds}))
    SELECT v.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM v JOIN c ON c.vec_id = v.vec_id, h
"""


VECTOR_CODES = _vector_codes()

HARD_NEGATIVES = """
    WITH v AS MATERIALIZED (
      SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS x
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS MATERIALIZED (
      SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
      FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
    p AS (
      SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT anchor_id, positive_id,
      (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
      other_id AS negative_id, positive_score, score AS negative_score
    FROM s JOIN p USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
"""
