"""Registered queries of the text operators and the SQL that states their results."""

from __future__ import annotations

from .fingerprint import op6_fingerprints
from .html import op4_html
from .language import op12_language
from .licenses import op10_licenses
from .lines import op9_lines
from .merkle import op13_manifest
from .neardup import op7_minhash
from .packing import op1_packing
from .pieces import op2_sentencepiece
from .secrets import op8_secrets
from .spelling import op11_spelling
from .toxicity import op5_toxicity
from .vectors import op3_embeddings

QUERIES = {f.__name__: f for f in (op1_packing, op2_sentencepiece, op3_embeddings, op4_html, op5_toxicity, op6_fingerprints,
                                 op7_minhash, op8_secrets, op9_lines, op10_licenses,
                                 op11_spelling, op12_language, op13_manifest)}

OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM link l WHERE l.a = v.vec_id) AS n_links, low.component_id,
  v.vec_id = low.component_id AS kept
FROM v JOIN low ON low.a = v.vec_id
"""

OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, low.component_id, d.doc_id = low.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN low ON low.a = d.doc_id
"""

_CRC32 = """list_reduce(list_transform(range(1, len({0}) + 1), lambda i: CAST(ascii(substr({0}, CAST(i AS BIGINT), 1)) AS BIGINT)),
  lambda a, b: list_reduce(range(0, 8), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, b)),
  4294967295::BIGINT)"""
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}"))

OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, sha256({_LEAF.format("text")}) AS leaf,
    CASE WHEN xor({_CRC32.format("CAST(doc_id AS VARCHAR)")}, 4294967295) % 5 = 0
         THEN sha256({_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS claimed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    (SELECT count(*) FROM (SELECT DISTINCT source FROM documents)) AS trees, row_number() OVER () AS id FROM leaves
), node(tree, level, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM node WHERE n > 1
  GROUP BY tree, level, pos // 16, n
), up(level, pos, h, n) AS (
  SELECT 0, tree, h, (SELECT max(trees) FROM placed) FROM node WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM up WHERE n > 1 GROUP BY level, pos // 16, n
), run AS (
  SELECT tree, level, pos // 16 AS parent, list(h ORDER BY pos) AS hs FROM node WHERE n > 1 GROUP BY tree, level, pos // 16
), uprun AS (
  SELECT level, pos // 16 AS parent, list(h ORDER BY pos) AS hs FROM up WHERE n > 1 GROUP BY level, pos // 16
), step AS (
  SELECT p.id, r.level, r.hs, (p.pos // CAST(16 ** r.level AS BIGINT)) % 16 AS place
  FROM placed p JOIN run r ON r.tree = p.tree AND r.parent = p.pos // CAST(16 ** (r.level + 1) AS BIGINT)
  UNION ALL
  SELECT p.id, 1000 + r.level, r.hs, (p.tree // CAST(16 ** r.level AS BIGINT)) % 16
  FROM placed p JOIN uprun r ON r.parent = p.tree // CAST(16 ** (r.level + 1) AS BIGINT)
), steps AS (
  SELECT id, list({{'hs': hs, 'place': place}} ORDER BY level) AS way FROM step GROUP BY id
), proof AS (
  SELECT p.*, coalesce(way, []) AS way FROM placed p LEFT JOIN steps USING (id)
), folded(id, k, h, way) AS (
  SELECT id, 0, coalesce(claimed, leaf), way FROM proof
  UNION ALL
  SELECT id, k + 1, sha256(array_to_string(list_transform(way[k + 1].hs, lambda x, i: CASE WHEN i = way[k + 1].place + 1 THEN h ELSE x END), '')), way
  FROM folded WHERE k < len(way)
), last AS (SELECT id, h FROM folded WHERE k = len(way))
SELECT doc_id, leaf, s.h AS subroot, t.h AS root,
  sha256(array_to_string(flatten(list_transform(way, lambda w: list_filter(w.hs, lambda x, i: i <> w.place + 1))), '')) AS proof_sha256,
  last.h AS folded_root, last.h = t.h AS verified
FROM proof JOIN last USING (id) JOIN (SELECT tree, h FROM node WHERE n = 1) s USING (tree), (SELECT h FROM up WHERE n = 1) t
"""

# Two words are near if leaving out one letter of the longer, or one at the same place of both, makes them equal.
_BYTES = "list_transform(range(0, strlen({0})), lambda i: CAST('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
_CRC_OF = """xor(list_reduce({0}, lambda a, b: list_reduce(range(0, 8), lambda x, k: xor(x >> 1,
  CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, b)), 4294967295::BIGINT), 4294967295)"""
OP11_SQL = f"""
WITH RECURSIVE found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS c, CAST(doc_id AS VARCHAR) || ':' || run AS k FROM found GROUP BY ALL
), summed AS (SELECT *, {_CRC_OF.format(_BYTES.format("k"))} AS h FROM counted
), typed AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM summed
), words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), cut AS (
  SELECT word, place, substr(word, 1, place - 1) || substr(word, place + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS place FROM words)
), near AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest
), best AS (
  SELECT x.word, count(*) AS n_near, arg_min(near, (-v.n, near)) AS near, max(v.n) AS near_n
  FROM near x JOIN words v ON v.word = x.near GROUP BY x.word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form,
    CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word
), follow(word, reached, k) AS (
  SELECT word, word, 0 FROM formed UNION ALL SELECT f.word, g.form, k + 1 FROM follow f JOIN formed g ON g.word = f.reached WHERE g.form IS NOT NULL
)
SELECT f.word, form, (SELECT arg_max(reached, k) FROM follow w WHERE w.word = f.word) AS root, n, n_near, form_n FROM formed f
"""

ORACLES = {"op3_embeddings": OP3_SQL, "op7_minhash": OP7_SQL, "op11_spelling": OP11_SQL, "op13_manifest": OP13_SQL}
