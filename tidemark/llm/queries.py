"""The registered queries of this folder, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from .embeddings import OP1_SQL, op1_embeddings
from .html_text import op7_html
from .language import op5_language
from .matroska import op10_media
from .minhash import op2_minhash
from .mixing import OP9_SQL, op9_mixing
from .pieces import op6_sentencepiece
from .quality import op4_quality
from .token_counts import op8_token_counts
from .toxicity import op3_toxicity

OP2_SQL = """
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM cut),
shingles AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sets p ON a = p.doc_id JOIN sets q ON b = q.doc_id WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, sym.b FROM reach JOIN sym ON reach.r = sym.a),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON doc_id = id
"""

QUERIES = {f.__name__: f for f in (op1_embeddings, op2_minhash, op3_toxicity, op4_quality, op5_language, op6_sentencepiece, op7_html, op8_token_counts, op9_mixing, op10_media)}
SQL = {"op1_embeddings": OP1_SQL, "op2_minhash": OP2_SQL, "op9_mixing": OP9_SQL}
