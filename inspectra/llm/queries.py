"""The registered queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inspectra.llm.bag_minhash import op5_bag_minhash
from inspectra.llm.ball_tree import OP4_SQL, op4_ball_tree_topk
from inspectra.llm.bm25_packing import op10_bm25_packing
from inspectra.llm.filter_audit import OP12_SQL, op12_filter_audit
from inspectra.llm.fst_tokens import op2_fst_token_counts
from inspectra.llm.huffman_ids import op3_huffman_ids
from inspectra.llm.jpeg_media import op1_progressive_jpeg
from inspectra.llm.line_edit_join import op7_line_edit_join
from inspectra.llm.markov_secrets import op9_markov_secrets
from inspectra.llm.merge_replay import op6_merge_replay
from inspectra.llm.quality_svm import op13_quality_svm
from inspectra.llm.token_alignment import op11_token_alignment
from inspectra.llm.toxicity import op8_lexicon_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_progressive_jpeg": op1_progressive_jpeg,
    "op2_fst_token_counts": op2_fst_token_counts,
    "op3_huffman_ids": op3_huffman_ids,
    "op4_ball_tree_topk": op4_ball_tree_topk,
    "op5_bag_minhash": op5_bag_minhash,
    "op6_merge_replay": op6_merge_replay,
    "op7_line_edit_join": op7_line_edit_join,
    "op8_lexicon_toxicity": op8_lexicon_toxicity,
    "op9_markov_secrets": op9_markov_secrets,
    "op10_bm25_packing": op10_bm25_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_filter_audit": op12_filter_audit,
    "op13_quality_svm": op13_quality_svm,
}
#: Classes by exact weighted similarity of all documents that share a shingle; for small tables, as it counts every such pair.
OP5_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS x FROM w),
    m AS (SELECT doc_id, x, count(*) AS k FROM s GROUP BY ALL),
    n AS (SELECT doc_id, sum(k) AS n FROM m GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.k, b.k)) AS c FROM m a JOIN m b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE c >= 0.8 * (p.n + q.n - c) UNION SELECT min(doc_id) OVER (), doc_id FROM w WHERE len(w) = 0),
    t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, t.b FROM r JOIN t ON r.other = t.a)
SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id"""
ORACLE_SQL: dict[str, str] = {"op4_ball_tree_topk": OP4_SQL, "op5_bag_minhash": OP5_SQL, "op12_filter_audit": OP12_SQL}
