"""The queries of this subpackage and their SQL."""
import corpus_pipeline
import public_tokenizers as P

from . import audit, bpe, jaccard, knn, licenses, oracles, packing, pii, quality, ranking, sharding, suffix, token_files
from .common import documents

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_token_counts": lambda s, d: bpe.token_counts(documents(s, d), P.path("byte_bpe_50k.json")),
    "op2_byte_bpe": lambda s, d: bpe.encoded(documents(s, d), P.path("byte_bpe_multi_50k.tiktoken")),
    "op3_jaccard_join": lambda s, d: jaccard.joined(documents(s, d)).drop("rep"),
    "op4_suffix_dedup": lambda s, d: suffix.digests(documents(s, d)),
    "op5_license_scan": lambda s, d: licenses.scan(documents(s, d)),
    "op6_voronoi_topk": lambda s, d: knn.top_k(s.read.parquet(f"{d}/embeddings.parquet")),
    "op9_pii_surrogates": lambda s, d: pii.replaced(documents(s, d)),
    "op7_kd_sharding": lambda s, d: sharding.sharded(s.read.parquet(f"{d}/documents.parquet")),
    "op8_quality_rules": lambda s, d: quality.scored(s.read.parquet(f"{d}/documents.parquet")),
    "op10_best_fit_packing": lambda s, d: packing.packed_documents(documents(s, d)),
    "op11_token_orc": lambda s, d: token_files.written_and_read(documents(s, d)),
    "op12_filter_audit": lambda s, d: audit.audited(s.read.parquet(f"{d}/documents.parquet"), s.read.parquet(f"{d}/labels.parquet")),
    "op13_grouped_ranks": lambda s, d: ranking.sale_line_ranks(s.read.parquet(f"{d}/sale_lines.parquet")),
}
ORACLE = {
    "op3_jaccard_join": oracles.JACCARD,
    "op4_suffix_dedup": oracles.SUFFIX,
    "op8_quality_rules": oracles.QUALITY,
    "op12_filter_audit": oracles.AUDIT,
    "op13_grouped_ranks": oracles.RANKING,
    "op6_voronoi_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
