"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from quillmark.llm import embedding_dedup, jaccard_join, line_dedup, warc
from quillmark.llm.conversations import op13_conversation_repair
from quillmark.llm.decontaminate import op5_benchmark_decontamination
from quillmark.llm.packing import op2_best_fit_packing
from quillmark.llm.quality import op6_quality_classifier
from quillmark.llm.secret_scan import op1_secret_scan
from quillmark.llm.spelling import op11_spelling_variants
from quillmark.llm.token_counts import op10_token_counts
from quillmark.llm.token_store import op3_token_store
from quillmark.llm.vector_search import op8_vector_search

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_best_fit_packing,
        op3_token_store,
        jaccard_join.op4_jaccard_join,
        op5_benchmark_decontamination,
        op6_quality_classifier,
        line_dedup.op7_line_dedup,
        op8_vector_search,
        warc.op9_warc,
        op10_token_counts,
        op11_spelling_variants,
        embedding_dedup.op12_embedding_dedup,
        op13_conversation_repair,
    )
}
SQL: dict[str, str] = {**embedding_dedup.SQL, **jaccard_join.SQL, **line_dedup.SQL, **warc.SQL}
