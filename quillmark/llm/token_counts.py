"""Token counts by finite-state tokenizer compilation (operator 10)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm.bpe_automaton import automaton
from quillmark.llm.common import in_parts, keyed_text, table


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: key as ``doc_id``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    The vocabulary's merge rules are compiled into a deterministic transducer whose
    transitions carry emitted-token counts; texts are run in chunks whose state maps are
    composed by a prefix scan (``bpe_automaton``).  One pass, no shuffle, whole texts.
    Null and empty texts have 0 bytes and 0 tokens; null keys and repeated rows stay as they
    are; other columns are not read.  An empty table gives no rows.
    """

    def run(batches):
        machine = automaton(tokenizer)
        for part, texts in in_parts(batches, tokenizes=True):
            n = machine.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).cast(pa.int64()),
                    pc.cast(pc.binary_length(part.column(1)), pa.int64()),
                    pa.array(n),
                    pa.array(n > limit),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return keyed_text(docs, key, text).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
