"""Operator 1, token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.llm.common import small_batches
from depgraph.llm.pieces import Pieces, encoded


@cache
def _lengths(path: str) -> Pieces:
    """One for each worker process."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return Pieces(lambda xs: [len(x) for x in model.encode(xs, num_threads=1)], limit=0)

    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return Pieces(lambda xs: [len(x) for x in model.encode_batch_fast(xs, add_special_tokens=False)])


def token_count(text, tokenizer: str):
    """Column: tokens of the whole text by the tokenizer file (.json: tokenizers, .model: sentencepiece).

    Null and empty texts have 0 tokens. No begin, end or added special tokens, no truncation, no padding; special
    strings inside a text count as the library's default has it. Arrow batches are regrouped by size, and texts
    longer than a block are cut at safe places, so memory doesn't grow with a text's tokens. The sentencepiece
    model treats white space in its own way, so its texts are encoded whole.
    """

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _lengths(tokenizer)
        for texts in batches:
            if tokenizer.endswith(".model"):
                out = known.encode([x or "" for x in texts.to_pylist()])
            else:
                out = [sum(map(sum, x)) for x in encoded(known, (x.as_py() for x in texts))]
            yield pa.array(out, pa.int64())

    return lengths(text)


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens); columns so named are replaced."""
    small_batches(docs.sparkSession)
    counted = docs.withColumns(
        {"n_bytes": F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")), "n_tokens": token_count(F.col(text), tokenizer)}
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
