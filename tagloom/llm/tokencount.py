"""Token counts: pieces are counted once for each distinct pre-token and summed by frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import _text as tx
from tagloom.llm._pieces import Pieces
from tagloom.llm._work import table


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of each row of ``docs`` (doc_id, text).

    Each Arrow slice counts how often each distinct pre-token stands in each document, joins those
    frequencies to the pre-tokens' counts (taken once, kept from slice to slice in the worker) and sums
    the products; no document's ids are made and none are kept. Nothing is shuffled.
    Null or empty text: 0 bytes, 0 tokens. Null and repeated doc_ids: a row each. Other columns are
    left out; an empty table gives none. ``tokenizer`` is the path of a byte-level BPE file of the
    tokenizers library, readable on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(tokenizer, "counts")
        for batch in tx.slices(batches, "text"):
            data, offsets = tx.column(batch.column("text"))
            n = pieces.counts(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op7_token_counts": query}
ORACLE: dict[str, str] = {}
