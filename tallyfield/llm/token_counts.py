"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is put through the merge rules once; those that come out
as one token with their own id are proven. A pre-token that is such a string counts one
without merging; only the others are merged. Texts are read in pieces (see ``pieces``) so
that a piece met before is not looked at again. A ``.model`` file is counted by
sentencepiece itself, whose pieces reach over spaces.

A null text counts as empty: no bytes, no tokens. Repeated rows and null ids are kept as
they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import held, small_batches, string_array, task, text_or_empty
from tallyfield.llm.pieces import PieceTable, encode_batch
from tallyfield.llm.token_file import _tokenizer, vocabulary_path


@cache
def proven_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings (in the byte alphabet) that encode alone as their own token."""
    model = _tokenizer(path).model
    proven = []
    for word, i in _tokenizer(path).get_vocab(with_added_tokens=False).items():
        got = model.tokenize(word)
        if len(got) == 1 and got[0].id == i:
            proven.append(word)
    return frozenset(proven)


def _counting(path: str) -> PieceTable | None:
    """The table of counts, or None for a tokenizer that isn't byte-level BPE."""
    tk = _tokenizer(path)
    simple = tk.normalizer is None and type(tk.pre_tokenizer).__name__ == "ByteLevel"
    return held(("counts", path), lambda: PieceTable(tk, with_ids=False, proven=proven_tokens(path))) if simple else None


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens is over ``limit``, per document."""
    path = tokenizer or vocabulary_path()
    small_batches(docs.sparkSession, 2000, 8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            counts = lambda texts: np.array([len(x) for x in sp.encode(texts.to_pylist(), num_threads=1)], np.int64)
        else:
            table, tk = _counting(path), _tokenizer(path)

            def counts(texts):
                if table is None:
                    return np.array([len(x.ids) for x in tk.encode_batch(texts.to_pylist(), add_special_tokens=False)], np.int64)
                return encode_batch(texts, table)[0]

        for batch in batches:
            texts = string_array(batch.column(1))
            n = counts(texts)
            size = pc.binary_length(texts.cast(pa.large_binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(task(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
