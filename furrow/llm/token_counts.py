"""Operator 1: token counts of whole texts.

An Arrow function encodes texts in batches of about equal bytes and returns
lengths only. The vocabulary's file decides the library: ``.json`` tokenizers,
``.model`` sentencepiece, ``.tiktoken`` tiktoken (a rank file of the same byte-level
vocabulary gives the counts of its .json, several times faster; tested). A text longer than ``PIECE_CHARS`` is cut at safe boundaries: a
space that follows a letter or digit always starts a new pre-token, so the
counts of the pieces add up to the count of the whole text.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows
each give a row; an empty table gives an empty result; other columns of the
input, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import doc_chunks, parts, utf8

PIECE_CHARS = 1 << 15
BATCH_BYTES = 1 << 19


def pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """Cut ``text`` at spaces that follow a letter or digit, into pieces of
    about ``limit`` characters (longer only where no such space occurs)."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = text.find(" ", at + limit)
        while cut > 0 and not text[cut - 1].isalnum():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def length_counter(path: str, pattern: str | None = None, special: dict[str, int] | None = None):
    """A function from a list of texts to their numbers of tokens."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        return lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})
    return lambda texts: [len(enc.encode_to_numpy(t, allowed_special="all")) for t in texts]


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str | None = None,
                 special: dict[str, int] | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of ``docs``.

    ``tokenizer_path``: a vocabulary file that every worker can read; a rank file
    also needs the ``pattern`` that splits texts, and its ``special`` strings.
    sentencepiece adds a word mark at the start of a text, so its texts stay whole.
    """
    id_type = docs.schema[id_col].dataType
    limit = None if tokenizer_path.endswith(".model") else PIECE_CHARS

    def count(batches):
        lengths = length_counter(tokenizer_path, pattern, special)
        for batch in parts(batches, 1):
            _, offsets = utf8(batch.column(1))
            texts = batch.column(1).to_pylist()
            n_tokens = [0] * len(texts)
            for a, b in doc_chunks(offsets, BATCH_BYTES):
                short = []
                for i in range(a, b):
                    if not texts[i]:
                        continue
                    if limit is None or len(texts[i]) <= limit:
                        short.append(i)
                    else:
                        n_tokens[i] = sum(lengths([p])[0] for p in pieces(texts[i]))
                for i, n in zip(short, lengths([texts[i] for i in short]), strict=True):
                    n_tokens[i] = n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(offsets[1:] - offsets[:-1], pa.int64()),
                 pa.array(n_tokens, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    schema = f"`{id_col}` {id_type.simpleString()}, n_bytes bigint, n_tokens bigint"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(count, schema)
