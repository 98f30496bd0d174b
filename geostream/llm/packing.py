"""Concatenate and cut: documents become one long run of token ids, cut into windows of fixed length.

Pass one tokenizes each document once, writes its ids with their place in their partition to the shared folder and so
knows each partition's total. A prefix sum over those totals (one row for each input split, never one for each document)
gives each partition's place in the whole run; pass two cuts every document at window borders, without a shuffle.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostream.llm.common import stage

SPECIAL = "<|endoftext|>"
_encoders: dict = {}


def encoder(name: str):
    """text -> list of ids, as the tokenizers library gives them for {name}.json without added special tokens.

    The rank file of the same vocabulary is read by tiktoken, which yields the same ids about four times as fast; the
    vocabulary's one special string is id 50256 where it stands in a text, as in that library.
    """
    if name not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        special = len(ranks)

        def encode(text: str) -> list[int]:
            if SPECIAL not in text:
                return plain(text)
            ids: list[int] = []
            for i, part in enumerate(text.split(SPECIAL)):
                ids += [special] * (i > 0) + plain(part)
            return ids

        _encoders[name] = encode
    return _encoders[name]


def _tokenize(tokenizer: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        encode, part, place = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            starts, counts, ids = [], [], []
            for text in batch.column(1):
                own = encode(text.as_py() or "")
                own.append(end_id)
                starts.append(place)
                counts.append(len(own))
                ids.append(array("H", own).tobytes())
                place += len(own)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "part", "place", "doc_tokens", "ids"])

    return run


def _cut(length: int):
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, ids, total, at in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "ids", "doc_tokens", "at"))):
                ids = np.frombuffer(ids, "<u2").astype("<u4")
                start = 0
                while start < total:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, total - start)
                    for column, value in zip(out, (doc, start, size, ids[start : start + size].tobytes(), total, sequence, offset)):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i == 3 else pa.int64()) for i, x in enumerate(out)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, length: int = 2048, tokenizer: str = "byte_bpe_50k", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids (binary, unsigned 32-bit little-endian), doc_tokens, sequence_id, offset.

    A null text is empty and has the end id alone. A repeated row is a document of its own. Only the last sequence is not
    full, so that at most length - 1 ids of padding are needed in all. A document that crosses a border has a piece in
    each sequence that it touches. No documents: no pieces. Other columns are ignored. Ids are stored in 16 bits: a tokenizer
    with an id of 65,536 or more is an error.
    """
    ids = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_tokenize(tokenizer, end_id), "doc_id long, part int, place long, doc_tokens long, ids binary"), "packing")
    totals = ids.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    # One row of 16 bytes for each input split: 100 TB in splits of 128 MB are 13 MB.
    placed = ids.join(F.broadcast(before), "part").select("doc_id", "ids", "doc_tokens", (F.col("base") + F.col("place")).alias("at"))
    return placed.mapInArrow(_cut(length), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
