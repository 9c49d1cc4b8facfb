"""Operator 5, BPE encoding and decoding over a documents table.

Defined results: a null text counts as empty and has no tokens; repeated rows
stay; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import pieces, texts_of

SEPARATOR = "<|endoftext|>"


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (binary, little-endian unsigned 32-bit) of each text."""
    def run(batches):
        import pyarrow as pa
        from .tokens import UnitEncoder, encoder
        enc = encoder(UnitEncoder, path, SEPARATOR)
        for b in batches:
            ids = enc.encode([bytes(t) for t in texts_of(b.column(1))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows ``(doc_id, ids)``."""
    def run(batches):
        import pyarrow as pa
        from .tokens import ByteDecoder
        dec = ByteDecoder(path)
        for b in batches:
            texts = [dec.decode(np.frombuffer(x or b"", "<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of tokens and the digests of its ids and of the text decoded from them.

    Encoder and decoder are the same as above; they follow each other in one
    task, so the ids do not travel through the JVM.
    """
    def run(batches):
        import pyarrow as pa
        from .tokens import ByteDecoder, UnitEncoder, encoder
        enc, dec = encoder(UnitEncoder, path, SEPARATOR), ByteDecoder(path)
        for b in pieces(batches):
            n, x, y = [], [], []
            raws = [bytes(t) for t in texts_of(b.column(1))]
            for at in range(0, len(raws), 200):
                for ids in enc.encode(raws[at:at + 200]):
                    n.append(len(ids) // 4)
                    x.append(hashlib.sha256(ids).hexdigest())
                    y.append(hashlib.sha256(dec.decode(np.frombuffer(ids, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
