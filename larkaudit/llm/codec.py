"""Encoding and decoding of text columns with a byte-pair vocabulary."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larkaudit.llm import bpe
from larkaudit.llm.common import bounded_batches, fresh


def codec(text: Column, path: str | None = None) -> Column:
    """ids (binary, little-endian unsigned 32-bit integers; null text: none) and the SHA-256 of what they decode to.

    One Python worker a core encodes and decodes; the decoded text itself does not leave it.
    """
    path = path or bpe.default_path()

    @F.pandas_udf("ids binary, decoded_sha256 string")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, decoder = bpe.encoder(path), bpe.decoder(path)
        try:
            for texts in batches:
                ids = [encoder.encode(t) if t else b"" for t in texts]
                yield pd.DataFrame({"ids": ids, "decoded_sha256": [hashlib.sha256(decoder.decode(x)).hexdigest() for x in ids]})
        finally:
            encoder.forget()

    return coded(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text that the ids spell, special tokens included (null or no ids: empty)."""
    path = path or bpe.default_path()

    @F.pandas_udf(StringType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = bpe.decoder(path)
        for rows in batches:
            yield pd.Series([decoder.decode(bytes(x)).decode() if x is not None else "" for x in rows], dtype=object)

    return decoded(ids)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids and ids_sha256 of ``text`` and decoded_sha256 of the text that they decode to.

    Null and empty texts give no ids and an empty decoded text. Repeated rows are encoded each and
    null ids stay; an empty table stays empty; columns of the four names are replaced, others kept.
    """
    bounded_batches(docs.sparkSession)
    new = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    kept = [F.col(c) for c in docs.columns if c not in new]
    name = fresh(docs, "coded")
    out = docs.select(*kept, codec(F.col("text"), path).alias(name))
    ids = F.col(name)["ids"]
    digests = [(F.octet_length(ids) / 4).cast("long"), ids, F.sha2(ids, 256), F.col(name)["decoded_sha256"]]
    return out.select(*kept, *[c.alias(n) for n, c in zip(new, digests, strict=True)])


def encoding_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded text for each document."""
    return encode_documents(docs.select("doc_id", "text"), path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
