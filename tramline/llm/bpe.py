"""Byte-level BPE encoding and decoding of whole texts with the token automaton."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_automaton import automaton
from .shared import bounded_batches, id_in, id_out
from .units import UnitEncoder, as_texts

_ENCODERS: dict = {}


def _encoder(path: str) -> UnitEncoder:
    if path not in _ENCODERS:
        machine = automaton(path)

        def encode(units: list) -> list:
            return machine.encode_units(units)

        _ENCODERS[path] = UnitEncoder(encode, True, machine.split, 3)
    return _ENCODERS[path]


def _whole(path: str, texts: list):
    """Per text the units' (count, decimals, labels); special tokens' strings cut a
    text into parts of their own."""
    machine = automaton(path)
    special = [s for s in machine.special if any(s in t for t in texts)]
    if not special:
        yield from _encoder(path).texts(texts)
        return
    for text in texts:
        if not any(s in text for s in special):
            yield from _encoder(path).texts([text])
            continue
        ids = machine.encode(text)
        yield [(1, machine.decimals[t], machine.labels[t]) for t in ids]


def encode_documents(
    docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, ids array<int>) of whole texts. Null text gives no ids; a null id
    stays null; repeated rows are kept; other columns are not read."""
    rows = bounded_batches(docs).select(id_in(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            ids = [
                [int(x) for v in values if v[0] for x in v[1].split(b",")]
                for values in _whole(tokenizer_path, as_texts(batch["text"]))
            ]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})

    return rows.mapInPandas(run, "doc_id long, ids array<int>").withColumn("doc_id", id_out("doc_id"))


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): arc labels joined, read as UTF-8."""
    rows = bounded_batches(encoded).select(id_in("doc_id").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        machine = automaton(tokenizer_path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [machine.decode(x.tolist()) for x in batch["ids"]]})

    return rows.mapInPandas(run, "doc_id long, text string").withColumn("doc_id", id_out("doc_id"))


def digest_documents(
    docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass
    without sending ids or texts on. Nulls as in ``encode_documents``."""
    rows = bounded_batches(docs).select(id_in(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            count, ids, decoded = [], [], []
            for values in _whole(tokenizer_path, as_texts(batch["text"])):
                count.append(sum([v[0] for v in values]))
                ids.append(hashlib.sha256(b",".join([v[1] for v in values if v[0]])).hexdigest())
                text = b"".join([v[2] for v in values]).decode("utf-8", "replace")
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "n_tokens": count, "ids_sha256": ids, "decoded_sha256": decoded}
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInPandas(run, schema).withColumn("doc_id", id_out("doc_id"))
