"""Packing of documents into sequences of fixed length by best-fit decreasing.

A document's ids, with an end id, are first cut into full windows, each a sequence of its own. What is left of
each document goes, longest first, into the open window with the least room that still holds it; a segment tree
over the remaining room finds that window. The leftovers are dealt at random into shards of a fixed size and each
shard is packed by itself, so that no task grows with the corpus; a shard wastes about one window.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm import bpe
from copse.llm.common import cut, small_batches, text_of

#: The same vocabulary as ``bpe.RANKS``, as the tokenizers library reads it; the ranks encode it several times faster.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LENGTH, END_ID, SHARD = 2048, 1, 65536


@functools.cache
def _special(tokenizer: str) -> dict[str, int]:
    """The special tokens that a tokenizer file finds in texts."""
    from tokenizers import Tokenizer

    return {t.content: i for i, t in Tokenizer.from_file(tokenizer).get_added_tokens_decoder().items()}


def encode(text: str, special: dict[str, int], enc) -> list[int]:
    """The ids that the tokenizers library gives: a special token's string is one id, the rest is encoded around it."""
    if not any(token in text for token in special):
        return bpe.encode(text, enc)
    ids: list[int] = []
    for part in re.split("(" + "|".join(map(re.escape, special)) + ")", text):
        ids += [special[part]] if part in special else bpe.encode(part, enc)
    return ids


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, tokenizer: str = TOKENIZER, ranks: str = bpe.RANKS) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids`` of each document's full windows and what is left after them.

    ``ids`` are unsigned little-endian 32-bit integers; ``start`` counts the document's ids before the piece. A
    null or empty text is its end id alone. Repeated rows are documents of their own; other columns are left out;
    an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, special = bpe.encoding(ranks), _special(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text, special, enc)
                ids.append(end_id)
                raw = bpe.id_bytes(ids)
                rows += [(doc_id, at, min(length, len(ids) - at), len(ids), raw[4 * at : 4 * (at + length)]) for at in range(0, len(ids), length)]
            cols = list(zip(*rows, strict=True)) or [[] for _ in _SCHEMA]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SCHEMA.types, strict=True)], schema=_SCHEMA)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


class _OpenWindows:
    """Open windows by their room, under a segment tree that says where any are."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.tree = np.zeros(2 * self.leaves, dtype=np.int64).tolist()
        self.at: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, n: int) -> None:
        node = room + self.leaves
        while node:
            self.tree[node] += n
            node //= 2

    def put(self, window: int, room: int) -> None:
        if room:
            self.at[room].append(window)
            self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the least room of at least ``need``: it and its room."""
        node = need + self.leaves
        if not self.tree[node]:
            while node > 1 and (node % 2 or not self.tree[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return self.at[room].pop(), room


def best_fit_decreasing(lengths: list[int], length: int) -> tuple[list[int], list[int]]:
    """Window and offset of each item, for items given longest first."""
    opened, windows, offsets, count = _OpenWindows(length), [], [], 0
    for n in lengths:
        window, room = opened.tightest(n) or (count, length)
        count += window == count
        windows.append(window)
        offsets.append(length - room)
        opened.put(window, room - n)
    return windows, offsets


def pack(cut_pieces: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """``cut_pieces`` (``doc_id, start, length`` and any more) with ``sequence_id`` and ``offset``.

    Offsets are gapless from 0 within each sequence. Sequence ids are unique, not gapless: even ones are full
    windows, odd ones belong to shards, whose numbers lead them. Leftovers are dealt by their place in ``cut_pieces``, so
    that repeated rows are spread like others; it is read more than once: give it as a table or checkpoint.
    """
    full = F.col("length") == length
    count = cut_pieces.where(~full).count()
    shards = max(1, -(-count // shard))
    alone = cut_pieces.where(full).select("*", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows = cut_pieces.where(~full).withColumn("__shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        windows, offsets = best_fit_decreasing(rows["length"].tolist(), length)
        return rows.assign(sequence_id=2 * (rows["__shard"] * 2**33 + windows) + 1, offset=offsets).drop(columns="__shard")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema)
    return alone.unionByName(rows.groupBy("__shard").applyInPandas(run, f"{fields}, sequence_id long, offset long"))


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """``sequence_id, n_ids, ids`` of packed pieces that carry their ``ids``: each sequence's bytes, padded.

    A sequence whose length is a power of two is left at it.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "").alias("h"))
    pad = F.lit(pad_id.to_bytes(4, "little").hex().upper())
    power = F.expr("bit_count(n_ids) = 1")
    return joined.select("sequence_id", "n_ids", F.unhex(F.when(power, F.col("h")).otherwise(F.rpad("h", 8 * length, pad))).alias("ids"))


def packed_digests(docs: DataFrame) -> DataFrame:
    """The packing of documents, with a checksum of each piece in place of its ids."""
    digests = pieces(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(cut(digests))
