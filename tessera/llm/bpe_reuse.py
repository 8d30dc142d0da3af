"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last ``WINDOW`` characters cuts each text where the hash has ``MASK_BITS`` zero
bits, so a passage that many documents share is cut the same way in all of them. Each worker keeps a
bounded store of chunks it has met; a chunk in the store is not encoded again. A cut can fall anywhere,
also inside a word, so a chunk is kept as (head, ids of the body, tail): the body lies between the first
and the last break at which encoding cannot depend on the surroundings (see ``units``). Each join is
repaired by encoding tail + next head again; where a chunk has no break the seam goes on into the next
chunk until one is met. From there on the ids agree with those of the whole text. What the library decodes
a body or a seam to is stored beside its ids, and the parts are put together as the decoder would: with a space
where there is no decoder, directly for a byte-level one; for any other decoder the ids of the whole text are decoded.

The store is per worker and bounded by characters, so nothing is shuffled. (One store for the cluster
would move every text once and every id twice; see the README.)

Defined cases: a null text counts as empty (no ids, empty decoded text); rows repeat as they come; an
empty table gives an empty result.
"""
from __future__ import annotations

import json
import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ddl, per_worker, prepare, read, slices
from tessera.llm.registry import query
from tessera.llm.units import UnitCache, UnitEncoder, first_break, last_break, split_units, tokenizer_blob

WINDOW = 16                 # characters under the rolling hash
MASK_BITS = 10              # a cut about every 2 ** MASK_BITS characters
LEAST, MOST = 256, 8192     # characters of a chunk
STORE_CHARS = 16 << 20      # characters of the chunks a worker stores
CACHE_PIECES = 600_000      # units whose ids a worker stores
_BASE = 0x9E3779B1          # odd multiplier of the rolling hash


def rolling_hash(text: str) -> np.ndarray:
    """Hash of the ``WINDOW`` characters that end at each position (fewer at the start)."""
    h = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint32)
    span, base = 1, _BASE
    while span < WINDOW:
        longer = h.copy()
        longer[span:] += h[:-span] * np.uint32(base)
        h, span, base = longer, span * 2, base * base & 0xFFFFFFFF
    return h * np.uint32(_BASE)


def cut_points(text: str) -> list[int]:
    """Content-defined ends of the chunks of ``text``."""
    if len(text) <= LEAST:
        return [len(text)]
    ends, start = [], 0
    for at in (np.flatnonzero(rolling_hash(text) >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist() + [len(text)]:
        while at - start > MOST:
            start += MOST
            ends.append(start)
        if at - start >= LEAST or at == len(text):
            ends.append(at)
            start = at
    return ends


def part_separator(blob: bytes) -> str | None:
    """What stands between decoded parts of a text; None if parts can't be decoded on their own."""
    decoder = json.loads(blob).get("decoder")
    if decoder is None:
        return " "
    return "" if decoder["type"] == "ByteLevel" else None


class ChunkEncoder:
    """Encodes texts chunk by chunk, decoded parts beside the ids; chunks met before come from the store."""

    def __init__(self, units: UnitEncoder, separator: str | None, store_chars: int = STORE_CHARS):
        self.units, self.separator, self.store, self.room = units, separator, {}, store_chars
        self.ids = UnitCache(units, self._part, CACHE_PIECES)
        self.encoded = self.reused = 0

    def _part(self, ids: np.ndarray) -> tuple[bytes, str]:
        return ids.tobytes(), self._decode(ids) if self.separator is not None else ""

    def _decode(self, ids: np.ndarray) -> str:
        return self.units.tok.decode(ids.tolist(), skip_special_tokens=False)

    def _join(self, parts: list[tuple[bytes, str]]) -> tuple[bytes, str]:
        """Parts one after the other; a part without ids leaves no trace."""
        ids, texts = zip(*parts)
        return b"".join(ids), (self.separator or "").join([t for i, t in parts if i] if b"" in ids else texts)

    def _chunk(self, chunk: str) -> tuple[str, tuple[bytes, str], str | None]:
        known = self.store.get(chunk)
        if known is not None:
            self.reused += 1
            return known
        self.encoded += 1
        i = first_break(chunk)
        if i < 0:
            parts = (chunk, (b"", ""), None)
        else:
            j = last_break(chunk)
            body = self._join(list(self.ids.lookup(split_units(chunk[i + 1:j])))) if j > i else (b"", "")
            parts = (chunk[:i], body, chunk[j:])
        while self.store and self.room < len(chunk):
            self.room += len(old := next(iter(self.store)))
            del self.store[old]
        if self.room >= len(chunk):
            self.store[chunk] = parts
            self.room -= len(chunk)
        return parts

    def _seam(self, seam: str) -> tuple[bytes, str]:
        """What lies between two bodies: tail and head of the chunks that meet, encoded as one."""
        if not seam:
            return b"", ""
        if seam[0] == " " and len(seam) > 1:
            return next(self.ids.lookup([seam[1:]]))
        return self._part(self.units.one(seam))

    def __call__(self, text: str) -> tuple[bytes, str]:
        """Ids of ``text`` (4 bytes each) and what they decode to."""
        out, seam, start = [], "", 0
        for end in cut_points(text):
            head, body, tail = self._chunk(text[start:end])
            start = end
            seam += head
            if tail is None:
                continue            # no break yet: the seam goes on
            out += (self._seam(seam), body)
            seam = tail
        out.append(self._seam(seam))
        ids, decoded = self._join(out)
        return ids, decoded if self.separator is not None else self._decode(np.frombuffer(ids, "<u4"))


def encode_decode(docs: DataFrame, blob: bytes, id_col: str = "doc_id", text_col: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (the id by default), ``ids`` (binary, unsigned 32-bit little-endian) and ``decoded``."""
    spark = docs.sparkSession
    prepare(spark)
    keep = keep or [id_col]
    key = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            return ChunkEncoder(UnitEncoder(sent.value), part_separator(sent.value))

        encode = per_worker(("bpe", key), make, keep=1)
        for batch in slices(batches, 128):
            ids, decoded = zip(*[encode(text or "") for text in batch.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                [*keep, "ids", "decoded"])

    columns = [F.col(f"`{c}`") for c in keep]
    return docs.select(*columns, F.col(f"`{text_col}`").alias("_text")).mapInArrow(
        run, ddl(docs, keep) + ", ids binary, decoded string")


def with_digests(encoded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 in place of ids and decoded."""
    return (encoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
            .withColumn("ids_sha256", F.sha2("ids", 256))
            .withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256))
            .drop("ids", "decoded"))


@query("op5_bpe_reuse")
def op5_bpe_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents`` under the word-end BPE vocabulary."""
    import public_tokenizers

    blob = tokenizer_blob(public_tokenizers.path("word_bpe_49k.json"))
    return with_digests(encode_decode(read(spark, sf_dir, "documents"), blob))
