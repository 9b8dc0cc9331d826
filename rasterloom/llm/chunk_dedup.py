"""Substring deduplication by content-defined chunks: a gear rolling hash sets the borders, digests find copies."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import batches_of, mix64, row_keyed, texts, written

#: The gear table: a 64-bit number for each byte.
GEAR = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
REACH = 32
#: Settings that find repeated passages of over 50 words: short chunks, compared in stretches of at least ``span`` bytes.
PASSAGES = {"least": 16, "bits": 4, "span": 128}


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of the last 32 gear numbers, each shifted once per byte since (32 bits).

    Doubling the span five times gives what the byte-by-byte recurrence does.
    """
    h = GEAR[data].astype(np.uint32)
    span = 1
    while span < REACH:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def borders(data: np.ndarray, least: int, bits: int, most: int) -> list[int]:
    """Ends of the chunks: after a byte whose hash has ``bits`` leading zeros, at least ``least`` and at most ``most`` bytes on.

    No end lies inside a UTF-8 character; where ``most`` bytes would end in one, the chunk ends before it.
    """
    n = len(data)
    start = np.append((data & 0xC0) != 0x80, True)  # whether a character starts at each byte; the end counts as one
    cuts = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - bits) == 0) + 1
    cuts = cuts[start[cuts]].tolist()
    out, at, k = [], 0, 0
    while at < n:
        k = bisect_left(cuts, at + least, k)
        end = min(at + most, n)
        while not start[end] and end > at + most - 4:
            end -= 1
        if k < len(cuts) and cuts[k] <= end:
            end = cuts[k]
        out.append(end)
        at = end
    return out


def stretches(ends: list[int], span: int) -> list[tuple[int, int]]:
    """(start, end) of the shortest row of chunks of at least ``span`` bytes from every border on, and of the one that ends the text.

    A text under ``span`` bytes is one stretch; with ``span`` 0 each chunk is one.
    """
    starts, out, j = [0, *ends][:-1], [], 0
    for i, start in enumerate(starts):
        j = max(j, i)
        while j < len(ends) and ends[j] - start < span:
            j += 1
        if j == len(ends):
            if not out or out[-1][1] < ends[-1]:
                out.append((starts[max(i - 1, 0)], ends[-1]))
            break
        out.append((start, ends[j]))
    return out


def covered(ends: list[int], spans: list[dict]) -> list[dict]:
    """The chunks (start, length) that lie in ``spans``, which are sorted rows of whole chunks."""
    out, start, far, k = [], 0, 0, 0
    for end in ends:
        while k < len(spans) and spans[k]["start"] <= start:
            far = max(far, spans[k]["start"] + spans[k]["length"])
            k += 1
        if start < far:
            out.append({"start": start, "length": end - start})
        start = end
    return out


def _chunks(text: str, least: int, bits: int, most: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 512):
            row, at, n, dig = [], [], [], []
            for k, data in enumerate(texts(batch.column(text))):
                for start, end in stretches(borders(np.frombuffer(data, np.uint8), least, bits, most), span):
                    row.append(k)
                    at.append(start)
                    n.append(end - start)
                    dig.append(hashlib.blake2b(data[start:end], digest_size=16).digest())
            keys = [batch.column(c).take(pa.array(row, pa.int64())) for c in ("doc_id", "row_id")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(at, pa.int64()), pa.array(n, pa.int32()), pa.array(dig, pa.binary())], ["doc_id", "row_id", "start", "length", "digest"])

    return run


def chunk_table(rows: DataFrame, text: str = "text", least: int = 128, bits: int = 8, most: int = 2048, span: int = 0) -> DataFrame:
    """doc_id, row_id, start, length and digest of every stretch of chunks of every whole text (``span`` 0: of every chunk); a null or empty text has none."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "row_id", text).mapInArrow(_chunks(text, least, bits, most, span), f"doc_id {kind}, row_id long, start long, length int, digest binary")


def later_copies(chunks: DataFrame) -> DataFrame:
    """Chunks of which an equal one stands before (smaller doc_id, null first, then smaller row_id and start).

    Hashes are counted first, so only chunks whose hash comes again meet by their digests.
    """
    again = chunks.groupBy(F.xxhash64("digest").alias("h")).count().filter(F.col("count") > 1).select("h")
    chunks = written(chunks.join(again.hint("merge"), F.xxhash64("digest") == F.col("h"), "left_semi"), "chunks")
    own = F.struct("doc_id", "row_id", "start")
    firsts = (
        chunks.groupBy("digest")
        .agg(F.count("*").alias("copies"), F.min(own).alias("first"))
        .filter(F.col("copies") > 1)
        .select(F.col("digest").alias("d"), "first")
    )
    return chunks.join(firsts, F.col("digest") == F.col("d")).filter(~own.eqNullSafe(F.col("first"))).drop("d", "first")


def dedup_chunks(docs: DataFrame, text: str = "text", least: int = 128, bits: int = 8, most: int = 2048, span: int = 0) -> DataFrame:
    """One row per document: n_bytes, n_removed, ``removed`` (start, length; in bytes) and ``kept_text``.

    The first copy of a chunk stays and later ones go, so an exact copy of a document is emptied.
    Borders follow content and fall between characters, so an insertion moves only the chunks
    around it. A null or empty text has no chunks and keeps nothing. With a ``span``, a chunk goes
    only as part of a stretch of at least so many bytes (or a whole text) that stands before; an
    equal chunk at an earlier place is kept. Rows are told apart even if they share a doc_id: they
    count as documents of their own, and of equal rows one stays whole. Other columns aren't read.
    """
    rows = row_keyed(docs, "doc_id", text)
    removed = (
        later_copies(chunk_table(rows, text, least, bits, most, span))
        .select(F.col("doc_id").alias("k"), F.col("row_id").alias("r"), F.struct("start", "length").alias("span"))
        .groupBy("k", "r")
        .agg(F.sort_array(F.collect_list("span")).alias("removed"))
    )
    joined = rows.join(removed, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("row_id") == F.col("r")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 512):
            spans = batch.column("removed").to_pylist()
            n, gone, kept, went = [], [], [], []
            for data, own in zip(texts(batch.column(text)), spans, strict=True):
                parts, last = [], 0
                if own:
                    own = covered(borders(np.frombuffer(data, np.uint8), least, bits, most), own)
                went.append(own)
                for s in own or ():
                    parts.append(data[last : s["start"]])
                    last = s["start"] + s["length"]
                kept.append(b"".join([*parts, data[last:]]))
                n.append(len(data))
                gone.append(len(data) - len(kept[-1]))
            cols = [
                batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(went, batch.schema.field("removed").type),
                pa.array([x.decode() for x in kept], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "removed", "kept_text", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", text, "removed").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, removed array<struct<start: long, length: int>>, kept_text string, kept_sha256 string"
    )
