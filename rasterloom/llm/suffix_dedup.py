"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

Whether a string of W bytes starts anywhere else is read off sorted suffixes: equal strings are
neighbours whose common prefix reaches W. Only suffixes at anchors are sorted. An anchor is the
least hash of the GRAM-byte strings in some W-byte window (the first of equals), so equal windows
have their anchor at the same place d, and a window is its anchor's left context of d bytes and
right context of W - d bytes. The job:

1. Each text's anchors, with the range of d they serve and hashes of their first GRAM bytes and
   of all bytes that their windows cover. Anchors whose first bytes occur once are dropped: none
   of their windows repeats. Equal contexts are counted before anything else moves.
2. One suffix per distinct context goes into a sorted run of its task. Runs are cut at common
   splitters, front-coded (length of the prefix shared with the one before, and the rest) and
   exchanged.
3. Each range is merged by a loser tree that keeps, for every waiting run, the prefix it shares
   with the last winner, and compares bytes only beyond it; the merged common prefixes come out
   with the order. Together with the same for left contexts they say, for each d, which
   windows are equal.
4. Repeated windows become byte ranges of their documents.

A GRAM-byte string that more than RANGE distinct contexts start with (a line that stands in many
different surroundings) would be one range that nothing can split. Its contexts are split by d
into bands first (STEPS): all windows of a band of w places share W - w + 1 bytes, so each band is
an anchor of its own, shifted to the start of these bytes, and goes through steps 1 to 3 with that
longer string as its first bytes. The last bands are single windows: all its distinct keys differ.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterloom.llm.common import batches_of, mix64, texts, written

W, GRAM = 200, 40
#: Places of an anchor within its window.
PLACES = W - GRAM + 1
#: Widths of the bands of d: that of all anchors, and those that hot strings are split into in turn.
STEPS = (PLACES, 23, 1)
#: Suffixes of a sorted run, and of a range after the exchange.
RUN, RANGE = 40_000, 30_000
#: Contexts that are sampled for each range asked for, and sampled keys that one task ranks.
PER_RANGE, RANKED = 64, 100_000

_MULT = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
_INVERSE = np.uint64(pow(int(_MULT), -1, 2**64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_CHUNK = 1 << 19


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_MULT, _CHUNK + 1), _powers(_INVERSE, _CHUNK + 1)


class Hashed:
    """Polynomial hashes (mod 2^64) of all substrings of at most _CHUNK bytes of text."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _UP[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _DOWN[start]


def anchors_of(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all windows that lie in one text: place, least d, most d, hash of the first GRAM bytes and of the context.

    ``data``: texts in a row (fewer than _CHUNK bytes); ``first`` and ``last`` bound each text.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < W:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    own = Hashed(data)
    at = np.arange(n - GRAM + 1)
    gram = (own.sums[GRAM:] - own.sums[:-GRAM]) * _DOWN[: n - GRAM + 1]
    # High bits rank the strings; the low bits hold the place, so the least is the first of equals.
    rank = (mix64(gram) & ~np.uint64(_CHUNK - 1)) | at.astype(np.uint64)
    least, span = rank, 1
    while span * 2 <= PLACES:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = PLACES - span
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    pick = (least & np.uint64(_CHUNK - 1)).astype(np.int64)  # of the window that starts at each byte
    inside = np.zeros(n + 1, np.int32)
    long = last - first >= W
    np.add.at(inside, first[long], 1)
    np.add.at(inside, last[long] - W + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[: len(pick)] > 0)
    pick = pick[starts]
    new = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1])]) if len(pick) else none
    end = np.r_[new[1:], len(pick)] - 1 if len(pick) else none
    place = pick[new]
    low, high = starts[new], starts[end]
    context = mix64(own.of(low, high + W) ^ mix64(((place - low) * 512 + (place - high)).astype(np.uint64)))
    return place, place - high, place - low, gram[place], context


def _pieces(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose lengths together stay under _CHUNK."""
    at, total = 0, 0
    for k, n in enumerate(lengths):
        if k > at and total + n >= _CHUNK:
            yield at, k
            at, total = k, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


def _anchor_rows(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 512):
            # A text of _CHUNK bytes or more is cut into parts that overlap by W - 1 bytes, so each window lies in just one.
            parts: list[tuple[int, int, bytes]] = []
            for k, data in enumerate(texts(batch.column(text))):
                step = _CHUNK - W
                for off in range(0, max(1, len(data) - W + 1), step):
                    parts.append((k, off, data[off : off + step + W - 1]))
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for a, b in _pieces([len(p[2]) for p in parts]):
                last = np.cumsum([len(p[2]) for p in parts[a:b]])
                first = np.r_[0, last[:-1]]
                place, low, high, gram, context = anchors_of(np.frombuffer(b"".join(p[2] for p in parts[a:b]), np.uint8), first, last)
                which = np.searchsorted(last, place, side="right")
                row = np.array([p[0] for p in parts[a:b]])[which]
                off = np.array([p[1] for p in parts[a:b]])[which]
                for col, x in zip(out, (row, place - first[which] + off, low, high, gram, context), strict=True):
                    col.append(x)
            row, pos, low, high, gram, context = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
            cols = [
                batch.column("row_key").take(pa.array(row, pa.int64())), pa.array(pos, pa.int64()), pa.array(low.astype(np.int16)), pa.array(high.astype(np.int16)),
                pa.array(gram.astype(np.uint64).view(np.int64)), pa.array(context.astype(np.uint64).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["row_key", "pos", "low", "high", "gram", "context"])

    return run


# --- sorted runs, front coding and the loser tree ---


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n
    while high - low > 16:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    while a[low] == b[low]:
        low += 1
    return low


def front_code(items: list[tuple[bytes, bytes]]) -> bytes:
    """Sorted (key, payload) pairs as shared length, rest length, rest and payload of fixed size each."""
    parts, before = [], b""
    for key, load in items:
        shared = common_prefix(before, key)
        parts += [shared.to_bytes(2, "little"), (len(key) - shared).to_bytes(2, "little"), key[shared:], load]
        before = key
    return b"".join(parts)


def front_decode(blob: bytes, size: int) -> Iterator[tuple[bytes, int, bytes]]:
    """(key, prefix shared with the key before, payload) of each entry."""
    at, key, end = 0, b"", len(blob)
    while at < end:
        shared = int.from_bytes(blob[at : at + 2], "little")
        rest = int.from_bytes(blob[at + 2 : at + 4], "little")
        key = key[:shared] + blob[at + 4 : at + 4 + rest]
        at += 4 + rest
        yield key, shared, blob[at : at + size]
        at += size


def merge_runs(runs: list[Iterator[tuple[bytes, int, bytes]]]) -> Iterator[tuple[bytes, int, bytes]]:
    """Merges sorted runs of (key, prefix shared with the run's key before, payload) by a tree of losers.

    Every waiting entry carries the prefix that it shares with the last winner. Of two entries
    the one that shares more is smaller; only if they share equally are bytes compared, and
    those beyond the shared prefix. What comes out has the prefix shared with the entry before it.
    """
    k = 1
    while k < len(runs):
        k *= 2
    entries: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    shared = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared prefix becomes that with the winner."""
        x, y = entries[a], entries[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        s, t = shared[a], shared[b]
        if s != t:
            return (a, b) if s > t else (b, a)
        p, q = x[0], y[0]
        n = common_prefix(p, q, s)
        if n == len(p) or (n < len(q) and p[n] < q[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    while entries[top] is not None:
        key, _, load = entries[top]
        yield key, shared[top], load
        entry = next(runs[top], None)
        entries[top] = entry
        if entry is not None:
            shared[top] = entry[1]
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


# --- which windows of merged contexts repeat ---

#: Payload of an entry: context hash, gram hash, lengths of the left context, low and high d, and whether it occurs more than once.
_LOAD = np.dtype([("context", "<i8"), ("gram", "<i8"), ("low", "<i2"), ("high", "<i2"), ("many", "u1"), ("left", f"S{PLACES}"), ("n_left", "<i2")])


def _lcp_rows(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Common prefix of each row of bytes with the row before (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[1:] = np.minimum(first, np.minimum(length[1:], length[:-1]))
    return out


def repeated_windows(shared: np.ndarray, load: np.ndarray) -> np.ndarray:
    """entries x PLACES: whether the entry's window at d occurs elsewhere, for entries sorted by right context.

    Windows at d are equal if the right contexts share W - d bytes and the left ones d bytes;
    both are runs of neighbours in the respective order.
    """
    n = len(load)
    left = np.frombuffer(load["left"].tobytes(), np.uint8).reshape(n, PLACES) if n else np.zeros((0, PLACES), np.uint8)
    order = np.lexsort((load["n_left"], load["left"]))
    left_shared = _lcp_rows(left[order], load["n_left"][order].astype(np.int64))
    low, high, many = load["low"].astype(np.int64), load["high"].astype(np.int64), load["many"] > 0
    out = np.zeros((n, PLACES), bool)
    by_left = np.zeros(n, np.int64)
    for d in range(PLACES):
        rows = np.flatnonzero((low <= d) & (d <= high))
        if not len(rows):
            continue
        by_left[order] = np.cumsum(left_shared < d)
        key = np.cumsum(shared < W - d)[rows] * (n + 1) + by_left[rows]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        out[rows, d] = (counts[inverse] > 1) | many[rows]
    return out


def _runs_of(text: str, splitters: list[bytes], first: int):
    """Sorts a task's suffixes into runs and cuts them at the splitters, by their ``first`` bytes, into front-coded segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(items: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            items.sort()
            to, blob, at = [], [], 0
            while at < len(items):
                part = bisect_right(splitters, items[at][0][:first])
                end = at + 1
                while end < len(items) and (part == len(splitters) or items[end][0][:first] < splitters[part]):
                    end += 1
                to.append(part)
                blob.append(front_code(items[at:end]))
                at = end
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blob, pa.binary())], ["part", "segment"])

        held: list[tuple[bytes, bytes]] = []
        for batch in batches_of(batches, 256):
            for data, wanted in zip(texts(batch.column(text)), batch.column("wanted").to_pylist(), strict=True):
                for x in wanted:
                    pos, low, high = x["pos"], x["low"], x["high"]
                    left = data[pos - high : pos][::-1]
                    load = np.array((x["context"], x["gram"], low, high, x["many"], left, len(left)), _LOAD).tobytes()
                    held.append((data[pos : pos + W - low], load))
                if len(held) >= RUN:
                    yield flush(held)
                    held = []
        yield flush(held)

    return run


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges the segments of one range; returns the repeated runs of d of each context."""
    keys = merge_runs([front_decode(x, _LOAD.itemsize) for x in pdf["segment"]])
    shared, loads = [], []
    for _, s, load in keys:
        shared.append(s)
        loads.append(load)
    load = np.frombuffer(b"".join(loads), _LOAD)
    hit = repeated_windows(np.array(shared, np.int64), load)
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    return pd.DataFrame({"gram": load["gram"][row], "context": load["context"][row], "d_low": start, "d_high": stop - 1})


def _keys_of(text: str, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 256):
            rows = zip(texts(batch.column(text)), batch.column("wanted").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([data[x["pos"] : x["pos"] + first] for data, own in rows for x in own], pa.binary())], ["key"])

    return run


def range_splitters(body: DataFrame, contexts: DataFrame, text: str, first: int, n: int) -> list[bytes]:
    """First bytes that cut ``contexts`` into about ceil(n / RANGE) ranges of RANGE each; ``n`` is their number.

    One of every RANGE / PER_RANGE contexts, by hash, gives its key, whatever text it is from, so
    ranges keep their size as contexts become more. Keys are sorted and ranked by Spark, and just
    every PER_RANGE-th reaches the driver: one a range.
    """
    if n <= RANGE:
        return []
    some = contexts.filter(F.pmod(F.xxhash64("gram", "context"), F.lit(max(1, RANGE // PER_RANGE))) == 0)
    _, sampled = _with_wanted(body, some, text)
    keys = written(sampled.select(text, "wanted").mapInArrow(_keys_of(text, first), "key binary"), "sampled-keys")
    parts = -(-keys.count() // RANKED)
    dealt = written((keys.repartitionByRange(parts, "key") if parts > 1 else keys.coalesce(1)).withColumn("p", F.spark_partition_id()), "dealt-keys")
    # A row a part: the parts are in the order of their keys.
    sizes = dealt.groupBy("p").agg(F.count("*").alias("n"))
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy("key"))
    chosen = dealt.join(before, "p").withColumn("rank", rank).filter(F.col("rank") % PER_RANGE == 0)
    return sorted({bytes(r["key"]) for r in chosen.select("key").collect()})


_ANCHOR = "row_key long, pos long, low short, high short, gram long, context long"


def _shifted(text: str, width: int):
    """Splits contexts into bands of ``width`` places, each with an anchor at the start of the bytes that its windows share.

    ``g``, ``c`` and ``shift`` say which context a band is from, and by how much its places d are less.
    """
    first = W - width + 1
    names = ["row_key", "pos", "low", "high", "gram", "context", "many", "g", "c", "shift"]
    types = [pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int16()]

    def signed(data: bytes, seed: int) -> int:
        h = xxhash.xxh3_64_intdigest(data, seed)
        return h - (1 << 64) if h >> 63 else h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        held: list[tuple] = []
        for batch in batches_of(batches, 256):
            for key, data, wanted in zip(batch.column("row_key").to_pylist(), texts(batch.column(text)), batch.column("wanted").to_pylist(), strict=True):
                for x in wanted:
                    for shift in range(x["low"] // width * width, x["high"] + 1, width):
                        pos, low, high = x["pos"] - shift, max(x["low"] - shift, 0), min(x["high"] - shift, width - 1)
                        gram = signed(data[pos : pos + first], 0)
                        context = signed(data[pos - high : pos + W - low], low * 512 + high)
                        held.append((key, pos, low, high, gram, context, x["many"], x["gram"], x["context"], shift))
                    if len(held) >= RUN:
                        yield flush(held)
                        held = []
        yield flush(held)

    return run


def _with_wanted(body: DataFrame, contexts: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """What is wanted of each text, and the same with the texts. Rows that share a row_key are the same, so one of them is enough."""
    wanted = contexts.groupBy("row_key").agg(F.collect_list(F.struct("pos", "low", "high", "many", "context", "gram")).alias("wanted"))
    wanted = written(wanted, "wanted")
    return wanted, body.join(wanted, "row_key").dropDuplicates(["row_key"]).select("row_key", text, "wanted")


def _merge(body: DataFrame, contexts: DataFrame, text: str, first: int) -> DataFrame:
    """gram, context, d_low, d_high of repeated windows of distinct contexts, by the distributed merge sort."""
    wanted, runs = _with_wanted(body, contexts, text)
    splitters = range_splitters(body, contexts, text, first, contexts.count())
    segments = runs.select(text, "wanted").mapInArrow(_runs_of(text, splitters, first), "part int, segment binary")
    return written(segments.groupBy("part").applyInPandas(_merged, "gram long, context long, d_low int, d_high int"), "repeats")


def _repeats(body: DataFrame, rows: DataFrame, text: str, step: int) -> DataFrame:
    """gram, context, d_low, d_high of the windows in ``rows`` (anchors, and ``many`` if their context is known to repeat)."""
    contexts = rows.groupBy("gram", "context").agg(F.sum(F.col("many") + 1).alias("n"), F.min(F.struct("row_key", "pos", "low", "high")).alias("at"))
    contexts = written(contexts.select("gram", "context", (F.col("n") > 1).cast("int").alias("many"), "at.*"), "contexts")
    if step + 1 == len(STEPS):
        return _merge(body, contexts, text, W - STEPS[step] + 1)
    hot = written(contexts.groupBy("gram").count().filter(F.col("count") > RANGE).select("gram"), "hot-grams")
    if hot.isEmpty():
        return _merge(body, contexts, text, W - STEPS[step] + 1)
    hits = _merge(body, contexts.join(hot, "gram", "left_anti"), text, W - STEPS[step] + 1)
    _, split = _with_wanted(body, contexts.join(hot, "gram", "left_semi"), text)
    bands = written(split.mapInArrow(_shifted(text, STEPS[step + 1]), f"{_ANCHOR}, many int, g long, c long, shift short"), "bands")
    again = bands.groupBy("gram").agg(F.sum(F.col("many") + 1).alias("n")).filter(F.col("n") > 1).select("gram")
    bands = written(bands.join(again, "gram", "left_semi"), "repeated-bands")
    finer = _repeats(body, bands, text, step + 1)
    places = [(F.col(d) + F.col("shift")).cast("int").alias(d) for d in ("d_low", "d_high")]
    return hits.unionByName(bands.join(finer, ["gram", "context"]).select(F.col("g").alias("gram"), F.col("c").alias("context"), *places))


def repeated_ranges(docs: DataFrame, text: str = "text") -> DataFrame:
    """row_key, start, end: bytes of windows that also start elsewhere (``docs`` has row_key); ranges may overlap."""
    body = docs.select("row_key", text)
    anchors = written(body.mapInArrow(_anchor_rows(text), _ANCHOR), "anchors")
    # Written first, so that both sides of the join are plain shuffles, whose hot keys Spark can split.
    grams = written(anchors.groupBy(F.col("gram").alias("g")).count().filter(F.col("count") > 1).select("g"), "grams")
    again = written(anchors.join(grams, F.col("gram") == F.col("g"), "left_semi"), "repeated-anchors")
    hits = _repeats(body, again.withColumn("many", F.lit(0)), text, 0).withColumnsRenamed({"gram": "g", "context": "c"})
    found = again.join(hits, (F.col("gram") == F.col("g")) & (F.col("context") == F.col("c")))
    return found.select("row_key", (F.col("pos") - F.col("d_high")).alias("start"), (F.col("pos") - F.col("d_low") + W).alias("end"))


def _cut(text: str):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 512):
            size, gone, kept = [], [], []
            for data, own in zip(texts(batch.column(text)), batch.column("ranges").to_pylist(), strict=True):
                merged: list[dict] = []
                for r in own or ():  # sorted by start
                    if merged and r["start"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], r["end"])
                    else:
                        merged.append(dict(r))
                parts, last = [], 0
                for r in merged:
                    parts.append(data[last : r["start"]])
                    last = r["end"]
                size.append(len(data))
                gone.append(merged)
                kept.append(b"".join([*parts, data[last:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, spans), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, ``removed`` (maximal runs, start and end in bytes) and ``kept`` (bytes), one row per document.

    Each byte covered by a 200-byte string that also starts anywhere else, the same document
    included, is removed from all places; strings are judged on the input. Matches never cross
    documents. A null text is empty; texts under 200 bytes, and empty tables, lose nothing. Rows
    with equal doc_id are documents of their own; equal rows are copies of each other. Other
    columns aren't read.
    """
    own = docs.select("doc_id", text).withColumn("row_key", F.xxhash64("doc_id", text))
    ranges = repeated_ranges(own, text).groupBy(F.col("row_key").alias("k")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("ranges"))
    joined = own.join(ranges, F.col("row_key") == F.col("k"), "left").select("doc_id", text, "ranges")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_cut(text), f"doc_id {kind}, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")


def digest(out: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what ``remove_repeats`` returns."""
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed")
    return out.select("doc_id", "n_bytes", removed, F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
