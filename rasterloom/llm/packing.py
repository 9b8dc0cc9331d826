"""Packing of tokenised documents into sequences by length patterns, fitted with non-negative least squares."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.llm.common import batches_of, texts, written

#: Fits by least squares, each of what the one before left.
FITS = 3
#: Words whose ids a worker holds in each of two generations.
CACHE = 400_000
_STORES: dict[str, _Encoder] = {}


#: Words of letters a-z, A-Z and those of Latin-1 (UTF-8), whose lower case and composition are plain, with or without one last mark.
_EASY = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+[.,]?").fullmatch


def _merger(path: str):
    """The vocabulary as ranks of byte strings, a NUL for the end of a word; and which ids end one.

    The end marks have the lowest ranks, so they join a word's last byte before any merge, as the
    file's own rule has it. None if the file's merges don't make ids in rising order: ids can't
    stand for ranks then, and the tokenizer does all words.
    """
    import tiktoken

    with open(path) as file:
        model = json.load(file)["model"]
    vocab = model["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    made = np.array([vocab[a + b] for a, b in pairs])
    if (np.diff(made) <= 0).any():
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks: dict[bytes, int] = {}
    ends = np.zeros(max(vocab.values()) + 1, bool)
    for token, rank in sorted(vocab.items(), key=lambda x: x[1]):
        last = token.endswith("</w>")
        body = token[:-4] if last else token
        if body and all(c in byte_of for c in body):
            ranks.setdefault(bytes(byte_of[c] for c in body) + b"\0" * last, rank)
            ends[rank] = last
    return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}), ends


class _Encoder:
    """Ids of a text as little-endian uint32 bytes, word by word.

    Bytes that separate words part the tokenizer's own pieces too, so a text's ids are those of
    its words in a row. A new generation starts when one is full, which bounds the memory.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merger = _merger(path)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters, with or without one last mark, by the same merges in one pass over all of them."""
        # The mark is a piece of its own, with an end of its own.
        body = b"\n".join([*words, b""]).replace(b",\n", b"\0,\n").replace(b".\n", b"\0.\n").replace(b"\n", b"\0")
        ids = np.array(self.merger[0].encode_ordinary(body.decode().lower()), "<u4")
        marks = np.fromiter((w[-1] in b".," for w in words), np.int64, len(words))
        stops = (np.flatnonzero(self.merger[1][ids]) + 1)[np.cumsum(1 + marks) - 1]
        flat, last = ids.tobytes(), (4 * stops).tolist()
        return [flat[a:b] for a, b in zip([0, *last], last, strict=False)]

    def _learn(self, missed: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that the new generation lacks."""
        known = {w: ids for w in missed if (ids := self.old.get(w)) is not None}
        fresh = sorted(missed.difference(known))
        easy = [w for w in fresh if _EASY(w)] if self.merger else []
        if easy:
            known.update(zip(easy, self._merged(easy), strict=True))
        hard = [w for w in fresh if w not in known]
        for w, e in zip(hard, self.tokenizer.encode_batch([w.decode() for w in hard], add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()
        if len(self.new) + len(known) > CACHE:
            self.old, self.new = self.new, {}
        self.new.update(known)
        return known

    def encode_all(self, data: list[bytes]) -> list[bytes]:
        """Ids of each text; a batch's texts share the look-up of words not seen yet."""
        split = [x.split() for x in data]
        found = self._learn(set().union(*split).difference(self.new))
        return [b"".join([self.new.get(w) or found.get(w) or self.old.get(w, b"") for w in words]) for words in split]


def encoder(path: str) -> _Encoder:
    if path not in _STORES:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _STORES[path] = _Encoder(path)
    return _STORES[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieces(path: str, most: int, text: str, keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches_of(batches, 256):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(keep).to_pylist(), enc.encode_all(texts(batch.column(text))), strict=True):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * most)):
                    part = ids[at : at + 4 * most]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (batch.schema.field(keep).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenised_pieces(docs: DataFrame, most: int = 2048, path: str | None = None, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """Pieces of at most ``most`` ids of every document, each ended by id 0; a null text is empty (one piece of one id)."""
    kind = docs.schema[keep].dataType.simpleString()
    return docs.select(keep, text).mapInArrow(
        _pieces(path or tokenizer_path(), most, text, keep), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def length_patterns(lengths: np.ndarray, most: int) -> np.ndarray:
    """Patterns of one, two and three of the lengths that fill ``most`` exactly, padded with 0; nearly full ones where no exact one is.

    The last length follows from the others, so there are under most^2 / 6 triples, whatever the corpus.
    """
    have = np.zeros(most + 1, bool)
    have[lengths] = True
    # The largest length that is there and at most each index.
    below = np.maximum.accumulate(np.where(have, np.arange(most + 1), 0))
    a = np.sort(lengths)[::-1]
    single = np.stack([a, 0 * a, 0 * a], 1)
    pair_b = np.minimum(below[most - a], a)
    pairs = np.stack([a, pair_b, 0 * a], 1)[pair_b > 0]
    triples = []
    for x in a:
        b = a[(a <= x) & (a <= most - x)]
        c = below[most - x - b]
        fine = (c > 0) & (c <= b)
        triples.append(np.stack([np.full(fine.sum(), x), b[fine], c[fine]], 1))
    return np.concatenate([single, pairs, *triples])


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Non-negative repeat counts that bring the patterns' histogram closest to the given one (accelerated projected gradient).

    Rows are weighted by the inverse of the square root of their count, so rare lengths matter too.
    """
    most = len(histogram) - 1
    weight = 1 / np.maximum(histogram, 1.0)
    weight[0] = 0
    room = (most - patterns.sum(1)) / most  # unfilled room costs
    degree = np.bincount(patterns.ravel(), minlength=most + 1)
    # A step for each pattern: the sum over its lengths of weight times how many patterns share it.
    steep = (weight[patterns] * np.maximum(degree[patterns], 1)).sum(1) + 1e-12
    x = np.zeros(len(patterns))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        made = sum(np.bincount(patterns[:, j], weights=y, minlength=most + 1) for j in range(patterns.shape[1]))
        grad = (weight * (made - histogram))[patterns].sum(1) + 0.01 * room
        new = np.maximum(0, y - grad / steep)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def _take(pattern: np.ndarray, times: int, left: np.ndarray) -> int:
    """How often the pattern fits into what is left, at most ``times``; takes it."""
    own, many = np.unique(pattern[pattern > 0], return_counts=True)
    times = int(min(times, (left[own] // many).min()))
    left[own] -= times * many
    return times


def fitted_plan(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) by least squares; takes the pieces that they hold out of the histogram ``left``.

    Counts are rounded down, and the largest remainders up; at most 4 patterns for each possible
    length are taken. What is left is fitted again, while that places pieces.
    """
    most, plan = len(left) - 1, []
    for _ in range(FITS):
        lengths = np.flatnonzero(left)
        if not len(lengths):
            break
        patterns = length_patterns(lengths, most)
        patterns = patterns[patterns.sum(1) >= most - most // 256]
        if not len(patterns):
            break
        # A fit spreads over very many patterns; those of largest counts, a few for each length, are fitted
        # again alone, so the plan's size has a bound that no corpus moves.
        best = np.argsort(-fit_counts(patterns, left), kind="stable")[: 4 * most]
        patterns = patterns[best]
        counts = fit_counts(patterns, left, 400)
        whole = np.floor(counts).astype(np.int64)
        whole[np.argsort(whole - counts, kind="stable")[: round(float((counts - whole).sum()))]] += 1
        placed = 0
        for k in np.argsort(-whole, kind="stable")[: np.count_nonzero(whole)]:
            if n := _take(patterns[k], int(whole[k]), left):
                plan.append((tuple(int(x) for x in patterns[k] if x), n))
                placed += n
        if not placed:
            break
    return plan


def plan_patterns(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) that use every length as often as the histogram has it.

    Full pieces stand alone; then come the patterns of ``fitted_plan``. The residual lengths are
    packed best-fit, largest first, at the level of the histogram, so the work is bounded by the
    number of lengths.
    """
    most = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[most]:
        plan.append(((most,), int(left[most])))
        left[most] = 0
    plan += fitted_plan(left)
    while left.any():
        room, own = most, []
        have = left.copy()
        while room and (fits := np.flatnonzero(have[1 : room + 1])).size:
            own.append(pick := int(_best(have, room, fits[-1] + 1)))
            have[pick] -= 1
            room -= pick
        plan.append((tuple(own), _take(np.array(own), 2**62, left)))
    return plan


def _best(have: np.ndarray, room: int, largest: int) -> int:
    """The largest length that fits, unless a smaller one with a partner fills the room exactly and the largest can't."""
    if largest == room or room < 2:
        return largest
    rest = room - largest
    if have[rest] - (rest == largest) > 0:
        return largest
    low = np.flatnonzero(have[1 : room // 2 + 1]) + 1
    ok = (have[room - low] > 0) & ((room - low != low) | (have[low] > 1))
    if ok.any() and not _can_fill(have, rest):
        return int(room - low[ok].min())
    return largest


def _can_fill(have: np.ndarray, room: int) -> bool:
    """Whether one or two lengths fill the room exactly (counts of equal ones aside)."""
    if room <= 0 or have[room] > 0:
        return True
    low = np.flatnonzero(have[1 : room // 2 + 1]) + 1
    return bool((have[room - low] > 0).any())


def runs_of(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): the pieces of a length, by rank, fill runs of slots."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, times in plan:
        at = 0
        for n in lengths:
            first = used.get(n, 0)
            out.append((n, first, first + times, sequence, at))
            used[n] = first + times
            at += n
        sequence += times
    return out


def pack_pieces(pieces: DataFrame, most: int = 2048, share: int = 50_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with doc_id, piece and length (1 to ``most``).

    Only the histogram of lengths (at most ``most`` rows) and the plan made from it (at most a few
    runs a length) pass through the driver. Pieces get ranks within their length from counts of
    salted shares, so that a frequent length is spread over tasks. Ties between equal pieces go
    any way; every piece keeps its own row. No pieces give no rows.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").count().collect()
    histogram = np.zeros(most + 1, np.int64)
    for r in counts:
        histogram[r["length"]] = r["count"]
    runs = runs_of(plan_patterns(histogram))
    salts = 1 + int(histogram.max()) // share
    slots = spark.createDataFrame(runs, "run_length long, first long, stop long, sequence long, offset long")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        salted.groupBy("length", "salt")
        .count()
        .select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    )
    inside = W.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = (
        salted.withColumn("nth", F.row_number().over(inside) - 1)
        .join(starts, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s")))
        .withColumn("rank", F.col("before") + F.col("nth"))
    )
    # The runs of a length are disjoint, so each piece meets one; their number doesn't grow with the documents.
    fits = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop"))
    return ranked.join(F.broadcast(slots), fits).select(
        *pieces.columns, (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"
    )


def pack_documents(docs: DataFrame, most: int = 2048, path: str | None = None) -> DataFrame:
    """Tokenises and packs ``docs``; see ``tokenised_pieces`` and ``pack_pieces``."""
    return pack_pieces(written(tokenised_pieces(docs, most, path), "pieces"), most)
