"""Periodic runs of words by recompression: a run-length grammar answers how far two places agree.

The words of a batch of texts are one sequence, with a symbol of its own after each text, so no
match crosses texts. Levels of a grammar are made in turn by block compression (a stretch of one
symbol becomes one symbol) and pair compression (each symbol falls left or right; a left one and
the right one after it become one symbol). Equal stretches are cut alike but for their ends, so
how far two places agree is found by climbing while symbols agree and descending into the first
two that don't: one step a level.

A run of period p and of L words agrees with itself, p words on, at L - p places in a row, so at
one of every max(p, least - p) places or more. Only the places on that grid are extended, for each
period: in all n log n of them, and most have unequal words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import WHITE, mix64, texts

#: A run has at least so many words, and twice its period.
LEAST = 12
#: Words of one grammar, but for a longer text, and places of the grid that are held at once.
WORDS, PLACES = 400_000, 2_000_000


class Grammar:
    """Levels of a sequence of symbols; ``parent`` of a place is its place one level up, ``first`` the other way."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.parent, self.first, self.block = [symbols.astype(np.int64)], [], [], []
        seed = 0
        while True:
            now = self.symbols[-1]
            if len(np.unique(now)) == len(now):
                return
            start = np.append(True, now[1:] != now[:-1])
            if not start.all():
                first = np.flatnonzero(start)
                self._climb(start, now[first], np.diff(np.append(first, len(now))), True)
                continue
            seed += 1
            left = (mix64(now.astype(np.uint64) + np.uint64(seed << 40)) & np.uint64(1)).astype(bool)
            ahead, back = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
            pair = ahead if ahead.sum() >= back.sum() else back
            if pair.any():
                start = np.append(True, ~pair)
                self._climb(start, now[start], np.where(np.append(pair, False), np.append(now[1:], 0) + 1, 0)[start], False)

    def _climb(self, start: np.ndarray, head: np.ndarray, rest: np.ndarray, block: bool) -> None:
        self.symbols.append(pd.factorize(head * (int(rest.max()) + 1) + rest)[0].astype(np.int64))
        self.parent.append(np.cumsum(start) - 1)
        self.first.append(np.append(np.flatnonzero(start), len(start)))
        self.block.append(block)

    def _steps(self, level: int, at: np.ndarray, back: bool) -> np.ndarray:
        """How many places are left of each place's symbol one level up, itself included."""
        up = self.parent[level][at]
        return at - self.first[level][up] + 1 if back else self.first[level][up + 1] - at

    def agree(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from places i and j on (back: up to them) are equal; i < j, and no match may reach an end of the sequence."""
        way = -1 if back else 1
        at = np.stack([i, j]).astype(np.int64)
        level = np.zeros(len(i), np.int64)
        # Climb: at each level, step over what is left of the parents' symbols, as long as both agree.
        going = np.arange(len(i))
        for h in range(len(self.parent)):
            sym = self.symbols[h]
            a, b = at[:, going]
            left = self._steps(h, a, back), self._steps(h, b, back)
            size = [self.first[h][self.parent[h][x] + 1] - self.first[h][self.parent[h][x]] for x in (a, b)]
            whole = (left[0] == size[0]) & (left[1] == size[1])
            same = sym[a] == sym[b]
            step = np.where(whole | ~same, 0, np.minimum(*left) if self.block[h] else 1)
            at[:, going] += way * step
            # Blocks whose rests differ have been left by one place only: the next symbols differ.
            up = same & (whole | (left[0] == left[1]) | (not self.block[h]))
            level[going] = h
            going = going[up]
            if not len(going):
                break
            at[:, going] = self.parent[h][at[:, going]]
            level[going] = h + 1
        # Descend: the symbols here differ; their parts agree for one stretch at most.
        for h in range(int(level.max(initial=0)), 0, -1):
            down = np.flatnonzero(level == h)
            part = self.first[h - 1][at[:, down] + 1] - 1 if back else self.first[h - 1][at[:, down]]
            a, b = part
            same = self.symbols[h - 1][a] == self.symbols[h - 1][b]
            left = np.minimum(self._steps(h - 1, a, back), self._steps(h - 1, b, back))
            at[:, down] = part + way * np.where(same, left if self.block[h - 1] else 1, 0)
            level[down] = h - 1
        return np.abs(at[0] - i)


def _grid(offset: np.ndarray, size: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid of texts that start at ``offset`` and have ``size`` words, about PLACES at a time."""
    fine = size >= least
    offset, half = offset[fine], size[fine] // 2
    text = np.repeat(np.arange(len(half)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    step = np.maximum(period, least - period)
    count = (size[fine][text] - period - 1) // step + 1
    upto = np.cumsum(count)
    at = 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PLACES, "right")))
        n = count[at:end]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(offset[text[at:end]], n) + k * np.repeat(step[at:end], n), np.repeat(period[at:end], n)
        at = end


def runs_of(words: list[list[bytes]], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(runs, offset): rows (start, length, period) of all runs of all texts by start and period, and the texts' places in the sequence that starts refer to."""
    size = np.array([len(w) for w in words], np.int64)
    offset = 1 + np.cumsum(size + 1) - (size + 1)
    codes = pd.factorize(np.array([w for own in words for w in own], object))[0]
    text = np.repeat(np.arange(len(words)), size)
    symbols = np.zeros(int(size.sum()) + len(words) + 1, np.int64)
    symbols[np.append(0, offset + size)] = (codes.max(initial=-1) + 1) + np.arange(len(words) + 1)
    symbols[offset[text] + np.arange(len(text)) - (np.cumsum(size) - size)[text]] = codes
    grammar, found = None, [np.zeros((0, 3), np.int64)]
    for place, period in _grid(offset, size, least):
        same = symbols[place] == symbols[place + period]
        place, period = place[same], period[same]
        if not len(place):
            continue
        grammar = grammar or Grammar(symbols)
        ahead = grammar.agree(place, place + period)
        back = grammar.agree(place, place + period, back=True) - 1
        far = ahead + back >= np.maximum(period, least - period)
        rows = np.stack([place - back, period + ahead + back, period], 1)[far]
        found.append(np.unique(rows, axis=0))
    runs = np.concatenate(found)
    # The same stretch under a multiple of its period comes later; the smallest period is kept.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(1)) if len(runs) else np.zeros(0, bool)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))], offset


def _groups(words: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about WORDS words."""
    at, held = 0, 0
    for k, own in enumerate(words):
        if held and held + len(own) > WORDS:
            yield at, k
            at, held = k, 0
        held += len(own)
    yield at, len(words)


def _run_rows(text: str, key: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                words = [data.split() for data in texts(batch.column(text))]
                for low, high in _groups(words):
                    yield found(batch.slice(low, high - low), words[low:high])

    def found(batch: pa.RecordBatch, words: list[list[bytes]]) -> pa.RecordBatch:
        runs, offset = runs_of(words, least)
        ends = np.append(offset, np.iinfo(np.int64).max)
        cuts = np.searchsorted(runs[:, 0], ends)
        kept = []
        for k, own in enumerate(words):
            mine = runs[cuts[k] : cuts[k + 1]]
            if len(mine):
                gone = np.zeros(len(own) + 1, np.int64)
                np.add.at(gone, mine[:, 0] - offset[k] + mine[:, 2], 1)
                np.add.at(gone, mine[:, 0] - offset[k] + mine[:, 1], -1)
                own = [w for w, g in zip(own, np.cumsum(gone), strict=False) if not g]
            kept.append(b" ".join(own).decode())
        starts = runs[:, 0] - np.repeat(offset, np.diff(cuts))
        each = pa.StructArray.from_arrays([pa.array(starts), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), each)
        cols = [batch.column(key), pa.array([len(w) for w in words], pa.int64()), lists, pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(cols, [key, "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """``key``, n_words, runs (start, length, period; in words from 0, by start, then period) and ``collapsed`` of every whole text.

    A run is a stretch of words with smallest period q (words q apart are identical) and of at
    least max(``least``, 2 q) words, that no neighbouring word extends keeping period q.
    ``collapsed`` holds the words, joined by one space, that no run covers after its first q
    words. A null or empty text, or one of white space, has no words, no runs and collapses to the
    empty string. Rows are judged one by one, so repeated rows and ids give equal rows, and a null
    id stays. Other columns aren't read.
    """
    kind = docs.schema[key].dataType.simpleString()
    out = f"{key} {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(key, text).mapInArrow(_run_rows(text, key, least), out)


def repeating(text: Column, key: Column) -> Column:
    """``text``, but for one of ten keys, whose words from some place on repeat those at that place.

    With h the CRC-32 of the decimal key and g = h div 10: where 10 divides h, each of the n words
    from a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). A null
    key or a text without words stays.
    """
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)
    split = F.filter(F.split(text, f"{WHITE}+"), lambda w: w != "")

    def rebuilt(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i))), " ")

    # A one-element array binds the split words once, however often the lambda reads them.
    planted = F.get(F.transform(F.array(split), lambda words: F.when(F.size(words) > 0, rebuilt(words)).otherwise("")), 0)
    return F.when((h % 10 == 0) & text.isNotNull(), planted).otherwise(text)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, n_runs, the longest run (ties: smallest start, then period; nulls without runs), and digests of all runs and of the collapsed text."""
    best = F.get(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 0)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length = -F.col("best.less")
    return found.withColumn("best", best).select(
        key, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(length * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
