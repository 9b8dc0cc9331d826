"""Quality rules: text statistics, and decision lists learned from labels by sequential covering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import batches_of, hash_sample, texts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "alpha_ratio", "digit_ratio")
STAT_TYPES = [*((c, "long") for c in COUNTS), *((c, "double") for c in RATIOS)]
SYMBOLS = b"#*$%&|<>"

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1
_CLASS[list(range(48, 58))] = 2
_CONT = np.zeros(256, bool)
_CONT[0x80:0xC0] = True


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    wide = np.int64(int(ids.max()) + 1)
    if wide < 2_000_000:  # three ids fit into 63 bits
        keys = (ids[:-2] * wide + ids[1:-1]) * wide + ids[2:]
    else:
        _, pairs = np.unique(ids[:-1] * wide + ids[1:], return_inverse=True)
        keys = pairs[:-1] * wide + ids[2:]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    cover = np.zeros(n, bool)
    cover[:-2] |= again
    cover[1:-1] |= again
    cover[2:] |= again
    return int(cover.sum())


def text_stats(data: bytes) -> tuple:
    """The counts and ratios of one text, in the order of COUNTS and RATIOS."""
    words = data.split()
    n = len(words)
    plain = b"".join(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    joined = np.frombuffer(plain, np.uint8)
    chars = int(len(joined) - _CONT[joined].sum())
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines: set[bytes] = set()
    full = dup = 0
    for line in data.split(b"\n"):
        if line and not line.isspace():
            full += 1
            if line in lines:
                dup += 1
            else:
                lines.add(line)
    repeat = repeated_words(ids)
    kinds = np.bincount(_CLASS[joined], minlength=3) if len(joined) else np.zeros(3, int)
    bytes_ = max(len(joined), 1)
    words_ = max(n, 1)
    return (
        n, chars, symbols, dup, repeat,
        chars / words_, symbols / words_, dup / max(full, 1), repeat / words_, len(seen) / words_,
        float(kinds[1]) / bytes_, float(kinds[2]) / bytes_,
    )


def _stats_of(text: str, keep: list[str], prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 2048):
            rows = [text_stats(x) for x in texts(batch.column(text))]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in COUNTS + RATIOS]
            own = [pa.array(c, pa.int64()) for c in cols[: len(COUNTS)]] + [pa.array(c, pa.float64()) for c in cols[len(COUNTS) :]]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *own], [*keep, *(prefix + c for c in COUNTS + RATIOS)])

    return run


def with_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The ``keep`` columns of ``docs`` and the statistics of each whole text, their names after ``prefix``.

    A null text has no words; an empty one neither. Columns besides ``keep`` and ``text`` aren't
    read. No column of ``keep`` may have the name of a statistic.
    """
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    cols = list(dict.fromkeys([*keep, text]))
    return docs.select(*cols).mapInArrow(_stats_of(text, list(keep), prefix), ", ".join([*types, *(f"`{prefix}{c}` {t}" for c, t in STAT_TYPES)]))


@dataclass
class Rule:
    """``col <= at`` or ``col > at`` for each condition; all must hold."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def holds(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(stats.values()))), bool)
        for col, above, at in self.conditions:
            out &= stats[col] > at if above else stats[col] <= at
        return out

    def expression(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for name, above, at in self.conditions:
            col = F.col(prefix + name)
            out = out & (col > F.lit(at) if above else col <= F.lit(at))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{c} {'>' if above else '<='} {at:.6g}" for c, above, at in self.conditions)


def _grow(stats, bad, cuts, most) -> Rule:
    rule, inside = Rule(), np.ones(len(bad), bool)
    for _ in range(most):
        p0, n0 = bad[inside].sum(), (~bad)[inside].sum()
        if not n0 or not p0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for col, points in cuts.items():
            v = stats[col]
            order = np.sort(v[inside & bad]), np.sort(v[inside & ~bad])
            p_low, n_low = (np.searchsorted(o, points, side="right") for o in order)
            for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - base), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (col, above, float(points[k])))
        if best[1] is None:
            break
        col, above, at = best[1]
        v = stats[col][inside]
        if (v <= at).any() and (v > at).any():  # midway, so that neither side's rows stand at the edge
            at = float(v[v <= at].max() + v[v > at].min()) / 2
        rule.conditions.append((col, above, at))
        inside &= Rule([(col, above, at)]).holds(stats)
    return rule


def _worth(rule: Rule, stats, bad) -> float:
    hit = rule.holds(stats)
    p, n = bad[hit].sum(), (~bad)[hit].sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(
    stats: dict[str, np.ndarray],
    bad: np.ndarray,
    fold: np.ndarray,
    precision: float = 0.9,
    support: int = 5,
    most_rules: int = 16,
    most_conditions: int = 4,
    cuts: int = 64,
) -> list[Rule]:
    """Sequential covering: grow a conjunction by information gain, prune it on held-out rows, drop what it covers.

    ``fold``: true for the rows to grow on; the others prune. A rule stays if at least
    ``precision`` of the rows that it newly covers are bad and it newly covers ``support`` bad
    rows; the first that doesn't ends the list. Without bad rows, or without good ones, there is
    no rule.
    """
    if not bad.any() or bad.all():
        return []
    points = {c: np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1))) for c, v in stats.items()}
    rules, left = [], np.ones(len(bad), bool)
    while len(rules) < most_rules:
        grow, prune = left & fold, left & ~fold
        if bad[grow].sum() < support:
            break
        sub = {c: v[grow] for c, v in stats.items()}
        # Finer cuts where the bad rows are, so that a rare kind has thresholds of its own.
        fine = {c: np.unique(np.concatenate([points[c], np.quantile(v[bad[grow]], np.linspace(0, 1, 17))])) for c, v in sub.items()}
        rule = _grow(sub, bad[grow], fine, most_conditions)
        if not rule.conditions:
            break
        if bad[prune].any():
            held = {c: v[prune] for c, v in stats.items()}
            tails = [Rule(rule.conditions[:k]) for k in range(len(rule.conditions), 0, -1)]
            rule = max(tails, key=lambda r: (_worth(r, held, bad[prune]), len(r.conditions)))
        hit = rule.holds(stats) & left
        p, n = int(bad[hit].sum()), int((~bad)[hit].sum())
        if p < support or p < precision * (p + n):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def labelled_stats(docs: DataFrame, labels: DataFrame, rows: int, text: str = "text") -> DataFrame:
    """Statistics of at most ``rows`` labelled documents, chosen by hash order of doc_id.

    Labels without a doc_id or quality take no part; of several labels of a document, the lowest counts.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.min(F.col("quality").cast("int")).alias("quality"))
    )
    chosen = hash_sample(chosen, "label_id", rows)
    # At most ``rows`` small rows, so the broadcast is bounded.
    own = docs.select("doc_id", text).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).drop("label_id")
    return with_stats(own, text, ("doc_id", "quality"))


def fit_decision_list(docs: DataFrame, labels: DataFrame, rows: int = 20_000, **settings) -> list[Rule]:
    """Rules that find documents of quality 0, fitted on at most ``rows`` labelled documents."""
    pdf = labelled_stats(docs, labels, rows).orderBy("doc_id").toPandas()
    stats = {c: pdf[c].to_numpy(np.float64) for c in (*COUNTS[:1], *RATIOS)}
    fold = np.array([xxhash.xxh3_64_intdigest(str(x).encode()) % 3 > 0 for x in pdf["doc_id"]], bool)
    return learn_rules(stats, (pdf["quality"] == 0).to_numpy(), fold, **settings)


def rejected_by(rules: list[Rule], prefix: str = "") -> Column:
    """The number (from 1) of the first rule that holds, as one ordered conditional; null if none."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = (F if out is None else out).when(rule.expression(prefix), F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def base_failure(prefix: str = "") -> Column:
    """Under 50 words, or over half of the words in repeated three-word windows."""
    n = F.col(f"{prefix}n_words")
    return (n < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * n)


def judge_quality(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = 20_000, **settings) -> DataFrame:
    """One row per document: counts, ``base_failed``, the rule that rejects it, and ``kept``.

    ``base_failed``: under 50 words, or over half of the words in repeated three-word windows.
    A null or empty text has no words and fails. Rows with equal doc_id each stay. An empty table
    of labels gives no rules, and the base alone decides.
    """
    rules = fit_decision_list(docs, labels, rows, **settings)
    return (
        with_stats(docs, text)
        .withColumn("base_failed", base_failure())
        .withColumn("rule", rejected_by(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = 20_000, **settings) -> DataFrame:
    """``docs`` without the documents that ``judge_quality`` rejects; all columns stay as they are."""
    rules, mark = fit_decision_list(docs, labels, rows, **settings), "_quality_"
    judged = with_stats(docs, text, tuple(docs.columns), mark)
    return judged.filter(~base_failure(mark) & rejected_by(rules, mark).isNull()).select(*docs.columns)
