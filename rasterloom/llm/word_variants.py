"""Spelling variants of a vocabulary by a dictionary of pairs of trie nodes.

Every word is cut at each of its places into a prefix and a suffix, which are nodes of a trie of
the words and of a trie of the reversed words. Nodes are numbered, so a cut is a pair of integers.
A word gives its whole pairs (prefix up to i, suffix from i) and its gapped pairs (prefix up to i,
suffix from i + 1). Words that differ by one replaced code point share the gapped pair at that
place; a word and one with a code point more share a whole pair of the first and a gapped pair of
the second. Words are distinct, so a gapped pair is held by one word a letter at most, and no
pair is a large group, however frequent prefixes or suffixes are.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import batches_of, texts, written

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
#: Words have so many code points and occurrences; a form has so many times the occurrences of its variant.
LETTERS, TIMES, MORE = 7, 2, 10
#: One of so many (document, run) pairs loses a code point in the registered query.
DROPPED = 31
#: Nodes of up to so many letters are numbered by the letters themselves, eight bits each.
SHALLOW = 7


def thinned(doc_id: object, run: str) -> str:
    """``run`` without one code point, if the CRC-32 of ``doc_id:run`` is divisible by DROPPED."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DROPPED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(text: str, key: str, letters: int, change):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1024):
            total: Counter[str] = Counter()
            for doc_id, data in zip(batch.column(key).to_pylist(), texts(batch.column(text)), strict=True):
                for word, n in Counter(RUNS.findall(data.lower().decode())).items():
                    if len(word) < letters:
                        continue
                    if change is not None and len(word := change(doc_id, word)) < letters:
                        continue
                    total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    return run


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id", letters: int = LETTERS, times: int = TIMES, change=None) -> DataFrame:
    """word and n: the distinct maximal runs of letters of at least ``letters`` code points and ``times`` occurrences in all whole texts.

    Only A to Z are lower-cased. ``change(id, word)`` may rewrite a run and isn't to lengthen it.
    Counts are summed in batches of texts before they move. Null texts have no words.
    """
    counts = docs.select(key, text).mapInArrow(_counted(text, key, letters, change), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _nodes(letters: bytes, seed: bytes) -> tuple[list[int | None], list[bytes | None]]:
    """Numbers of the nodes of all beginnings of ``letters``, the empty one first: packed letters, or a digest where there are more than SHALLOW."""
    number: list[int | None] = [0]
    digest: list[bytes | None] = [None]
    packed, state = 0, hashlib.blake2b(digest_size=16, person=seed)
    for k in range(1, len(letters) + 1):
        state.update(letters[k - 1 : k])
        if k <= SHALLOW:
            packed = packed << 8 | letters[k - 1]
            number.append(packed)
            digest.append(None)
        else:
            number.append(None)
            digest.append(state.copy().digest())
    return number, digest


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "gap", "lead", "p", "p_key", "s", "s_key"]
    kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]

    def flush(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names)

    rows: list[list] = [[] for _ in names]
    for batch in batches:
        for own, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
            letters = word.encode("latin-1")
            n = len(letters)
            p, p_key = _nodes(letters, b"prefix")
            s, s_key = (x[::-1] for x in _nodes(letters[::-1], b"suffix"))
            lead = [k == 0 or letters[k] != letters[k - 1] for k in range(n)]
            new = [[own] * (2 * n + 1), [False] * (n + 1) + [True] * n, [False] * (n + 1) + lead, p + p[:-1], p_key + p_key[:-1], s + s[1:], s_key + s_key[1:]]
            for r, x in zip(rows, new, strict=True):
                r.extend(x)
            if len(rows[0]) > 50_000:
                yield flush(rows)
                rows = [[] for _ in names]
    yield flush(rows)


def cut_pairs(words: DataFrame) -> DataFrame:
    """id, gap, lead and the pair (p, s) of numbers of trie nodes of every cut of ``words`` (id, word).

    Nodes of at most SHALLOW letters are numbered by their letters; deeper ones have numbers under
    zero from a table of all of them, in which a node stands by a 128-bit digest of its path, so
    that a long word is read once and not once for each of its beginnings. ``lead`` marks gaps at
    the first of a row of equal letters: of the gaps that give the same shorter word, just one.
    """
    cuts = written(words.select("id", "word").mapInArrow(_cuts, "id long, gap boolean, lead boolean, p long, p_key binary, s long, s_key binary"), "cuts")
    keys = cuts.select(F.col("p_key").alias("node")).union(cuts.select("s_key")).filter(F.col("node").isNotNull()).distinct()
    nodes = written(keys.withColumn("number", -1 - F.monotonically_increasing_id()), "nodes")
    for side in ("p", "s"):
        own = nodes.select(F.col("node").alias(f"{side}_key"), F.col("number").alias(f"{side}_deep"))
        deep = cuts.filter(F.col(f"{side}_key").isNotNull()).join(own, f"{side}_key").withColumn(side, F.col(f"{side}_deep"))
        cuts = cuts.filter(F.col(f"{side}_key").isNull()).unionByName(deep.select(*cuts.columns))
    return cuts.select("id", "gap", "lead", "p", "s")


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near (how many near words) and best (the least id of them) of the words that have any.

    Each near pair is counted once: by the place of the replaced letter, or by the leading one of
    the gaps that turn the longer word into the shorter. A pair of nodes is a group of at most one
    whole cut and one gap a letter.
    """
    pairs = cut_pairs(words)
    member = F.struct("gap", "lead", "id")
    groups = pairs.groupBy("p", "s").agg(F.collect_list(member).alias("members")).filter(F.size("members") > 1)
    gaps = F.filter("members", lambda m: m["gap"])
    groups = groups.select(
        "members",
        F.size(gaps).alias("n_gaps"),
        F.size(F.filter("members", lambda m: m["lead"])).alias("n_leads"),
        F.sort_array(F.transform(gaps, lambda m: m["id"])).alias("ids"),
        F.get(F.filter("members", lambda m: ~m["gap"]), 0)["id"].alias("whole"),
    )
    m = F.col("m")
    near = F.when(m["gap"], F.col("n_gaps") - 1 + F.when(m["lead"] & F.col("whole").isNotNull(), 1).otherwise(0)).otherwise(F.col("n_leads"))
    other = F.when(F.get("ids", 0) == m["id"], F.get("ids", 1)).otherwise(F.get("ids", 0))
    best = F.when(m["gap"], F.least(other, "whole")).otherwise(F.get("ids", 0))
    found = groups.select("*", F.explode("members").alias("m")).select(m["id"].alias("id"), near.alias("near"), best.alias("best"))
    return found.groupBy("id").agg(F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best")).filter(F.col("n_near") > 0)


def follow(forms: DataFrame) -> DataFrame:
    """id and root, the last of the forms from id on, of ``forms`` (id, form; form null at the end).

    Each round doubles how far every word looks. Forms have at least MORE times the occurrences,
    so a chain of counts under 2^63 has at most 19 steps and five rounds reach its end.
    """
    now = written(forms.select("id", F.coalesce("form", "id").alias("root")), "roots")
    while True:
        up = now.select(F.col("id").alias("u"), F.col("root").alias("next"))
        then = written(now.join(up, F.col("root") == F.col("u")).select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        now = then.select("id", "root")
        if then.filter("moved").isEmpty():
            return now


def group_variants(words: DataFrame, more: int = MORE) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``words`` (word, n; distinct words of code points up to U+00FF).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point.
    A word's form is its near word of largest n (ties: the smaller in code-point order), if that
    is at least ``more`` times its own n; the root is the last of its forms, or the word itself.
    Words are numbered by n from the largest and then in code-point order, so the best near word
    is the least number. An empty table gives an empty one.
    """
    ranked = words.select("word", "n").orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id())
    ranked = written(ranked, "ranked")
    near = near_words(ranked)
    best = ranked.select(F.col("id").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    fits = F.col("best_n") >= more * F.col("n")
    judged = ranked.join(near, "id", "left").join(best, "best", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best")).alias("form_id"), F.when(fits, F.col("best_word")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"),
    )
    judged = written(judged, "judged")
    roots = follow(judged.select("id", F.col("form_id").alias("form")))
    named = ranked.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    last = roots.select(F.col("id").alias("r"), F.col("root").alias("root_id")).join(named, "root_id")
    return judged.join(last, F.col("id") == F.col("r")).select("word", "n", "n_near", "form", "form_n", "root")
