"""URL filters: rules by host and path, and naive Bayes over words that hosts are split into."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import batches_of, texts, written

#: (verdict, domain and path prefix); the longest that fits wins.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Words that the unigram model keeps, by count; and buckets of the hashed token table. Both bound what is broadcast.
VOCABULARY, BUCKETS = 50_000, 1 << 16
#: Runs of letters that count as words; longer runs are no words of their own, and aren't cut into false ones.
_WORD = re.compile(rb"(?<![a-z])[a-z]{2,24}(?![a-z])")
_TAGS = re.compile(rb"<(?:script|style)[^>]*>.*?</(?:script|style)>|<[^>]*>", re.DOTALL)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and the path after it; both empty without one, or for a null url."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (ties by its text) and its verdict; null if none fits."""
    rule, verdict = None, None
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, _, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{prefix}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return rule, verdict


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        keys = list(counts)
        batch = pa.RecordBatch.from_arrays([pa.array([k.decode() for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["word", "n"])
        counts.clear()
        return batch

    for batch in batches_of(batches, 1024):
        for data in texts(batch.column(0)):
            counts.update(_WORD.findall(_TAGS.sub(b" ", data).lower()))
        if len(counts) > 200_000:
            yield out()
    yield out()


def unigram_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """How often each word of 2 to 24 letters a-z stands in the visible text of all pages."""
    return pages.select(html).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, most: int = VOCABULARY) -> dict[str, int]:
    """The ``most`` words of highest count, ties by word.

    The count that the last of them has is found from how many words have each count, which are
    few; only words above it, and of those at it as many as are missing, are collected.
    """
    counts = written(counts, "unigrams")
    spread = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n"))
    above, least = 0, 0
    for r in spread.toLocalIterator():
        if above + r["words"] > most:
            least = r["n"]
            break
        above += r["words"]
    own = {r["word"]: r["n"] for r in counts.filter(F.col("n") > least).collect()}
    if least and above < most:
        own |= {r["word"]: r["n"] for r in counts.filter(F.col("n") == least).orderBy("word").limit(most - above).collect()}
    return own


class Splitter:
    """Splits a run of letters into the words of highest unigram probability (Viterbi).

    A letter that no word covers costs as much as an unseen word; ties take the longer last word.
    """

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + len(counts) + 1
        self.score = {w: math.log((n + 1) / total) for w, n in counts.items()}
        self.unseen = math.log(1 / total) - 1.0
        self.longest = max((len(w) for w in counts), default=1)

    def split(self, run: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            options = ((best[s] + self.score.get(run[s:end], self.unseen * (end - s) if end - s == 1 else -math.inf), -s) for s in range(max(0, end - self.longest), end))
            value, start = max(options)
            best.append(value)
            back.append(-start)
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return out[::-1]


def path_tokens(path: str) -> list[str]:
    """Runs of letters, and ``#`` with the length for runs of digits."""
    return [f"#{len(t)}" if t.isdigit() else t for t in re.findall(r"[a-z]+|[0-9]+", path.lower())]


def segment(splitter: Splitter, host: str) -> list[str]:
    return [w for run in re.findall(r"[a-z]+|[0-9]+", host) for w in (splitter.split(run) if run.isalpha() else [f"#{len(run)}"])]


def url_tokens(urls: DataFrame, counts: dict[str, int]) -> DataFrame:
    """``host_words`` of each host, and tokens of host and path, for rows with ``host`` and ``path``.

    Each distinct host of a batch is split once. ``counts`` is bounded by VOCABULARY.
    """
    spark = urls.sparkSession
    model = spark.sparkContext.broadcast(counts)
    names = urls.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, known = Splitter(model.value), {}
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            words = []
            for h in hosts:
                if h not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[h] = segment(splitter, h)
                words.append(known[h])
            tokens = [[*(f"h:{w}" for w in ws), *(f"p:{t}" for t in path_tokens(p))] for ws, p in zip(words, paths, strict=True)]
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, kind), pa.array(tokens, kind)], [*names, "host_words", "tokens"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return urls.mapInArrow(run, f"{types}, host_words array<string>, tokens array<string>")


def bayes_table(rows: DataFrame) -> tuple[float, pd.DataFrame]:
    """Log odds of block over allow, prior and by bucket, from the rows that a rule judges (add-one smoothing).

    All such rows count; the table has at most BUCKETS rows. With rows of one kind only, or of
    none, the odds hold what the smoothing says.
    """
    judged = rows.filter(F.col("ruled").isNotNull())
    block = F.col("ruled") == "block"
    priors = {r["b"]: r["n"] for r in judged.groupBy(block.alias("b")).agg(F.count("*").alias("n")).collect()}
    counts = (
        judged.select(F.explode("tokens").alias("t"), block.alias("b"))
        .groupBy(bucket_of(F.col("t")).alias("bucket"))
        .agg(F.count_if("b").alias("block"), F.count_if(~F.col("b")).alias("allow"))
        .toPandas()
        .sort_values("bucket")
    )
    n_block, n_allow = counts["block"].sum() + BUCKETS, counts["allow"].sum() + BUCKETS
    odds = np.log((counts["block"] + 1) / n_block) - np.log((counts["allow"] + 1) / n_allow)
    prior = math.log((priors.get(True, 0) + 1) / (priors.get(False, 0) + 1))
    return prior, pd.DataFrame({"bucket": counts["bucket"].astype("int64"), "odds": odds.astype("float64")})


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS))


def judge_urls(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id", rules=RULES) -> DataFrame:
    """One row per page: host, path, host_words, rule, log odds of block (``score``) and ``verdict``.

    A rule decides where one fits; elsewhere naive Bayes does, trained on all pages that rules
    judge: block if the odds are over 0. A null url, or one without ``://``, has an empty host
    and path, no tokens, and the verdict of the prior. A null html adds no words to the unigram
    model. Rows with equal ids each stay; only the three named columns are read.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    rows = written(url_tokens(rows, vocabulary(unigram_counts(pages, html))), "url-tokens")
    prior, table = bayes_table(rows)
    return scored(rows, prior, table).withColumn(
        "verdict", F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow"))
    )


def scored(rows: DataFrame, prior: float, table: pd.DataFrame) -> DataFrame:
    """Adds ``score``, the log odds of block, from a table of at most BUCKETS odds."""
    odds = np.zeros(BUCKETS)
    odds[table["bucket"].to_numpy()] = table["odds"].to_numpy()
    spark = rows.sparkSession
    model = spark.sparkContext.broadcast(odds)

    @F.pandas_udf("double")
    def total(buckets: pd.Series) -> pd.Series:
        own = model.value
        return pd.Series([prior + float(own[np.asarray(b, np.int64)].sum()) if len(b) else prior for b in buckets], dtype="float64")

    return rows.withColumn("score", total(F.transform("tokens", bucket_of)))
