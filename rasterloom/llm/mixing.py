"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.llm.common import written

#: Shares of tokens that the production mix aims at; languages not listed share what is left.
LANG_TARGET = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.1}
#: Topics by the first pattern that a text holds; the rest is prose.
TOPICS = (("legal", "(?i)licen[sc]e|copyright"), ("contact", "@|[+][0-9]"), ("data", "[0-9]{4}"))
#: The same for texts whose personal data has given way to its kinds in brackets.
REDACTED_TOPICS = (TOPICS[0], ("contact", r"@|[+][0-9]|\[(EMAIL|PHONE|HANDLE)\]"), ("data", r"[0-9]{4}|\[CARD\]"))
TOPIC_TARGET = {"prose": 0.82, "legal": 0.06, "contact": 0.06, "data": 0.06}
#: Source targets are their token shares to this power, so that large sources give way.
SOURCE_POWER = 0.8
#: Rounds at most, in sweeps of SWEEP that end once no weight of the last round moves by more than TOLERANCE of itself.
ROUNDS, SWEEP, TOLERANCE = 64, 8, 1e-13
#: Shares of tokens that stay at most and at least. Between them lies the highest share at which no probability passes 1;
#: where that is under the least, rare values stay whole and their targets are approached, not met.
KEEP_SHARE, LEAST_SHARE = 0.9, 0.25
SEED = "mix-1"
AXES = ("source", "lang", "topic")
#: Up to so many cells are raked as one partition, which saves the shuffles; the result is the same.
CELLS_A_TASK = 100_000


def topic_of(text: Column, topics: tuple[tuple[str, str], ...] = TOPICS) -> Column:
    out = None
    for name, pattern in topics:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(F.lit("prose"))


def tokens_of(text: Column) -> Column:
    """Words between bytes 0x20 and 0x09 to 0x0D, by counting their first characters."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def unit_of(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def described(docs: DataFrame, text: str = "text", topics: tuple[tuple[str, str], ...] = TOPICS) -> DataFrame:
    """``docs`` and ``mix_source``, ``mix_lang``, ``mix_topic``, ``mix_tokens``; nulls are the value ``none``, a null text has no tokens."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {
            "mix_source": F.coalesce(F.col("source"), F.lit("none")),
            "mix_lang": F.coalesce(F.col("lang"), F.lit("none")),
            "mix_topic": topic_of(body, topics),
            "mix_tokens": tokens_of(body),
        }
    )


def _scaled(shares: DataFrame, by: str) -> DataFrame:
    whole = W.partitionBy(F.lit(0))
    return shares.select(by, (F.col("raw") / F.sum("raw").over(whole)).alias(f"{by}_target"))


def listed_shares(cells: DataFrame, by: str, target: dict[str, float]) -> DataFrame:
    """Targets of the values that have tokens, scaled to 1; values not listed share the unlisted rest by their tokens.

    Windows over the whole see one row a value.
    """
    listed = F.lit(None).cast("double")
    for k, v in sorted(target.items()):
        listed = F.when(F.col(by) == k, F.lit(float(v))).otherwise(listed)
    own = cells.groupBy(by).agg(F.sum("tokens").cast("double").alias("t")).withColumn("listed", listed)
    other = F.sum(F.when(F.col("listed").isNull(), F.col("t"))).over(W.partitionBy(F.lit(0)))
    rest = max(0.0, 1 - sum(target.values()))
    return _scaled(own.withColumn("raw", F.coalesce("listed", F.lit(rest) * F.col("t") / other)), by)


def power_shares(cells: DataFrame, by: str, power: float) -> DataFrame:
    """Targets in proportion to a power of each value's tokens."""
    own = cells.groupBy(by).agg(F.sum("tokens").cast("double").alias("t"))
    return _scaled(own.withColumn("raw", F.pow("t", F.lit(power))), by)


def rake(cells: DataFrame, rounds: int = ROUNDS, share: float | None = None) -> DataFrame:
    """Fits ``weight`` of cells (source, lang, topic, tokens > 0, and the three targets) to all marginals in turn.

    Each step multiplies by target over present share, a window sum over the cells of a value.
    Sweeps are written, which cuts lineage, and go on until weights rest or ``rounds`` are done.
    Cells that no document is in stay out, so margins that can't be met together end as close as
    the last round brings them. Without ``share`` weights start at the tokens and sum to them.
    With it they go on from the weights that are there, a step more a round brings their sum to
    that share of the tokens, and none passes its cell's tokens.
    """
    n, total = cells.agg(F.count("*"), F.sum("tokens")).first()
    tokens = F.col("tokens").cast("double")
    bounded = (lambda w: w) if share is None else (lambda w: F.least(tokens, w))
    whole = float(total or 0) * (1.0 if share is None else share)
    now = cells.withColumn("weight", tokens if share is None else bounded(F.lit(share) * F.col("weight")))
    for at in range(0, rounds, SWEEP):
        if n <= CELLS_A_TASK:
            now = now.coalesce(1)
        for k in range(at, min(at + SWEEP, rounds)):
            now = now.withColumn("before", F.col("weight")) if k + 1 in (at + SWEEP, rounds) else now
            for by in (f"mix_{x}" for x in AXES):
                now = now.withColumn("weight", bounded(F.col("weight") * F.lit(whole) * F.col(f"{by}_target") / F.sum("weight").over(W.partitionBy(by))))
            if share is not None:  # what bounded values leave open goes to the others
                now = now.withColumn("weight", bounded(F.col("weight") * F.lit(whole) / F.sum("weight").over(W.partitionBy(F.lit(0)))))
        now = written(now, "rake")
        rests = now.filter(F.abs(F.col("weight") - F.col("before")) > TOLERANCE * F.col("before")).isEmpty()
        now = now.drop("before")
        if rests:
            break
    return now


def calibrated(cells: DataFrame, share: float = KEEP_SHARE, least: float = LEAST_SHARE, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``probability`` to raked cells: in proportion to weight over tokens, and never over 1.

    The tokens that a cell is expected to keep are in proportion to its weight, so the kept
    documents have the fitted marginals, at the highest share of all tokens (at most ``share``)
    at which that can be. If that is under ``least``, weights are raked once more at that share,
    each bounded by its cell's tokens. Columns ``mix_<axis>_residual`` hold how far the expected
    share of a cell's source, language and topic then is from its target.
    """
    feasible = cells.agg(F.min(F.col("tokens") / F.col("weight"))).first()[0]
    if feasible is not None and feasible < least:
        out = rake(cells, rounds, least).withColumn("probability", F.col("weight") / F.col("tokens"))
    else:
        level = F.lit(min(share, feasible or share))
        out = cells.withColumn("probability", F.least(F.lit(1.0), level * (F.col("weight") / F.col("tokens"))))
    kept = F.col("tokens") * F.col("probability")
    whole = F.sum(kept).over(W.partitionBy(F.lit(0)))
    return out.withColumns({f"mix_{x}_residual": F.sum(kept).over(W.partitionBy(f"mix_{x}")) / whole - F.col(f"mix_{x}_target") for x in AXES})


def margins(cells: DataFrame) -> DataFrame:
    """axis, value, target and residual of every marginal, from what ``calibrated`` returns."""
    rows = F.array(*(F.struct(F.lit(x).alias("axis"), F.col(f"mix_{x}").alias("value"), F.col(f"mix_{x}_target").alias("target"), F.col(f"mix_{x}_residual").alias("residual")) for x in AXES))
    return cells.select(F.explode(rows).alias("m")).groupBy("m.axis", "m.value").agg(F.first("m.target").alias("target"), F.first("m.residual").alias("residual"))


def calibrated_cells(rows: DataFrame, rounds: int = ROUNDS, share: float = KEEP_SHARE, least: float = LEAST_SHARE) -> DataFrame:
    """The cells of described documents with their targets, weights, probabilities and residuals."""
    cells = rows.filter(F.col("mix_tokens") > 0).groupBy("mix_source", "mix_lang", "mix_topic").agg(F.sum("mix_tokens").alias("tokens"))
    cells = written(cells, "cells")
    cells = (
        cells.join(power_shares(cells, "mix_source", SOURCE_POWER), "mix_source")
        .join(listed_shares(cells, "mix_lang", LANG_TARGET), "mix_lang")
        .join(listed_shares(cells, "mix_topic", TOPIC_TARGET), "mix_topic")
    )
    return written(calibrated(rake(cells, rounds), share, least, rounds), "chances")


def mix_documents(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, share: float = KEEP_SHARE, least: float = LEAST_SHARE, seed: str = SEED, keep: list[str] | None = None, topics: tuple[tuple[str, str], ...] = TOPICS) -> DataFrame:
    """``docs`` (or its columns ``keep``) with mix_source, mix_lang, mix_topic, mix_tokens, mix_probability, mix_kept and three residuals.

    A document stays if the number drawn from its id lies below its cell's probability; rows with
    equal doc_id and cell share a fate. Documents without a token (null, empty) have probability 1
    and stay: they weigh nothing in the mix, and have no residual. A null doc_id draws like an
    empty one. Columns of ``docs`` with a name that starts with ``mix_`` are replaced. An empty
    table gives no rows. Texts are described once: the described rows are written.
    """
    names = [c for c in (docs.columns if keep is None else keep) if not c.startswith("mix_")]
    own = ["mix_source", "mix_lang", "mix_topic", "mix_tokens"]
    rows = described(docs.drop(*(c for c in docs.columns if c.startswith("mix_"))), text, topics)
    rows = written(rows.select(*dict.fromkeys([*names, *own, "doc_id"])), "described")
    residuals = [f"mix_{x}_residual" for x in AXES]
    chances = calibrated_cells(rows, rounds, share, least).select(
        F.col("mix_source").alias("s"), F.col("mix_lang").alias("l"), F.col("mix_topic").alias("t"), F.col("probability").alias("p"), *residuals
    )
    same = (F.col("r.mix_source") == F.col("x.s")) & (F.col("r.mix_lang") == F.col("x.l")) & (F.col("r.mix_topic") == F.col("x.t")) & (F.col("r.mix_tokens") > 0)
    # Cells are few beside documents; Spark broadcasts them if their file is small enough, and shuffles otherwise.
    out = rows.alias("r").join(chances.alias("x"), same, "left").withColumn("mix_probability", F.coalesce("x.p", F.lit(1.0)))
    out = out.withColumn("mix_kept", unit_of(F.col("r.doc_id"), seed) < F.col("mix_probability"))
    return out.select(*(F.col(f"r.{c}") for c in [*names, *own]), "mix_probability", "mix_kept", *(F.col(f"x.{c}") for c in residuals))


def sample_documents(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that ``mix_documents`` keeps, with the columns of ``docs`` alone, whatever their names."""
    aside = {c: f"own_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "source", "lang", text)}
    hidden = docs.select(*(F.col(f"`{c}`").alias(aside.get(c, c)) for c in docs.columns))
    kept = mix_documents(hidden, text, **settings).filter("mix_kept")
    return kept.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def mix_sql(rounds: int = ROUNDS, share: float = KEEP_SHARE, least: float = LEAST_SHARE, seed: str = SEED) -> str:
    """``mix_documents`` in SQL over ``documents``; all rounds are done, which changes nothing once weights rest."""

    def listed(key: str, target: dict[str, float]) -> str:
        rest = max(0.0, 1 - sum(target.values()))
        cases = " ".join(f"WHEN {_quoted(k)} THEN {v!r}::DOUBLE" for k, v in sorted(target.items()))
        return f"""SELECT k, raw / sum(raw) OVER () AS target FROM (
          SELECT k, coalesce(v, {rest!r}::DOUBLE * t / sum(t) FILTER (v IS NULL) OVER ()) AS raw FROM (
            SELECT {key} AS k, sum(tokens)::DOUBLE AS t, CASE {key} {cases} END AS v FROM cells GROUP BY {key}))"""

    topics = " ".join(f"WHEN regexp_matches(coalesce(text, ''), {_quoted(p)}) THEN {_quoted(n)}" for n, p in TOPICS)
    parts = [
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, 'none') AS s, coalesce(lang, 'none') AS l, CASE {topics} ELSE 'prose' END AS t,
          len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents)""",
        "cells AS MATERIALIZED (SELECT s, l, t, sum(tokens)::BIGINT AS tokens FROM d WHERE tokens > 0 GROUP BY ALL)",
        f"ts AS (SELECT k, raw / sum(raw) OVER () AS target FROM (SELECT s AS k, pow(sum(tokens)::DOUBLE, {SOURCE_POWER!r}) AS raw FROM cells GROUP BY s))",
        f"tl AS ({listed('l', LANG_TARGET)})",
        f"tt AS ({listed('t', TOPIC_TARGET)})",
        """w0 AS MATERIALIZED (SELECT s, l, t, tokens, ts.target AS s_target, tl.target AS l_target, tt.target AS t_target, (sum(tokens) OVER ())::DOUBLE AS total, tokens::DOUBLE AS w
          FROM cells JOIN ts ON ts.k = s JOIN tl ON tl.k = l JOIN tt ON tt.k = t)""",
    ]

    def raked(name: str, start: str, bound: str) -> None:
        step = start
        for key in "slt":
            source = f"{name} WHERE i < {rounds}" if step == start else f"({step})"
            step = f"SELECT * EXCLUDE (w), {bound.format(f'w * total * {key}_target / sum(w) OVER (PARTITION BY {key})')} AS w FROM {source}"
        if name == "r2":
            step = f"SELECT * EXCLUDE (w), {bound.format('w * total / sum(w) OVER ()')} AS w FROM ({step})"
        parts.append(f"{name} AS (SELECT 0 AS i, * FROM {start} UNION ALL SELECT i + 1 AS i, * EXCLUDE (i) FROM ({step}))")
        parts.append(f"{name}_end AS MATERIALIZED (SELECT * EXCLUDE (i) FROM {name} WHERE i = {rounds})")

    raked("r1", "w0", "{}")
    parts.append("f AS MATERIALIZED (SELECT *, min(tokens / w) OVER () AS feasible FROM r1_end)")
    parts.append(f"b0 AS MATERIALIZED (SELECT * REPLACE (least(tokens, {least!r}::DOUBLE * w) AS w, {least!r}::DOUBLE * total AS total) FROM f WHERE feasible < {least!r})")
    raked("r2", "b0", "least(tokens, {})")
    parts.append(f"p AS MATERIALIZED (SELECT *, least(1, least({share!r}::DOUBLE, feasible) * (w / tokens)) AS p FROM f WHERE feasible >= {least!r} UNION ALL SELECT *, w / tokens AS p FROM r2_end)")
    gaps = ", ".join(f"sum(tokens * p) OVER (PARTITION BY {k}) / sum(tokens * p) OVER () - {k}_target AS {k}_gap" for k in "slt")
    parts.append(f"g AS (SELECT *, {gaps} FROM p)")
    unit = f"CAST('0x' || substr(md5({_quoted(seed + ':')} || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) / 4294967296.0"
    return (
        "WITH RECURSIVE " + ",\n".join(parts) + f"""
SELECT doc_id, d.s AS mix_source, d.l AS mix_lang, d.t AS mix_topic, d.tokens AS mix_tokens, round(coalesce(p, 1)::DOUBLE, 5) AS probability,
  round(s_gap, 6) + 0::DOUBLE AS source_residual, round(l_gap, 6) + 0::DOUBLE AS lang_residual, round(t_gap, 6) + 0::DOUBLE AS topic_residual,
  {unit} < coalesce(p, 1) AS kept FROM d LEFT JOIN g ON g.s = d.s AND g.l = d.l AND g.t = d.t AND d.tokens > 0"""
    )
