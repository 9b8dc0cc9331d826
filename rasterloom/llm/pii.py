"""Personal data: base patterns, and further spans by weak supervision.

Candidates are wider than any rule: digit runs, dotted numbers, long mixed tokens, values after
``=`` or ``:``, at-names and capitalised pairs. Labelers (pattern, checksum, gazetteer, context,
variety, length) vote for, against or not at all. Expectation maximisation over the counts of
vote patterns estimates how reliable each labeler is for each kind; a logistic classifier over
votes and features of span and context is trained on the posteriors. Candidates that it accepts
and that overlap no base span are added.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import batches_of, written

#: Kinds in the order that ties take; the last three come from the method alone.
KINDS = ("email", "ip", "card", "phone", "secret", "handle", "name")
BASE = KINDS[:4]
LABELERS = ("pattern", "checksum", "gazetteer", "context", "variety", "length")
#: What each labeler is believed to do before any data: chances of abstaining, voting against and for, of false and of true candidates.
BELIEF = np.array([
    [[0.30, 0.45, 0.25], [0.20, 0.10, 0.70]],
    [[0.50, 0.45, 0.05], [0.50, 0.01, 0.49]],
    [[0.40, 0.45, 0.15], [0.40, 0.10, 0.50]],
    [[0.70, 0.20, 0.10], [0.60, 0.05, 0.35]],
    [[0.30, 0.40, 0.30], [0.30, 0.10, 0.60]],
    [[0.20, 0.50, 0.30], [0.20, 0.10, 0.70]],
])
#: How much BELIEF weighs against a kind's candidates, by labeler. What a checksum tells is arithmetic: a true card passes, a false one does in a tenth of cases.
WEIGHT = np.array([0.2, 5.0, 0.2, 0.2, 0.2, 0.2])

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}")
_RUN = re.compile(r"[(+]?[0-9](?:[\x20().-]{0,2}[0-9]){8,}")
_TOKEN = re.compile(r"[A-Za-z0-9_/+=-]{12,}")
_VALUE = re.compile(r"[A-Za-z_]{3,20}[\x20]?[=:][\x20]?[\"']?([A-Za-z0-9_/+!$-]{6,})")
_HANDLE = re.compile(r"(?<![A-Za-z0-9._%+-])@[A-Za-z0-9_]{2,40}(?![A-Za-z0-9.@-])")
_NAME = re.compile(r"[A-Z][a-zà-ÿ]{1,20}\x20[A-Z][a-zà-ÿ]{1,20}(?![A-Za-zà-ÿ])")
_GROUPED = re.compile(r"[0-9]{14,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{4,5}")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_CUES = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "pay", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "secret": ("password", "passwd", "token", "secret", "key", "auth", "="),
    "handle": ("follow", "user", "twitter", "contact", "by "),
    "name": ("mr", "mrs", "ms", "dr", "dear", "name", "author", "contact", "signed"),
}
_AGAINST = ("version", "section", "isbn", "chapter", "order", "no.", "license", "page")
#: Top-level domains, card ranges, calling codes, prefixes of keys and given names.
_DOMAINS = frozenset("com org net edu gov int mil info io co de fr es it nl uk eu us ch at be pl se no dk fi pt br mx ar ca au nz jp cn in ru".split())
_CARDS = ("34", "37", "35", "36", "38", "4", "51", "52", "53", "54", "55", "6011", "64", "65", "62", "50", "56", "57", "58", "67", *(str(n) for n in range(222, 273)))
_CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 351 352 353 354 358 420 421 971 972".split())
_PREFIXES = ("akia", "asia", "ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "pk_live_", "xox", "glpat-", "eyj", "aiza")
_GIVEN = frozenset(
    "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen "
    "anna maria peter paul hans klaus thomas andreas stefan sabine petra monika jean pierre michel jacques marie nathalie isabelle sophie "
    "jose juan carlos luis antonio manuel carmen ana isabel pilar".split()
)


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def find_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the base email pattern, in time linear in the text."""
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, last := m.end()))
        else:
            last = at + 1  # no match spans this sign, so no local part reaches back over it
        at = text.find("@", max(at + 1, last))
    return out


def base_and_failed(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and matches that the base drops."""
    good = [(s, e, "email") for s, e in find_emails(text)]
    bad: list[tuple[int, int, str]] = []
    for m in _IP.finditer(text):
        fine = all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))
        (good if fine else bad).append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        d = digits_of(m[0])
        if 14 <= len(d) <= 19:
            (good if luhn(d) else bad).append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            fine = 10 <= len(digits_of(m[0])) <= 15
            (good if fine else bad).append((m.start(), m.end(), "phone"))
    return sorted(good, key=_place), bad


def _place(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def _yes(x: bool | None) -> int:
    """A vote as a digit: 0 abstains, 1 against, 2 for."""
    return 0 if x is None else 1 + x


def _pattern_vote(kind: str, span: str, text: str, start: int) -> bool | None:
    if kind == "ip":
        return not (start and text[start - 1] == ".") or None
    if kind == "card":
        return bool(_GROUPED.fullmatch(span))
    if kind == "phone":
        return span.startswith("+") or bool(_LOCAL_PHONE.fullmatch(span))
    if kind == "secret":
        return True if text[max(0, start - 2) : start].strip(" \"'").endswith(("=", ":")) else None
    return None if kind == "name" else True


def _checksum_vote(kind: str, span: str, digits: str) -> bool | None:
    if kind == "card":
        return luhn(digits)
    if kind == "ip":
        return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in span.split("."))
    if kind == "secret":
        return True if len(span) in (32, 40, 64) and _HEX.fullmatch(span) else None
    return None


def _gazetteer_vote(kind: str, span: str, digits: str) -> bool | None:
    low = span.lower()
    if kind == "email":
        return low.rpartition(".")[2] in _DOMAINS
    if kind == "ip":
        return None if 0 < int(digits[:3] and span.split(".")[0][:3] or 0) < 224 else False
    if kind == "card":
        return digits.startswith(_CARDS)
    if kind == "phone":
        return any(digits.startswith(c) for c in _CALLING) if span.startswith("+") else None
    if kind == "secret":
        return True if low.startswith(_PREFIXES) else None
    if kind == "name":
        return low.split(" ")[0] in _GIVEN
    return None


def _variety_vote(kind: str, span: str, digits: str) -> bool | None:
    if kind == "name":
        one, _, other = span.partition(" ")
        return False if one == other else None
    if kind == "secret":
        mixed = bool(digits) and any(c.isalpha() for c in span)
        return mixed and len(set(span)) >= 10
    used = len(set(digits or span))
    return False if used <= 2 else True if used >= 5 else None


#: Usual lengths: of digits for cards and phones, of characters for the rest.
_LENGTH = {"email": (6, 64), "ip": (7, 15), "card": (15, 16), "phone": (10, 13), "secret": (20, 128), "handle": (4, 30), "name": (5, 40)}


def votes(text: str, start: int, end: int, kind: str) -> int:
    """The votes of LABELERS on a span as base-3 digits, and three features of span and context as base-3 digits after them.

    The features: share of digits (none, some, over half), what stands before (nothing or white
    space, a letter or digit, a mark) and what stands after.
    """
    span = text[start:end]
    digits = digits_of(span)
    before, low = text[max(0, start - 24) : start].lower(), span.lower()
    context = False if any(w in before for w in _AGAINST) else True if any(w in before for w in _CUES[kind]) else None
    n, (least, most) = len(digits) if kind in ("card", "phone") else len(span), _LENGTH[kind]
    cast = (
        _pattern_vote(kind, span, text, start), _checksum_vote(kind, span, digits), _gazetteer_vote(kind, span, digits), context,
        _variety_vote(kind, low if kind == "handle" else span, digits), least <= n <= most,
    )
    out = 0
    for v in cast:
        out = out * 3 + _yes(v)
    share = 0 if not digits else 1 + (2 * len(digits) > len(span))
    beside = [0 if not c or c.isspace() else 1 if c.isalnum() else 2 for c in (text[start - 1 : start] if start else "", text[end : end + 1])]
    return ((out * 3 + share) * 3 + beside[0]) * 3 + beside[1]


def wider(text: str) -> Iterator[tuple[int, int, str]]:
    """Candidates beyond the base patterns, in time linear in the text."""
    for m in _RUN.finditer(text):
        yield m.start(), m.end(), "card" if len(digits_of(m[0])) >= 13 and m[0][0] not in "+(" else "phone"
    for m in _TOKEN.finditer(text):
        if not m[0].isalpha() and any("0" <= c <= "9" for c in m[0]) and any(c.isalpha() for c in m[0]):
            yield m.start(), m.end(), "secret"
    if "=" in text or ":" in text:
        for m in _VALUE.finditer(text):
            yield m.start(1), m.end(1), "secret"
    if "@" in text:
        for m in _HANDLE.finditer(text):
            yield m.start(), m.end(), "handle"
    for m in _NAME.finditer(text):
        yield m.start(), m.end(), "name"


def candidates(text: str) -> list[tuple[int, int, str, int, bool]]:
    """All candidates (start, end, kind, votes, whether base) in order, base ones first among equals."""
    good, bad = base_and_failed(text)
    base = set(good)
    found = [(s, e, k, votes(text, s, e, k), True) for s, e, k in good]
    found += [(s, e, k, votes(text, s, e, k), False) for s, e, k in sorted({*bad, *wider(text)} - base)]
    return sorted(found, key=lambda c: (_place(c[:3]), not c[4]))


_CANDIDATE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("votes", pa.int32()), ("base", pa.bool_())]))


def _scan(text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1024):
            col = batch.column(text)
            found = [candidates(x or "") for x in col.to_pylist()]
            rows = [[dict(zip(("start", "end", "kind", "votes", "base"), c, strict=True)) for c in cs] for cs in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(rows, _CANDIDATE)], [*keep, "candidates"])

    return run


def find_candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``candidates`` of every whole text; null reads as empty."""
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    kind = "candidates array<struct<start: long, end: long, kind: string, votes: int, base: boolean>>"
    cols = list(dict.fromkeys([*keep, text]))
    return docs.select(*cols).mapInArrow(_scan(text, list(keep)), ", ".join([*types, kind]))


def _vote_chances(table: np.ndarray, kinds: np.ndarray, vote: np.ndarray) -> np.ndarray:
    """Log chance of each row's votes under false and true."""
    return sum(np.log(table[kinds, j][np.arange(len(kinds)), :, vote[:, j]]) for j in range(vote.shape[1]))


def estimate_reliability(kinds: np.ndarray, vote: np.ndarray, count: np.ndarray, belief: np.ndarray = BELIEF, weight: np.ndarray = WEIGHT, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation over vote patterns: posterior of each pattern, and P(vote | class) by kind, labeler, class and vote.

    ``belief`` weighs ``weight`` times a kind's candidates (at least two), so few data can't overturn it.
    A labeler whose estimates say that it votes for false candidates at least as
    often as for true ones tells nothing about that kind: both classes then share its mean.
    """
    n_kinds, n_lab = len(KINDS), vote.shape[1]
    table = np.tile(belief, (n_kinds, 1, 1, 1))
    seen = np.bincount(kinds, weights=count, minlength=n_kinds)
    strength = np.maximum(2.0, np.asarray(weight)[:, None] * seen)
    prior = np.full(n_kinds, 0.5)
    post = np.full(len(count), 0.5)
    for _ in range(rounds):
        log = _vote_chances(table, kinds, vote) + np.log(np.stack([1 - prior[kinds], prior[kinds]], 1))
        odds = np.exp(log - log.max(1, keepdims=True))
        post = odds[:, 1] / odds.sum(1)
        for c, mass in enumerate(((1 - post) * count, post * count)):
            for j in range(n_lab):
                own = np.zeros((n_kinds, 3))
                np.add.at(own, (kinds, vote[:, j]), mass)
                own += strength[j][:, None] * belief[j, c]
                table[:, j, c] = own / own.sum(1, keepdims=True)
        useless = (table[:, :, 1, 2] * table[:, :, 0, 1] <= table[:, :, 0, 2] * table[:, :, 1, 1])[:, :, None, None]
        table = np.where(useless, table.mean(2, keepdims=True), table)
        prior = np.clip((np.bincount(kinds, weights=post * count, minlength=n_kinds) + 1) / (seen + 2), 0.02, 0.98)
    return post, table


def _features(kinds: np.ndarray, vote: np.ndarray, context: np.ndarray) -> np.ndarray:
    """One-hot votes, votes of checksum and gazetteer by kind, features of span and context, and kinds."""
    own = [np.ones(len(kinds)), *(vote[:, j] == v for j in range(vote.shape[1]) for v in (1, 2))]
    own += [(vote[:, j] == v) & (kinds == k) for j in (1, 2) for v in (1, 2) for k in range(len(KINDS))]
    own += [context[:, j] == v for j in range(context.shape[1]) for v in (1, 2)]
    return np.stack([*own, *(kinds == k for k in range(len(KINDS)))], 1).astype(np.float64)


def fit_span_classifier(x: np.ndarray, count: np.ndarray, post: np.ndarray, steps: int = 30) -> np.ndarray:
    """Logistic weights by Newton steps on soft labels, with a ridge of 1."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (count * (post - p)) - w
        hess = (x * (count * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        move = np.linalg.solve(hess, grad)
        w += move / max(1.0, np.abs(move).max())
        if np.abs(move).max() < 1e-8:
            break
    return w


def unpack_votes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes and features of the codes that ``votes`` gives."""
    digits = np.stack([codes // 3**k % 3 for k in range(len(LABELERS) + 2, -1, -1)], 1)
    return digits[:, : len(LABELERS)], digits[:, len(LABELERS) :]


def judged_patterns(counts: list[tuple[str, int, int]]) -> list[tuple[str, int, float, float]]:
    """(kind, votes, posterior, chance by the classifier) of each of (kind, votes, count)."""
    if not counts:
        return []
    counts = sorted(counts)
    kinds = np.array([KINDS.index(k) for k, _, _ in counts])
    vote, context = unpack_votes(np.array([v for _, v, _ in counts]))
    count = np.array([n for _, _, n in counts], np.float64)
    post, _ = estimate_reliability(kinds, vote, count)
    x = _features(kinds, vote, context)
    p = 1 / (1 + np.exp(-np.clip(x @ fit_span_classifier(x, count, post), -30, 30)))
    return [(k, v, float(a), float(b)) for (k, v, _), a, b in zip(counts, post, p, strict=True)]


def accepted_patterns(found: DataFrame, threshold: float = 0.5) -> frozenset[tuple[str, int]]:
    """(kind, votes) that the trained classifier accepts.

    The table of patterns has at most 7 kinds times 3^9 votes and features, however many documents there are.
    """
    counts = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").count().collect()
    return frozenset((k, v) for k, v, _, p in judged_patterns([(r["kind"], r["votes"], r["count"]) for r in counts]) if p >= threshold)


def chosen(cands: list[dict], accepted: frozenset[tuple[str, int]]) -> list[tuple[int, int, str, bool]]:
    """Base spans and accepted candidates that overlap none of them, leftmost first and not each other."""
    base = [(c["start"], c["end"], c["kind"], True) for c in cands if c["base"]]
    starts = [b[0] for b in base]  # candidates come in order, and so do base ones
    ends = list(accumulate((b[1] for b in base), max))
    out, reach = list(base), 0
    for c in cands:
        s, e, k = c["start"], c["end"], c["kind"]
        if c["base"] or (k, c["votes"]) not in accepted or s < reach:
            continue
        k_base = bisect_left(starts, e)
        if k_base and ends[k_base - 1] > s:
            continue
        out.append((s, e, k, False))
        reach = e
    return sorted(out, key=lambda x: (_place(x[:3]), not x[3]))


def _choose(accepted: frozenset[tuple[str, int]], keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))
        for batch in batches:
            rows = [[dict(zip(("start", "end", "kind", "base"), x, strict=True)) for x in chosen(cs, accepted)] for cs in batch.column("candidates").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(rows, kind)], [*keep, "spans"])

    return run


def detect_pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """``keep`` columns and ``spans`` (start, end, kind, base) of every whole text, in order.

    Every base span is there; the classifier's others overlap no base span and not each other.
    Places are code points, the end exclusive. Null and empty texts have no spans; an empty table
    gives no rows; rows with equal doc_id each stay. Columns besides ``keep`` and ``text`` aren't read.
    """
    found = written(find_candidates(docs, text, keep), "pii-candidates")
    accepted = accepted_patterns(found, threshold)
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    kind = "spans array<struct<start: long, end: long, kind: string, base: boolean>>"
    return found.mapInArrow(_choose(accepted, list(keep)), ", ".join([*types, kind]))


def _of_kind(kind: str):
    return lambda s: s["base"] & (s["kind"] == kind)


def digest(spans: DataFrame) -> DataFrame:
    """Counts of base spans, the SHA-256 of their list, and the list of all spans."""
    listed = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return spans.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _masked(text: str, spans: list[tuple[int, int, str, bool]]) -> str:
    parts, last = [], 0
    for start, end, kind, _ in sorted(spans, key=lambda x: x[:2]):
        if end <= last:
            continue
        parts += [text[last : max(last, start)], f"[{kind.upper()}]"]
        last = end
    return "".join([*parts, text[last:]])


def redact(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; a null text stays null.

    Where spans overlap, the one that starts first names the part that they share.
    ``n_chars``, where there is such a column, becomes the length of the new text. Texts are
    searched once: they are written with their candidates. A column named ``candidates`` stays.
    """
    names = docs.columns
    own = docs.select(*(F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(names) if c != text), F.col(f"`{text}`").alias("body"))
    found = written(find_candidates(own, "body", tuple(own.columns)), "pii-candidates")
    accepted = accepted_patterns(found, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1024):
            old, cands = batch.column("body").to_pylist(), batch.column("candidates").to_pylist()
            new = pa.array([x if x is None or not cs else _masked(x, chosen(cs, accepted)) for x, cs in zip(old, cands, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text else batch.column(f"own_{k}") for k, c in enumerate(names)], names)

    wanted = [f"own_{k}" for k, c in enumerate(names) if c != text]
    out = found.select(*wanted, "body", "candidates").mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(F.col(f"`{text}`")).cast(docs.schema["n_chars"].dataType))
    return out
