"""Periodic runs, spelling variants and SimHash links against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import bit_dups, entries, word_runs, word_variants

DOCS = "doc_id long, text string, n long, runs string, word string, print string"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "r", "w", "p") for i, t in texts], DOCS)


# --- 11 ---


def planted(doc_id, text):
    words = SPLIT.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def runs_by_force(words, least=12):
    """Every maximal stretch of each period, then the smallest period of each stretch."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed_by_force(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_repeats(rng, size):
    """Words with nested repeats of many periods."""
    out = []
    while len(out) < size:
        part = [f"w{x}" for x in rng.integers(0, rng.integers(1, 6) + 1, rng.integers(1, 30))]
        part *= int(rng.integers(1, 6))
        if out and rng.random() < 0.5:
            at = int(rng.integers(0, len(out)))
            part += out[at : at + int(rng.integers(1, 80))] * int(rng.integers(1, 4))
        out += part
    return out[:size]


def test_runs_equal_brute_force_on_random_repeats():
    rng = np.random.default_rng(5)
    words = [random_repeats(rng, int(n)) for n in rng.integers(0, 260, 120)]
    words += [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 1000, ["a", "b"] * 300, list("abcdefghijkl") * 2, list("abcdefghijk") * 2, list("aab" * 40 + "aac" * 40)]
    got, offset = word_runs.runs_of([[w.encode() for w in own] for own in words])
    ends = np.append(offset, 1 << 60)
    for k, own in enumerate(words):
        mine = got[(got[:, 0] >= ends[k]) & (got[:, 0] < ends[k + 1])] - [offset[k], 0, 0]
        assert [tuple(r) for r in mine.tolist()] == runs_by_force(own), k


def test_grammar_agrees_with_comparison():
    rng = np.random.default_rng(6)
    body = rng.integers(0, 3, 600)
    body[200:400] = np.tile(body[200:205], 40)
    body[420:520] = body[220:320]
    symbols = np.concatenate([[9], body, [8]])
    grammar = word_runs.Grammar(symbols)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(1, 601), np.arange(1, 601)))
    i, j = i[i < j], j[i < j]

    def force(a, b, way):
        n = 0
        while symbols[a] == symbols[b]:
            a, b, n = a + way, b + way, n + 1
        return n

    pick = rng.integers(0, len(i), 4000)
    for back in (False, True):
        got = grammar.agree(i, j, back)
        assert all(got[k] == force(i[k], j[k], -1 if back else 1) for k in pick)
    assert all(len(x) > len(y) for x, y in zip(grammar.symbols, grammar.symbols[1:], strict=False))


def test_grid_in_small_parts_gives_the_same(monkeypatch):
    rng = np.random.default_rng(7)
    words = [[w.encode() for w in random_repeats(rng, 300)] for _ in range(5)]
    whole, _ = word_runs.runs_of(words)
    monkeypatch.setattr(word_runs, "PLACES", 50)
    parts, _ = word_runs.runs_of(words)
    assert whole.tolist() == parts.tolist()
    monkeypatch.setattr(word_runs, "WORDS", 500)
    assert list(word_runs._groups(words)) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]


def test_runs_query_with_nulls_blanks_copies_and_long_texts(spark):
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(random_repeats(rng, int(n)))) for i, n in enumerate(rng.integers(0, 200, 60))]
    texts += [(100, None), (101, ""), (102, " \t\n"), (103, "É é x " * 30), (None, "a b " * 20), (7, "a b c " * 9), (7, "a b c " * 9)]
    texts += [(104, "x " * 30_000), (105, " ".join(f"u{k}" for k in range(20_000)) + " end" * 13)]
    docs = frame(spark, texts)
    found = word_runs.find_runs(docs.withColumn("text", word_runs.repeating(F.col("text"), F.col("doc_id"))))
    got = Counter(tuple(r) for r in word_runs.digest(found).collect())
    want = Counter()
    for i, t in texts:
        words = planted(i, t) if i is not None else SPLIT.findall(t or "")
        if i == 104:
            n = len(words)
            runs = [(0, n, 1)]
        elif i == 105:
            runs = [(len(words) - 13, 13, 1)] if zlib.crc32(b"105") % 10 else runs_by_force(words)
        else:
            runs = runs_by_force(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
        milli = 1000 * best[1] // best[2] if runs else None
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[(i, len(runs), *best, milli, sha(lines), sha(collapsed_by_force(words, runs)))] += 1
    assert got == want
    assert word_runs.digest(word_runs.find_runs(docs.limit(0))).count() == 0


# --- 12 ---


def near_by_force(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def variants_by_force(count):
    best, near = {}, {}
    for w in count:
        own = [x for x in count if near_by_force(w, x)]
        near[w] = len(own)
        top = min(own, key=lambda x: (-count[x], x), default=None)
        best[w] = top if top is not None and count[top] >= 10 * count[w] else None
    out = set()
    for w in count:
        root = w
        while best[root] is not None:
            root = best[root]
        out.add((w, count[w], near[w], best[w], count[best[w]] if best[w] else None, root))
    return out


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    words = {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaabaaaa", "x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 150, "ÿéàÿéàÿ", "ÿéàÿéà÷"}
    for _ in range(60):
        base = "".join(rng.choice(list("abé"), rng.integers(7, 14)))
        words.add(base)
        for _ in range(4):
            at, c = int(rng.integers(0, len(base))), str(rng.choice(list("abéz")))
            words |= {base[:at] + c + base[at:], base[:at] + c + base[at + 1 :], base[:at] + base[at + 1 :]}
    count = {w: int(rng.choice([2, 3, 20, 30, 200, 2000])) for w in sorted(words)}
    table = spark.createDataFrame(list(count.items()), "word string, n long").withColumn("id", F.lit("clash")).withColumn("p", F.lit(1))
    got = word_variants.group_variants(table)
    assert {tuple(r) for r in got.collect()} == variants_by_force(count)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert word_variants.group_variants(table.limit(0)).count() == 0


def test_chains_of_forms_end_at_the_root(spark):
    rows = [(k, k + 1 if k % 19 != 18 else None) for k in range(190)]
    got = {r["id"]: r["root"] for r in word_variants.follow(spark.createDataFrame(rows, "id long, form long")).collect()}
    assert got == {k: k // 19 * 19 + 18 for k in range(190)}


def test_vocabulary_counts_whole_texts(spark):
    texts = [(1, "Straßen Straßen straßen kurz"), (2, None), (3, ""), (4, "ÉCOLIERS École-écoliers écoliers éCOLIERS"), (None, "abcdefg1abcdefg"), (5, "q" * 5000 + " " + "q" * 5000)]
    texts += [(k, "gleiche Wörter überall") for k in range(10, 300)]
    got = {r["word"]: r["n"] for r in word_variants.vocabulary(frame(spark, texts)).collect()}
    want = Counter(re.sub("[A-Z]", lambda m: m[0].lower(), w) for _, t in texts for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    changed = {r["word"]: r["n"] for r in word_variants.vocabulary(frame(spark, texts), change=word_variants.thinned).collect()}
    want = Counter()
    for i, t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{i}:{w}".encode())
            want[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    assert changed == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}


# --- 13 ---


def print_by_force(text):
    words = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels_by_force(points, most=3):
    label = {}
    for start in points:
        if start in label:
            continue
        label[start], edge = start, [start]
        while edge:
            x = edge.pop()
            for y in points:
                if y not in label and (x ^ y).bit_count() <= most:
                    label[y] = start
                    edge.append(y)
    return label


def test_fingerprints_of_words(spark):
    for text in ("", " ", "One", "one TWO", "one two three", "a b c d e f", "É é x Y z " * 50, "w " * 70_000):
        assert bit_dups.fingerprint(text.encode()) % 2**64 == print_by_force(text), text[:20]


def test_counts_bound_the_distance():
    rng = np.random.default_rng(10)
    x = rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000).astype(np.uint64)
    y = x.copy()
    for k in range(6):
        y[k * 600 :] ^= np.uint64(1) << rng.integers(0, 64, 4000 - k * 600).astype(np.uint64)
    counts = lambda v: np.array([[int(p >> (2 * s) & 3).bit_count() for s in range(32)] for p in map(int, v)])
    manhattan = np.abs(counts(x) - counts(y)).sum(1)
    hamming = np.bitwise_count(x ^ y)
    assert (manhattan <= hamming).all()
    for most in (0, 1, 3, 5):
        assert (bit_dups._close(x, y, most) == (hamming <= most)).all()
    # Every pair within three bits shares a cell of one grid.
    masks = np.array(bit_dups.grids(), np.int64).view(np.uint64)
    packed = lambda v: v - ((v >> np.uint64(1)) & np.uint64(0x5555555555555555))
    shared = ((packed(x)[:, None] & masks) == (packed(y)[:, None] & masks)).any(1)
    assert len(masks) == 20 and shared[hamming <= 3].all() and not shared.all()


@pytest.mark.parametrize("cell", [512, 4])
def test_links_give_the_components_of_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(bit_dups, "BLOCK", 16)
    rng = np.random.default_rng(11)
    points = set()
    for centre in rng.integers(-(2**62), 2**62, 12):
        own = int(centre)
        for _ in range(25):  # chains of small steps, and some larger ones
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                own ^= 1 << int(b)
            points.add((own + 2**63) % 2**64 - 2**63)
    table = spark.createDataFrame([(p,) for p in points], "print long")
    links = [(r["a"], r["b"]) for r in bit_dups.close_pairs(table, cell=cell).collect()]
    assert all(((a ^ b) % 2**64).bit_count() <= 3 for a, b in links)
    unsigned = [p % 2**64 for p in points]
    want = labels_by_force(unsigned)
    near = {p: {p} for p in unsigned}
    for a, b in links:
        own = near[a % 2**64] | near[b % 2**64]
        for p in own:
            near[p] = own
    assert {frozenset(x) for x in near.values()} == {frozenset(p for p in unsigned if want[p] == w) for w in set(want.values())}


def test_simhash_query_with_nulls_copies_and_clashing_columns(spark):
    rng = np.random.default_rng(12)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, n)) for n in (30, 200, 900, 3)]
    texts = [(20, None), (21, ""), (22, " \n"), (23, "one"), (24, "One"), (None, base[0]), (30, base[0]), (29, base[0]), (29, base[1])]
    for k in range(40):
        words = base[k % 3].split()
        words[int(rng.integers(0, len(words)))] = "other"
        texts.append((100 + k, " ".join(words)))
    docs = frame(spark, texts)
    got = Counter(tuple(r) for r in bit_dups.link_fingerprints(docs).collect())
    own = [(i, print_by_force(t)) for i, t in texts]
    label = labels_by_force(sorted({p for _, p in own}))
    least = {}
    for i, p in own:
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    assert got == Counter((i, f"{p:016x}", least[label[p]]) for i, p in own)
    assert bit_dups.link_fingerprints(docs.limit(0)).count() == 0


def test_queries_of_this_file_are_registered():
    assert {"op11_recompression_runs", "op12_trie_pair_variants", "op13_popcount_simhash"} <= set(entries.queries())
