"""Operators of the llm subpackage against brute force on small tables, with nulls, empties, ties and clashing columns."""

import hashlib
import itertools
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import additive_ann, chat, chunk_dedup, entries, mixing, near_dup, packing, pii, quality_rules, suffix_dedup, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    base = [sentence(rng, int(n)) for n in rng.integers(1, 260, 40)]
    words = base[0:1][0].split() + sentence(rng, 200).split()
    out = dict(enumerate(base))
    for k in range(12):  # near copies of one text
        own = list(words)
        for at in rng.integers(0, len(own), k):
            own[at] = "zz"
        out[100 + k] = " ".join(own)
    out |= {200: base[7], 201: base[7], 202: None, 203: "", 204: " \t\n", 205: "one two", 206: "ONE two", 207: "ß É one", 208: "x" * 900, 209: "ab" * 400}
    passage = sentence(rng, 80)
    out |= {300: base[3] + passage + base[4], 301: passage, 302: base[5] + " " + passage}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCS).withColumn("count", F.lit(1)).withColumn("text_hash", F.lit("x"))


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ---


def test_ann_recall_ties_and_refusals(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = additive_ann.search(table, table.filter("vec_id % 20 = 0"), k=10, block=128, query_block=8, shortlist=64)
    found = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 600, 20))
    y, hits = x.astype(np.float64), 0
    for q, own in found.items():
        score = y @ y[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(600), -score))[:10]
        hits += len({i for i, _ in own} & set(best.tolist()))
        assert all(abs(s - score[i]) < 1e-9 for i, s in own)
        assert own == sorted(own, key=lambda p: (-p[1], p[0]))
    assert hits / (10 * len(found)) >= 0.9
    assert [i for i, _ in found[100]] == list(range(101, 111))
    assert additive_ann.search(table.filter("vec_id >= 1000"), table, k=3).count() == 0


def test_ann_few_candidates(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = additive_ann.search(table, table.filter("vec_id = 0"), k=20).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 0.5), (2, 2, 0.5)]


def test_ann_shared_ids_and_mixed_dimensions(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0]), (3, [1.0, 1.0, 1.0]), (4, []), (20, [1.0])]
    schema = "vec_id long, embedding array<double>"
    one, two = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[::-1], schema).repartition(3)
    asked = spark.createDataFrame([(40, [1.0, 0.5]), (60, [1.0] * 3), (2, [0.0, 1.0])], schema)
    a, b = ([tuple(r) for r in additive_ann.search(t, asked, k=3).orderBy("query_id", "rank").collect()] for t in (one, two))
    # Each id comes once, also where it has several rows; other dimensions take no part.
    assert a == b and [r[:3] for r in a if r[0] == 40] == [(40, 1, 1), (40, 2, 2), (40, 3, 0)] and {r[0] for r in a} == {2, 40}
    assert [r[2] for r in a if r[0] == 2][0] == 1 and 2 not in [r[2] for r in a if r[0] == 2]


def test_code_scan_ends_early_without_loss():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 12)) * rng.lognormal(0, 1, size=(3000, 1))
    books = additive_ann.train_codebooks(x, m=4, k=16)
    codes = books.encode(x)
    coded = books.decode(codes)
    q = rng.normal(size=(5, 12))
    which, ids, score = additive_ann.best_codes(books, 40, np.arange(3000) * 2, [c.tobytes() for c in codes], np.linalg.norm(coded, axis=1), q, step=100)
    for i in range(5):
        want = np.sort(coded @ q[i])[::-1][:40]
        assert np.allclose(np.sort(score[which == i])[::-1], want, atol=1e-3) and np.allclose((coded @ q[i])[ids[which == i] // 2], score[which == i], atol=1e-3)


# --- 2 ---


def test_packing_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack_documents(docs, most=64).collect()
    places = defaultdict(list)
    pieces = defaultdict(dict)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]][r["piece"]] = r
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    for i, text in texts.items():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        assert len(pieces[i]) == -(-len(ids) // 64)
        for k, r in pieces[i].items():
            part = ids[64 * k : 64 * k + 64]
            assert (r["start"], r["length"], r["ids_crc32"]) == (64 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    total = sum(r["length"] for r in rows)
    assert len(places) <= 1.1 * -(-total // 64) + 1
    assert packing.pack_documents(empty(spark)).count() == 0


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(packing.tokenizer_path()), packing._Encoder(packing.tokenizer_path())
    rng = np.random.default_rng(0)
    odd = ["", "<|endoftext|> a", "x<|ENDOFTEXT|>y, É.", "don't, it's.. a.,b A. É, ,.", "x y\x1cz\x85w I'LL, e\u0301, KK 12.5,", "ﬁ. ǅ, İ. Σας", "a\x00b. c\x00"]
    odd += ["".join(rng.choice(list("abßÉ,.'1 \n<|>"), 60)) for _ in range(200)]
    for text, ids in zip(odd, enc.encode_all([x.encode() for x in odd]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_plan_uses_every_length_once():
    rng = np.random.default_rng(5)
    hist = np.zeros(257, np.int64)
    for n in rng.integers(1, 257, 5000):
        hist[n] += 1
    plan = packing.plan_patterns(hist)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 256
        for n in lengths:
            used[n] += times
    assert all(used[n] == hist[n] for n in range(257))
    sequences = sum(t for _, t in plan)
    assert sequences <= 1.02 * -(-int((hist * np.arange(257)).sum()) // 256)


# --- 3 ---


def repeats_by_force(all_texts):
    data = [(t or "").encode() for t in all_texts]
    count = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        cover = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if count[d[i : i + 200]] > 1:
                cover[i : i + 200] = True
        out.append((len(d), int(cover.sum()), int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(d, np.uint8)[~cover].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("ranges", [30_000, 20])
def test_suffix_dedup(spark, docs, texts, monkeypatch, ranges):
    monkeypatch.setattr(suffix_dedup, "RANGE", ranges)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect()}
    assert got == dict(zip(texts, repeats_by_force(texts.values()), strict=True))


def test_suffix_dedup_repeated_rows_and_nothing(spark, texts):
    rows = [(1, texts[300]), (1, texts[300]), (None, texts[9]), (2, "é" * 150), (3, "é" * 150 + "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.remove_repeats(table)).collect())
    assert got == sorted(repeats_by_force([t for _, t in rows]))
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_suffix_dedup_splits_lines_of_many_surroundings(spark, monkeypatch):
    rng = np.random.default_rng(11)
    letters = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    lines = [letters(n) for n in (70, 130, 185, 199)]
    surroundings = [letters(150) for _ in range(30)]
    # Each line stands in many surroundings; some share 100 bytes on the left or on the right, so that windows repeat.
    rows = [surroundings[rng.integers(30)] + line + surroundings[rng.integers(30)] for line in lines for _ in range(30)]
    rows += [letters(300), rows[5], None, rows[9] + "é" + rows[40]]
    steps = []
    plain = suffix_dedup._repeats
    monkeypatch.setattr(suffix_dedup, "RANGE", 8)
    monkeypatch.setattr(suffix_dedup, "_repeats", lambda body, anchors, text, step: steps.append(step) or plain(body, anchors, text, step))
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.remove_repeats(table)).orderBy("doc_id").collect()]
    assert got == repeats_by_force(rows)
    assert steps == [0, 1, 2]


def test_loser_tree_merges_with_prefixes():
    rng = np.random.default_rng(2)
    keys = ["".join(rng.choice(list("ab"), rng.integers(0, 12))).encode() for _ in range(300)]
    for k in (1, 2, 3, 7):
        runs = [suffix_dedup.front_code(sorted((x, b"p") for x in keys[i::k])) for i in range(k)]
        merged = list(suffix_dedup.merge_runs([suffix_dedup.front_decode(r, 1) for r in runs]))
        assert [m[0] for m in merged] == sorted(keys)
        for (a, _, _), (b, shared, _) in itertools.pairwise(merged):
            assert shared == len(os.path.commonprefix([a, b]))


# --- 4 ---


def test_rotation_against_sql(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hello"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, "ann", "late"), (2, 0, "system", "x"), (None, 0, None, "é"), (3, 70, "ann", "b"), (3, 1, "cat", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("clash"))
    got = chat.rotate_perspectives(table)
    con = duckdb.connect()
    con.register("conversations", table.drop("name").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.sql(chat.ROTATE_SQL)
    key = lambda names, r: tuple(str(r[list(names).index(c)]) for c in sorted(names))
    assert sorted(key(got.columns, r) for r in got.collect()) == sorted(key(want.columns, r) for r in want.fetchall())
    assert chat.rotate_perspectives(table.limit(0)).count() == 0
    whole = [r["rendered"] for r in got.filter("conv_id = 1 and perspective = 'bob'").orderBy("seq").collect()]
    text = "".join(whole)
    assert [text[r["mask_start"] : r["mask_end"]] for r in got.filter("conv_id = 1 and perspective = 'bob' and mask_start is not null").orderBy("seq").collect()] == ["<|im_end|>"] * 2


# --- 5 ---

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_force(text):
    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_pii_base_patterns(spark):
    rng = np.random.default_rng(4)
    parts = ["a@b.co", "x.y@z", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4041894974608795", "+1 (988) 555-2485", "+1+1", "é", " ", "(456) 555-2186", "password=abcdef1234", "a@b.c@d.e", "0-0", "..", "@x_y_z", "255.255.255.255", "\n"]
    cases = ["".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(400)]
    cases += ["".join(rng.choice(list("ab@.1 +-()0"), 40)) for _ in range(400)]
    table = spark.createDataFrame([*enumerate(cases), (9000, None), (9001, "")], "doc_id long, text string").withColumn("spans", F.lit(1))
    for r in pii.digest(pii.detect_pii(table)).collect():
        want = base_by_force(cases[r["doc_id"]] if r["doc_id"] < 9000 else "")
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), (cases[r["doc_id"]], listed, r["spans"])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(x[3] == k for x in want) for k in pii.BASE)
        assert {x for x in listed.split(",") if x} <= set(r["spans"].split(","))
    assert pii.detect_pii(empty(spark)).count() == 0


def test_pii_method_adds_and_redacts(spark, docs):
    text = "call phone (456) 555-2186 or mail bob@mail.example.com, token = \"d48fd8e940a86f41832370bc4d\" end"
    rows = [(i, text.replace("2186", str(2000 + i)), "en", "s", None) for i in range(40)]
    table = spark.createDataFrame([*rows, (99, None, None, None, None)], DOCS)
    spans = pii.digest(pii.detect_pii(table)).filter("doc_id = 1").first()["spans"]
    assert "phone:11:25" in spans and "email:34:" in spans and "secret:" in spans
    out = {r["doc_id"]: r for r in pii.redact(table).collect()}
    assert out[1]["text"].startswith("call phone [PHONE] or mail [EMAIL],") and out[1]["n_chars"] == len(out[1]["text"])
    assert out[99]["text"] is None and pii.redact(docs).columns == docs.columns


def test_em_tells_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    vote = np.stack([np.where(rng.random(4000) < p, 1 + truth, 2 - truth) for p in (0.95, 0.9, 0.55, 0.5, 0.85)], 1)
    neutral = {"belief": np.tile([[0.4, 0.4, 0.2], [0.3, 0.15, 0.55]], (5, 1, 1)), "weight": np.zeros(5)}
    post, table = pii.estimate_reliability(np.zeros(4000, int), vote, np.ones(4000), **neutral)
    assert ((post > 0.5) == truth).mean() > 0.95
    assert table[0, 0, 1, 2] > table[0, 2, 1, 2] + 0.2
    # The same votes cast by chance in another kind don't count for this one.
    kinds = np.repeat([0, 3], 4000)
    both, own = pii.estimate_reliability(kinds, np.concatenate([vote, rng.integers(0, 3, vote.shape)]), np.ones(8000), **neutral)
    assert ((both[:4000] > 0.5) == truth).mean() > 0.95 and own[0, 0, 1, 2] > own[3, 0, 1, 2] + 0.1


def card(rng, first, valid):
    own = first + "".join(str(x) for x in rng.integers(0, 10, 15 - len(first)))
    return own + next(c for c in "0123456789" if pii.luhn(own + c) == valid)


def test_pii_votes_keep_cards_and_refuse_decoys(spark):
    """End to end: what the votes accept is neither all candidates nor what one pattern says."""
    rng = np.random.default_rng(15)
    texts, good, decoys = {}, {}, {}
    for i in range(240):
        token = "".join(rng.choice(list("0123456789abcdef"), 40))
        number = card(rng, str(rng.choice(["4", "51", "37", "6011"])), True) if i % 2 else card(rng, str(rng.choice(["1", "7", "98"])), False)
        key = f'token = "{token}"' if i % 3 else f"chapter {token[:12]}"
        texts[i] = f"{sentence(rng, 9)} Then Then {sentence(rng, 6)} {number} {sentence(rng, 4)} {key} {sentence(rng, 5)}"
        (good if i % 2 else decoys)[i] = number
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["candidates"] for r in pii.find_candidates(table).collect()}
    judged = {(k, v): (post, p) for k, v, post, p in pii.judged_patterns([(*key, n) for key, n in Counter((c["kind"], c["votes"]) for cs in found.values() for c in cs).items()])}
    for i, number in {**good, **decoys}.items():
        own = [c for c in found[i] if c["kind"] == "card" and texts[i][c["start"] : c["end"]] == number]
        assert len(own) == 1 and (judged["card", own[0]["votes"]][0] > 0.5) == (i in good)
    spans = {r["doc_id"]: r["spans"] for r in pii.detect_pii(table).collect()}
    named = lambda i: {(x["kind"], texts[i][x["start"] : x["end"]]) for x in spans[i]}
    assert all(("card", number) in named(i) for i, number in good.items())
    assert not any(kind in ("card", "name") for i in decoys for kind, _ in named(i))
    for i in texts:  # a base span inside a token (its digits may pass for a card) keeps the token out
        inside = any(x["base"] and texts[i][x["start"] : x["end"]] != good.get(i) for x in spans[i])
        assert inside or any(kind == "secret" for kind, _ in named(i)) == bool(i % 3)


def test_redaction_of_overlaps_nulls_and_clashing_columns(spark):
    text = "write a.b@mail.example.com, +1 (456) 555-2186@mail.example.com end"
    rows = [(1, text, 7, 0), (2, None, 7, 0), (3, "", 7, 0), (3, "x" * 300_000 + " 10.1.2.3", 7, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, candidates int, n_chars int")
    out = pii.redact(table)
    assert out.columns == table.columns
    got = {(r["doc_id"], len(r["text"] or "")): r for r in out.collect()}
    assert len(got) == 4 and all(r["candidates"] == 7 for r in got.values())
    assert sorted(r["text"] or "" for r in got.values())[-1] == "x" * 300_000 + " [IP]"
    first = next(r for r in got.values() if r["doc_id"] == 1)
    assert first["text"] == "write [EMAIL], [PHONE][EMAIL] end" and first["n_chars"] == len(first["text"])
    assert pii.redact(table.limit(0)).count() == 0


# --- 6 ---


def test_mixing_reaches_margins(spark):
    rng = np.random.default_rng(6)
    rows = [(i, sentence(rng, 30) + (" license" if i % 7 == 0 else ""), str(rng.choice(["en", "de", "fr"], p=[0.7, 0.2, 0.1])), str(rng.choice(["a", "b"], p=[0.8, 0.2])), 0) for i in range(3000)]
    rows += [(5000, None, None, None, None), (5001, "", "en", "a", 0), (None, "some words here", None, "b", 1)]
    table = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(True))
    out = mixing.mix_documents(table).toPandas()
    assert len(out) == len(rows) and out[out.doc_id == 5000].mix_kept.all() and out[out.doc_id == 5001].mix_kept.all()
    own = out[out.mix_tokens > 0]
    kept = own.mix_tokens * own.mix_probability
    assert mixing.LEAST_SHARE - 0.03 < kept.sum() / own.mix_tokens.sum() <= mixing.KEEP_SHARE + 1e-9 and own.mix_probability.max() <= 1
    # Three tokens of no language can't be its share of the target: that is what the residuals say; the sources are met.
    assert own[own.mix_lang == "none"].mix_lang_residual.max() < -0.02 and own.mix_source_residual.abs().max() < 0.01
    assert mixing.mix_documents(empty(spark)).count() == 0


def test_rake_fits_all_margins(spark):
    cells = spark.createDataFrame([("a", "en", "p", 100), ("a", "de", "p", 50), ("b", "en", "q", 30), ("b", "de", "p", 20), ("a", "de", "q", 10)], "mix_source string, mix_lang string, mix_topic string, tokens long")
    want = {"mix_source": {"a": 0.6, "b": 0.4}, "mix_lang": {"en": 0.5, "de": 0.5}, "mix_topic": {"p": 0.7, "q": 0.3}}
    for by, target in want.items():
        cells = cells.join(spark.createDataFrame(list(target.items()), f"{by} string, {by}_target double"), by)
    out = mixing.rake(cells, rounds=30).toPandas()
    for by, target in want.items():
        share = out.groupby(by).weight.sum() / out.weight.sum()
        assert all(abs(share[k] - v) < 1e-3 for k, v in target.items())


def test_mixing_meets_its_targets_on_the_documents(spark):
    """Every expected marginal lies within a point of its target, and the residual columns say what brute force says."""
    out = mixing.mix_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), keep=["doc_id"]).toPandas()
    own = out[out.mix_tokens > 0]
    kept = own.mix_tokens * own.mix_probability
    topics = kept.groupby(own.mix_topic).sum() / kept.sum()
    assert all(abs(topics[k] - v) < 0.01 for k, v in mixing.TOPIC_TARGET.items())
    langs, whole = kept.groupby(own.mix_lang).sum() / kept.sum(), sum(mixing.LANG_TARGET.values())
    assert all(abs(langs[k] - v / whole) < 0.01 for k, v in mixing.LANG_TARGET.items())
    sources = own.groupby("mix_source").mix_tokens.sum() ** mixing.SOURCE_POWER
    share = kept.groupby(own.mix_source).sum() / kept.sum()
    assert (share - sources / sources.sum()).abs().max() < 0.01
    assert own[[f"mix_{x}_residual" for x in mixing.AXES]].abs().max().max() < 0.01
    real = own[own.mix_kept].mix_tokens.sum() / own.mix_tokens.sum()
    assert abs(real - kept.sum() / own.mix_tokens.sum()) < 0.05


def test_margins_that_cannot_be_met_are_reported(spark):
    """One licence among many texts can't be 6 % of what stays: it stays, most of the rest does, and the residual says so; nothing is emptied."""
    rng = np.random.default_rng(16)
    rows = [(i, sentence(rng, 30) + (" license" if i == 7 else ""), str(rng.choice(["en", "de"])), str(rng.choice(["a", "b"])), 0) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCS)
    for least in (0.25, 0.8):
        out = mixing.mix_documents(docs, least=least).toPandas()
        share = (out.mix_tokens * out.mix_probability).sum() / out.mix_tokens.sum()
        assert least - 0.15 < share <= least + 1e-9 and out.mix_probability.max() <= 1
        rare = out[out.doc_id == 7].iloc[0]
        assert rare.mix_probability > 0.99 and rare.mix_kept and rare.mix_topic_residual < -0.05
        assert out[out.doc_id != 7].mix_topic_residual.max() > 0.05


# --- 7 ---


def test_sampler_keeps_own_columns_and_reads_redacted_topics(spark):
    texts = ["mail a.b@example.com now", "call +49 30 1234567 89 now", "pay 4111 1111 1111 1111 now", "plain words here", "year 1999 was long", None, ""] * 3
    rows = [(k, t, "en", f"s{k % 2}", k, 7, "x", 0.5) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_foo long, mix_kept int, mix_topic string, `a.b` double")
    out = mixing.sample_documents(docs, least=1.0, share=1.0)
    assert out.columns == docs.columns and all(r["mix_foo"] == r["doc_id"] and r["mix_kept"] == 7 and r["mix_topic"] == "x" for r in out.collect())
    topics = lambda df, t: {r["doc_id"]: r["k"] for r in df.select("doc_id", mixing.topic_of(F.coalesce("text", F.lit("")), t).alias("k")).collect()}
    before, hidden = topics(docs, mixing.TOPICS), pii.redact(docs)
    assert [before[k] for k in range(5)] == ["contact", "contact", "data", "prose", "data"]
    assert topics(hidden, mixing.REDACTED_TOPICS) == before and topics(hidden, mixing.TOPICS) != before
    assert mixing.sample_documents(docs.limit(0)).count() == 0


def test_gear_hash_and_chunk_dedup(spark, docs, texts):
    data = np.frombuffer(texts[100].encode(), np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = ((h << 1) + int(chunk_dedup.GEAR[b] & np.uint64(0xFFFFFFFF))) & 0xFFFFFFFF
        want.append(h)
    assert chunk_dedup.gear_hashes(data).tolist() == want
    got = {r["doc_id"]: r for r in chunk_dedup.dedup_chunks(docs).collect()}
    seen, settings = set(), dict(least=128, bits=8, most=2048)
    for i in sorted(texts):
        raw, kept, at = (texts[i] or "").encode(), [], 0
        for end in chunk_dedup.borders(np.frombuffer(raw, np.uint8), **settings):
            if raw[at:end] not in seen:
                kept.append(raw[at:end])
                seen.add(raw[at:end])
            at = end
        assert got[i]["kept_sha256"] == hashlib.sha256(b"".join(kept)).hexdigest() and got[i]["n_bytes"] == len(raw)
    assert got[201]["n_removed"] == got[201]["n_bytes"] > 0
    assert chunk_dedup.dedup_chunks(empty(spark)).count() == 0


def test_chunks_resist_shifts():
    rng = np.random.default_rng(8)
    raw = rng.integers(97, 123, 60_000).astype(np.uint8)
    cut = lambda d: {bytes(d[a:b]) for a, b in itertools.pairwise([0, *chunk_dedup.borders(d, 128, 8, 2048)])}
    a, b = cut(raw), cut(np.insert(raw, 30_000, [65, 66, 67]).astype(np.uint8))
    assert len(a & b) >= 0.95 * len(a)


def test_chunk_stretches_by_force(spark, docs, texts):
    got = {r["doc_id"]: r["kept_sha256"] for r in chunk_dedup.dedup_chunks(docs, **chunk_dedup.PASSAGES).collect()}
    seen = set()
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        at = [0, *chunk_dedup.borders(np.frombuffer(raw, np.uint8), 16, 4, 2048)]
        spans = {(a, min(b for b in at if b >= a + 128)) for a in at if a + 128 <= len(raw)}
        if raw:
            spans.add((max((a for a in at if a + 128 <= len(raw)), default=0), len(raw)))
        gone = np.zeros(len(raw), bool)
        for a, b in sorted(spans):
            gone[a:b] |= raw[a:b] in seen
            seen.add(raw[a:b])
        assert got[i] == hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest(), i


def test_passages_of_over_fifty_words_go(spark, tmp_path):
    rng = np.random.default_rng(50)
    phrase, rows, size = sentence(rng, 8), [], {}
    for k in range(60):
        passage = sentence(rng, int(rng.integers(51, 81)))
        size[100 + k] = len(passage)
        for i in (k, 100 + k):
            rows.append((i, " ".join([sentence(rng, int(rng.integers(40, 120))), passage, sentence(rng, int(rng.integers(40, 120)))])))
        rows.append((200 + k, " ".join([sentence(rng, 60), phrase, sentence(rng, 60)])))  # a short phrase may stay
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    gone = {r["doc_id"]: r["n_removed"] for r in entries.op7_gear_chunk_dedup(spark, str(tmp_path)).collect()}
    assert all(n == 0 for i, n in gone.items() if i not in size)
    assert sum(gone[i] > 0 for i in size) >= 0.95 * len(size)
    assert sum(gone[i] for i in size) >= 0.65 * sum(size.values())
    assert all(gone[i] <= n + 2 for i, n in size.items())


def test_chunk_borders_by_their_rule():
    """Borders against the rule told byte by byte: a hash with leading zeros, bounds on the length, and no cut character."""
    rng = np.random.default_rng(12)
    table = [int(x) & 0xFFFFFFFF for x in chunk_dedup.GEAR]
    for least, bits, most in ((16, 4, 40), (16, 4, 2048), (128, 8, 2048)):
        for _ in range(20):
            raw = "".join(rng.choice(list("abcé€😀 "), int(rng.integers(0, 900)))).encode()
            want, at = [], 0
            while at < len(raw):
                end = min(at + most, len(raw))
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end -= 1
                for k in range(at + least, end):
                    h = 0
                    for b in raw[max(0, k - 32) : k]:
                        h = (2 * h + table[b]) & 0xFFFFFFFF
                    if h >> (32 - bits) == 0 and raw[k] & 0xC0 != 0x80:
                        end = k
                        break
                want.append(end)
                at = end
            assert chunk_dedup.borders(np.frombuffer(raw, np.uint8), least, bits, most) == want


def test_chunks_of_shared_ids_and_long_texts(spark):
    rng = np.random.default_rng(13)
    a, b, long = sentence(rng, 90), sentence(rng, 90), sentence(rng, 60_000)
    rows = [(0, a), (1, a), (1, b), (2, b), (2, b), (None, a), (None, long), (3, long), (4, None), (5, "é" * 3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_id", F.lit("clash"))
    out = chunk_dedup.dedup_chunks(table, **chunk_dedup.PASSAGES).collect()
    assert len(out) == len(rows)
    left = Counter((r["doc_id"], r["kept_text"]) for r in out)
    assert left[(None, a)] == left[(None, long)] == left[(1, b)] == left[(4, "")] == 1
    assert left[(0, "")] == left[(1, "")] == left[(3, "")] == 1 and left[(2, "")] == 2
    assert all("\ufffd" not in r["kept_text"] for r in out)


# --- 8 ---


def test_url_parts_and_rules(spark):
    urls = ["https://A.Example.com/en/7?x", "http://example.com/en/81", "ftp://x.com/EN/", "x", None, "://h", "http://net/de/", "https://a.example.net/de/8/z#q", "https://badexample.com/en/7", "http://x.org/es/?a/b", "a://b://c/d", "http://y.example.org/fr/1"]
    table = spark.createDataFrame([(i, u, "<p>bad example words</p>") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", F.lit(0))
    got = {r["page_id"]: r for r in url_filter.judge_urls(table).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(t), t, v) for v, t in url_filter.RULES if (host == t.partition("/")[0] or host.endswith("." + t.partition("/")[0])) and path.startswith("/" + t.partition("/")[2])]
        r = got[i]
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == (max(fits)[1:] if fits else (None, r["verdict"])) and r["verdict"] in ("allow", "block")
    assert url_filter.judge_urls(table.limit(0)).count() == 0


def test_viterbi_equals_all_splits():
    split = url_filter.Splitter({"the": 50, "there": 9, "in": 30, "rein": 2, "them": 5, "me": 8})
    for run in ("therein", "theme", "xthe", "themein"):
        options = []
        for mask in range(1 << (len(run) - 1)):
            parts, at = [], 0
            for k in range(1, len(run) + 1):
                if k == len(run) or mask >> (k - 1) & 1:
                    parts.append(run[at:k])
                    at = k
            if all(p in split.score or len(p) == 1 for p in parts):
                options.append((sum(split.score.get(p, split.unseen) for p in parts), parts))
        got = split.split(run)
        assert abs(sum(split.score.get(p, split.unseen) for p in got) - max(options)[0]) < 1e-9


# --- 9 ---


def stats_by_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {k for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_text_statistics_by_force():
    rng = np.random.default_rng(9)
    cases = ["", " ", "a b c a b c", "\x0b\x0c\x1c\x85 x", "ab\nab\n\n ab\nab ", "é ü é ü é"] + ["".join(rng.choice(list("ab \n#é$\t"), 80)) for _ in range(500)]
    for text in cases:
        assert quality_rules.text_stats(text.encode())[:5] == stats_by_force(text), text


def test_rules_cover_bad_rows_and_leave_good_ones(spark):
    rng = np.random.default_rng(10)
    good = [sentence(rng, 120) for _ in range(150)]
    bad = [" ".join(rng.choice(["buy", "now", "#1", "$$"], 120)) for _ in range(60)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(good + bad)] + [(900, None, "en", "s", 0), (901, "few words", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 210, 2)] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality_rules.judge_quality(docs, labels).collect()}
    assert all(out[i]["kept"] for i in range(150)) and not any(out[i]["kept"] for i in range(150, 210))
    assert out[900]["base_failed"] and out[901]["base_failed"] and not out[901]["kept"]
    clash = docs.withColumn("n_words", F.lit("x"))
    kept = quality_rules.keep_good(clash, labels)
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == set(range(150))
    assert quality_rules.judge_quality(docs, labels.limit(0)).filter("kept").count() >= 150
    assert quality_rules.judge_quality(empty(spark), labels).count() == 0


# --- 10 ---


def links_by_force(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in texts}
    for _ in texts:
        for a, b in itertools.combinations(texts, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
        if all(label[label[i]] == label[i] for i in texts):
            break
    return {i: (len(sets[i]), label[i], label[i] == i) for i in texts}


@pytest.mark.parametrize("leaf", [32, 2])
def test_near_duplicates(spark, docs, texts, monkeypatch, leaf):
    monkeypatch.setattr(near_dup, "LEAF", leaf)
    monkeypatch.setattr(near_dup, "BLOCK", 5 if leaf == 2 else 384)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.link_documents(docs).collect()}
    assert got == links_by_force(texts)
    assert near_dup.link_documents(empty(spark)).count() == 0
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, x in got.items() if x[2]}


def test_near_duplicates_null_and_repeated_ids(spark, texts):
    rows = [(None, texts[100]), (None, None), (5, texts[100]), (5, texts[100]), (7, texts[101])]
    out = near_dup.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 5 and all(r["kept"] and r["component_id"] is None for r in out if r["doc_id"] is None)
    assert {r["component_id"] for r in out if r["doc_id"] is not None} == {5}


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r["label"] for r in near_dup.components(edges).collect()} == {0}


def test_near_duplicates_of_very_long_texts_and_clashing_columns(spark):
    rng = np.random.default_rng(14)
    words = sentence(rng, 40_000).split()
    near = list(words)
    near[7] = "zz"
    rows = [(3, " ".join(words)), (4, " ".join(near)), (5, " ".join(words[:20_000]))]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone_id", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("rep", F.lit(2))
    kept = near_dup.drop_near_duplicates(table)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 5]


# --- pipeline ---


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        path = str(tmp_path / f"{stage.__name__}")
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        ids, before = {r["doc_id"] for r in kept.select("doc_id").collect()}, {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        assert ids <= set(before)
        if stage.__name__ == "near_duplicates":
            assert ids == {i for i, x in links_by_force(before, 80).items() if x[2]}
        if stage.__name__ == "quality":
            assert not any(n[0] < 50 or 100 * n[4] > 50 * n[0] for n in (stats_by_force(before[i]) for i in ids))
        if stage.__name__ == "mix":
            words = lambda own: sum(len((before[i] or "").split()) for i in own)
            assert words(ids) >= 0.7 * words(before)
        docs = kept
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_pipeline_drops_near_copies_from_eighty_percent(spark):
    import corpus_pipeline

    rng = np.random.default_rng(80)
    texts, shares = {}, []
    for k in range(30):
        words = sentence(rng, 200).split()
        own = list(words)
        for at in range(20, 20 + 30 * (3 + k % 4), 30):  # 3 to 6 changed words, each in five shingles
            own[at] = "zz"
        x, y = ({tuple(w[i : i + 5]) for i in range(196)} for w in (words, own))
        shares.append(len(x & y) / len(x | y))
        texts |= {2 * k: " ".join(words), 2 * k + 1: " ".join(own)}
    assert any(0.8 <= x < 0.85 for x in shares) and any(x < 0.8 for x in shares) and any(x >= 0.85 for x in shares)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], DOCS)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == set(range(0, 60, 2)) | {2 * k + 1 for k, x in enumerate(shares) if x < 0.8}


def test_sql_of_queries(spark):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("conversations", "documents"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in entries.oracle_sql().items():
        got, want = entries.queries()[name](spark, sf), con.sql(sql)
        key = lambda names, r: tuple(str(r[list(names).index(c)]) for c in sorted(names))
        assert sorted(key(got.columns, r) for r in got.collect()) == sorted(key(want.columns, r) for r in want.fetchall())
