"""Each operator against a brute-force version, and its defined odd cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from halyard.llm import chat_format, decontaminate, jaccard_join, lattice_lm, license_scan, mixing, nbsvm, quality_cascade, token_attribution, toxicity
from halyard.llm.queries import op5_chat_format

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def frame(spark, texts, sources=None, first=0):
    return spark.createDataFrame([(first + i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], len(t or "")) for i, t in enumerate(texts)], SCHEMA)


# 1


def test_token_attribution(spark, odd, clash, empty):
    import tiktoken

    enc = token_attribution.Encoder(open(token_attribution.DEFAULT_VOCABULARY, "rb").read())
    text = "Hello  world,\n\nthis is\na  test of 12345 naïve tokens\n"
    df = frame(spark, [text])
    for rule in ("majority", "start", "fraction"):
        rows = token_attribution.attribute_tokens(df, rule=rule).orderBy("section").collect()
        assert sum(r.n_tokens for r in rows) == pytest.approx(len(enc.encoding.encode_ordinary(text))) and rows[0].doc_tokens == len(enc.encoding.encode_ordinary(text))
        assert [r.n_bytes for r in rows] == [len(x.encode()) for x in text.splitlines(keepends=True)]
    # brute force: every byte of a token votes
    sizes = [len(enc.encoding.decode_single_token_bytes(t)) for t in enc.encoding.encode_ordinary(text)]
    owner = [i for i, x in enumerate(text.splitlines(keepends=True)) for _ in x.encode()]
    want, at = collections.Counter(), 0
    for n in sizes:
        c = collections.Counter(owner[at : at + n])
        want[min(c, key=lambda k: (-c[k], k))] += 1
        at += n
    got = {r.section: r.n_tokens for r in token_attribution.attribute_tokens(df).collect()}
    assert {k: v for k, v in got.items() if v} == dict(want)
    fields = token_attribution.attribute_tokens(df, fields=("source", "text"), sections="fields").orderBy("first_byte").collect()
    assert [f.field for f in fields] == ["source", "text"] and sum(f.n_bytes for f in fields) == len(text.encode()) + 2
    assert token_attribution.attribute_tokens(empty).count() == 0
    assert token_attribution.attribute_tokens(odd).count() == token_attribution.attribute_tokens(clash).count() > 0
    assert tiktoken is not None
    with pytest.raises(ValueError):
        token_attribution.attribute_tokens(df, rule="nearest")


# 2


def brute_lattice(lat, pieces, word, k=0):
    ids = {p: i for i, (p, _) in enumerate(pieces)}
    w = b" " + word.encode()
    a = [0.0] + [-math.inf] * len(w)
    for j in range(1, len(w) + 1):
        a[j] = np.logaddexp.reduce([a[j - 1] + lat.log_p[lat.n + w[j - 1], k]] + [a[i] + lat.log_p[ids[w[i:j]], k] for i in range(j) if w[i:j] in ids])
    return a[-1]


def test_lattice_recursion():
    pieces = [(b" a", -1.0), (b"a", -2.0), (b"ab", -1.5), (b"b", -2.5), (b" ab", -3.0), (b"ba", -2.0), ("é".encode(), -4.0)]
    one = lattice_lm.Lattice(pieces).log_p
    other = np.random.default_rng(1).normal(-5, 1, one.shape)
    lat = lattice_lm.Lattice(pieces, np.hstack([one, other]))
    words = ["a", "ab", "abab", "bbba", "é", "zé", "x" * 300]
    for rows, buf, sizes in lattice_lm._word_blocks(pa.array(words)):
        got = lat.forward(buf, sizes)[1]
        for r, v in zip(rows, got, strict=True):
            assert v.tolist() == pytest.approx([brute_lattice(lat, pieces, words[r], k) for k in (0, 1)])
        lengths = np.array([len(p) for p, _ in pieces] + [1] * 256 + [0])
        for k in (0, 1):
            assert (lat.expect(buf, sizes, k) * lengths).sum() == pytest.approx(sizes.sum())  # every byte lies under one piece


def test_lattice_scores(spark, prose, odd, clash, empty):
    texts = prose(60, 1) + [None, "", "The the THE"]
    rows = lattice_lm.lattice_scores(frame(spark, texts), rounds=1).collect()
    tok = {i: [*WORD.findall(lower(t)), "\n"] for i, t in enumerate(texts)}
    train = [w for i, t in tok.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t]
    c = collections.Counter(train)
    for r in rows:
        base = sum(math.log10((c[w] + 1) / (len(train) + len(c) + 1)) for w in tok[r.doc_id])
        assert r.base_score == pytest.approx(base) and r.n_tokens == len(tok[r.doc_id]) and r.n_known == sum(c[w] > 0 for w in tok[r.doc_id]) and r.train_tokens == len(train)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0 and math.isfinite(r.score)
    assert {r.doc_id: r.score for r in rows}[60] == {r.doc_id: r.score for r in rows}[61]
    a = sorted(map(str, lattice_lm.lattice_scores(odd, rounds=1).collect()))
    assert a == sorted(map(str, lattice_lm.lattice_scores(clash, rounds=1).collect())) and len(a) == 10
    assert lattice_lm.lattice_scores(empty).count() == 0


def brute_scores(texts, langs, held):
    """log10 of the sum over languages of their share of the training texts times the text's probability in them; spellings as the vocabulary's scores have them."""
    lat = lattice_lm.Lattice(lattice_lm.read_vocabulary(lattice_lm.DEFAULT_VOCABULARY))
    vocabulary = lattice_lm.read_vocabulary(lattice_lm.DEFAULT_VOCABULARY)
    words = [WORD.findall(lower(t)) for t in texts]
    out = [[] for _ in texts]
    for lang in sorted(set(langs), key=str):
        own = [w for w, x, h in zip(words, langs, held, strict=True) if x == lang and not h]
        c = collections.Counter(x for w in own for x in w)
        total, of = sum(c.values()) + len(own), collections.Counter(c.values())
        cut, spread = lattice_lm.discounts((of[1], of[2], of[3], of[4]), len(c) + 1, total)
        prob = lambda x: (max(c[x] - cut[min(c[x], 3)], 0) / total) + spread * math.exp(brute_lattice(lat, vocabulary, x) + lat.log_p[-1, 0])  # noqa: B023, E731
        for i, w in enumerate(words):
            out[i].append(math.log(len(own) / held.count(False) * (len(own) - cut[min(len(own), 3)]) / total) + sum(math.log(prob(x)) for x in w))
    return [np.logaddexp.reduce(x) / math.log(10) for x in out]


def test_classes_of_the_language_model(spark, prose, monkeypatch):
    texts = prose(24, 8, 5, 12) + [t.upper().replace("E", "é") for t in prose(16, 9, 5, 12)] + [None, "", "the unheard-of word"]
    langs = ["en"] * 24 + [None] * 16 + ["en", None, "en"]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string")
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    got = {r.doc_id: r.score for r in lattice_lm.lattice_scores(df, rounds=0).collect()}
    want = brute_scores(texts, langs, held)
    assert [got[i] for i in range(len(texts))] == pytest.approx(want)
    assert brute_scores(texts, ["en"] * len(texts), held) == pytest.approx([r.score for r in lattice_lm.lattice_scores(df, rounds=0, class_col=None).orderBy("doc_id").collect()])
    # languages beyond the most common ones are one class
    monkeypatch.setattr(lattice_lm, "CLASSES", 1)
    three = df.withColumn("lang", F.when(F.col("doc_id") == 30, "xx").otherwise(F.col("lang")))
    assert {r.doc_id: r.score for r in lattice_lm.lattice_scores(three, rounds=0).collect()} == pytest.approx(got)


def test_language_model_beats_the_base(spark, prose):
    own = {"en": "th er on an re", "de": "sch ung ei ch ge"}
    rng, texts = random.Random(3), []
    for i in range(400):
        lang = ("en", "de")[i % 2]
        word = lambda: "".join(rng.choice(own[lang].split()) for _ in range(rng.randint(1, 4)))  # noqa: B023, E731
        texts.append((i, " ".join(word() for _ in range(60)), lang))
    rows = lattice_lm.lattice_scores(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect()
    for part in (True, False):
        assert sum(r.score for r in rows if r.held_out == part) > sum(r.base_score for r in rows if r.held_out == part)


def test_highest(spark):
    from halyard.llm.storage import highest

    df = spark.range(10_000).select("id", (F.col("id") % 1000 + 1).alias("n"))
    got = sorted(r.n for r in highest(df, "n", "id", 100).collect())
    assert 60 <= len(got) <= 130 and got[0] >= 980 and highest(df, "n", "id", 20_000).count() == 10_000 and highest(df.limit(0), "n", "id", 5).count() == 0


def test_rare_words_meet_in_the_join(spark, prose, monkeypatch):
    df = frame(spark, prose(30, 5))
    want = {r.doc_id: (r.n_known, r.base_score, r.score) for r in lattice_lm.lattice_scores(df, rounds=0).collect()}
    monkeypatch.setattr(lattice_lm, "HOT", 5)
    for r in lattice_lm.lattice_scores(df, rounds=0).collect():
        assert (r.n_known, r.base_score, r.score) == (want[r.doc_id][0], pytest.approx(want[r.doc_id][1]), pytest.approx(want[r.doc_id][2]))


# 3


def test_license_scan(spark, prose, odd, clash, empty):
    body = prose(20, 3)
    notes = {"mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0", "gpl": "This program is licensed under the GNU General Public License, version 2.", "cc": "Licensed under CC BY-NC 3.0."}
    texts = [f"{body[i]}\n{n}\n{body[i]}" for i, n in enumerate(notes.values())] + ["He lost his driving licence.", "Permission was denied."] + body
    got = license_scan.scan_licenses(frame(spark, texts)).collect()
    assert {(r.doc_id, r.paragraph, r.family, r.confirmed) for r in got} == {(i, 1, f, True) for i, f in enumerate(notes)}
    assert all(0.5 <= r.probability <= 1 for r in got)
    # the SQL arithmetic is that of the fitted model
    weights, bias, temperature, classes = license_scan.fit(license_scan.sample_paragraphs(frame(spark, texts), 64, 400))
    z = np.array([bias]) + sum((np.array([weights[g]]) for g in license_scan.py_grams(notes["gpl"]) if g in weights), np.zeros((1, len(classes))))
    assert next(r for r in got if r.family == "gpl").probability == pytest.approx(license_scan.softmax(z / temperature)[0, classes.index("gpl")])
    assert license_scan.scan_licenses(odd).count() == license_scan.scan_licenses(clash).count() == license_scan.scan_licenses(empty).count() == 0
    twice = frame(spark, texts[:1]).unionByName(frame(spark, texts[:1]))
    assert license_scan.scan_licenses(twice).count() == 2


def test_licences_without_a_keyword_and_over_lines(spark, prose):
    body = prose(20, 3)
    notes = {"Provided under the BSD 3-Clause terms": "bsd", "CC-BY-SA 4.0": "cc"}
    texts = [f"{body[i]}\n{n}\n{body[i]}" for i, n in enumerate(notes)]
    texts += [f"{body[4]}\n\nThis is free and\nunencumbered software released into\nthe public domain.\n\n{body[5]}"] + body[6:]
    got = [(r.doc_id, r.paragraph, r.family) for r in license_scan.scan_licenses(frame(spark, texts)).collect()]
    assert sorted(g for g in got if g[0] < 2) == [(i, 1, f) for i, f in enumerate(notes.values())]
    assert {(2, "unlicense")} == {(d, f) for d, _, f in got if d >= 2}
    pieces = license_scan.paragraphs(spark.createDataFrame([(1, "a\nb\n \nc\n\nd\ne\n")], "doc_id long, text string"), "doc_id").collect()
    assert sorted((r.paragraph, r["last"], r.line) for r in pieces) == [(0, 0, "a"), (0, 1, "a\nb"), (1, 1, "b"), (3, 3, "c"), (5, 5, "d"), (5, 6, "d\ne"), (6, 6, "e")]


def test_licences_of_lines_are_those_of_the_model(spark, prose):
    rng, known = random.Random(5), sorted({g for v in license_scan.NOTICES.values() for x in v for g in license_scan.py_grams(x) if " " not in g})
    notices = [x for v in license_scan.NOTICES.values() for x in v]
    texts = prose(20, 3) + [" ".join(rng.sample(known, rng.randint(1, 40))) for _ in range(150)]
    texts += [" ".join(w for w in rng.choice(notices).split() if rng.random() < 0.6) for _ in range(150)]
    weights, bias, temperature, classes = license_scan.fit(license_scan.sample_paragraphs(frame(spark, texts), 64, 400))
    assert {"the", "of"}.isdisjoint(weights) and {"apache", "gpl"} <= set(weights)
    want = {}
    for i, t in enumerate(texts):
        own = [weights[g] for g in license_scan.py_grams(t) if g in weights]
        p = license_scan.softmax((np.array([bias]) + sum(map(np.array, own), np.zeros(len(bias)))) / temperature)[0]
        if own and p.argmax() and p.max() >= 0.5:
            want[i] = (classes[p.argmax()], p.max())
    got = {r.doc_id: (r.family, r.probability) for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert len(want) > 50 and {i: f for i, (f, _) in got.items()} == {i: f for i, (f, _) in want.items()}
    assert [got[i][1] for i in sorted(got)] == pytest.approx([want[i][1] for i in sorted(want)])


# 4


def brute_leaks(texts, items):
    def bag(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    out = set()
    for d, t in enumerate(texts):
        w = WORD.findall(lower(t))
        for k, item in enumerate(items):
            q = WORD.findall(lower(item))
            if not q:
                continue
            best = 0
            for a in range(len(w) - len(q) + 1):
                p, s = bag(w[a : a + len(q)]), bag(q)
                best = max(best, sum((p & s).values()) / sum((p | s).values()))
            if best >= 0.75:
                out.add((d, k))
    return out


def test_decontamination(spark, prose, odd, clash, empty, monkeypatch):
    rng = random.Random(4)
    items = prose(8, 11, 15, 50) + ["three word item", "", None, "a b a b a b a b a b a b a b a b"]
    texts = []
    for i, t in enumerate(prose(40, 12)):
        w = t.split()
        q = (items[i % 8]).split()
        for _ in range(i % 5):  # none to four words changed
            q[rng.randrange(len(q))] = "changed"
        texts.append(" ".join(w[:10] + q + w[10:]))
    texts += prose(10, 13) + ["say Three WORD item now", "x " + items[11] + " y", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute_leaks(texts, items)
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_hits(frame(spark, texts), bench).collect()}
    assert got == want and len(want) > 10
    monkeypatch.setattr(decontaminate, "ITEMS", 3)
    assert {(r.doc_id, r.item_id) for r in decontaminate.benchmark_hits(frame(spark, texts), bench).collect()} == want
    clean = {r.doc_id for r in decontaminate.decontaminated(frame(spark, texts), bench).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.benchmark_hits(odd, bench).count() == decontaminate.benchmark_hits(clash, bench).count() == 0
    assert decontaminate.benchmark_hits(empty, bench).count() == 0 and decontaminate.benchmark_hits(odd, bench.limit(0)).count() == 0
    assert decontaminate.decontaminated(clash, bench).columns == clash.columns and decontaminate.decontaminated(clash, bench).count() == 10


def test_documents_shorter_than_an_item(spark, prose):
    def bag(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    items = prose(12, 14, 20, 60)
    texts = []
    for t in items:
        w = t.split()
        k = len(w) // 3
        texts += [" ".join(w[:-1]), " ".join(w[: len(w) * 9 // 10]), " ".join(w[:k] + w[k + 1 :]), " ".join(w[: len(w) // 2]), " ".join(w[: len(w) * 8 // 10])]
    want = {}
    for d, t in enumerate(texts):
        for i, q in enumerate(items):
            x, y = bag(t.split()), bag(q.split())
            if 100 * (x & y).total() >= 75 * (x | y).total() and len(t.split()) < len(q.split()):
                want[d, i] = (x & y).total() / (x | y).total()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.benchmark_hits(frame(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == pytest.approx(want) and len(want) >= 36
    assert all(r.first_word == 0 and r.n_words == len(texts[r.doc_id].split()) for r in got)
    assert {r.doc_id for r in decontaminate.decontaminated(frame(spark, texts), bench).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_blocks_find_everything_within_the_radius():
    rng = np.random.default_rng(0)
    index = decontaminate.Index([(i, rng.integers(0, 2**63, 20, dtype=np.uint64)) for i in range(70)])
    probes = index.prints ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 30), replace=False)) for _ in index.prints], np.uint64)
    want = {(a, b) for a in range(70) for b in range(70) if int(np.bitwise_count(probes[a] ^ index.prints[b])) <= decontaminate.RADIUS}
    assert set(index.candidates(probes, 20)) == want


# 5


def test_chat_format(spark, tmp_path):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "### User: hi </turn>\n"), (1, 2, "assistant", "\\a\\\\<\\/turn>#\\##"), (2, 1, "assistant", None), (2, 0, None, "x"), (3, 0, "user", "a"), (3, 0, "user", "a"), (None, None, "we:ird ### role", ""), (4, 0, "user", "q"), (4, 1, "assistant", "r1"), (4, 2, "assistant", "r2")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_chats(df.withColumn("segments", F.lit(1))).withColumn("t", chat_format.read_turns(F.col("formatted"))).withColumn("l", chat_format.loss_text(F.col("segments"))).collect()}
    assert [(t.role, t.text) for t in got[1].t] == [r[2:] for r in rows[:3]] and got[1].valid and got[1].l == rows[2][3]
    assert [(t.role, t.text) for t in got[2].t] == [("", "x"), ("assistant", "")] and not got[2].valid and got[2].first_bad_turn == 0
    assert got[3].n_turns == 2 and [(t.role, t.text) for t in got[None].t] == [("we:ird ### role", "")]
    assert got[4].first_bad_turn == 2 and got[4].l == "r1r2"
    assert got[1].formatted.count("</turn>") == 3 and got[1].formatted.count("### User: ") == 1
    df.where("conv_id is not null").write.parquet(str(tmp_path / "conversations.parquet"))
    query = {r.conv_id: r for r in op5_chat_format(spark, str(tmp_path)).collect()}
    own = "\\### Assistant: </turn> ok"
    assert query[-7].loss_sha256 == hashlib.sha256(own.encode()).hexdigest() and query[-7].turns_sha256 == hashlib.sha256(f"user\n{own}\nassistant\n{own}\n".encode()).hexdigest()
    assert chat_format.format_chats(df.limit(0)).count() == 0


# 6


def test_quality_cascade(spark, prose, odd, clash, empty):
    line = "a line that comes again and again with some words"
    texts = prose(20, 21) + ["\n".join([line] * 6 + prose(1, 22)), "SHOUTING WORDS " * 12, "a*** b&&& " * 20, "few words", "\n\n" + prose(1, 23)[0] + "\n", None, ""]
    always = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality_cascade.quality_cascade(frame(spark, texts), always=always).collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        full = [x for x in t.split("\n") if WORD.search(x)]
        win = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered))
        upper, low = len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t))
        bad = len(w) < 20 or 100 * len(covered) > 30 * len(w) or 10 * r.n_symbols > 3 * len(w) or 10 * r.n_dup_lines > 3 * len(full) or not 2 * len(w) <= r.word_chars <= 20 * len(w) or upper > low
        assert r.kept == (not bad)
    assert [r.doc_id for r in quality_cascade.quality_filtered(frame(spark, texts)).orderBy("doc_id").collect()] == [*range(20), 24]
    a = sorted(map(str, quality_cascade.quality_cascade(odd, always=always).collect()))
    assert a == sorted(map(str, quality_cascade.quality_cascade(clash, always=always).collect())) and len(a) == 10
    assert quality_cascade.quality_cascade(empty).count() == 0 and quality_cascade.quality_filtered(clash).columns == clash.columns


def test_rules_are_ordered_by_rejections_per_cost(prose):
    rules = (quality_cascade.Rule("never", ("n_repeat_words",), lambda x: x < 0), quality_cascade.Rule("always", ("n_symbols",), lambda x: x >= 0))
    assert [r.name for r in quality_cascade.order_rules(pa.array(prose(50, 1)), rules)] == ["always", "never"]


# 7


def distances(a, b):
    """Edit distances of ``b`` and each beginning of ``a``."""
    column = list(range(len(b) + 1))
    out = [column[-1]]
    for i, x in enumerate(a, 1):
        last, column = column, [i]
        for j, y in enumerate(b, 1):
            column.append(min(last[j] + 1, column[-1] + 1, last[j - 1] + (x != y)))
        out.append(column[-1])
    return out


def letters(words):
    ends = np.cumsum([len(w) for w in words])
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), ends - [len(w) for w in words], ends


def test_automaton_is_the_edit_distance():
    whole, stems = ["idiot", "worthless", "scum", "crétin", "lowexyz"], ["lowe", "ünding"]
    auto = toxicity.compile_automaton([(t, False, 9.0) for t in whole] + [(t, True, 7.0) for t in stems])
    rng = random.Random(2)
    words = ["idiot", "idiots", "xidiot", "idoit", "iidiot", "diot", "id1ot", "idiöt", "worthles", "wrthless", "scum", "scums", "loweischaft", "lowe", "", "a", "cretin", "crêtin", "crtin", "undinglich", "ündnglich", "ündin", "üding"]
    words += ["".join(rng.choice("idotwrhlesuünéct") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    for w in [*whole, *stems] * 150:
        x = list(w + "".join(rng.choice("abc") for _ in range(rng.choice((0, 0, 3)))))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(x) + 1)
            x[k : k + rng.randint(0, 1)] = rng.choice(["", "z", "ü", "t"])
        words.append("".join(x))
    seen = set()
    for w, f in zip(words, auto.match(*letters(words)), strict=True):
        long_whole, long_stems = [t for t in whole if len(t) >= 5], [t for t in stems if len(t) >= 5]
        want = toxicity.STEM if any(w.startswith(t) for t in stems) else toxicity.EXACT if w in whole else toxicity.FUZZY if any(distances(w, t)[-1] <= 1 for t in long_whole) else toxicity.NEAR_STEM if any(min(distances(w, t)) <= 1 for t in long_stems) else 0
        assert f == want, w
        seen.add(int(f))
    assert seen == {0, *toxicity.KINDS}


def test_every_term_of_a_large_lexicon_has_edits():
    rng = random.Random(4)
    terms = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 9))) for _ in range(400)})
    auto = toxicity.compile_automaton([(t, i % 4 == 0, 5.0) for i, t in enumerate(terms)])
    assert all(auto.match(*letters([t[0] + "z" + t[2:] for t in terms])) > 0) and all(auto.match(*letters(terms)) > 0)


def test_words_of_toxicity_fold_case_and_lose_marks():
    auto = toxicity.compile_automaton([("âne", False, 5.0), ("crétin", False, 5.0)])
    texts = ["«ÂNE»", "quel CRÉTIN!", "l'âne,dit-il", "“Cretin”", "anne", "***", None]
    found = []
    for chunk in toxicity.chunks(pa.array(texts)):
        at = toxicity.Letters(chunk)
        flags = toxicity.word_flags(at, auto)[0]
        found += [flags[at.firsts[i] : at.firsts[i + 1]].max(initial=0) for i in range(len(chunk))]
    assert found == [toxicity.EXACT, toxicity.EXACT, toxicity.EXACT, toxicity.FUZZY, 0, 0, 0]


def toxic_set(prose, n, seed):
    rng = random.Random(seed)
    texts, y = prose(n, seed), []
    for i in range(n):
        toxic = i % 4 == 0
        if toxic:
            w = texts[i].split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "worthless", "scumbag", "moron"]))
            texts[i] = " ".join(w)
        y.append(int(toxic))
    return texts, y


def test_toxicity(spark, prose, odd, clash, empty, labels):
    texts, y = toxic_set(prose, 300, 31)
    lab = spark.createDataFrame([(i, 1, t) for i, t in enumerate(y)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(frame(spark, texts), lab).collect()}
    held = [i for i in got if got[i].held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i].predicted == y[i] for i in held) / len(held) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    model = toxicity.train(frame(spark, texts), lab)
    clean, fuzzy = prose(1, 99)[0], prose(1, 99)[0] + " you idi0t and w0rthless thing"
    x = toxicity.hit_features(pa.array([clean, fuzzy, 'he said "you idiot" to them', None]), model.automaton)
    quoted = len(toxicity.KINDS)
    assert x[0].sum() == 0 and x[1, 2:quoted].sum() > 0 and x[2, quoted] > 0 and x[3].sum() == 0
    a = sorted((str(r.doc_id), r.score) for r in toxicity.toxicity_scores(odd, labels).collect())
    assert a == sorted((str(r.doc_id), r.score) for r in toxicity.toxicity_scores(clash, labels).collect()) and len(a) == 10
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(odd, labels.limit(0)).collect()} == {0.5}


# 8


def brute_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def copies(prose, seed):
    rng = random.Random(seed)
    texts = prose(40, seed)
    passage = " ".join(prose(1, seed + 1, 40, 40))
    for i in range(20):
        texts[i] += " " + passage
    for base in (0, 0, 1, 5, 25):
        for n in range(12):
            w = texts[base].split()
            for _ in range(n % 4):
                w[rng.randrange(len(w))] = f"w{rng.randrange(999)}"
            texts.append(" ".join(w[: len(w) - n // 4]))
    texts += [texts[3], texts[3].upper(), "a b c", "A b  c", "a b", "", None, "  "]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,tile,hot", [(1, 1024, 6), (2, 3, 2)])
def test_near_duplicates(spark, prose, monkeypatch, seed, tile, hot):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "HOT_IN_RUN", hot)
    texts = copies(prose, seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame(spark, texts).repartition(3)).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_odd(spark, odd, clash, empty):
    a = sorted(map(str, jaccard_join.near_duplicates(odd).collect()))
    assert a == sorted(map(str, jaccard_join.near_duplicates(clash).collect())) and len(a) == 10
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(odd).collect()}
    assert got[1] == 1 and got[8] == 7 and got[None] is None
    assert jaccard_join.near_duplicates(empty).count() == 0
    kept = jaccard_join.distinct_documents(clash)
    assert kept.columns == clash.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]


def test_null_and_repeated_ids(spark, prose):
    a, b, c, d, e, g = prose(6, 71, 60, 80)
    near = lambda t: " ".join("other" if k == 20 else w for k, w in enumerate(t.split()))
    rows = [(1, a), (2, b), (2, b), (2, c), (3, d), (3, near(a)), (4, e), (4, near(e)), (None, g), (None, near(b)), (None, near(d)), (None, prose(1, 72)[0]), (None, ""), (None, None), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    groups = collections.Counter((r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(df).collect() if r.doc_id is None)
    assert groups == {(None, None): 4, (None, 2): 1, (None, 3): 1}
    kept = collections.Counter((r.doc_id, r.text) for r in jaccard_join.distinct_documents(df.repartition(3)).collect())
    four = [t for i, t in kept if i == 4]
    assert len(four) == 1 and four[0] in (e, near(e))
    assert kept == collections.Counter([(1, a), (2, b), (2, c), (3, d), (4, four[0]), (None, g), (None, prose(1, 72)[0]), (None, ""), (None, None), (5, "")])
    # classes without any id link to each other too
    pair = spark.createDataFrame([(None, g), (None, near(g)), (None, near(near(g)) + " end"), (7, near(g) + " end of it")], "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.near_duplicates(pair).collect()} == {7}


def test_bounds_are_bounds():
    rng = np.random.default_rng(3)
    for _ in range(200):
        u = rng.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = np.unique(rng.choice(u, rng.integers(1, 60))), np.unique(rng.choice(u, rng.integers(1, 60)))
        for bits in (64, 256, 1024):
            x, y = jaccard_join.bitmap(a, bits), jaccard_join.bitmap(b, bits)
            assert jaccard_join.upper_bounds(x, len(a), y[None, :], np.array([len(b)]))[0] >= jaccard_join.overlap(a, b) == len(np.intersect1d(a, b))


def test_components(spark):
    from halyard.llm.storage import Scratch

    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    up = {v: v for e in edges for v in e}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.v: r.c for r in jaccard_join.connected(df, Scratch(spark, "test")).collect()}
    loops = {v for v in up if all(v not in e or e[0] == e[1] for e in edges)}
    assert got == {v: root(v) for v in up if v not in loops}


# 9


def test_components_write_few_files(spark):
    from halyard.llm.storage import Scratch

    class Counted(Scratch):
        files = []

        def keep(self, df, *rows):
            out = super().keep(df, *rows)
            self.files.append(len(out.inputFiles()))
            return out

    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        scratch = Counted(spark, "test")
        comp = scratch.keep(jaccard_join.connected(spark.range(200).selectExpr("id a", "id + 1 b"), scratch))
        assert {tuple(r) for r in comp.collect()} == {(i, 0) for i in range(201)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(Counted.files) > 3 and set(Counted.files[1:]) == {1}  # but for the first, whose edges aren't counted


KEEPS = """
import re, sys
import numpy as np
import pyarrow as pa
from halyard.llm import jaccard_join, storage

def resident():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) // 1024

class Hot:
    value = np.empty(0, np.uint32)

def batches(n):
    rng = np.random.default_rng(1)
    for _ in range(n):
        words = rng.integers(0, 10**6, 600_000).astype(str)
        yield pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([" ".join(words[i : i + 600]) for i in range(0, 600_000, 600)])], names=["doc_id", "text"])

f = jaccard_join._sketch(Hot)
f = storage.sparing(f) if sys.argv[1] == "sparing" else f
for _ in f(batches(1)):
    pass
storage.give_back()
before = resident()
for _ in f(batches(6)):
    pass
print(resident() - before)
"""


def test_idle_workers_give_memory_back():
    import os
    import subprocess
    import sys
    from pathlib import Path

    if not os.path.exists("/proc/self/smaps_rollup") or "glibc" not in os.confstr("CS_GNU_LIBC_VERSION"):
        pytest.skip("needs Linux and glibc")
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[2]), "OMP_NUM_THREADS": "1"}
    kept = {how: int(subprocess.run([sys.executable, "-c", KEEPS, how], env=env, capture_output=True, text=True, check=True, timeout=120).stdout) for how in ("plain", "sparing")}
    assert kept["sparing"] < 12 and kept["sparing"] < kept["plain"] / 2, kept


def test_operators_of_the_pipeline_give_memory_back(spark, prose, labels, monkeypatch):
    import corpus_pipeline

    frame, handed = type(spark.range(0)), []
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: handed.append(f.__qualname__) or real(self, f, *a, **b))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(prose(40, 3) + prose(5, 3))], "doc_id long, text string, lang string, source string, n_chars long")
    near = jaccard_join.distinct_documents(quality_cascade.quality_filtered(docs))
    decontaminate.decontaminated(nbsvm.accepted(near, nbsvm.train(docs, labels), 0.0), spark.createDataFrame([(1, prose(1, 9)[0])], "item_id long, text string")).count()
    assert corpus_pipeline.STAGES and len(handed) >= 8 and set(handed) == {"sparing.<locals>.run"}, handed


def test_descent_solves_the_dual(prose):
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    y = np.array([1 if 3 in r or 7 in r else -1 for r in rows])
    scale = rng.normal(size=30)
    cost = np.full(60, 0.7)
    w, b = nbsvm.descend(rows, y, scale, cost, 2000, 0)
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt(len(r))
    x[:, 30] = 1
    v = np.append(w, b)
    primal = v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    for _ in range(300):  # no step away from it is better
        u = v + rng.normal(size=31) * 10 ** -rng.uniform(0, 3)
        assert u @ u / 2 + (cost * np.maximum(0, 1 - y * (x @ u))).sum() >= primal - 1e-3


def test_quality_classifier(spark, prose, odd, clash, empty, labels):
    texts, y = prose(300, 41), []
    for i in range(300):
        y.append(int(i % 5 > 0))
        if not y[-1]:
            texts[i] = " | ".join(texts[i].split()) if i % 2 else " ".join(f"{w}***" for w in texts[i].split())
    lab = spark.createDataFrame([(i, q, 0) for i, q in enumerate(y)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in nbsvm.quality_scores(frame(spark, texts), lab).collect()}
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].predicted == y[i] for i in held) / len(held) > 0.95 and all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    again = {r.doc_id: r.score for r in nbsvm.quality_scores(frame(spark, texts).repartition(5), lab).collect()}
    assert again == {i: r.score for i, r in got.items()}
    a = sorted((str(r.doc_id), r.score) for r in nbsvm.quality_scores(odd, labels).collect())
    assert a == sorted((str(r.doc_id), r.score) for r in nbsvm.quality_scores(clash, labels).collect()) and len(a) == 10
    assert nbsvm.quality_scores(empty, labels).count() == 0 and {r.score for r in nbsvm.quality_scores(odd, labels.limit(0)).collect()} == {0.5}


# 10


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        open_ -= set(over)
    return out


def test_mix(spark, prose, clash, empty):
    texts = prose(200, 51, 1, 300) + [None, ""]
    sources = ["b", "a", None, "é", "a", "c", "b"]
    df = frame(spark, texts, sources)
    rows = mixing.mixed_documents(df, block=64).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = brute_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    assert len(rows) == len(texts) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in mixing.mixed_documents(df.repartition(5), block=64).collect()}
    assert mixing.mixed_documents(clash).count() == 10 and mixing.mixed_documents(empty).count() == 0


def test_schedule_is_even(spark):
    t = spark.createDataFrame([("a", 10_000, 10_000.0), ("b", 5_000, 4_000.0), (None, 100, 60.0)], "source string, source_size long, target double")
    rows = mixing.schedule(t, 10).orderBy("slot", "source").collect()
    per = collections.Counter(r.source for r in rows)
    assert per == {"a": 1000, "b": 400, None: 6} and sorted(r.k for r in rows if r.source == "b") == list(range(400))
    for cut in (100, 500, 1000):  # each part of the schedule has about the shares of the whole
        part = collections.Counter(r.source for r in rows if r.slot < cut)
        assert abs(part["a"] - cut * 1000 / 1406) < 8 and abs(part["b"] - cut * 400 / 1406) < 8
    by_slot = [r.k for r in rows if r.source == "a"]
    assert by_slot == sorted(by_slot)
