"""The corpus operators against plain restatements on small tables with awkward rows."""

import math
import random
import re
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tracewell.llm import _stage, components, jaccard_join, language_id, line_dedup, lm_scoring, nearest, packing, pieces, quality, secrets, substring_dedup
from tracewell.llm.queries import PIECES, tokenizer_path

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=1):
    """Copies, near copies, shared passages and lines, empty, null, blank, short and long texts."""
    rng = random.Random(seed)
    draw = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage, line = " ".join(draw(40)), "a common line\nand the one after it\nthen a third one\nand one more"
    out = [None, "", " \n\t ", "one", "one", "two words", "TWO Words", "naïve é ß ㍿ 日本語 😀", line, "x " * 3000]
    for n in (6, 8, 12, 20, 30, 60, 120, 250, 500):
        base = draw(n)
        for changes in (0, 0, 1, 1, 2, n // 20, n // 8, n // 4):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(n)] = f"c{rng.randrange(9999)}"
            out.append(" ".join(copy))
    out += [" ".join(draw(30)) + " " + passage + " " + " ".join(draw(30)) for _ in range(5)]
    out += ["\n".join([*(" ".join(draw(4)) for _ in range(5)), line, *(" ".join(draw(4)) for _ in range(5))]) for _ in range(6)]
    out += ["the very same text of a large group of copies, word by word the same"] * 60
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3 + 1, t, ["aa", None][k % 2], "s", len(t) if t else None) for k, t in enumerate(texts())]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def pairs(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.collect())


def test_jaccard_join(docs, pairs):
    found = jaccard_join.link(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.components(pairs) and len(found) == len(pairs)


def test_jaccard_join_scans_open_lists(spark):
    # texts of one template: lists stay open after their first round
    rng = random.Random(3)
    base = [f"t{k}" for k in range(80)]
    rows = []
    for k in range(120):
        copy = list(base)
        for at in rng.sample(range(80), rng.choice((1, 2, 3, 6))):
            copy[at] = f"r{rng.randrange(50)}"
        rows.append((k, " ".join(copy)))
    found = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.components(rows)


def test_jaccard_join_counts_links_within_components(spark, monkeypatch):
    # near copies of one text: all are one component, yet not each pair links; several blocks
    monkeypatch.setattr(jaccard_join, "COUNT_BLOCK", 16)
    rng, rows = random.Random(4), []
    for k in range(90):
        copy = [f"t{j}" for j in range(80)]
        for at in rng.sample(range(80), k % 3):
            copy[at] = f"r{rng.randrange(50)}"
        rows.append((k, " ".join(copy)))
    rows += [(90, None), (91, "one two"), (92, "One two"), (93, "far from all of the others here")]
    shingles = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows}
    links = {i: sum(i != j and bool(a & b) and 100 * len(a & b) >= 75 * len(a | b) for j, b in shingles.items()) for i, a in shingles.items()}
    assert max(links.values()) > 60 and min(links[k] for k in range(90)) < 80 and links[91] == 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in jaccard_join.count_links(df).collect()}
    assert {i: r["n_links"] for i, r in found.items()} == links
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == brute.components(rows)
    ids = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "x y"), (3, None)], "doc_id long, text string")
    assert sorted((r["n_shingles"], r["doc_id"] or 0, r["n_links"]) for r in jaccard_join.count_links(ids).collect()) == [(0, 3, 0), (1, 0, 0), (2, 0, 2), (2, 2, 1), (2, 2, 1)]


def test_substring_dedup(docs, pairs):
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs.withColumn("n_words", F.lit("clash"))).collect()}
    assert found == dict(zip([i for i, _ in pairs], brute.repeats_removed([t for _, t in pairs])))


def test_fingerprint_index_knows_old_windows(spark):
    make = lambda words: substring_dedup._keyed(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), "text", "doc_id")
    first, second = [f"a{k}" for k in range(50)], [f"b{k}" for k in range(50)]
    index = substring_dedup.FingerprintIndex(spark)
    index.add(make(first))
    index.add(make(first + second))
    assert index._read(index.runs[1]).where("again").count() > 0 and index._read(index.runs[1]).where("not again").count() > 0
    index.compact()
    assert len(index.runs) == 1 and index.repeated().count() > 0


def test_line_dedup(docs, pairs):
    out = line_dedup.remove_repeated_chunks(docs.withColumn("n_lines", F.lit("clash")))
    assert {r["doc_id"]: (r["n_lines"], r["n_lines_removed"], r["text"]) for r in out.collect()} == brute.chunks_removed(pairs)
    assert set(out.columns) == {*docs.columns, "n_lines", "n_lines_removed"}


def test_line_dedup_of_runs_and_long_texts(spark):
    rng = random.Random(8)
    line = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(6))
    shared = [line() for _ in range(70)]
    rows = [(k, "\n".join([line() for _ in range(k)] + ["the same line"] * (10 + k % 3) + [line() for _ in range(3)] + shared)) for k in range(6)]
    rows += [(90, "\n" * 40), (91, "x"), (92, "\n".join(["a b"] * 65)), (93, "one\none"), (94, "one\none")]
    found = {r["doc_id"]: (r["n_lines"], r["n_lines_removed"], r["text"]) for r in line_dedup.remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute.chunks_removed(rows)
    # of a run of ten lines or more three at most are beside other lines, and half of a passage stays in step
    assert all(found[k][2].count("the same line") <= 3 and found[k][1] >= 7 + 35 for k in range(1, 6))


def test_line_dedup_stays_native(docs):
    plan = line_dedup.remove_repeated_chunks(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 12)) * rng.uniform(0.5, 3, size=(1500, 1)) + rng.normal(size=(20, 12))[rng.integers(20, size=1500)] * 2
    x = x.astype(np.float32)
    x[7] = x[8]  # a tie
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [None] * 12), (2080, [1.0])]
    found = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    exact, y = {}, x.astype(float)
    for q in range(0, 1500, 20):
        s = y @ y[q]
        s[q] = -np.inf
        exact[q] = np.lexsort((np.arange(1500), -s))[:20].tolist()
    mine = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        assert abs(r["score"] - float(y[r["query_id"]] @ y[r["vec_id"]])) < 1e-9
        mine.setdefault(r["query_id"], []).append(r["vec_id"])
    assert mine.keys() == exact.keys() and all(len(v) == 20 for v in mine.values())
    assert sum(len(set(mine[q]) & set(exact[q])) for q in exact) >= 0.9 * 20 * len(exact)


def test_nearest_of_small_and_awkward_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score int")
    search = lambda rows: nearest.search(make([(*r, "clash", 1) for r in rows]), F.col("vec_id") % 20 == 0).collect()
    assert search([]) == [] and search([(0, None), (20, [0.0, 0.0])]) == []
    few = sorted(search([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0]), (None, [9.0, 9.0])]), key=lambda r: r["rank"])
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few] == [(0, 1, 2, 5.0), (0, 2, 3, 5.0), (0, 3, 1, 4.0)]
    # a repeated query counts once, its own rows are no candidates, repeated candidates stand for themselves
    again = search([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (5, [3.0, 0.0]), (5, [3.0, 0.0])])
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in again) == [(1, 5, 3.0), (2, 5, 3.0)]


def test_nearest_scores_visited_leaves_only():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(40, size=8000)] + rng.normal(size=(8000, 16))
    tree = nearest.grow(x[:4000], 32)
    leaf = tree.assign(x)
    shares, found = [], []
    for q in range(0, 400, 10):
        near = np.argsort(-(x @ x[q]))[:21]
        mine = np.isin(leaf, tree.order(x[q], 6))
        shares.append(mine.mean())
        found.append(mine[near].mean())
    assert np.mean(shares) < 0.3 and np.mean(found) >= 0.9


def test_lm_scoring(docs, pairs):
    train = F.col("doc_id") % 4 != 0
    found = {r["doc_id"]: r for r in lm_scoring.score(docs, train, tokenizer_path(PIECES)).collect()}
    split = {i: brute.words(brute.lower(t)) for i, t in pairs}
    learned = [i for i in split if i % 4]
    counts = Counter(w for i in learned for w in split[i])
    total, different = sum(counts.values()) + len(learned), len(counts) + 1
    # the pieces' probabilities, then a plain recursion over each word
    p = lm_scoring.Pieces(tokenizer_path(PIECES))
    seen = np.zeros(len(p.bytes))
    for w, n in counts.items():
        for i in p.library.encode(w):
            seen[i] += n
    share = np.array([0.0 if b is None else v for b, v in zip(p.bytes, p.prior + seen)])
    whole = share.sum() + len(learned) + 1
    chance = {}
    for b, v in zip(p.bytes, share):
        if b and v and b.rfind(b" ") <= 0:
            chance[b] = chance.get(b, 0.0) + v / whole
    known = {}

    def marginal(word):
        if word not in known:
            raw = b" " + word.encode()
            forward = [1.0] + [0.0] * len(raw)
            for end in range(1, len(raw) + 1):
                forward[end] = sum(forward[k] * chance.get(raw[k:end], 0.0) for k in range(max(0, end - 48), end))
            known[word] = math.log10(forward[-1])
        return known[word]

    for i, w in split.items():
        base = sum(math.log10((n + 1) / (total + different + 1)) for n in (*(counts[x] for x in w), len(learned)))
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i % 4 == 0, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total)
        assert abs(r["score"] - (sum(map(marginal, w)) + math.log10((len(learned) + 1) / whole))) < 1e-6 * max(1, len(w))
        assert r["base_score"] == pytest.approx(base, abs=1e-6 * max(1, len(w)))


def test_quality_measures(spark, docs, pairs):
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i, _ in pairs], "doc_id long, quality int")
    for model in (None, quality.fit(docs, labels)):
        for r in quality.score(docs.withColumn("kept", F.lit("clash")), model).collect():
            text = r["text"] or ""
            w, lines = brute.words(text), text.split("\n")
            again = sum(bool(brute.words(x)) and x in lines[:k] for k, x in enumerate(lines))
            windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
            repeated = len({k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)})
            assert [r[f] for f in quality.FIELDS] == [len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), again, repeated]
            failed = len(w) < 50 or 100 * repeated > 50 * len(w)
            assert r["base_failed"] == failed and r["kept"] == (not failed and (model is None or r["quality_score"] >= quality.KEEP_FROM))


def test_language_id(spark, docs):
    rows = spark.read.parquet(str(DATA / "documents.parquet"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.fit(rows.where(~held))
    found = language_id.predict(rows.where(held).where("lang is not null and n_chars > 100"), model)
    assert found.where("lang_pred = lang").count() >= 0.95 * found.count()
    odd = {r["text"]: (r["lang_pred"], r["lang_score"]) for r in language_id.predict(docs, model).collect()}
    assert odd[None] == odd[""] == odd[" \n\t "] == ("und", 0.0)
    assert all(x == "und" for x in [r["lang_pred"] for r in language_id.predict(docs, language_id.fit(rows.where("false"))).collect()])


def test_language_id_equals_plain_bayes(spark):
    learned = [("aa", "ab ab ba é"), ("bb", "cd dc cd"), ("cc", "xyz zyx"), ("aa", "ab ba"), ("bb", "cd cd"), ("cc", "xyz xyz é"), ("aa", "abcd"), ("aa", ""), ("bb", "q")]
    df = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate([*learned, ("aa", None), (None, "zz")])], "doc_id long, text string, lang string")
    asked = ["ab", "cd xyz", "XYZ abcd zyx", "ab cd", "éé zyx", "q"]
    found = {r["text"]: r for r in language_id.predict(spark.createDataFrame([(t,) for t in asked], "text string"), language_id.fit(df)).collect()}

    def grams(text):
        points = np.array([ord(c) for c in brute.lower(text)], np.uint32)
        return [int(x) for bucket, n in language_id.ngrams(points, np.array([0, len(points)])) for x in bucket[: n[0]]]

    counts, size = {lang: Counter() for lang in ("aa", "bb", "cc")}, Counter(lang for lang, _ in learned)
    for lang, text in learned:
        counts[lang].update(grams(text))
    for text in asked:
        logs, seen = {}, grams(text)
        for lang, c in counts.items():
            logs[lang] = sum(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * language_id.BUCKETS)) for g in seen)
        prior = {lang: math.log(n / len(learned)) for lang, n in size.items()}
        best = max(logs, key=lambda lang: logs[lang] + prior[lang])
        cut = {lang: math.exp(x * min(1, language_id.EVIDENCE / len(seen)) + prior[lang]) for lang, x in logs.items()}
        assert found[text]["lang_pred"] == best and found[text]["lang_score"] == pytest.approx(cut[best] / sum(cut.values()), rel=1e-4)


def test_language_id_lets_all_evidence_choose():
    # each n-gram speaks a little for the rare language, and the text is long
    weights = np.repeat(np.array([[-9.1, -9.0]], np.float32), language_id.BUCKETS, 0)
    model = language_id.LanguageModel(["common", "rare"], weights, np.array([0.0, -20.0]))
    data = np.frombuffer(b"ab " * 400, np.uint8)
    names, scores = model.predict(data, np.array([0, 30, len(data)]))
    assert names == ["common", "rare"] and scores[0] > 0.9 and scores[1] < 0.1


def test_pieces(spark, docs, pairs):
    path = tokenizer_path(PIECES)
    vocabulary = pieces.Vocabulary(path)
    for r in pieces.decode(pieces.encode(docs, path), path).collect():
        assert r["decoded"] == (r["text"] or "")
    split = re.compile(r" [^ \n]*|\n|[^ \n]+")
    for r in pieces.encode(docs.withColumn("piece_ids", F.lit("clash")), path, decoded="back").collect():
        plain = [i for u in (split.findall(" " + r["text"]) if r["text"] else []) for i in vocabulary.encode_sorted([u])[0]]
        assert r["piece_ids"] == plain and r["back"] == (r["text"] or "")
    # no segmentation of a word has a larger sum of scores
    real = {u for r in spark.read.parquet(str(DATA / "documents.parquet")).collect() for u in split.findall(" " + (r["text"] or ""))}
    for word in (*sorted(real, key=len)[:-5], " naïve", " w123", " wordings", "\n", " 日本😀"):
        best = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            for begin in range(end):
                s = vocabulary.pieces.get(word[begin:end], (vocabulary.unknown if end - begin == 1 else -math.inf, 0))[0]
                best[end] = max(best[end], best[begin] + s)
        ids, score = vocabulary.encode_sorted([word])[0], 0.0
        of = {i: s for s, i in vocabulary.pieces.values()}
        unknown = [c for c in word if c not in vocabulary.pieces]
        score = sum(of[i] for i in ids if i in of) + vocabulary.unknown * len(unknown)
        assert score == pytest.approx(best[-1], rel=1e-9)


def test_packing(docs, pairs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    library.encode_special_tokens = True
    rows = [r.asDict() for r in packing.pack(docs, tokenizer_path()).collect()]
    of = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        assert r["start"] == len(of.get(r["doc_id"], b"")) // 4
        of[r["doc_id"]] = of.get(r["doc_id"], b"") + bytes(r["ids"])
    for i, t in pairs:
        assert np.frombuffer(of[i], np.uint32).tolist() == library.encode(t or "", add_special_tokens=False).ids + [1]
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= packing.SEQUENCE


def _mirrored():
    """Two words that polynomial hashes modulo powers of two cannot tell apart."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_of_one_structure_are_told_apart(spark):
    x, y = _mirrored()
    make = lambda rows: spark.createDataFrame(list(enumerate(rows, 1)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.link(make([x, y])).collect()} == {1: 1, 2: 2}
    tail = " ".join(f"w{k}" for k in range(34))
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(make([f"{x} {tail}", f"{y} {tail}"])).collect()] == [0, 0]
    text = f"p {x} q p {y} q"
    assert [r["n_repeat_words"] for r in quality.score(make([text]), None).collect()] == [0]
    alone, beside = (lm_scoring.score(make(rows), F.lit(False), tokenizer_path(PIECES)).where("doc_id = 1").first()["score"] for rows in ([x], [x, y]))
    assert alone == pytest.approx(beside)


def test_long_words_take_linear_time(spark):
    word = "".join(random.Random(9).choices("abcdefgh", k=1 << 20))
    begin = time.perf_counter()
    row = lm_scoring.score(spark.createDataFrame([(1, word), (2, "abc")], "doc_id long, text string"), F.lit(True), tokenizer_path(PIECES)).where("doc_id = 1").first()
    assert row["n_tokens"] == 2 and row["score"] < -1e5 and time.perf_counter() - begin < 60


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(400)], "a long, b long")
    stage = _stage.Stage(spark, "test")
    found = components.components(edges, stage, "path")
    assert found.count() == 401 and found.select("root").distinct().count() == 1
    assert max(int(n.removeprefix("path-labels")) for n in stage.names() if "labels" in n) < 16


def test_index_opened_again_knows_old_windows(spark):
    make = lambda rows: substring_dedup._keyed(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "text", "doc_id")
    draw = lambda c, n=60: " ".join(f"{c}{k}" for k in range(n))
    old, new = [draw("a"), draw("b")], [draw("b") + " " + draw("c"), draw("d"), draw("d")]
    first = substring_dedup.FingerprintIndex(spark, buckets=3)
    first.add(make(old))
    first.close(keep=True)
    again = substring_dedup.FingerprintIndex(spark, path=first.stage.root)
    again.add(make(new))
    whole = substring_dedup.FingerprintIndex(spark)
    whole.add(make(old + new))
    marks = lambda index: {r["anchor"] for r in index.repeated().collect()}
    assert marks(again) == marks(whole) != set()
    again.compact()
    assert len(again.runs) == 1 and marks(again) == marks(whole)


def _credentials(rng, n):
    return [f"api_key = {''.join(rng.choice('abcdef0123456789') for _ in range(32))}" for _ in range(n)]


def test_secret_scan(spark):
    rng = random.Random(6)
    rows = [f"é text {c} end" for c in _credentials(rng, 60)] + ["key AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16)) for _ in range(60)]
    rows += [None, "", "password:short", "PassWord: 'longer.one'", "ſecret=abcdefgh", "plain words only, 12345 of them", "x" * 5000, "aaaa" * 10, "internationalization-of-everything"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("secrets", F.lit("clash"))
    model = secrets.fit(df)
    found = {r["doc_id"]: r["secrets"] for r in secrets.scan(df, model).collect()}
    for i, text in enumerate(rows):
        base = [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in found[i] if s["kind"] != "format"]
        assert base == brute.base_spans(text)
    assert not found[len(rows) - 4] and not found[len(rows) - 1]
    hidden = {r["doc_id"]: r["text"] for r in secrets.mask(df, model).collect()}
    assert all((hidden[i] == t) == (not found[i]) for i, t in enumerate(rows))
    assert model.automata and not model.accepts(b"internationalization-of-everything")


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "a b c d e f"), (None, "a b c d e f"), (1, None), (2, "a b c d e f"), (2, "a b c d e f")]])
def test_empty_tables_and_null_ids(spark, rows):
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    results = [
        jaccard_join.link(df), substring_dedup.remove_repeats(df), line_dedup.remove_repeated_chunks(df), lm_scoring.score(df, F.lit(True), tokenizer_path(PIECES)),
        quality.score(df, quality.fit(df, labels)), language_id.predict(df, language_id.fit(df)), pieces.encode(df, tokenizer_path(PIECES)), packing.pack(df, tokenizer_path()), secrets.scan(df, secrets.fit(df)),
    ]
    assert [r.count() for r in results] == [len(rows)] * 9
    if rows:
        same = {(r["doc_id"], r["component_id"]) for r in jaccard_join.link(df).where("n_shingles > 0").collect()}
        assert same == {(None, 2), (2, 2)}

