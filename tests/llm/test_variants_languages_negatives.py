"""Spelling variants, language ID and hard negatives against plain versions, held-out labels and odd rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import duck_rows, spark_rows
from pyspark.sql import functions as F
from test_ops import DOCS, SF, odd_rows, table  # noqa: F401

from foyer.llm import langid, negatives, queries, spelling


def counted(rows, shortest=7, one_in=31):
    """Words and their counts, character by character."""
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                k = h % len(run)
                word = run[:k] + run[k + 1 :] if one_in and h % one_in == 0 else run
                counts[word] += len(word) >= shortest
            run = ""
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or len(a) == len(b) and a[k + 1 :] == b[k + 1 :]


def variants(counts, times=10):
    near = defaultdict(list)
    gone = defaultdict(set)  # two words one edit apart share one of their forms with a character deleted, or one is such a form
    for w in counts:
        for v in {w[:k] + w[k + 1 :] for k in range(len(w))} | {w}:
            gone[v].add(w)
    for w in counts:
        for v in set().union(*(gone[w[:k] + w[k + 1 :]] for k in range(len(w))), gone[w]):
            if one_edit(w, v):
                near[w].append(v)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None))
    return out


def test_op11(spark, table):  # noqa: F811
    folder, rows = table
    found = queries.op11_spelling_variants(spark, folder).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = variants(counted([r[:2] for r in rows]))
    assert len(found) == len(want) and {tuple(x) for x in found} == want and any(x.form for x in found)


LONG = "abcdefghij" * 5
SPELT = [LONG, LONG[:-1], LONG[1:], LONG + "x", LONG[:20] + "Z" + LONG[20:], LONG[:32], LONG[:33], LONG[:31] + "q", "y" * 32, "y" * 33, "y" * 34, "x" + "y" * 32, "éàüöñçß", "éàüöñç×ß", "èàüöñçß", "éàüöñçs", "STRASSE", "straßexx", "aaaaaaa", "aaaaaaaa", "aaaaaab", "baaaaaa", "abaaaaa", "aaaabaaa"]


@pytest.mark.parametrize("shard_words", [5, 1000])
def test_variants_of_odd_words_over_several_shards(spark, shard_words):
    r = np.random.default_rng(5)
    texts = [w for k, w in enumerate(SPELT) for _ in range(2 + k * k)]
    texts += ["".join(r.choice(list("abé"), r.integers(7, 10))) for _ in range(1500)]
    rows = [(int(k), " ".join(texts[k::40])) for k in range(40)] + [(None, "aaaaaaa;AAAAAAA"), (3, None), (3, ""), (3, "aaaaaab\x00aaaaaab"), (3, "aaaaaab\x00aaaaaab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("own")).withColumn("n", F.lit(1))
    for one_in, times in ((0, 2), (31, 10)):
        found = spelling.group_variants(docs, one_in=one_in, times=times, shard_words=shard_words).collect()
        want = variants(counted(rows, one_in=one_in), times)
        assert len(found) == len(want) and {tuple(x) for x in found} == want


def test_op12(spark, table):  # noqa: F811
    folder, rows = table
    found = queries.op12_language_id(spark, folder).collect()
    lang = {r[0]: r[2] for r in rows}
    text = {r[0]: r[1] for r in rows}
    assert sorted(x.doc_id for x in found) == sorted(lang)
    for x in found:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1
        letters = any(c.isalpha() for c in text[x.doc_id] or "")
        assert (x.lang_pred == "und") == (not letters) and (letters or x.score == 0)
    by_text = defaultdict(set)
    for x in found:
        by_text[text[x.doc_id]].add((x.lang_pred, x.score))
    assert all(len(s) == 1 for s in by_text.values())
    if folder == SF:
        held = [x for x in found if x.held_out and len((text[x.doc_id] or "").split()) >= 20]
        assert len(held) > 20 and sum(x.lang_pred == lang[x.doc_id] for x in held) >= 0.97 * len(held)


def test_language_model_against_counts_of_plain_n_grams(spark):
    """The same predictions as a model that counts n-grams in dictionaries, and equal sums however texts are batched."""
    rows = [tuple(r) for r in queries.documents(spark, SF).select("doc_id", "text", "lang").collect()]

    def plain(text):
        kept = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
        kept = " " + " ".join(kept.split()) + (" " if kept.split() else "")
        return Counter(kept[i : i + n] for n in langid.GRAMS for i in range(len(kept) - n + 1) if kept[i : i + n] != " ")

    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 and r[1] is not None and r[2] is not None]
    model = langid.fit(spark.createDataFrame(learnt, "doc_id long, text string, lang string"), sample=10**6)
    counts = defaultdict(Counter)
    for _, text, lang in learnt:
        counts[lang].update(plain(text))
    for k, lang in enumerate(model.langs):  # each n-gram's bucket has at least its own count
        total = sum(counts[lang].values())
        for g, n in counts[lang].most_common(30):
            assert model.logs[k].max() >= np.log((n + 0.5) / (total + 0.5 * (1 << model.bits))) * langid.POINT - 1, (lang, g)
        sizes = sum(s.sum() for _, s in langid.grams([t for _, t, l in learnt if l == lang], model.bits))
        assert sizes == total
    texts = [r[1] or "" for r in rows]
    names, scores = model.predict(texts)
    for k in range(0, len(texts), 17):
        one, score = model.predict([texts[k]])
        assert one[0] == names[k] and score[0] == scores[k]


def test_odd_languages(spark, monkeypatch):
    none = langid.identify(spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id long, text string, lang string")).collect()
    assert {(x.doc_id, x.lang_pred, x.score) for x in none} == {(1, "und", 0.0), (2, "und", 0.0)}
    rows = [(k, "le la les des une " * 3, "fr") for k in range(30)] + [(k, "the of and that is " * 3, "en") for k in range(30, 60)]
    rows += [(None, "le la les", "en"), (None, None, None), (7, "123 -- !", "fr"), (7, "123 -- !", "fr"), (8, "", ""), (61, "日本語", "fr"), (62, "Le  LA\n\nles", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("own")).withColumn("held_out", F.lit("own")).withColumn("share", F.lit(1))
    found = langid.identify(docs).collect()
    assert Counter(x.doc_id for x in found) == Counter(r[0] for r in rows)
    assert all(x.held_out and x.lang_pred in ("fr", "und") for x in found if x.doc_id is None)
    assert {x.lang_pred for x in found if x.doc_id in (7, 8)} <= {"und", "fr"} and next(x for x in found if x.doc_id == 62).lang_pred == "fr"
    monkeypatch.setattr(langid, "STEP", 1000)
    text = "le la les des une " * 4000 + "x" * 5000
    assert "".join(p for _, p in langid.parts_of([text])) == text and max(len(p) for _, p in langid.parts_of([text])) <= 1000
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0


def hard_negatives(rows, anchors, positives=5, negatives=3):
    """rows: (vec_id, label, integers)."""
    out = Counter()
    order = lambda x: (-x[1], x[0][0] is None, x[0][0] or 0)
    for k, a in enumerate(rows):
        if not anchors(a[0]):
            continue
        scored = [(b, sum(x * y for x, y in zip(a[2], b[2]))) for j, b in enumerate(rows) if j != k]
        same = sorted((x for x in scored if x[0][1] == a[1]), key=order)[:positives]
        for p, score in same:
            fit = sorted((x for x in scored if x[0][1] != a[1] and 50 * score <= 100 * x[1] <= 95 * score), key=order)[:negatives]
            out.update((a[0], p[0], k + 1, x[0][0], score, x[1]) for k, x in enumerate(fit))
    return out


def whole(vec):
    return [int(np.floor(256 * np.float64(np.float32(x)))) for x in vec]


def test_op13(spark):
    names, found = spark_rows(queries.op13_hard_negatives(spark, SF))
    want_names, want = duck_rows(SF, queries.oracle_sql()["op13_hard_negatives"])
    assert names == want_names and found == want and found


@pytest.mark.parametrize("small", [False, True])
def test_op13_odd_vectors(spark, tmp_path, monkeypatch, small):
    if small:
        for name, value in (("ROWS", 16), ("ANCHORS", 3), ("CELLS", 8)):
            monkeypatch.setattr(negatives, name, value)
    r = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    rows = [(k, int(k % 3), r.normal(size=6).round(2 if k % 2 else 1).tolist()) for k in range(150)]
    rows += [(200 + k, 1, rows[50][2]) for k in range(40)] + [(300 + k, 2, [0.9 * x for x in rows[50][2]]) for k in range(40)]  # copies
    rows += [(350, None, [1.0] * 6), (400, 1, None), (401, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (450, 1, [nan] * 6), (451, 2, [inf] + [0.0] * 5), (500, 2, []), (550, 1, [0.5, 0.5]), (None, 2, rows[50][2]), (None, 1, rows[50][2]), (100, 1, rows[50][2]), (100, 1, rows[50][2]), (600, 0, [3e4, -3e4, 0.0, 0.0, 0.0, 0.0]), (650, 0, [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    vectors.withColumn("key", F.lit("own")).withColumn("rank", F.lit(9)).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.op13_hard_negatives(spark, str(tmp_path)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    usable = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, whole(v)) for i, label, v in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert Counter(map(tuple, found)) == hard_negatives(usable, lambda i: i is not None and i % 50 == 0) and found
    vectors.limit(0).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert queries.op13_hard_negatives(spark, str(tmp_path / "none")).count() == 0
    vectors.filter("vec_id % 50 <> 0").write.parquet(str(tmp_path / "alone" / "embeddings.parquet"))
    assert queries.op13_hard_negatives(spark, str(tmp_path / "alone")).count() == 0
    vectors.filter("vec_id = 500 or vec_id = 50").write.parquet(str(tmp_path / "two" / "embeddings.parquet"))
    assert queries.op13_hard_negatives(spark, str(tmp_path / "two")).count() == 0


def test_bounds_hold_and_exclude(spark):
    r = np.random.default_rng(7)
    x = r.integers(-300, 300, (4000, 24))
    grid = negatives.Grid(x.min(axis=0), x.max(axis=0))
    for q in (r.integers(-300, 300, 24), r.integers(-300, 300, 24) << 24):
        low, high = negatives.bounds(grid.tables(q), grid.cells(x).T)
        exact = x @ q
        assert (low <= exact).all() and (exact <= high).all()
        assert (high >= negatives.largest(low, 5)).sum() < 200
