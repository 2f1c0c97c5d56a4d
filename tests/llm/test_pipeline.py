"""The stages of the pipeline against plain versions, each on what its predecessor kept."""

import random
from collections import Counter, defaultdict

import brute
import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from test_ops import DOCS, odd_rows

from foyer.llm import common, queries, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("table", ["given", "odd"])
def test_stages(spark, table):
    docs, kept = queries.documents(spark, SF) if table == "given" else spark.createDataFrame(odd_rows(), DOCS), {}
    given = {r.doc_id: r.text for r in docs.collect()}
    docs = docs.withColumn("_key", F.lit("own")).withColumn("kept", F.lit(7))
    for name, stage in cp.STAGES:
        before = docs.columns
        docs = common.store(stage(spark, docs, SF), "test")
        kept[name] = docs
        assert name == cp.STAGES[-1][0] or docs.columns == before
    rows = {n: {r.doc_id: r.text for r in kept[n].collect()} for n in ("quality rules", "simhash near-dedup", "suffix-array dedup")}
    good, near, cut = rows.values()
    assert good == {d: t for d, t in given.items() if not brute.cascade(t)}
    alike = brute.similarities(good)
    gone = set(good) - set(near)
    assert all(good[d] == t for d, t in near.items())
    assert not [p for p, v in alike.items() if v == 1 and not gone & set(p)]  # copies never both stay
    close = [p for p, v in alike.items() if v >= 0.8]
    assert sum(bool(gone & set(p)) for p in close) >= 0.9 * len(close) and close
    assert gone <= {d for p, v in alike.items() if v >= 0.65 for d in p}  # what nothing is like stays
    assert cut == {d: k.decode("utf-8", "ignore") for d, (_, _, _, k) in brute.byte_repeats(near).items()}

    mixed = kept["source mixture"].collect()
    source = {r.doc_id: r.source for r in kept["suffix-array dedup"].collect()}
    size = {d: len(brute.words(t)) for d, t in cut.items()}
    sizes = Counter()
    for d, n in size.items():
        sizes[source[d]] += n
    taken, times = Counter(), defaultdict(list)
    for r in mixed:
        times[r.doc_id].append(r.text)
        taken[r.source] += len(brute.words(r.text))
        assert r.source == source[r.doc_id] and r.n_chars == len(r.text)
    targets = brute.targets(dict(sizes))
    assert {s: taken[s] for s in sizes} == {s: int(targets[s]) for s in sizes}
    for d, texts in times.items():
        cuts = [t for t in texts if t != cut[d]]
        assert len(cuts) <= 1 and all(cut[d].startswith(t) and brute.words(cut[d])[: len(brute.words(t))] == brute.words(t) for t in cuts)
        assert len(brute.words(" ".join(texts))) <= 2 * size[d]

    packed = kept["best-fit packing"].collect()
    ids = brute.token_ids(queries.tokenizer_path("byte_bpe_50k.json"), [r.text for r in mixed])
    want = sorted((r.doc_id, *p) for r, i in zip(mixed, ids) for p in brute.pieces(i))
    assert sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in packed) == want
    bins = defaultdict(list)
    for x in packed:
        bins[x.sequence_id].append((x.offset, x.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048


def near_copies(r, n_bases=40):
    """Documents and copies of them with single words replaced at random places; and others that share a third of a base."""
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(2000)]
    texts, n = {}, 0
    for _ in range(n_bases):
        base = [r.choice(vocabulary) for _ in range(r.randint(150, 500))]
        for edits in (0, 0, 1, 2, len(base) // 100, len(base) // 55):
            own = list(base)
            for k in r.sample(range(len(own)), edits):
                own[k] = r.choice(vocabulary)
            texts[n] = " ".join(own)
            n += 1
        texts[n] = " ".join(base[: len(base) // 3] + [r.choice(vocabulary) for _ in range(2 * len(base) // 3)])
        n += 1
    return texts


def test_recall_and_false_links_of_near_copies(spark):
    texts = near_copies(random.Random(8))
    found = {x.doc_id: x.component_id for x in simhash.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert set(found) == set(texts) and all(found[g] == g <= d for d, g in found.items())
    alike = brute.similarities(texts)
    close = [p for p, v in alike.items() if v >= 0.8]
    joined = sum(found[a] == found[b] for a, b in close)
    assert len(close) > 300 and joined >= 0.95 * len(close)
    assert not [p for p, v in alike.items() if v < 0.65 and found[p[0]] == found[p[1]] and not any({p[0], p[1]} & set(q) for q in close)]
    groups = len(set(found.values()))
    assert 80 <= groups <= 100  # 40 bases and 40 others, and few copies at the bound that stay alone


def test_segments_grow_with_the_documents():
    for n in (10, 10**5, 10**9):
        bits, tables = simhash.tables_for(n)
        d = simhash.differing(simhash.NEAR)
        assert 1 - (1 - (1 - d) ** bits - bits * d * (1 - d) ** (bits - 1)) ** tables >= simhash.FOUND and 2**bits >= min(16 * n, 2**16)


def test_a_large_group_of_near_copies(spark):
    """A group of many near copies is one component, and no step holds all its pairs."""
    r = random.Random(9)
    base = [f"w{r.randint(0, 900)}" for _ in range(300)]
    rows = []
    for k in range(1500):
        own = list(base)
        own[r.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(own)))
    found = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.component_id for x in found.collect()} == {0}


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in cp.STAGES:
        docs = common.store(stage(spark, docs, SF), "test")
        assert docs.count() == 0
