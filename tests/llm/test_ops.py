"""Every operator's query against a plain version, over the driver's table and a table of odd rows."""

import random
import shutil
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
import zlib
from pyspark.sql import functions as F

from foyer.llm import chunkstore, mixture, packing, phrases, quality, queries, recompress, sharding, simhash, suffixes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """Distinct doc_ids; null, empty, blank and long texts, copies, near copies, shared passages, odd characters."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, line = prose(120), prose(12)
    texts = [None, "", "   \t\n ", None, "", "word", "two words", "A b   c\x1cd\x0be", "<|endoftext|> <s> é\r\n\r\nÉ  ñ ", prose(60_000)]
    base = prose(300)
    texts += [base] * 12 + [base.replace(" ", "  ", 3), base.upper(), base + " end"]
    texts += [prose(80) + " " + passage + " " + prose(60) for _ in range(6)] + [passage, passage + passage, "x" * 3000, "ab" * 2500]
    texts += ["\n".join([line] * 9), "the same words again " * 40, "# * $ % & | < > " * 30, "日本語 テスト " * 90, "🙂" * 700]
    texts += [prose(r.randint(1, 200)) for _ in range(40)]
    order = r.sample(range(-5, 500), len(texts))
    sources = ["web", "web", "web", "books", "", None, "Éd"]
    return [(d, t, None if d % 5 == 0 else "fr", sources[k % 7], None if t is None else len(t)) for k, (d, t) in enumerate(zip(order, texts))]


@pytest.fixture(scope="module", params=["given", "odd"])
def table(request, spark, tmp_path_factory):
    """(folder, rows) of a documents table."""
    if request.param == "given":
        return SF, [tuple(r) for r in queries.documents(spark, SF).select("doc_id", "text", "lang", "source", "n_chars").collect()]
    folder, rows = str(tmp_path_factory.mktemp("odd")), odd_rows()
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_op1(spark, table):
    folder, rows = table
    found = queries.op1_best_fit_packing(spark, folder).collect()
    ids = brute.token_ids(queries.tokenizer_path("byte_bpe_50k.json"), [r[1] for r in rows])
    want = {(r[0], *p) for r, i in zip(rows, ids) for p in brute.pieces(i)}
    assert {(x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in found} == want and len(found) == len(want)
    bins = defaultdict(list)
    for x in found:
        bins[x.sequence_id].append((x.offset, x.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and sum(own[-1]) <= 2048
    total = sum(x.length for x in found)
    assert len(bins) <= -(-total // 2048) + max(1, len(bins) // 100)


def test_pack_keeps_pieces_that_fill_no_bin(spark):
    sizes = [1030] * 300 + [1025 + k for k in range(100)] + [2048, 700]
    pieces = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "doc_id long, length int")
    found = packing.pack(pieces, group_pieces=20).collect()
    assert sorted(x.doc_id for x in found) == list(range(len(sizes)))
    bins = defaultdict(list)
    for x in found:
        bins[x.sequence_id].append((x.offset, x.length))
    assert all(sum(n for _, n in own) <= 2048 and len({at for at, _ in own}) == len(own) for own in bins.values())


def test_packing_searches_all_underfull_bins():
    r = random.Random(5)
    sizes = [r.randint(500, 1100) for _ in range(4000)]
    bins, at, room = packing.pack_group(sizes, 2048)
    fills = defaultdict(int)
    for k, a, n in sorted(zip(bins, at, sizes)):
        assert fills[k] == a
        fills[k] += n
    assert all(fills[k] == 2048 - left for k, left in zip(bins, room))
    plain = len(packing.best_fit(sizes, 2048)[0])
    assert len(fills) <= 0.975 * plain  # 0.986 if only the 400 emptiest take part


def test_mixture_cuts_long_documents(spark):
    text = "".join(f"{'  ' if k % 7 == 0 else ' '}w{k}" for k in range(60_000)) + "\n"
    found = mixture.mixed_documents(spark.createDataFrame([(1, text, "fr", "web", len(text))], DOCS)).collect()
    half = text[: text.index(" w30000")].rstrip()
    assert sorted((x.text for x in found), key=len) == [half, text]


def test_op2(spark, table):
    folder, rows = table
    found = {x.doc_id: (x.start, x.n_tokens, x.ids_crc32) for x in queries.op2_chunk_store(spark, folder).collect()}
    rows = sorted(rows)
    at, want = 0, {}
    for r, ids in zip(rows, brute.token_ids(queries.tokenizer_path("word_bpe_49k.json"), [r[1] for r in rows])):
        want[r[0]] = at, len(ids) + 1, brute.crc([*ids, 1])
        at += len(ids) + 1
    assert found == want


def test_op3(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {x.pair_id: (x.n_common, x.prompt, x.chosen, x.rejected, x.chosen_mask, x.rejected_mask) for x in queries.op3_preference_format(spark, SF).collect()}
    assert found == brute.preference(turns) and found


ODD_TURNS = [
    (0, 1, "user", "Bonjour"), (0, 2, "assistant", "Salut"), (1, 1, "user", "Bonjour"), (1, 2, "assistant", "Oui"),  # differ in the last turn
    (2, 1, "user", "a"), (2, 2, "assistant", "b"), (3, 1, "user", "a"), (3, 2, "assistant", "b"),  # equal
    (4, 1, None, "x"), (4, 2, "assistant", None), (5, 1, "", "x"), (5, None, "user", "y"),  # nulls
    (6, 1, "user", "alone"),  # the other side is missing
    (8, 1, "user", "same"), (8, 1, "user", "same"), (9, 1, "user", "same"), (9, 3, "assistant", ""),  # repeated rows and turns
    (None, 1, "user", "no conversation"), (11, 1, "user", "alone, too"),
    (12, 1, "user", "é🙂" * 40_000), (12, 2, "assistant", "日本" * 30_000), (13, 1, "user", "é🙂" * 40_000), (13, 2, "assistant", "z"),  # long
]


def test_op3_odd_conversations(spark, tmp_path):
    turns = spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string")
    turns.withColumn("prompt", F.lit("own")).withColumn("at", F.lit(7)).write.parquet(str(tmp_path / "conversations.parquet"))
    found = {x.pair_id: (x.n_common, x.prompt, x.chosen, x.rejected, x.chosen_mask, x.rejected_mask) for x in queries.op3_preference_format(spark, str(tmp_path)).collect()}
    assert found == brute.preference(ODD_TURNS) and set(found) == {0, 1, 2, 4, 6}
    turns.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert queries.op3_preference_format(spark, str(tmp_path / "none")).count() == 0


def test_op4(spark, table):
    folder, rows = table
    found = queries.op4_feistel_shards(spark, folder).collect()
    assert {(x.doc_id, x.size, x.text_crc32) for x in found} == {(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows}
    slots = defaultdict(list)
    for x in found:
        slots[x.shard].append(x.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    counts = [len(slots[k]) for k in range(40)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    for k, d in enumerate(sorted(r[0] for r in rows)):
        assert sharding.row_place(k, len(rows)) == next((x.shard, x.slot) for x in found if x.doc_id == d)


def test_feistel_against_single_numbers():
    """The vectorized permutation against the network written for one number at a time."""
    keys = [int.from_bytes(np.random.Philox(key=4 + k).random_raw(1).tobytes(), "little") for k in range(sharding.ROUNDS)]
    for n in (1, 2, 5, 97, 1000):
        want = brute.feistel(n, 40, keys, brute.mix)
        assert [sharding.row_place(k, n) for k in range(n)] == want and len(set(want)) == n


def test_op5(spark, table):
    folder, rows = table
    found = {x.doc_id: x for x in queries.op5_rule_cascade(spark, folder).collect()}
    want = {r[0]: brute.quality(r[1]) for r in rows}
    assert {d: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for d, x in found.items()} == want
    reasons = {r[0]: brute.cascade(r[1]) for r in rows}
    assert {d: (x.kept, x.rejected_by) for d, x in found.items()} == {d: (not r, r[0] if r else None) for d, r in reasons.items()}
    assert any(x.kept for x in found.values())


def test_op6(spark, table):
    folder, rows = table
    found = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in queries.op6_recompression_dedup(spark, folder).collect()}
    want = {d: (n, gone, brute.sha(kept)) for d, (n, gone, kept) in brute.word_windows([r[:2] for r in rows]).items()}
    assert found == want and any(x[1] for x in want.values())


def test_op7(spark, table):
    folder, rows = table
    found = {x.doc_id: (x.fingerprint, x.component_id) for x in queries.op7_simhash_near_duplicates(spark, folder).collect()}
    own = {r[0]: brute.simhash(r[1]) for r in rows}
    groups = brute.near_components(own)
    assert found == {d: (f"{own[d]:016x}", groups[d]) for d in own}


def test_op8(spark, table):
    folder, rows = table
    found = {x.doc_id: x for x in queries.op8_phrase_fingerprints(spark, folder).collect()}
    rows = sorted(rows, reverse=True)
    assert len(found) == len(rows)
    short = [k for k, r in enumerate(rows) if len(r[1] or "") < 4000]
    for k in short:  # the parse written symbol by symbol
        text, other = rows[k][1] or "", rows[(k + 1) % len(rows)][1] or ""
        if len(other) < 4000:
            one, two, next_ = map(brute.fingerprint, (text, text[: len(text) - len(text) // 3] + other[: len(text) // 3], other))
            x = found[rows[k][0]]
            assert (x.fingerprint, x.edited_fingerprint) == tuple("".join(f"{v:04x}" for v in f) for f in (one, two))
            assert abs(x.near_edited - brute.alike(one, two)) < 1e-12 and abs(x.near_next - brute.alike(one, next_)) < 1e-12
    for k, r in enumerate(rows):
        text, other = r[1] or "", rows[(k + 1) % len(rows)][1] or ""
        new = phrases.edited(text, other)
        x = found[r[0]]
        assert (x.n_chars, x.edited_sha256) == (len(text), brute.sha(text[: len(text) - len(text) // 3] + other[: len(text) // 3])), r[0]
        one, two, next_ = phrases.sketches([text.encode(), new.encode(), other.encode()])
        assert (x.fingerprint, x.edited_fingerprint) == (one.tobytes().hex(), two.tobytes().hex())
        assert x.near_edited == phrases.likeness(one[None], two[None])[0] and x.near_next == phrases.likeness(one[None], next_[None])[0]
    by_text = defaultdict(set)
    for r in rows:
        by_text[r[1] or ""].add(found[r[0]].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    # prose only: a text of one repeated character has too few phrases to be like its edited form
    prose = {r[0] for r in rows if len(set(brute.words(r[1]))) > 50}
    long_ = [x for x in found.values() if x.n_chars > 2000 and x.doc_id in prose]
    assert sum(x.near_edited > x.near_next for x in long_) >= 0.95 * sum(1 for x in long_ if x.near_next < 1 and x.near_edited < 1)


def test_op9(spark, table):
    folder, rows = table
    result = queries.op9_suffix_array_dedup(spark, folder).collect()
    found = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in result}
    holders = {length: defaultdict(set) for length in (suffixes.PASSAGE, suffixes.PASSAGE_GRAM)}
    for r in rows:
        own = (r[1] or "").encode()
        for length, by in holders.items():
            for i in range(len(own) - length + 1):
                by[hash(own[i : i + length])].add(r[0])
    must, may = ({d for ids in by.values() if len(ids) > 1 for d in ids} for by in holders.values())
    assert must <= {x.doc_id for x in result if x.shares_passage} <= may
    want = {d: (n, gone, spans, brute.sha(kept)) for d, (n, gone, spans, kept) in brute.byte_repeats({r[0]: r[1] for r in rows}).items()}
    assert found == want and any(x[1] for x in want.values())


def test_op10(spark, table):
    folder, rows = table
    found = queries.op10_source_mixture(spark, folder).collect()
    size = {r[0]: len(brute.words(r[1])) for r in rows}
    source = {r[0]: r[3] for r in rows}
    sizes = Counter()
    for d, n in size.items():
        sizes[source[d]] += n
    want = brute.targets(dict(sizes))
    assert len(found) == len(rows)
    taken = Counter()
    for x in found:
        assert (x.size, x.source_size) == (size[x.doc_id], sizes[source[x.doc_id]]) and 0 <= x.taken <= 2 * x.size
        assert abs(x.target - want[source[x.doc_id]]) < 1e-6
        taken[source[x.doc_id]] += x.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = queries.op10_source_mixture(spark, folder).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)


OPERATORS = {
    "pack": lambda d: packing.pack(packing.token_pieces(d, queries.tokenizer_path("byte_bpe_50k.json"))),
    "chunks": lambda d: chunkstore.stored_digests(d, queries.tokenizer_path("word_bpe_49k.json")),
    "shard": sharding.shard,
    "cascade": quality.cascade,
    "quality_report": quality.quality_report,
    "word repeats": recompress.remove_repeats,
    "near": simhash.near_duplicates,
    "similar": lambda d: simhash.similar_groups(d.select(F.monotonically_increasing_id().alias("doc_id"), "text")),
    "phrases": phrases.compare_with_next,
    "byte repeats": suffixes.remove_repeats,
    "byte repeats and passages": lambda d: suffixes.remove_repeats(d, passages=True),
    "mix": mixture.mix,
    "mixed": mixture.mixed_documents,
}


def check_repeated(name, rows, found):
    """What each operator makes of rows that share a doc_id or have none."""
    n_words = Counter((d, len(brute.words(t))) for d, t in rows)
    if name == "chunks":
        ids = brute.token_ids(queries.tokenizer_path("word_bpe_49k.json"), [t for _, t in rows])
        assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in found) == Counter((d, len(i) + 1, brute.crc([*i, 1])) for (d, _), i in zip(rows, ids))
        assert sorted(x.start for x in found)[0] == 0 and max(x.start + x.n_tokens for x in found) == sum(len(i) + 1 for i in ids)
    elif name == "shard":
        assert Counter((x.doc_id, x.size) for x in found) == Counter((d, len((t or "").encode()) + 16) for d, t in rows)
    elif name in ("cascade", "quality_report"):
        assert Counter((x.doc_id, x.kept) for x in found) == Counter((d, not brute.cascade(t)) for d, t in rows)
    elif name == "word repeats":  # null is the smallest doc_id: its words stay, those of 1 go
        assert Counter((x.doc_id, x.n_words, x.n_removed) for x in found) == Counter((d, len(brute.words(t)), len(brute.words(t)) if d is not None else 0) for d, t in rows)
    elif name == "near":
        assert {(x.doc_id, x.component_id) for x in found} == {(d, min(e for e, u in rows if e is not None and bool(u) == bool(t))) for d, t in rows}
    elif name.startswith("byte repeats"):
        assert all(x.n_removed == x.n_bytes for x in found)
    elif name == "mix":
        assert Counter((x.doc_id, x.size) for x in found) == n_words and all(x.taken <= 2 * x.size for x in found)
    elif name == "phrases":
        assert Counter((x.doc_id, x.n_chars) for x in found) == Counter((d, len(t or "")) for d, t in rows)


NAMES = ("kept", "N_words", "_key", "_order", "_text", "_left", "_size", "at", "runs", "taken", "size", "sequence_id", "row_no", "fp", "name", "rejected_by")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_and_null_rows_and_clashing_columns(spark, name):
    text = " ".join(f"w{k % 61}" for k in range(400))
    rows = [(1, text, "fr", "web", 5)] * 3 + [(None, text, None, None, None)] * 2 + [(2, None, None, "web", None), (None, None, None, None, None), (2, "", "fr", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    plain = OPERATORS[name](docs)
    if name != "pack":
        assert name == "mixed" or plain.count() == len(rows)
        check_repeated(name, [r[:2] for r in rows], plain.collect())
    wide = OPERATORS[name](docs.withColumns({c: F.lit(f"own {c}") for c in NAMES}))
    assert wide.count() == plain.count()
    for c in set(NAMES) & set(wide.columns) - set(plain.columns):
        assert {x[0] for x in wide.select(c).distinct().collect()} == {f"own {c}"}, c


def test_chunk_store_round_trip_and_broken_parts(spark, tmp_path):
    """Documents come back from chunks; a changed chunk, recipe or manifest is noticed."""
    tokenizer, rows = queries.tokenizer_path("word_bpe_49k.json"), odd_rows()
    path = str(tmp_path / "store")
    chunkstore.write_store(spark.createDataFrame(rows, DOCS), tokenizer, 1, path)
    assert chunkstore.verify_manifest(spark, path) == len(rows)
    want = [i + [1] for i in brute.token_ids(tokenizer, [r[1] for r in sorted(rows)])]
    found = chunkstore.read_documents(spark, path).orderBy("start").collect()
    assert [x.ids for x in found] == want and [x.doc_id for x in found] == [r[0] for r in sorted(rows)]

    def broken(table, column):
        """A copy of the store in which one row of a table has another value."""
        other = str(tmp_path / f"broken-{table.replace('/', '-')}-{column}")
        shutil.copytree(path, other)
        df = spark.read.parquet(f"{path}/{table}")
        first = df.agg(F.min("key" if "kind" in table else "start")).first()[0]
        mine = F.col("key" if "kind" in table else "start") == F.lit(first)
        other_value = {"ids": F.unhex(F.lit("0100")), "root": F.unhex(F.lit("00")), "n_docs": F.lit(7).cast("long"), "chunks": F.array(F.unhex(F.lit("00")))}[column]
        df.withColumn(column, F.when(mine, other_value).otherwise(F.col(column))).write.mode("overwrite").parquet(f"{other}/{table}")
        return other

    for table, column in (("stored/kind=chunk", "ids"), ("recipes", "chunks")):
        with pytest.raises(Exception, match="does not have its"):
            chunkstore.read_digests(spark, broken(table, column)).collect()
    for table, column in (("recipes", "root"), ("manifest", "n_docs"), ("manifest", "root")):
        with pytest.raises(ValueError, match="manifest"):
            chunkstore.verify_manifest(spark, broken(table, column))


def test_a_batch_inserted_into_a_stored_family(spark, tmp_path):
    """Batches of several sessions: a loaded family finds what earlier batches have, and every 400-byte repeat holds a match."""
    rows = [r[:2] for r in odd_rows()]
    path, seen = str(tmp_path / "family"), []
    suffixes.IndexFamily.create(spark, path)
    for k in range(3):
        batch = [r for j, r in enumerate(rows) if j % 3 == k]
        family = suffixes.IndexFamily.load(spark, path)
        found = defaultdict(list)
        for x in suffixes.new_matches(spark.createDataFrame(batch, "doc_id long, text string"), family).collect():
            found[x.doc_id].append((x.first, x.end))
        own = {d: (t or "").encode() for d, t in batch}
        length = suffixes.LENGTH - suffixes.BLOCK + 1
        strings = Counter(b[i : i + length] for b in own.values() for i in range(len(b) - length + 1))
        before = {b[i : i + length] for b in seen for i in range(len(b) - length + 1)}
        for d, spans in found.items():
            assert all(e - f == length and (own[d][f:e] in before or strings[own[d][f:e]] > 1) for f, e in spans)
        windows = Counter(b[i : i + 400] for b in own.values() for i in range(len(b) - 399))
        old = {b[i : i + 400] for b in seen for i in range(len(b) - 399)}
        for d, b in own.items():
            for i in range(0, len(b) - 399, 37):
                if windows[b[i : i + 400]] > 1 or b[i : i + 400] in old:
                    assert any(i <= f and e <= i + 400 for f, e in found[d]), (k, d, i)
        seen += own.values()
    assert sorted(suffixes.IndexFamily.load(spark, path).levels) == [0, 1]
    assert seen
