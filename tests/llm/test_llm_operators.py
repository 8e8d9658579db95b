"""Training-data operators on small tables: edge cases, brute force, round trips, held-out accuracy."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelag.llm import (
    best_fit,
    common,
    components,
    compression_quality,
    feistel_pii,
    line_quality,
    mil_toxicity,
    minmax_dedup,
    path_templates,
    queries,
    secret_forest,
    textkernel,
    token_codec,
    winnowing,
)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, hash long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def long_text(n=20_000, seed=5):
    pick = random.Random(seed)
    return " ".join(pick.choice(["alpha", "beta", "Gamma", "déjà", "omega", "x1", "the"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, empty and very long texts, repeated rows, columns whose names clash with results."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    texts = [None, "", "   \n\t ", "word", "two words", base, base, base.upper(), base + " sixteen", long_text(), long_text() + " end"]
    rows = [(i, t, "en", "src0", 1, True, 0.5, 7) for i, t in enumerate(texts)]
    rows += [rows[5], (None, base, None, None, None, None, None, None), (50, "a b \x0b c\x0cd\re", None, "s", None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (9, 0, 1), (None, 1, 1), (77, None, None)], "doc_id long, quality int, toxic int")


def read(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return spark.read.parquet(f"{SF}/{name}.parquet")


# -- shared kernel -------------------------------------------------------------


def test_words_of_the_kernel_are_those_of_the_pattern():
    texts = ["Ab, c-d é1", "", None, "x" * 5, " lead", "tail ", "Éa b"]
    for members, pattern in ((textkernel.SPACED, r"[^\x20\x09-\x0D]+"), (textkernel.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        by_hash = {}
        for row, raw, offsets in textkernel.slices(pa.array(texts)):
            assert row == 0
            words = textkernel.words(raw, offsets, members)
            for d, t in enumerate(texts):
                want = re.findall(pattern, (t or "").translate(LOWER))
                own = words.hashes[words.first[d] : words.first[d + 1]].tolist()
                assert len(own) == len(want)
                for h, w in zip(own, want, strict=True):
                    assert by_hash.setdefault(w, h) == h
        assert len(set(by_hash.values())) == len(by_hash)


def test_components(spark, tmp_path):
    chain = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (2, 1), (3, 3), (7, 5), (5, 9)] + [(500, n) for n in range(501, 560)]
    edges = spark.createDataFrame([*chain, (None, 4)], "a long, b long")
    got = dict(tuple(r) for r in components.components(edges, str(tmp_path), "c").collect())
    assert {got[i] for i in range(100, 141)} == {100} and got[2] == 1 and got[9] == 5 and 3 not in got
    assert {got[n] for n in range(500, 560)} == {500}
    assert components.components(edges.limit(0), str(tmp_path), "none").count() == 0


# -- 1 and 10: classifiers -----------------------------------------------------


@pytest.mark.parametrize("run", [compression_quality.quality, mil_toxicity.toxicity])
def test_classifiers_on_odd_tables(odd, empty, labels, run):
    rows = run(odd, labels).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    modulo, fold = (3, 1) if run is compression_quality.quality else (5, 0)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulo == fold)
    assert run(empty, labels).count() == 0
    assert run(odd, labels.limit(0)).count() == 14


def test_quality_held_out_accuracy(spark):
    read(spark, "labels")
    larger = SF.replace("sf0.001", "sf0.01")
    scored = queries.op1_compression_quality(spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id")
    rows = scored.where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def test_toxic_sentences_are_located(spark):
    pick = random.Random(3)
    words = ["river", "stone", "green", "walk", "window", "paper", "light", "table"]
    rows, marks = [], []
    for i in range(400):
        sentences = [" ".join(pick.choices(words, k=6)) for _ in range(5)]
        if i % 4 == 0:
            sentences[pick.randrange(5)] += " vilest" + pick.choice(["a", "o", "en"])
        rows.append((i, ". ".join(sentences)))
        marks.append((i, 1, int(i % 4 == 0)))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for r in mil_toxicity.toxicity(documents, labels).collect():
        assert r.predicted == int(r.doc_id % 4 == 0)
        assert all("vilest" in s for s in r.offending) and len(r.offending) == r.predicted


# -- 2: token ids --------------------------------------------------------------


def test_blocks_round_trip():
    pick = np.random.default_rng(1)
    blocks = [
        pick.integers(0, 65_000, 3).astype(np.uint16),
        (pick.zipf(1.3, token_codec.BLOCK) % 50_000).astype(np.uint16),
        np.zeros(5000, np.uint16),
        np.tile(np.arange(700, dtype=np.uint16), 9),
        np.array([65_534], np.uint16),
    ]
    payloads = token_codec.encode_blocks(blocks)
    found = token_codec.decode_blocks(payloads, [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(blocks, found, strict=True))
    assert len(payloads[2]) < 600 and len(payloads[3]) < 5000
    assert token_codec.encode_blocks(blocks[1:2]) == payloads[1:2]  # a block's form does not depend on its company


def test_blocks_close_with_two_words_and_carry():
    assert len(token_codec.encode_blocks([np.array([7], np.uint16)])[0]) <= 6
    pick = np.random.default_rng(2)
    blocks = [np.minimum(pick.geometric(p, 300), 65_534).astype(np.uint16) for p in np.linspace(0.001, 0.999, 400)]
    found = token_codec.decode_blocks(token_codec.encode_blocks(blocks), [300] * 400)
    assert all((a == b).all() for a, b in zip(blocks, found, strict=True))


def test_model_is_asked_once_for_pieces_in_use(monkeypatch):
    monkeypatch.setattr(token_codec, "MEMO_PIECES", 50)
    tool = token_codec.PieceTokenizer(queries.default_tokenizer())
    asked = []

    class Model:
        def tokenize(self, piece, model=tool.model):
            asked.append(piece)
            return model.tokenize(piece)

    tool.model = Model()
    for tail in ("", "  " + "x" * 100):  # by the table, and by the rule
        asked.clear()
        texts = [f"the same w{i} words, again{tail}" for i in range(200)]
        for some in (texts, texts):
            for text, ids in zip(some, tool.ids(some, 0), strict=True):
                assert ids.tolist() == [*tool.library.encode(text, add_special_tokens=False).ids, 0]
        assert asked.count("Ġsame") == asked.count("Ġwords") == 1  # kept from batch to batch
    assert max(map(len, tool.pieces)) <= token_codec.MEMO_LETTERS


def test_pieces_equal_the_library():
    tool = token_codec.PieceTokenizer(queries.default_tokenizer())
    tool.table = token_codec._PieceTable(4)  # too small for the pieces below
    pick = random.Random(5)
    parts = ["don't", "'ll", "''s", "'", " ", "\n", ".", "a1b22", "élan", "ß×", "—", "<|x", "<|endoftext|>", "\t", "Wörter", "#'re", "x'd5"]
    parts += ["q" * 23, "q" * 24, "q" * 25, "zq" * 40, "\r", "5'6", "'til", "I'm.", " 's", "\n'tis", "the", "\0", "日本"]
    texts = ["".join(pick.choices(parts, k=pick.randrange(1, 9))) for _ in range(3000)]
    texts += [" ".join(pick.choices(parts[:4] + parts[6:10] + parts[14:19], k=9)) for _ in range(1000)]
    for text, ids in zip(texts, tool.ids(texts, 0), strict=True):
        assert ids.tolist() == [*tool.library.encode(text, add_special_tokens=False).ids, 0], text


def test_frames_round_trip_and_damage_is_noticed():
    docs = [None, 3, 3, -7]
    tokens = [np.arange(n, dtype=np.uint16) for n in (1, 20_000, 1, 5)]
    frame = token_codec.write_frame(docs, tokens)
    ids, found = token_codec.read_frame(frame)
    assert ids == docs and all((a == b).all() for a, b in zip(tokens, found, strict=True))
    with pytest.raises(ValueError):
        token_codec.read_frame(frame[:-3] + bytes([frame[-3] ^ 1]) + frame[-2:])


def test_token_query_equals_the_library(spark, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.default_tokenizer())
    rows = [r for r in odd.collect()]
    extra = ["a  b\n\n c'll x's don't <|endoftext|> q", "x<|endoftext|>y αβ", "\r\nq z", "A'S it''s 1a2 3-4_5 ß×÷ª"]
    table = odd.select("doc_id", "text").unionByName(
        spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    )
    texts = sorted(
        [(r.doc_id, r.text) for r in rows] + [(100 + i, t) for i, t in enumerate(extra)],
        key=lambda r: (r[0] is not None, r[0] or 0),
    )
    want, start = [], 0
    for doc, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in token_codec.coded(table, queries.default_tokenizer()).collect()), key=lambda r: r[1])
    assert got == want
    assert token_codec.coded(empty, queries.default_tokenizer()).count() == 0


# -- 3: secrets ----------------------------------------------------------------


def test_secrets(spark, odd, empty):
    pick = random.Random(9)

    def key(n=40):
        return "".join(pick.choice("0123456789abcdef") for _ in range(n))

    rows = []
    for i in range(120):
        plain = "some representation internationalization 1234567890123456 words"
        rows.append((i, f'{plain} token = "{key()}" end' if i % 3 == 0 else plain, "src/app.py"))
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    score = secret_forest.train_by_rule(documents)
    found = secret_forest.scan(documents, score).collect()
    texts = {i: t for i, t, _ in rows}
    for r in found:
        value = texts[r.doc_id][r.start : r.start + r.length]
        assert hashlib.sha256(value.encode()).hexdigest() == r.sha256
        assert r.is_secret == (r.length == 40)
    assert sum(r.is_secret for r in found) == 40 and len(found) == 120 * 2 + 40
    clean = secret_forest.redacted(documents, score)
    assert clean.columns == documents.columns and clean.count() == 120
    assert clean.where("text like '%[SECRET]\" end'").count() == 40
    assert secret_forest.redacted(odd, score).exceptAll(odd).count() == 0
    assert secret_forest.scan(empty, score).count() == 0
    none = secret_forest.train_by_rule(empty)
    assert secret_forest.scan(documents, none).where("is_secret").count() == 0


def hexadecimal(pick, n=40):
    return "".join(pick.choice("0123456789abcdef") for _ in range(n))


def test_one_secret_among_many_documents_is_found(spark):
    pick = random.Random(3)
    secret = 'token = "' + hexadecimal(pick) + '" end'
    plain = F.concat(F.lit("internationalization 1234567890123456 "), F.col("id").cast("string"))
    documents = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") == 41_234, secret).otherwise(plain).alias("text"), F.lit("src").alias("source")
    )
    labels = secret_forest.labelled_by_rule(secret_forest.candidates(documents)).groupBy("label").count()
    assert {r["label"]: r["count"] for r in labels.collect()}[1] == 1
    score = secret_forest.train_by_rule(documents)
    # a constant score, as without any positive finding, reads no feature
    assert "length" in str(score(F.col("f")))
    with pytest.warns(UserWarning, match="no forest was fitted"):
        secret_forest.train_by_rule(documents.where("doc_id < 100"))


def test_rule_vouches_for_hard_cases(spark):
    pick = random.Random(4)
    hard = {
        "commit " + hexadecimal(pick): 0,
        "sha256: " + hexadecimal(pick, 64): 0,
        "see 3f2b8c1e-77aa-4d10-9c3b-0123456789ab there": 0,
        "left AKIA" + "Q7ZP4M2X9K1T5R8W" + " here": 1,
        "bare " + hexadecimal(pick): None,
    }
    table = spark.createDataFrame([(i, t, "src") for i, t in enumerate(hard)], "doc_id long, text string, source string")
    got = {r.doc_id: r.label for r in secret_forest.labelled_by_rule(secret_forest.candidates(table)).collect()}
    assert [got.get(i) for i in range(len(hard))] == list(hard.values())


def test_long_names_and_web_tokens_are_context(spark):
    pick = random.Random(6)
    web = "eyJ" + hexadecimal(pick, 33) + "." + "eyJ" + hexadecimal(pick, 60) + "." + hexadecimal(pick, 43)
    values = {
        "AWS_SECRET_ACCESS_KEY={}": "wJalrXUtnFEMI/K7MDENG/bPxRfi" + hexadecimal(pick, 12),
        'stripe_secret_key: "{}"': "sk_test_" + hexadecimal(pick, 24),
        "internationalization access_token={} end": web,
        'MY_SERVICE_CLIENT_SECRET="{}"': hexadecimal(pick) + "==",
    }
    texts = [(i, name.format(v), "src") for i, (name, v) in enumerate(values.items())]
    found = secret_forest.candidates(spark.createDataFrame(texts, "doc_id long, text string, source string")).collect()
    for i, (name, v) in enumerate(values.items()):
        (own,) = [r for r in found if r.doc_id == i and r.value == v]
        assert own.features.assigned == own.features.equals == 1 and own.features.quoted == ('"' in name)
    table = spark.createDataFrame(texts, "doc_id long, text string, source string")
    labels = secret_forest.labelled_by_rule(secret_forest.candidates(table)).where("label = 1").collect()
    assert {r.value for r in labels} == set(values.values())


def test_short_credentials_of_any_characters(spark):
    pick = random.Random(8)
    forms = ['password = "{}" end', "postgres://app:{}@db/prod", "pwd={} end", "db_password: '{}'"]
    rows, values = [], {}
    for i in range(120):
        value = "".join(pick.choice("BCDFGHJKLMbcdfghjkm") + pick.choice("23456789") + pick.choice("!.$:%") for _ in range(3))
        plain = f"internationalization 1234567890123456 secret: {pick.choice(['that', 'information', 'for', 'section'])} words"
        values[i] = value if i % 2 else None
        rows.append((i, forms[i // 2 % 4].format(value) if i % 2 else plain, "src/app.py"))
    rows += [(200, 'password = "hunter2!Xy"', "src/app.py"), (201, "postgres://app:S3cr3t.pw@db/prod", "src/app.py")]
    values |= {200: "hunter2!Xy", 201: "S3cr3t.pw"}
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    score = secret_forest.train_by_rule(documents)
    texts = {i: t for i, t, _ in rows}
    got = {(r.doc_id, texts[r.doc_id][r.start : r.start + r.length]) for r in secret_forest.scan(documents, score).where("is_secret").collect()}
    assert got == {(i, v) for i, v in values.items() if v}
    for r in secret_forest.redacted(documents, score).collect():
        assert r.text == (texts[r.doc_id].replace(values[r.doc_id], "[SECRET]") if values[r.doc_id] else texts[r.doc_id])


def test_neighbouring_words_are_learned_from_labels(spark):
    pick = random.Random(12)
    # values alike in form; only the word on the left tells, and in one of ten cases it errs
    rows = [(i, f"grey {('session', 'build')[i % 2]} {hexadecimal(pick)} ends", "src") for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    label = F.when(F.col("doc_id") % 20 >= 18, F.col("doc_id") % 2).otherwise(1 - F.col("doc_id") % 2)
    labelled = secret_forest.candidates(table).withColumn("label", label.cast("int"))
    score = secret_forest.train(labelled)
    new = [(i, f"some {('session', 'build')[i % 2]} {hexadecimal(pick)} now", "src") for i in range(40)]
    found = secret_forest.scan(spark.createDataFrame(new, table.schema), score).collect()
    assert len(found) == 40 and all(r.is_secret == (r.doc_id % 2 == 0) for r in found)
    assert any(0.01 < r.score < 0.99 for r in found)
    got = {(r["label"], r["predicted"]): r["count"] for r in secret_forest.held_out(labelled).collect()}
    right, wrong = got.get((0, 0), 0) + got.get((1, 1), 0), got.get((0, 1), 0) + got.get((1, 0), 0)
    assert right > 4 * wrong and 40 < right + wrong < 130
    # a fitted forest keeps scan and redaction free of Python, and redacts what it judges
    clean = secret_forest.redacted(spark.createDataFrame(new, table.schema), score)
    for frame in (secret_forest.scan(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("s").alias("source")), score), clean):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert {r.doc_id for r in clean.collect() if "[SECRET]" in r.text} == {i for i, _, _ in new if i % 2 == 0}


def test_odds_of_words_against_brute_force(spark):
    counts = {3: [5, 1], 7: [0, 9], 1000: [2, 0]}
    (odds,) = secret_forest._odds([counts])
    got = spark.range(1).select(odds.alias("o")).first().o
    assert len(got) == secret_forest.BUCKETS
    for b in range(secret_forest.BUCKETS):
        c0, c1 = counts.get(b, [0, 0])
        want = math.log((c1 + 1) / 12) - math.log((c0 + 1) / 9) if b in counts else 0.0
        assert abs(got[b] - want) < 1e-4


def test_values_in_many_surroundings_are_common(spark):
    pick = random.Random(13)
    often, copied = hexadecimal(pick), hexadecimal(pick)
    words = ["".join(pick.choice("bcdfgh") + "aei"[i % 3] for i in range(4)) for _ in range(60)]
    rows = [(i, f"{w} {often} end", "src") for i, w in enumerate(words)]
    rows += [(100 + i, f'token = "{copied}" {w}', "src") for i, w in enumerate(words)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secret_forest.with_common(secret_forest._unnamed(secret_forest.candidates(table)))
    beside = {r.own: r.n for r in found.groupBy("own").agg(F.count_distinct("features.left").alias("n")).collect()}
    assert sorted(n >= secret_forest.COMMON for n in beside.values()) == [False, True]
    for r in found.select("own", "common").distinct().collect():
        assert r.common == (beside[r.own] >= secret_forest.COMMON)
    labels = {(r.features.assigned, r.label) for r in secret_forest.labelled_by_rule(found).collect()}
    assert labels == {(0.0, 0), (1.0, 1)}


def test_forest_is_evaluated_as_it_is_printed(spark):
    printed = """RandomForestClassificationModel: uid=r, numTrees=2, numClasses=2, numFeatures=18
  Tree 0 (weight 1.0):
    If (feature 0 <= 20.0)
     Predict: 0.0
    Else (feature 0 > 20.0)
     If (feature 1 <= 0.5)
      Predict: 0.0
     Else (feature 1 > 0.5)
      Predict: 1.0
  Tree 1 (weight 1.0):
    Predict: 1.0
"""
    score = secret_forest.forest(printed)
    table = spark.createDataFrame([(30.0, 0.9), (30.0, 0.1), (10.0, 0.9)], "length double, digits double")
    got = table.select(score(F.struct(*table.columns)).alias("s")).collect()
    assert [r.s for r in got] == [1.0, 0.5, 0.5]


# -- 4: packing ----------------------------------------------------------------


def plain_best_fit(items, capacity, per_source):
    """Tightest compatible bin by looking at all bins."""
    bins = []
    rest = []
    for i, (length, _, _) in enumerate(items):
        bins += [(capacity, [], [i])] * (length // capacity)
        if length % capacity:
            rest.append((length % capacity, i))
    for size, i in sorted(rest, key=lambda r: (-r[0], r[1])):
        _, source, cluster = items[i]
        fits = [
            (capacity - b[0], n)
            for n, b in enumerate(bins)
            if capacity - b[0] >= size
            and sum(s == source for s, _ in b[1]) < per_source
            and (cluster is None or all(c != cluster for _, c in b[1]))
        ]
        if fits:
            n = min(fits)[1]
            bins[n] = (bins[n][0] + size, [*bins[n][1], (source, cluster)], [*bins[n][2], i])
        else:
            bins.append((size, [(source, cluster)], [i]))
    return sorted(sorted(b[2]) for b in bins)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_a_search_of_all_bins(seed):
    pick = random.Random(seed)
    items = [
        (pick.randint(1, 130), pick.choice(["a", "a", "b", None, "c"]), pick.choice([None, 1, 2, 3, 4])) for _ in range(150)
    ]
    bins, filled = best_fit.best_fit(items, 100, 2)
    assert sorted(sorted(i for i, _, _ in b) for b in bins) == plain_best_fit(items, 100, 2)
    assert [sum(n for _, _, n in b) for b in bins] == filled and max(filled) <= 100


def test_packing_covers_every_document(spark, odd, empty):
    rows = best_fit.pack(best_fit.measured(odd), capacity=1000, shard_documents=5).collect()
    by_doc = Counter()
    for r in rows:
        by_doc[r.doc_id] += r.length
        assert r.fill <= 1000
    want = Counter()
    for r in odd.collect():
        want[r.doc_id] += len((r.text or "").encode()) + 1
    assert by_doc == want
    assert best_fit.pack(best_fit.measured(empty)).count() == 0


def test_near_copies_share_no_bin(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in range(0, 60, 6)] + [" ".join(words).upper()]
    rows = [(i if i % 3 else None, t, f"s{i}") for i, t in enumerate(texts)] + [(1, "another text of its own", "t"), (2, None, "t"), (2, "", "t")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    measured = best_fit.measured(table)
    clusters = [r.cluster for r in measured.collect() if r.length > 100]
    assert len(clusters) == 11 and len(set(clusters)) == 1 and None not in clusters
    assert sorted(r.length for r in measured.where("cluster is null").collect()) == [1, 1]
    packed = best_fit.pack(measured).where("length > 100").collect()
    assert len({r.bin_id for r in packed}) == 11
    assert best_fit.measured(table, near=False).where("length > 100").select("cluster").distinct().count() == 11


# -- 5: near duplicates --------------------------------------------------------


def brute_components(documents):
    sets = {}
    for doc, text in documents:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[doc] = {tuple(words[i : i + 4]) for i in range(max(len(words) - 3, min(len(words), 1)))}
    least = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b]:
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and least[a] != least[b]:
                        least[a] = least[b] = min(least[a], least[b])
                        changed = True
    return {d: (len(s), least[d], least[d] == d) for d, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    pick = random.Random(4)
    documents = []
    for base in range(12):
        words = [pick.choice("abcdefghijklmnopqrstuvw") * pick.randint(1, 3) for _ in range(pick.randint(1, 90))]
        for _ in range(12):
            own = list(words)
            for _ in range(pick.choice([0, 0, 1, 2, 4])):
                own[pick.randrange(len(own))] = f"new{pick.randint(0, 999)}"
            documents.append((len(documents), " ".join(own)))
    documents += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "one two"), (906, "one two three")]
    table = spark.createDataFrame(documents, "doc_id long, text string")
    want = brute_components(documents)
    assert {r.doc_id: tuple(r)[1:] for r in minmax_dedup.dedup(table).collect()} == want
    monkeypatch.setattr(minmax_dedup, "CELL_DOCUMENTS", 3)  # cells of large groups
    monkeypatch.setattr(minmax_dedup, "CELL_SHINGLES", 150)
    assert {r.doc_id: tuple(r)[1:] for r in minmax_dedup.dedup(table).collect()} == want


def test_near_duplicates_on_odd_tables(odd, empty):
    rows = minmax_dedup.dedup(odd).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 14 and by_id[None].component_id is None and by_id[None].kept
    assert by_id[6].component_id == by_id[7].component_id == by_id[8].component_id == 5 and by_id[10].component_id == 9
    assert all(by_id[i].kept and by_id[i].n_shingles == 0 for i in (0, 1, 2)) and by_id[3].n_shingles == 1
    assert minmax_dedup.dedup(empty).count() == 0


# -- 6: decontamination --------------------------------------------------------


def test_winnowing_equals_brute_force(spark, odd, empty):
    pick = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(pick.choices(words, k=pick.choice([1, 3, 9, 10, 14, 30])))) for i in range(25)]
    items += [(90, None), (91, ""), (None, "seven eight nine ten"), (92, "Seven EIGHT, nine ten")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [(i, " ".join(pick.choices(words, k=200) + items[i % 25][1].split() + ["x"])) for i in range(200, 230)]
    table = odd.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def cut(text):
        return pattern.findall((text or "").translate(LOWER))

    windows = {}
    for item, text in items:
        own = cut(text)
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            windows.setdefault(tuple(own[i : i + n]), set()).add(item)
    want = []
    for r in table.collect():
        own, hit, named = cut(r.text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(own) - n + 1):
                if (items_here := windows.get(tuple(own[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    named |= {str(x) for x in items_here if x is not None}
        names = ",".join(sorted(named))
        want.append((r.doc_id, len(own), len(hit), len(named), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = winnowing.contamination(table, benchmark).drop("items").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert winnowing.contamination(table, benchmark.limit(0)).where("contaminated").count() == 0
    assert winnowing.contamination(empty, benchmark).count() == 0


# -- 7: quality rules ----------------------------------------------------------


def test_base_figures():
    text = "a b c a b c\n\nx #$\nx #$\n  \n"
    m = line_quality.measure(text)
    words = text.split()
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    assert (m.n_words, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == (10, 4, 1, len(covered))
    assert m.word_chars == sum(map(len, words)) and m.base_failed
    assert line_quality.measure(None).n_words == line_quality.measure("").n_words == 0


def test_viterbi_equals_all_labellings():
    pick = random.Random(2)
    field = line_quality.LineField([pick.uniform(-2, 2) for _ in range(1 << line_quality.N_FEATURES)], -0.7, -1.3, 0.4)
    for _ in range(30):
        masks = [pick.randrange(1 << line_quality.N_FEATURES) for _ in range(7)]

        def score(labels, masks=masks):
            total = field.start * labels[0] + sum(field.emission[m] for m, y in zip(masks, labels, strict=True) if y)
            for a, b in zip(labels, labels[1:], strict=False):
                total += field.to_content * (not a and b) + field.to_boilerplate * (a and not b)
            return total

        best = max(score([bool(n >> i & 1) for i in range(7)]) for n in range(128))
        assert abs(score(field.viterbi(masks)) - best) < 1e-9


def test_line_field_learns_and_filters(spark, odd, empty, labels):
    pick = random.Random(6)
    texts = []
    for i in range(80):
        lines = [["".join(pick.choices("abcdefgh", k=5)) for _ in range(12)] for _ in range(8)]
        texts.append((i, "\n".join(" ".join(w if i % 2 else w + "###" for w in line) + "." * (i % 2) for line in lines)))
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    field = line_quality.train(documents, marks)
    rows = line_quality.judge_lines(documents, field).collect()
    assert all(r.kept == bool(r.doc_id % 2) for r in rows)
    kept = line_quality.filter_documents(documents, field)
    assert kept.columns == documents.columns and kept.count() == 40
    assert line_quality.judge_lines(odd, line_quality.train(odd, labels)).count() == 14
    assert line_quality.judge_lines(empty, line_quality.ALL_CONTENT).count() == 0
    assert line_quality.filter_documents(odd, line_quality.ALL_CONTENT).schema == odd.schema


# -- 8: pseudonyms -------------------------------------------------------------


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def feistel_digits(digits, key, label):
    """The permutation, step by step."""
    half = len(digits) // 2
    left, right = digits[:half], digits[half:]
    for i in range(feistel_pii.ROUNDS):
        d = hashlib.sha256(f"{key}|{label}|{i}|{len(digits)}|{right}".encode()).digest()
        left, right = right, "".join(str((int(c) + d[j % 32]) % 10) for j, c in enumerate(left))
    return left + right


def test_pseudonyms(spark, odd, empty):
    card, account = "4111 1111 1111 1111", "9807915762804490"
    text = f"{card}; 4111-1111-1111-1112 {account} 97.51.17.173 300.1.1.1 1980-02-29 1981-02-29 31.12.1999 ab.34@mail7.example.com +1 (017) 555-7713."
    table = spark.createDataFrame([(1, text), (2, f"again {card} and {account}"), (3, "v1.2 12 days")], "doc_id long, text string")
    rows = {r.doc_id: r for r in feistel_pii.pseudonymised(table, "k").collect()}
    kinds = [(f.kind, f.value) for f in rows[1].findings]
    assert [k for k, _ in kinds] == ["card", "account", "ip", "date", "date", "email", "phone"]
    assert kinds[0] == (rows[2].findings[0].kind, rows[2].findings[0].value) and kinds[1][1] == rows[2].findings[1].value
    body = feistel_digits("411111111111111", "k", "card")
    assert kinds[0][1].replace(" ", "")[:-1] == body and luhn(kinds[0][1].replace(" ", "")) and kinds[0][1] != card
    walked = feistel_digits(account, "k", "account")
    while luhn(walked):  # an account never becomes a valid card number
        walked = feistel_digits(walked, "k", "account")
    assert kinds[1][1] == walked
    for kept in ("4111-1111-1111-1112", "300.1.1.1", "1981-02-29", "@mail7.example.com", "+1 ("):
        assert kept in rows[1].text
    shape = re.compile(r"[0-9]")
    assert [shape.sub("9", v) for k, v in kinds if k in ("phone", "date")] == ["9999-99-99", "99.99.9999", "+9 (999) 999-9999"]
    assert rows[3].text == "v1.2 12 days" and rows[3].findings == []
    other = feistel_pii.pseudonymised(table, "another").where("doc_id = 2").first()
    assert other.text != rows[2].text
    same = feistel_pii.pseudonymised(odd, "k")
    assert same.select("doc_id", "text").exceptAll(odd.select("doc_id", "text")).count() == 0
    assert feistel_pii.pseudonymised(empty, "k").count() == 0


def test_permutations_keep_values_apart(spark):
    numbers = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"))
    made = numbers.select(feistel_pii.permute_digits(F.col("d"), F.lit("k"), "t").alias("p"))
    assert made.where("p rlike '^[0-9]{4}$'").distinct().count() == 10_000
    days = spark.range(feistel_pii._A * feistel_pii._B).select(
        F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d")
    )
    made = days.select(feistel_pii.pseudonym_date(F.col("d"), F.lit("k")).alias("p"))
    assert made.distinct().count() == days.count() and made.exceptAll(days).count() == 0


# -- 9: urls -------------------------------------------------------------------


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.ORG/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2#z": ("example.org", "/en/2", "org/", "allow"),
        "ftp://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
        "http://y.com/de/1": ("y.com", "/de/1", "com/de/", "block"),
        "http://notexample.org/es/1": ("notexample.org", "/es/1", "org/", "allow"),
        "http://a.org": ("a.org", "", None, "allow"),
        "http://q.net?u=/de/": ("q.net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, "page") for i, u in enumerate(cases)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = path_templates.judged_urls(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        want = list(cases.values())[r.page_id] if r.page_id is not None else cases[None]
        assert (r.host, r.path, r.rule, r.verdict) == want
    assert path_templates.judged_urls(pages.limit(0)).count() == 0


def test_templates_reject_by_labelled_purity(spark):
    pages, labels = [], []
    for i in range(400):
        bad = i % 2
        pages.append((i, f"http://shop.test/{'spam' if bad else 'item'}/{i}/p{i}"))
        if i % 5:
            labels.append((i, 1 - bad))
    pages += [(1000 + i, f"http://wide.test/{chr(97 + i // 26)}{chr(97 + i % 26)}/x") for i in range(100)]
    table = spark.createDataFrame(pages, "page_id long, url string")
    marks = spark.createDataFrame(labels, "page_id long, label int")
    got = path_templates.judged_urls(table, labels=marks).collect()
    for r in got:
        assert r.verdict == ("block" if r.path.startswith("/spam") else "allow")
    assert len({r.template for r in got if r.host == "wide.test"}) == 1


# -- all -----------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.sql_texts()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        read(spark, t)
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.registered()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(queries.sql_texts()[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["op3_secret_forest", "op8_feistel_pii", "op13_license_diagonals"])
def test_native_plans_have_no_python(spark, name):
    read(spark, "documents")
    plan = queries.registered()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Pandas", "InArrow"):
        assert word not in plan


def test_shared_folder_comes_from_the_session(spark):
    class Session:
        conf = {"spark.checkpoint.dir": "hdfs://shared/points/"}

    assert re.fullmatch("hdfs://shared/points/llm-[0-9a-f]{32}", common.shared_dir(Session))


def test_pipeline_stages(spark):
    import corpus_pipeline

    documents = read(spark, "documents")
    folder = common.shared_dir(spark)
    docs, sizes = documents, [documents.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), folder, name)
        if name != "packing":
            assert docs.columns == documents.columns
        sizes.append(docs.count())
        if name == "near_duplicates":
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            before = spark.read.parquet(f"{folder}/quality_rules")
            want = brute_components([(r.doc_id, r.text) for r in before.collect()])
            assert kept == {d for d, w in want.items() if w[2]}
        if name == "secrets":
            last = {r.doc_id: r.text for r in docs.collect()}
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4]
    packed = Counter()
    for r in docs.collect():
        packed[r.doc_id] += r.length
    assert packed == {d: len(t.encode()) + 1 for d, t in last.items()}
