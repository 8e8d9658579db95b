"""Merkle proofs, spelling variants and licence notices: brute force, edge cases, hot groups."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidelag.llm import license_diagonals as L
from tidelag.llm import merkle_manifest as M
from tidelag.llm import spelling_variants as S

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, place long, row string, tree string, score double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), "x", 7, "r", "t", 0.5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- Merkle manifest ---------------------------------------------------------------


def merkle(records):
    """All results by building every tree in full."""

    def leaf(r, low=False):
        values = [r[0], r[3], r[2], r[4], r[1].translate(LOWER) if low and r[1] is not None else r[1]]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def climb(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            d = levels[-1]
            levels.append([sha("".join(d[i : i + 8])) for i in range(0, len(d), 8)])
        return levels

    def sides(levels, i):
        for d in levels[:-1]:
            s = i // 8 * 8
            yield d[s:i], d[i + 1 : s + 8]
            i //= 8

    langs = {}
    for r in records:
        langs.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    order = sorted(langs)
    trees = {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k, v in langs.items()}
    levels = {k: climb([leaf(r) for r in v]) for k, v in trees.items()}
    top = climb([levels[k][-1][0] for k in order])
    root = top[-1][0] if order else ""
    out = []
    for place, k in enumerate(order):
        for i, r in enumerate(trees[k]):
            path = [*sides(levels[k], i), *sides(top, place)]
            digest = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for left, right in path:
                digest = sha("".join(left) + digest + "".join(right))
            proof = sha("".join("".join(a) + "".join(b) for a, b in path))
            out.append((r[0], leaf(r), levels[k][-1][0], root, proof, digest, digest == root))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("partition", [5, 4096])
def test_manifest_equals_whole_trees(spark, partition):
    pick = random.Random(partition)
    records = [doc(i * 3, pick.choice(["Aa", "b", "É Q", "", None]), pick.choice(["en"] * 9 + ["de", "", None, "é"])) for i in range(150)]
    records += [doc(None, "Z"), doc(None, None, None, None), doc(2**60 + 1, "Lone", "lone"), records[0], records[0]]
    got = M.manifest(spark.createDataFrame(records, DOCS), partition)
    assert got.columns == COLUMNS
    assert rows(got) == merkle(records)


@pytest.mark.parametrize("n", [1, 8, 65])
def test_manifest_of_one_language(spark, n):
    records = [doc(i, f"T{i}") for i in range(n)]
    assert rows(M.manifest(spark.createDataFrame(records, DOCS), 16)) == merkle(records)


def test_manifest_of_nothing(empty):
    assert rows(M.manifest(empty)) == []


def test_manifest_of_many_equal_rows(spark):
    records = [doc(7, "Same")] * 700
    got = M.manifest(spark.createDataFrame(records, DOCS).repartition(5), 64)
    assert rows(got) == merkle(records)


def test_every_language_its_own(spark):
    records = [doc(i, "t", f"l{i:03}") for i in range(90)]
    assert rows(M.manifest(spark.createDataFrame(records, DOCS))) == merkle(records)


def test_tampering_shows_only_where_letters_change(spark):
    records = [doc(i, "UPPER" if i % 2 else "lower") for i in range(60)]
    got = {r.doc_id: r.verified for r in M.manifest(spark.createDataFrame(records, DOCS)).collect()}
    assert got == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 3 == 0) for i in range(60)}


@pytest.mark.parametrize("seed", range(20))
def test_missing_nodes_are_necessary_and_sufficient(seed):
    pick = random.Random(seed)
    leaves = pick.randint(1, 700)
    known = np.array(sorted(pick.sample(range(leaves), pick.randint(1, min(leaves, 40)))))
    found = M.missing(known, leaves)
    # every sibling on every path, less what the known leaves' own paths pass through
    want, at = [], known
    for width in M.widths(leaves)[:-1]:
        needed = {c for p in at for c in range(p // 8 * 8, min(p // 8 * 8 + 8, width))}
        want.append(sorted(needed - set(at.tolist())))
        at = np.unique(at // 8)
    assert [f.tolist() for f in found] == want


def test_one_key_is_dealt_to_many_partitions(spark):
    df = spark.range(20000).select(F.lit("t").alias("tree"), F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("leaf"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = M.placed(df, "tree", ["doc_id", "leaf"], M.shared_dir(spark), "x")
        assert placed.agg(F.count_distinct("place"), F.max("place")).first()[:] == (20000, 19999)
        dealt = df.withColumn("at", F.monotonically_increasing_id()).repartitionByRange("tree", "doc_id", "leaf", "at")
        assert dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# -- spelling variants ---------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants(records):
    count = Counter()
    for r in records:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    out, form, about = [], {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        about[w] = len(others)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], about[w], n[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def edited(word, pick, letters):
    i = pick.randrange(len(word) + 1)
    kind = pick.randrange(3)
    if kind == 0:
        return word[:i] + pick.choice(letters) + word[i:]
    i = pick.randrange(len(word))
    return word[:i] + (pick.choice(letters) if kind == 1 else "") + word[i + 1 :]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aéÿ÷Z"])
def test_variants_equal_brute_force(spark, letters):
    pick = random.Random(letters)
    words = {"".join(pick.choice(letters) for _ in range(pick.randint(6, 11))) for _ in range(60)}
    words |= {edited(edited(w, pick, letters), pick, letters) for w in list(words)}
    words |= {edited(w, pick, letters) for w in list(words)}
    counts = {w: pick.choice([3, 5, 6, 30, 200]) for w in sorted(words)}
    drawn = [w for w, c in counts.items() for _ in range(c)]
    pick.shuffle(drawn)
    records = [doc(i, " ".join(drawn[i * 40 : (i + 1) * 40])) for i in range(len(drawn) // 40 + 1)]
    records += [doc(None, "aaaaaa " * 9), doc(None, "aaaaaa"), doc(5, None), doc(5, ""), doc(6, "1;2 \n"), records[0]]
    got = S.variants(spark.createDataFrame(records, DOCS))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows(got) == variants(records)


def test_variants_of_nothing(empty, spark):
    assert rows(S.variants(empty)) == []
    assert rows(S.variants(spark.createDataFrame([doc(1, "short words only")], DOCS))) == []


def test_chain_of_forms_and_ties(spark):
    text = " ".join(["wordaaa"] * 5 + ["wordaab"] * 25 + ["wordabb"] * 125 + ["tiedxxx"] * 5 + ["tiedxxy"] * 25 + ["tiedxxz"] * 25)
    got = S.variants(spark.createDataFrame([doc(1, text)], DOCS), altered=None)
    assert rows(got.where("form is not null"), "word", "form", "root") == [
        ("tiedxxx", "tiedxxy", "tiedxxy"),
        ("wordaaa", "wordaab", "wordabb"),
        ("wordaab", "wordabb", "wordabb"),
    ]


def test_only_bigram_counts_are_broadcast(spark, tmp_path):
    """A word has many join keys, which Spark leaves out of the sizes by which it would broadcast a side."""
    pick = random.Random(5)
    words = sorted({"".join(pick.choice("abcdefgh") for _ in range(7)) for _ in range(300)})
    vocab = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    pairs = S.near_pairs(vocab)
    got = {(r.a, r.b) for r in pairs.collect()}
    assert got == {(v, w) for v in words for w in words if v < w and near(v, w)}
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan
    formed = S.forms(vocab, pairs).withColumn("form", F.when(F.col("word") > words[0], F.lit(words[0])))
    reached = S.roots(formed, str(tmp_path))
    assert {r.root for r in reached.collect()} == {words[0]}


def test_pivots_are_disjoint_and_cheapest(spark):
    pick = random.Random(3)
    words = sorted({"".join(pick.choice("aab") for _ in range(pick.randint(6, 14))) for _ in range(80)})
    vocab = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    freq = Counter(g for w in words for g in {w[i : i + 2] for i in range(len(w) - 1)})
    for r in S.marked(vocab).collect():
        grams = sorted((freq[r.word[i : i + 2]], r.word[i : i + 2], i) for i in range(len(r.word) - 1))
        prefix = [g[2] for g in grams if g[:2] <= grams[2][:2]]
        cost = lambda i: freq[r.word[i : i + 2]]
        least = min(cost(i) + cost(j) for i in prefix for j in prefix if j >= i + 2)
        assert sorted(r.prefix) == sorted(prefix) and {r.a, r.b} <= set(prefix)
        assert r.b >= r.a + 2 and cost(r.a) + cost(r.b) == least


# -- licence notices ---------------------------------------------------------------


def licence(text):
    words = WORD.findall((text or "").translate(LOWER))
    places, base, own, score = [], set(), set(), 0.0
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for label, notice in L.NOTICES:
        t = WORD.findall(notice.translate(LOWER))
        known = {}
        for j in range(len(t) - 2):
            known.setdefault(tuple(t[j : j + 3]), []).append(j)
        diagonals = sorted({i - j for i in range(len(words) - 2) for j in known.get(tuple(words[i : i + 3]), [])})
        groups = []
        for d in diagonals:
            if groups and d - groups[-1][-1] <= L.DRIFT:
                groups[-1].append(d)
            else:
                groups.append([d])
        for group in groups:
            agreed = {j for d in group for j in range(len(t)) if 0 <= d + j < len(words) and words[d + j] == t[j]}
            score = max(score, len(agreed) / len(t))
            if 5 * len(agreed) >= 4 * len(t):
                own.add(label)
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | own)), score,
    )


def test_licences_equal_brute_force(spark):
    pick = random.Random(4)
    texts = [None, "", " \n", "word", "CC BY-NC", "cc by nc by cc by nc", "under the mit license under the MIT  License!"]
    for label, notice in L.NOTICES:
        w = notice.split()
        texts += [notice, "Intro words. " + notice.upper() + " outro", notice + "\n" + notice]
        for _ in range(4):
            cut = list(w)
            for _ in range(pick.randint(1, 4)):
                i = pick.randrange(len(cut))
                cut[i : i + pick.randint(0, 2)] = pick.choice([[], ["changed"], ["two", "more"]])
            texts.append("x " * pick.randint(0, 5) + " ".join(cut))
    texts += [" ".join(pick.choice("the license under of any".split()) for _ in range(3000)), ("é " * 50 + L.NOTICES[0][1]) * 300]
    records = [doc(i, t) for i, t in enumerate(texts)] + [doc(None, texts[10]), doc(3, texts[20]), doc(10, texts[10])]
    got = L.licences(spark.createDataFrame(records, DOCS))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert rows(got) == sorted([(r[0], *licence(r[1])) for r in records], key=key)


def test_licences_of_nothing(empty):
    assert rows(L.licences(empty)) == []


def test_changed_notice_is_found_and_a_stranger_is_not(spark):
    notice = L.NOTICES[1][1]
    moved = notice.replace("free of charge", "wholly free of any charge").replace("without limitation", "with no limitation")
    stranger = "The license of the house is old, and the people there read books under the tree."
    got = L.licences(spark.createDataFrame([doc(1, moved), doc(2, stranger)], DOCS)).orderBy("doc_id").collect()
    assert (got[0].base_labels, got[0].labels) == ("", "mit") and got[0].score >= 0.8
    assert got[1].labels == "" and got[1].score < 0.5


def test_own_templates_without_a_broadcast(spark, monkeypatch):
    own = spark.createDataFrame([("house", "all rights of the house are kept"), (None, None), ("tiny", "two words")], "label string, text string")
    documents = spark.createDataFrame([doc(1, "All rights of the House are kept."), doc(2, "nothing")], DOCS)
    want = [(1, "house", 1.0), (2, "", 0.0)]
    assert rows(L.licences(documents, own), "doc_id", "labels", "score") == want
    monkeypatch.setattr(L, "BROADCAST_WORDS", 0)
    assert rows(L.licences(documents, own), "doc_id", "labels", "score") == want


def test_licence_plan_has_no_python(spark):
    documents = spark.createDataFrame([doc(1, "text")], DOCS)
    documents.write.mode("overwrite").parquet(f"{(folder := M.shared_dir(spark))}/docs")
    plan = L.licences(spark.read.parquet(f"{folder}/docs"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
