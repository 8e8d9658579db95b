"""Secret scan: a random forest sorts real secrets from false positives among token-like strings.

All work is done by built-in expressions.  Candidates are runs of at least ``MIN_LENGTH`` token characters, web tokens,
and, of any length and characters, what is assigned to a credential's name or is the password in a URL.  Their
features are length, character classes and transitions, coverage by a dictionary, the path of the document and the
neighbouring words: the two words on the left and the one on the right, hashed to buckets, each bucket with the log odds
of the labels seen beside it.  The odds of a training row come from the other folds, so no row sees its own label.  A
forest is trained on labelled findings by Spark's own learner and then written out as nested conditions, so scoring
happens inside the row: no shuffle, no join, however many candidates a text holds.

Labels are the caller's (``train``) or those of a rule (``train_by_rule``).  What the rule goes by first, namely the
credential's name, the issued form, the digest's name, the UUID and in how many surroundings a value recurs, is not
shown to the trees.

Defined results: a NULL or empty text has no finding; a NULL path counts as an empty one; repeated rows are scanned
one by one; an empty table gives an empty result; without findings of both labels every candidate gets the share
of positive labels (0 without any) and a warning says so; extra columns are ignored, and ``redacted`` passes them through.
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelag.llm.common import shared_dir, written

MIN_LENGTH = 16
TREES = 15
DEPTH = 5
TRAIN_PER_CLASS = 4_000  # labelled findings of either class used to fit, those of smallest hash
BUCKETS = 1024  # of hashed words
FOLDS = 5
COMMON = 20  # a value beside so many different words on its left is a common one
REDACTED = "[SECRET]"

_TOKEN = "A-Za-z0-9+/_-"
# A web token is one candidate, with its dots; an equals sign right before a value is not padding.
_WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)?"
_RUN = rf"(?<![{_TOKEN}])(?:{_WEB_TOKEN}|[{_TOKEN}]{{{MIN_LENGTH},}}+(?:={{1,2}}(?![={_TOKEN}]))?)"
_NAMES = "token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|key|auth|credential|bearer"
# What is assigned to a credential's name, and the password of a URL: of any length and characters.  The short
# conditions on the left come first, so that most places fail at once.
_VALUE = r"(?:(?<=\")[^\"\r\n]++(?=\")|(?<=')[^'\r\n]++(?=')|(?<=`)[^`\r\n]++(?=`)|(?<![\"'`])[^\s\"'`<>]++)"
_NAMED = rf"(?<=[=:> \"'`])(?<=[=:][ >]{{0,3}}[\"'`]?)(?<=(?i:{_NAMES})[A-Za-z0-9_\"' -]{{0,16}}[=:][ >]{{0,3}}[\"'`]?)(?![ >=:]){_VALUE}"
_IN_URL = r"(?<=:)(?<=://[^\s/:@\"'<>]{0,64}:)[^\s/\"'<>]+(?=@)"
CANDIDATE = f"{_IN_URL}|{_NAMED}|{_RUN}"
# Pieces that ordinary words and identifiers are made of (a parameter; any list of lower-case pieces serves).
DICTIONARY = (
    "the and ing ion ent tion ment for with that this from have are was not you all can has her his one our out "
    "test example sample default value name user data file path config index page image style script class "
    "public private static return function number string version license united general information service "
    "que los las del con una por para como der die das und ist ein eine nicht mit von les des est pour dans "
    "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve"
).split()

_NEAR = 48  # characters kept on the left of a candidate, 16 on the right
_ASSIGNED = rf"(?i)({_NAMES})[A-Za-z0-9_\"' -]{{0,16}}[=:][ >]*[\"'`]?$"
_LOGIN = r"://[^\s/:@\"'<>]*:$"
_DIGEST = r"(?i)(sha-?(1|224|256|384|512)|md5|checksum|digest|hash|commit|revision|etag|uuid|guid|integrity|fingerprint)[\"' ]{0,2}[=:]?[ >-]{0,3}[\"']?$"
_UUID = "^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
_ISSUED = "^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|[sr]k_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{16,}|AIza[A-Za-z0-9_-]{35})$"

NUMBERS = [
    "length", "digits", "capitals", "small", "marks", "switches", "case_switches", "distinct", "hexadecimal",
    "coverage", "longest_word", "vowels", "quoted", "equals", "linked", "test_path", "path_depth",
]
WORDS = ["left", "left2", "right"]  # buckets of neighbouring words
EVIDENCE = ["assigned", "digest", "uuid", "issued"]  # for labels only
FEATURES = [*NUMBERS, *[f"{w}_odds" for w in WORDS]]  # what the trees see


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")).cast("double") / F.length(value)


def features(value: Column, before: Column, after: Column, path: Column) -> Column:
    """A struct of NUMBERS, WORDS and EVIDENCE, for a candidate and the text around it."""
    size = F.length(value)
    switches = F.regexp_count(value, F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"))
    cases = F.regexp_count(value, F.lit("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"))
    uncovered = F.length(F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))
    words = F.transform(F.split(value, "[^A-Za-z]+"), F.length)
    near = F.coalesce(path, F.lit(""))
    made = {
        "length": size,
        "digits": _share(value, "[^0-9]"),
        "capitals": _share(value, "[^A-Z]"),
        "small": _share(value, "[^a-z]"),
        "marks": _share(value, "[A-Za-z0-9]"),
        "switches": switches / size,
        "case_switches": cases / size,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(64)),
        "hexadecimal": value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "coverage": 1 - uncovered / size,
        "longest_word": F.array_max(words) / size,
        "vowels": _share(F.lower(value), "[^aeiou]"),
        "assigned": before.rlike(_ASSIGNED) | (before.rlike(_LOGIN) & after.rlike("^@")),
        "quoted": before.rlike("[\"'`]$") & after.rlike("^[\"'`]"),
        "equals": before.rlike("[=:][ ]*[\"']?$"),
        "linked": before.rlike("[@.:/\\\\]$") & ~before.rlike("[:=]$"),
        "test_path": near.rlike("(?i)test|example|sample|spec|mock|doc"),
        "path_depth": F.size(F.split(near, "/")),
        "digest": before.rlike(_DIGEST),
        "uuid": value.rlike(_UUID),
        "issued": value.rlike(_ISSUED),
        "left": _bucket("left", F.regexp_extract(before, r"(\p{L}++)[^\p{L}]*+$", 1)),
        "left2": _bucket("left2", F.regexp_extract(before, r"(\p{L}++)[^\p{L}]++\p{L}++[^\p{L}]*+$", 1)),
        "right": _bucket("right", F.regexp_extract(after, r"^[^\p{L}]*+(\p{L}++)", 1)),
    }
    return F.struct(*[made[name].cast("double").alias(name) for name in [*NUMBERS, *WORDS, *EVIDENCE]])


def _bucket(side: str, word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(side), F.lower(word)), F.lit(BUCKETS))


def _with_candidates(documents: DataFrame, path: str) -> DataFrame:
    """``documents`` with ``__found`` (candidates) and ``__gaps`` (the text between them), NULL without any."""
    text = F.col("text").cast("string")
    there = text.rlike(CANDIDATE)
    return documents.withColumns(
        {
            "__found": F.when(there, F.regexp_extract_all(text, F.lit(CANDIDATE), 0)),
            "__gaps": F.when(there, F.split(text, CANDIDATE, -1)),
            "__path": F.col(path).cast("string"),
        }
    )


def _judged(score: Callable[[Column], Column]) -> Column:
    """For each candidate a struct: value, where it starts in the text, features, score."""

    def tail(text: Column) -> Column:
        return F.coalesce(F.right(text, F.lit(_NEAR)), F.lit(""))

    def one(gaps: Column, found: Column, value: Column, i: Column) -> Column:
        # the running text: a credential's own name may be the candidate before
        before = F.concat(tail(F.get(gaps, i - 1)), tail(F.get(found, i - 1)), tail(F.get(gaps, i)))
        around = features(value, tail(before), F.left(F.get(gaps, i + 1), F.lit(16)), F.col("__path"))
        return bound(around, lambda f: F.struct(value.alias("value"), f.alias("features"), score(f).alias("score")))

    # both are bound: the optimizer would otherwise cut the text anew for every candidate
    cut = F.struct(F.col("__gaps").alias("gaps"), F.col("__found").alias("found"))
    return bound(cut, lambda c: F.transform(c["found"], lambda value, i: one(c["gaps"], c["found"], value, i)))


def labelled_by_rule(findings: DataFrame) -> DataFrame:
    """Labels of findings that a rule can vouch for; the others are left out.

    1: assigned to a credential's name, with letters and digits mixed and hardly a dictionary piece; or of a form that
       only issued keys have, wherever it stands.
    0: letters only, or digits only, or mostly dictionary pieces, or a UUID, or named as a digest or commit, without
       an assignment; or, assigned too, letters only that are mostly dictionary pieces; or, where ``findings`` has a
       column ``common``, a value that is common and of no issued form.
    """
    f = F.col("features")
    mixed = ((f["digits"] > 0) & (f["digits"] < 0.95)) | ((f["digits"] == 0) & (f["marks"] > 0) & (f["capitals"] > 0) & (f["small"] > 0))
    word = (f["digits"] == 0) & (f["marks"] == 0) & (f["coverage"] > 0.6)
    harmless = (f["digits"] == 0) | (f["digits"] == 1) | (f["coverage"] > 0.6) | (f["uuid"] == 1) | (f["digest"] == 1)
    common = F.col("common") if "common" in findings.columns else F.lit(False)
    label = F.when(f["issued"] == 1, 1).when(common, 0).when((f["assigned"] == 1) & mixed & (f["coverage"] < 0.5), 1).when(
        ((f["assigned"] == 0) & harmless) | word, 0
    )
    return findings.withColumn("label", label).where("label is not null")


def _unnamed(findings: DataFrame) -> DataFrame:
    """Distinct findings with ``own``, a hash, in place of the value: values are not written to any file."""
    kept = [F.col(c) for c in ("features", "label") if c in findings.columns]
    return findings.select(F.xxhash64("value").alias("own"), *kept).distinct()


def with_common(findings: DataFrame) -> DataFrame:
    """``findings`` (own, features) with ``common``: beside at least COMMON different words on the left, by bucket.

    Copies of a document show a value beside the same word, so a copied secret is not common.
    """
    # at most BUCKETS rows of a value reach the second count
    beside = findings.select("own", F.col("features.left").alias("left")).distinct().groupBy("own").count()
    common = beside.where(F.col("count") >= COMMON).select("own", F.lit(True).alias("common"))
    return findings.join(common, "own", "left").withColumn("common", F.coalesce("common", F.lit(False)))


def _odds(counts: list[dict[int, list[int]]]) -> list[Column]:
    """For each of WORDS the log odds of label 1 by bucket, as one array, from {bucket: [label 0, label 1]}."""
    out = []
    for count in counts:
        n0, n1 = (sum(c[k] for c in count.values()) for k in (0, 1))
        at = {b: math.log((c[1] + 1) / (n1 + 2)) - math.log((c[0] + 1) / (n0 + 2)) for b, c in count.items()}
        # an unseen bucket says nothing; one literal, which the optimizer folds into an array
        out.append(F.split(F.lit(",".join(f"{at.get(b, 0.0):.6g}" for b in range(BUCKETS))), ",").cast("array<double>"))
    return out


def _seen(f: Column, odds: list[Column]) -> Column:
    """What the trees see: NUMBERS, and for each of WORDS the odds of its bucket."""
    words = [F.get(o, f[w].cast("int")).alias(f"{w}_odds") for w, o in zip(WORDS, odds, strict=True)]
    return F.struct(*[f[n].alias(n) for n in NUMBERS], *words)


def train(labelled: DataFrame, per_class: int = TRAIN_PER_CLASS, folder: str | None = None) -> Callable[[Column], Column]:
    """Fit a forest to findings (value, features, label), at most ``per_class`` of each; returns its score.

    The odds of words are counted over all labelled findings.
    """
    return _fit(written(_unnamed(labelled), folder or shared_dir(labelled.sparkSession), "labelled"), per_class)


def _fit(labelled: DataFrame, per_class: int) -> Callable[[Column], Column]:
    """``train`` for findings (own, features, label)."""
    numbers = [f"features.{n}" for n in [*NUMBERS, *WORDS]]
    fold = F.pmod(F.xxhash64("own"), F.lit(FOLDS)).cast("int")
    table = labelled.select(F.xxhash64("own", *numbers).alias("order"), fold.alias("fold"), "features", F.col("label").cast("int"))
    # at most WORDS x BUCKETS x FOLDS x 2 rows come to the driver
    words = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"features.{w}").cast("int").alias("bucket")) for i, w in enumerate(WORDS)]))
    counted = table.select("fold", "label", words.alias("w")).groupBy("fold", "label", "w.side", "w.bucket").count().collect()
    totals: dict[int, int] = {}
    whole: list[dict[int, list[int]]] = [{} for _ in WORDS]
    others: list[list[dict[int, list[int]]]] = [[{} for _ in WORDS] for _ in range(FOLDS)]
    for r in counted:
        if r["side"] == 0:
            totals[r["label"]] = totals.get(r["label"], 0) + r["count"]
        for count in [whole, *[others[k] for k in range(FOLDS) if k != r["fold"]]]:
            count[r["side"]].setdefault(r["bucket"], [0, 0])[r["label"]] += r["count"]
    if not totals.get(0) or not totals.get(1):
        share = 1.0 if totals.get(1) else 0.0
        warnings.warn(f"no forest was fitted: labelled findings by class are {totals}; every candidate scores {share}", stacklevel=3)
        return lambda f: F.lit(share)

    def smallest(k: int) -> DataFrame:
        # the hash is even, so about twice per_class rows lie below the limit; only they go to the one sorting task
        below = min(1.0, 2 * per_class / totals[k])
        own = table.where((F.col("label") == k) & (F.col("order") <= int(-(2**63) + below * (2**64 - 2048))))
        return own.orderBy("order", *numbers).limit(per_class)

    by_fold = [F.array(*side) for side in zip(*[_odds(o) for o in others], strict=True)]
    seen = _seen(F.col("features"), [F.get(o, F.col("fold")) for o in by_fold])
    sample = smallest(0).unionByName(smallest(1)).select(seen.alias("seen"), F.col("label").cast("double"))
    sample = sample.select("seen.*", "label").persist()
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(sample).select("vector", "label")
    learner = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=11)
    model = learner.fit(vectors)
    sample.unpersist()
    vote, odds = forest(model.toDebugString), _odds(whole)
    return lambda f: bound(_seen(f, odds), vote)


def held_out(labelled: DataFrame, per_class: int = TRAIN_PER_CLASS, folder: str | None = None) -> DataFrame:
    """label, predicted, count over the findings whose value falls into one of FOLDS folds, by a forest fitted to the rest."""
    table = written(_unnamed(labelled), folder or shared_dir(labelled.sparkSession), "held-out")
    # another hash than that of the folds inside the fit
    out = F.pmod(F.xxhash64(F.lit("held out"), "own"), F.lit(FOLDS)) == 0
    score = _fit(table.where(~out), per_class)
    judged = table.where(out).select("label", (score(F.col("features")) >= 0.5).cast("int").alias("predicted"))
    return judged.groupBy("label", "predicted").count()


def forest(text: str) -> Callable[[Column], Column]:
    """The share of trees that vote 1, as nested conditions, from a model's printed form."""
    trees: list = []
    lines = iter([line.strip() for line in text.splitlines()])

    def node(line: str):
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        which, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node(next(lines))
        next(lines)  # the Else line repeats the condition
        return int(which), float(limit), low, node(next(lines))

    for line in lines:
        if line.startswith("Tree"):
            trees.append(node(next(lines)))

    def vote(tree, f: Column) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        which, limit, low, high = tree
        return F.when(f[FEATURES[which]] <= limit, vote(low, f)).otherwise(vote(high, f))

    def score(f: Column) -> Column:
        total = vote(trees[0], f)
        for tree in trees[1:]:
            total = total + vote(tree, f)
        return total / len(trees)

    return score


def candidates(documents: DataFrame, path: str = "source") -> DataFrame:
    """One row per candidate: doc_id, value, features."""
    found = _with_candidates(documents.select("doc_id", "text", path), path).where("__found is not null")
    judged = found.select("doc_id", F.explode(_judged(lambda f: F.lit(0.0))).alias("c"))
    return judged.select("doc_id", "c.value", "c.features")


def train_by_rule(documents: DataFrame, path: str = "source", folder: str | None = None) -> Callable[[Column], Column]:
    """Fit on the findings of all documents, labelled by ``labelled_by_rule``; only ``TRAIN_PER_CLASS`` bounds them."""
    folder = folder or shared_dir(documents.sparkSession)
    found = written(_unnamed(candidates(documents, path)), folder, "findings")
    return _fit(written(labelled_by_rule(with_common(found)), folder, "labelled"), TRAIN_PER_CLASS)


def scan(documents: DataFrame, score: Callable[[Column], Column], path: str = "source") -> DataFrame:
    """One row per finding: doc_id, ordinal, start, length, sha256, score, is_secret.  The secret itself is not shown."""
    found = _with_candidates(documents.select("doc_id", "text", path), path).where("__found is not null")
    sizes = F.transform(F.slice("__gaps", 1, F.size("__found")), F.length)
    own = F.transform("__found", F.length)
    placed = found.select(F.col("doc_id").cast("long"), sizes.alias("gap"), own.alias("len"), _judged(score).alias("c"))
    # running start of each candidate: gaps and candidates before it
    starts = F.aggregate(
        F.arrays_zip("gap", "len"),
        F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at")),
        lambda a, x: F.struct(
            F.array_append(a["starts"], a["at"] + x["gap"]).alias("starts"), (a["at"] + x["gap"] + x["len"]).alias("at")
        ),
        lambda a: a["starts"],
    )
    rows = placed.select("doc_id", starts.alias("starts"), F.posexplode("c").alias("ordinal", "c"))
    return rows.select(
        "doc_id",
        "ordinal",
        F.get("starts", F.col("ordinal")).alias("start"),
        F.length("c.value").alias("length"),
        F.sha2(F.col("c.value").cast("binary"), 256).alias("sha256"),
        F.col("c.score").alias("score"),
        (F.col("c.score") >= 0.5).alias("is_secret"),
    )


def redacted(documents: DataFrame, score: Callable[[Column], Column], path: str = "source") -> DataFrame:
    """``documents`` with every secret in ``text`` replaced; all other columns and rows unchanged."""
    marked = _with_candidates(documents, path).withColumn("__found", F.transform(_judged(score), lambda c: F.when(c["score"] >= 0.5, REDACTED).otherwise(c["value"])))
    joined = F.array_join(F.zip_with("__gaps", "__found", lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    text = F.when(F.col("__found").isNull(), F.col("text")).otherwise(joined)
    return marked.withColumn("text", text).select(*documents.columns)
