"""Groups of spelling variants among the words of a corpus, found by pivotal grams.

Words are counted over all documents; those with enough letters and occurrences are the vocabulary.  Two words are near
if one edit (an inserted, deleted or replaced code point) turns one into the other.

1. Bigrams are ranked by how many words have them, rare ones first.  The ``prefix`` of a word is its three rarest
   bigrams with everything ranked equal to the third; by dynamic programming two disjoint ones of them are chosen whose
   counts add up least, the word's ``pivots`` (three bigrams always hold two disjoint ones).
2. One edit can't touch both pivots, so the pivot it spares stands in the other word too, and in its prefix where that
   one's last rank is not below.  So pivots of each word are looked up among the prefixes of the others.
3. Position limits: an edit behind the first pivot leaves its distance from the start and all text up to its end as
   they are; any other edit leaves the second pivot's distance from the end and all text from it on.  In both cases the
   first or the second half of the word is spared too.  Pivot, distance, length and spared text are the key of an
   equality join, which proposes few pairs that are not near.
4. Proposed pairs are verified on the words, inside the join.  Near words are counted without listing them.

Defined results: NULL and empty texts have no words; a NULL doc_id counts as an empty one where words are altered;
equal rows count each; ties of counts fall to the word that is smallest in code-point order; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.llm.common import shared_dir, written

MIN_LETTERS = 6
MIN_COUNT = 5
DOMINANCE = 5  # a word's form has at least so many times its occurrences
ALTERED = 199  # of so many (document, run) pairs one loses a letter
_LETTERS = "A-Za-z\\u00C0-\\u00FF"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(documents: DataFrame, altered: int | None = ALTERED) -> DataFrame:
    """``word``: every run of letters, A-Z lower-cased, of at least MIN_LETTERS.

    With ``altered`` set, a hash of document and run takes one letter out of a small share of the runs.
    """
    runs = documents.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.split(F.col("text").cast("string"), f"[^{_LETTERS}]+")).alias("run"),
    ).where(F.char_length("run") >= MIN_LETTERS)
    runs = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    if altered is None:
        return runs.select(F.col("run").alias("word"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % altered == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= MIN_LETTERS)


def vocabulary(words: DataFrame) -> DataFrame:
    """word, n: distinct words with at least MIN_COUNT occurrences."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


# Every bigram of a word with its place, from 0.
_GRAMS = "transform(sequence(0, char_length(word) - 2), i -> struct(i as at, substring(word, i + 1, 2) as gram))"

# All bigrams of a word by place, with NULL counts for those outside the prefix.  ``one`` is the cheapest bigram so
# far, ``ready`` the cheapest that ends before the one at hand begins, ``two`` the cheapest disjoint pair so far.
_ONE, _TWO = "struct<cost: bigint, at: int>", "struct<cost: bigint, a: int, b: int>"
_PIVOTS = f"""aggregate(
    array_sort(transform(grams, g -> struct(g.at as at, if(struct(g.freq, g.gram) <= last, g.freq, null) as freq))),
    named_struct('ready', cast(null as {_ONE}), 'one', cast(null as {_ONE}), 'two', cast(null as {_TWO})),
    (s, g) -> named_struct(
        'ready', s.one,
        'one', if(g.freq is null, s.one, least(s.one, named_struct('cost', g.freq, 'at', g.at))),
        'two', if(g.freq is null or s.ready is null, s.two,
                  least(s.two, named_struct('cost', s.ready.cost + g.freq, 'a', s.ready.at, 'b', g.at)))),
    s -> s.two)"""


def marked(vocab: DataFrame) -> DataFrame:
    """word, n, prefix (array of places), last (rank of the prefix's end), a and b (places of the pivots)."""
    grams = vocab.selectExpr("word", "n", f"inline({_GRAMS})")
    # At most one row per pair of letters of the alphabet, which bounds the broadcast.
    counts = grams.select("word", "gram").distinct().groupBy("gram").agg(F.count("*").alias("freq"))
    ranked = (
        grams.join(F.broadcast(counts), "gram")
        .groupBy("word", "n")
        .agg(F.expr("array_sort(collect_list(struct(freq, gram, at))) as grams"))
    )
    third = ranked.selectExpr("word", "n", "grams", "struct(grams[2].freq, grams[2].gram) as last")
    return third.selectExpr(
        "word",
        "n",
        "last",
        "transform(filter(grams, g -> struct(g.freq, g.gram) <= last), g -> g.at) as prefix",
        f"{_PIVOTS} as pivots",
    ).selectExpr("word", "n", "last", "prefix", "pivots.a as a", "pivots.b as b")


def _keys(at: str) -> str:
    """SQL for the join keys of the bigram at ``at``, given the shorter word's length ``m`` and who is longer.

    Two keys for an edit behind the bigram, of which the second only counts where half the word reaches beyond it, and
    two for one before it.
    """
    size, half = "char_length(word)", "m div 2"
    head, tail = f"{at} + 2", f"{size} - {at}"
    left, right = "left(word, {})".format, "right(word, {})".format
    return f"""array(
        struct(true as behind, xxhash64(1, {at}, m, longer, {left(f'greatest({head}, {half})')}) as key),
        if({head} < {half},
           struct(true as behind, xxhash64(2, {at}, m, longer, {left(head)}, {right(f'm - {half}')}) as key), null),
        struct(false as behind, xxhash64(3, {tail}, m, longer, {right(f'greatest({tail}, m - {half})')}) as key),
        if({tail} < m - {half},
           struct(false as behind, xxhash64(4, {tail}, m, longer, {right(tail)}, {left(half)}) as key), null))"""


def near_pairs(vocab: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every unordered pair of near words, once."""
    words = marked(vocab)
    # ``longer`` tells the three cases apart: words of one length, the asking word longer, or the other longer.
    asked = "inline(array(struct(size as m, 0 as longer), struct(size - 1 as m, 1 as longer), struct(size as m, 2 as longer)))"
    held = "inline(array(struct(size as m, 0 as longer), struct(size as m, 1 as longer), struct(size - 1 as m, 2 as longer)))"
    sized = words.withColumn("size", F.char_length("word"))
    asking = (
        sized.selectExpr("word", "n", "last", "a", "b", asked)
        .selectExpr("word", "n", "last", f"filter(concat(filter({_keys('a')}, k -> k.behind), filter({_keys('b')}, k -> not k.behind)), k -> k is not null) as keys")
        .selectExpr("word as w", "n as n_w", "last as last_w", "inline(keys)")
        .drop("behind")
    )
    holding = (
        sized.selectExpr("word", "n", "last", "size", "explode(prefix) as at")
        .selectExpr("word", "n", "last", "at", held)
        .selectExpr("word as v", "n as n_v", "last as last_v", f"inline(filter({_keys('at')}, k -> k is not null))")
        .drop("behind")
    )
    # A word has many keys, which Spark does not count when it sizes a side: without the hint it broadcasts one.
    found = asking.join(holding.hint("merge"), "key").where("last_w <= last_v and w <> v and levenshtein(w, v, 1) = 1")
    pair = "if(w < v, named_struct('a', w, 'n_a', n_w, 'b', v, 'n_b', n_v), named_struct('a', v, 'n_a', n_v, 'b', w, 'n_b', n_w))"
    return found.selectExpr(f"inline(array({pair}))").dropDuplicates(["a", "b"])


def forms(vocab: DataFrame, pairs: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """word, n, n_near, form, form_n: how many near words each has, and the one it is taken for a variant of."""
    both = "inline(array(struct(a as word, b as other, n_b as n_other), struct(b as word, a as other, n_a as n_other)))"
    most = F.expr("min(struct(-n_other as minus, other)) as most")
    near = pairs.selectExpr(both).groupBy("word").agg(F.count("*").alias("n_near"), most)
    dominant = F.col("most.minus") * -1 >= F.col("n") * dominance
    return vocab.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(dominant, F.col("most.other")).alias("form"),
        F.when(dominant, -F.col("most.minus")).alias("form_n"),
    )


def roots(formed: DataFrame, folder: str) -> DataFrame:
    """word, root of the words that have a form: the end of its chain of forms.

    Counts grow by DOMINANCE along a chain, so it has no circle and few links; their reach doubles with every round.
    Spark would size the written words by their compressed files and broadcast them every round, hence the hints.
    """
    reach = formed.where("form is not null").select("word", F.col("form").alias("root"))
    step = 0
    while True:
        reach = written(reach, folder, f"reach-{step}")
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if reach.join(onward.hint("merge"), "root", "left_semi").isEmpty():
            return reach
        reach = reach.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        step += 1


def variants(documents: DataFrame, altered: int | None = ALTERED, folder: str | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary of ``documents``."""
    folder = folder or shared_dir(documents.sparkSession)
    vocab = written(vocabulary(occurrences(documents, altered)), folder, "vocabulary")
    formed = written(forms(vocab, near_pairs(vocab)), folder, "forms")
    ends = roots(formed, folder)
    return formed.join(ends.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
