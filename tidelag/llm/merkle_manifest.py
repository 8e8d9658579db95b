"""Merkle manifest of a document table with octopus multiproofs.

Every row is a leaf of its language's tree, whose nodes have up to FANOUT children; the language subroots are the
leaves of one more tree, whose root stands for the whole table.

1. Leaves are hashed in the scan.  Only digests and ids travel further: they are dealt by range of (lang, doc_id), and
   a position is a row's place in its partition plus the rows of its language in the partitions before it.
2. ``grown`` builds all nodes, level by level, as a grouped aggregate over (tree, place of the parent).
3. ``proofs`` cuts the leaves of a language into partitions of neighbours.  ``missing`` gives the least set of nodes a
   partition can't derive itself but needs for all its proofs; these are fetched by one join on their coordinates, so
   nodes that many leaves share are fetched once a partition.  Each partition then derives its interior nodes once and
   expands the proof of every leaf from them.

Digests are lowercase hex texts and are hashed as such.  A proof is the text of all sibling digests, from the leaf's
run up to the root, left to right.

Defined results: a NULL field is hashed as ``-``, an empty text as ``0:``; a NULL lang is a language of its own, before
all others; a NULL doc_id comes first in its language and is never tampered with; rows of one id are ordered by their
digest and equal rows have a leaf each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelag.llm.common import id_crc, shared_dir, written

FANOUT = 8
PARTITION_LEAVES = 4096  # leaves whose proofs are expanded together
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TOP = ""  # the tree over the subroots


def _tree() -> Column:
    """The tree of a language: its text, led by a mark that tells NULL from an empty one and sorts it first."""
    return F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("lang").cast("string")))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: Sequence[Column]) -> Column:
    """Digest of a row: its fields, each led by its byte count so that no two rows read alike."""
    return _digest(F.concat(*[_field(f) for f in fields]))


def leaves(documents: DataFrame) -> DataFrame:
    """doc_id, tree, leaf and ``other``: the leaf after tampering, for the third of the ids where it happens."""
    lowered = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    changed = [lowered if f == "text" else F.col(f) for f in FIELDS]
    return documents.select(
        F.col("doc_id").cast("long"),
        _tree().alias("tree"),
        leaf_of([F.col(f) for f in FIELDS]).alias("leaf"),
        F.when(id_crc("doc_id") % 3 == 0, leaf_of(changed)).alias("other"),
    )


def placed(rows: DataFrame, tree: str, order: Sequence[str], folder: str, name: str) -> DataFrame:
    """``rows`` with ``place``: from 0 inside each ``tree``, by ``order``.

    Equal rows, however many, are dealt apart by their place of reading; their order does not show.
    """
    spread = rows.withColumn("__at", F.monotonically_increasing_id())
    keys = [tree, *order, "__at"]
    dealt = spread.repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = written(dealt.drop("__at").withColumn("__seq", F.monotonically_increasing_id()), folder, name)
    table = table.withColumn("__part", F.shiftrightunsigned("__seq", 33))
    # One row per tree and partition: few, however many rows there are.
    spans = table.groupBy(tree, "__part").agg(F.count("*").alias("__n"), F.min("__seq").alias("__first"))
    before = Window.partitionBy(tree).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(tree, "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    place = F.col("__seq") - F.col("__first") + F.col("__base")
    return table.join(spans, [tree, "__part"]).select(*rows.columns, place.alias("place"))


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above ``nodes`` (tree, place, digest); a node that is alone in its tree has none."""
    run = F.array_sort(F.collect_list(F.struct("place", "digest")))
    joined = F.array_join(F.transform(run, lambda n: n["digest"]), "")
    return (
        nodes.groupBy("tree", F.shiftright("place", FANOUT.bit_length() - 1).alias("above"))
        .agg(_digest(joined).alias("digest"), F.count("*").alias("children"))
        .where("above > 0 or children > 1")  # a first run of one node is the whole level
        .select("tree", F.col("above").alias("place"), "digest")
    )


def grown(level: DataFrame, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots) of all trees over ``level`` (tree, place, digest).

    ``nodes``: tree, level, place, digest of every level.  ``roots``: tree, leaves, digest.
    """
    sizes = level.groupBy("tree").agg(F.count("*").alias("leaves"))
    step, levels = 0, [level.withColumn("level", F.lit(0))]
    while True:
        step += 1
        level = written(_parents(level), folder, f"{name}-{step}")
        if level.isEmpty():
            break
        levels.append(level.withColumn("level", F.lit(step)))
    nodes = levels[0].select("tree", "level", "place", "digest")
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    top = nodes.where("place = 0").groupBy("tree").agg(F.max_by("digest", "level").alias("digest"))
    return nodes, top.join(sizes, "tree").select("tree", "leaves", "digest")


def widths(leaves: int) -> list[int]:
    """Nodes on each level of a tree, from its leaves to its root."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANOUT))
    return out


def missing(known: np.ndarray, leaves: int) -> list[np.ndarray]:
    """Per level, the least set of places that proofs of the ``known`` leaves need and can't derive from each other."""
    out = []
    for width in widths(leaves)[:-1]:
        above = np.unique(known // FANOUT)
        runs = (above[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        out.append(np.setdiff1d(runs[runs < width], known))
        known = above
    return out


_WANTED = "tree string, chunk long, of string, level int, place long"


def wanted(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The node coordinates that each partition of leaves lacks, in its language's tree and in the tree of subroots."""
    for batch in chunks:
        found = []
        for c in batch.itertuples():
            for of, known, size in (
                (c.tree, np.arange(c.first, c.last + 1), c.leaves),
                (TOP, np.array([c.lang_place]), c.langs),
            ):
                for level, places in enumerate(missing(known, size)):
                    found += [(c.tree, c.chunk, of, level, int(p)) for p in places]
        yield pd.DataFrame(found, columns=["tree", "chunk", "of", "level", "place"])


class _Levels:
    """One tree as far as a partition knows it: digests by level and place, interior nodes derived once."""

    def __init__(self, size: int, known: dict[int, str], fetched: dict[tuple[int, int], str]):
        self.widths = widths(size)
        self.levels = [dict(known)]
        for level in range(len(self.widths) - 1):
            below = self.levels[level]
            below |= {p: d for (at, p), d in fetched.items() if at == level}
            own = {p // FANOUT for p in (known if level == 0 else self.levels[level])}
            derived = {}
            for above in own:
                run = [below.get(p) for p in self._run(level, above)]
                if None not in run:
                    derived[above] = _sha("".join(run))
            self.levels.append(derived)
        self._tails: dict[tuple[int, int], str] = {}

    def _run(self, level: int, above: int) -> range:
        return range(above * FANOUT, min((above + 1) * FANOUT, self.widths[level]))

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, level: int, place: int) -> tuple[str, str]:
        """Digests left and right of a node in its run."""
        run = self._run(level, place // FANOUT)
        at = self.levels[level]
        return "".join(at[p] for p in run if p < place), "".join(at[p] for p in run if p > place)

    def proof(self, level: int, place: int) -> str:
        """Sibling digests from a node up to the root; what leaves share is put together once."""
        if level == len(self.widths) - 1:
            return ""
        key = (level, place)
        if level and key in self._tails:
            return self._tails[key]
        text = "".join(self.siblings(level, place)) + self.proof(level + 1, place // FANOUT)
        if level:
            self._tails[key] = text
        return text

    def folded(self, place: int, digest: str) -> str:
        """The root that a leaf's digest gives with the siblings of the leaf at ``place``."""
        for level in range(len(self.widths) - 1):
            left, right = self.siblings(level, place)
            digest = _sha(left + digest + right)
            place //= FANOUT
        return digest


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_PROVED = "doc_id string, leaf string, subroot string, proof_sha256 string, folded_root string"


def expanded(rows: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
    """Proofs of the leaves of one partition; at most PARTITION_LEAVES rows and a few fetched nodes per level.

    One row of ``fetched`` has no digest; it tells the sizes of the two trees and the language's place.
    """
    if rows.empty:
        return pd.DataFrame(columns=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])
    nodes: dict[str, dict[tuple[int, int], str]] = {}
    for n in fetched[fetched["digest"].notna()].itertuples():
        nodes.setdefault(n.of, {})[int(n.level), int(n.place)] = n.digest
    sizes = fetched[fetched["digest"].isna()].iloc[0]
    own = _Levels(int(sizes["leaves"]), dict(zip(rows["place"], rows["leaf"])), nodes.get(rows["tree"].iloc[0], {}))
    lang_place = int(sizes["lang_place"])
    top = _Levels(int(sizes["langs"]), {lang_place: own.root}, nodes.get(TOP, {}))
    above = top.proof(0, lang_place)
    proofs, folded = [], []
    for place, leaf, other in zip(rows["place"], rows["leaf"], rows["other"]):
        proofs.append(_sha(own.proof(0, place) + above))
        if isinstance(other, str) and other != leaf:
            folded.append(top.folded(lang_place, own.folded(place, other)))
        else:
            folded.append(top.root)
    return pd.DataFrame(
        {
            "doc_id": rows["doc_id"],
            "leaf": rows["leaf"],
            "subroot": own.root,
            "proof_sha256": proofs,
            "folded_root": folded,
        }
    )


def manifest(
    documents: DataFrame, partition_leaves: int = PARTITION_LEAVES, folder: str | None = None
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``documents``."""
    folder = folder or shared_dir(documents.sparkSession)
    hashed = written(leaves(documents), folder, "hashed")
    at = written(placed(hashed, "tree", ["doc_id", "leaf"], folder, "sorted"), folder, "leaves")
    nodes, subroots = grown(at.select("tree", "place", F.col("leaf").alias("digest")), folder, "node")
    subroots = written(subroots, folder, "subroots")
    langs = placed(subroots.withColumn("all", F.lit(TOP)), "all", ["tree"], folder, "langs")
    langs = written(langs.withColumnRenamed("place", "lang_place").drop("all"), folder, "trees")
    top, roots = grown(
        langs.select(F.lit(TOP).alias("tree"), F.col("lang_place").alias("place"), "digest"), folder, "top"
    )
    made = roots.first()  # one row at most
    root, count = (made["digest"], made["leaves"]) if made else ("", 0)

    sized = langs.select("tree", "leaves", "lang_place").withColumn("langs", F.lit(count).cast("long"))
    # Ids travel as text: pandas would make floats of a column with NULLs.
    cut = at.withColumn("chunk", F.call_function("div", F.col("place"), F.lit(partition_leaves))).withColumn(
        "doc_id", F.col("doc_id").cast("string")
    )
    chunks = cut.groupBy("tree", "chunk").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    chunks = written(chunks.join(sized.hint("rebalance"), "tree"), folder, "chunks")
    lacking = chunks.mapInPandas(wanted, _WANTED)
    known = nodes.unionByName(top).withColumnRenamed("tree", "of")
    # Tree sizes come with the fetched nodes, so leaves are dealt once, by partition, and never by language alone.
    told = chunks.select("tree", "chunk", "leaves", "lang_place", "langs")
    fetched = told.unionByName(lacking.join(known, ["of", "level", "place"]), allowMissingColumns=True)
    proved = (
        cut.groupBy("tree", "chunk")
        .cogroup(fetched.groupBy("tree", "chunk"))
        .applyInPandas(expanded, _PROVED)
    )
    return proved.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "leaf",
        "subroot",
        F.lit(root).alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
