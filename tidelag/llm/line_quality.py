"""Quality rules by line labelling: a linear-chain conditional random field marks each line of a text as content
or boilerplate; a document is kept when content lines hold at least half of its characters.

Defined results: a NULL or empty text has no words and fails the base rules; repeated rows are judged one by
one; an empty table gives an empty result; only ``doc_id`` and ``text`` are read, so extra columns are ignored
(``filter_documents`` passes them through).  Without usable labels every line counts as content.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.llm.common import hash_sample, texts_of

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double"
)

TRAIN_PER_CLASS = 600  # labelled documents of each class used to fit the field
TRAIN_LINES = 64  # training sequences are cut into runs of so many lines
MIN_CONTENT_SHARE = 0.5

_SYMBOLS = b"#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SMALL = bytes(range(ord("a"), ord("z") + 1))
_DIGITS = b"0123456789"
_ENDS = (b".", b"!", b"?", b":", b";", b'"')
N_FEATURES = 10  # bits of a line's feature mask


def line_mask(line: bytes, tokens: list[bytes], n_symbols: int, repeated: bool) -> int:
    """The line's features as bits; ``tokens`` are its words, never none."""
    size = len(line)
    mask = 1 if n_symbols * 50 > size else 0
    if n_symbols * 10 > size:
        mask |= 2
    if line.count(b"!") * 20 > size:
        mask |= 4
    capitals = size - len(line.translate(None, _CAPITALS))
    if capitals * 2 > capitals + size - len(line.translate(None, _SMALL)):
        mask |= 8
    if len(tokens) <= 3:
        mask |= 16
    if not tokens[-1].endswith(_ENDS):
        mask |= 32
    if repeated:
        mask |= 64
    if (size - len(line.translate(None, _DIGITS))) * 5 > size:
        mask |= 128
    if len(tokens) > 5 and len(set(tokens)) * 2 < len(tokens):
        mask |= 256
    if size > 30 * len(tokens):
        mask |= 512
    return mask


@dataclass
class Measured:
    """Base figures of one text, and its lines with a word as feature masks and sizes."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    masks: list[int]
    sizes: list[int]

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def repeated_words(tokens: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    windows = list(zip(tokens, tokens[1:], tokens[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, reach = 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered += i + 3 - max(reach, i)
            reach = i + 3
    return covered


def measure(text: str | None) -> Measured:
    text = text or ""
    tokens: list[bytes] = []
    masks: list[int] = []
    sizes: list[int] = []
    seen: set[bytes] = set()
    n_dup = n_symbols = 0
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        own = line.split()  # bytes split at exactly space, \t, \n, \v, \f, \r
        if not own:
            continue
        symbols = len(line) - len(line.translate(None, _SYMBOLS))
        repeated = line in seen
        n_dup += repeated
        seen.add(line)
        n_symbols += symbols
        tokens += own
        masks.append(line_mask(line, own, symbols, repeated))
        sizes.append(len(line))
    chars = len(text) - sum(map(text.count, _SPACES))
    return Measured(len(tokens), chars, n_symbols, n_dup, repeated_words(tokens), masks, sizes)


@dataclass
class LineField:
    """A fitted two-state chain: ``emission[mask]`` is the log-odds of content, ``switch`` the cost of changing."""

    emission: list[float]
    to_content: float
    to_boilerplate: float
    start: float

    def viterbi(self, masks: list[int]) -> list[bool]:
        """The likeliest labels, True for content; ties go to content."""
        if not masks:
            return []
        content, boiler = self.start + self.emission[masks[0]], 0.0
        back: list[tuple[bool, bool]] = []
        for mask in masks[1:]:
            from_boiler, from_content = boiler + self.to_content, content + self.to_boilerplate
            back.append((content >= from_boiler, from_content > boiler))
            content, boiler = max(content, from_boiler) + self.emission[mask], max(boiler, from_content)
        state = content >= boiler
        labels = [state]
        for stay, leave in reversed(back):
            state = stay if state else leave
            labels.append(state)
        return labels[::-1]

    def content_share(self, found: Measured) -> float:
        """Share of characters in content lines; 0 without lines."""
        total = sum(found.sizes)
        good = sum(s for s, label in zip(found.sizes, self.viterbi(found.masks), strict=True) if label)
        return good / total if total else 0.0


ALL_CONTENT = LineField([1.0] * (1 << N_FEATURES), 0.0, -1.0, 0.0)


def _design(masks: np.ndarray) -> np.ndarray:
    bits = (masks[..., None] >> np.arange(N_FEATURES)) & 1
    return np.concatenate([np.ones((*masks.shape, 1)), bits], axis=-1)


def fit_field(texts: list[tuple[list[int], int]], steps: int = 120, l2: float = 1e-3) -> LineField:
    """Fit the field to (line masks, label of the document) by conditional likelihood.

    Lines of good documents count as content.  Lines of bad documents count as boilerplate, save those whose
    mask is as common in good documents as in bad ones: also bad documents hold ordinary lines.
    """
    good: Counter[int] = Counter()
    bad: Counter[int] = Counter()
    for masks, label in texts:
        (good if label else bad).update(masks)
    if not good or not bad:
        return ALL_CONTENT
    n_good, n_bad = sum(good.values()), sum(bad.values())
    plain = {m for m in bad if (good[m] + 0.5) * n_bad >= (bad[m] + 0.5) * n_good}
    runs = [
        (masks[i : i + TRAIN_LINES], [label or m in plain for m in masks[i : i + TRAIN_LINES]])
        for masks, label in texts
        for i in range(0, len(masks), TRAIN_LINES)
    ]
    runs.sort(key=lambda run: -len(run[0]))
    n, longest = len(runs), len(runs[0][0])
    masks, truth, there = np.zeros((n, longest), int), np.zeros((n, longest)), np.zeros((n, longest), bool)
    for i, (m, y) in enumerate(runs):
        masks[i, : len(m)], truth[i, : len(m)], there[i, : len(m)] = m, y, True
    live = there.sum(axis=0)  # runs are sorted, so those with a line t are the first live[t]
    design = _design(masks)
    flat = design[there]
    stepped = there[:, 1:]
    up = ((truth[:, 1:] == 1) & (truth[:, :-1] == 0) & stepped).sum()
    down = ((truth[:, 1:] == 0) & (truth[:, :-1] == 1) & stepped).sum()
    observed = np.concatenate([truth[there] @ flat, [up, down, truth[:, 0].sum()]])
    theta = np.zeros(flat.shape[1] + 3)
    theta[-3:-1] = -1.0
    momentum, scale = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        expected = _expected(theta, design, flat, there, live)
        gradient = (observed - expected) / there.sum() - l2 * theta
        momentum = 0.9 * momentum + 0.1 * gradient
        scale = 0.99 * scale + 0.01 * gradient**2
        theta += 0.2 * momentum / (1 - 0.9**step) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)
    table = _design(np.arange(1 << N_FEATURES)) @ theta[:-3]
    return LineField(table.tolist(), *map(float, theta[-3:]))


def _expected(theta, design, flat, there, live) -> np.ndarray:
    """Expected feature counts under the field, by the forward-backward recursion over all runs at once."""
    score = design @ theta[:-3]
    into, out, start = theta[-3:]
    n, longest = score.shape
    ahead, behind = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))  # [..., 1] is content
    ahead[0, :, 1] = start + score[:, 0]
    for t in range(1, longest):
        k = live[t]
        before = ahead[t - 1, :k]
        ahead[t, :k, 1] = np.logaddexp(before[:, 1], before[:, 0] + into) + score[:k, t]
        ahead[t, :k, 0] = np.logaddexp(before[:, 0], before[:, 1] + out)
    for t in range(longest - 2, -1, -1):
        k = live[t + 1]
        one, zero = behind[t + 1, :k, 1] + score[:k, t + 1], behind[t + 1, :k, 0]
        behind[t, :k, 1] = np.logaddexp(one, zero + out)
        behind[t, :k, 0] = np.logaddexp(zero, one + into)
    whole = np.logaddexp(ahead[0, :, 1] + behind[0, :, 1], ahead[0, :, 0] + behind[0, :, 0])
    content = np.exp(ahead[:, :, 1] + behind[:, :, 1] - whole).T
    ups = downs = 0.0
    for t in range(1, longest):
        k = live[t]
        ups += np.exp(ahead[t - 1, :k, 0] + into + score[:k, t] + behind[t, :k, 1] - whole[:k]).sum()
        downs += np.exp(ahead[t - 1, :k, 1] + out + behind[t, :k, 0] - whole[:k]).sum()
    return np.concatenate([content[there] @ flat, [ups, downs, content[:, 0].sum()]])


def train(documents: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> LineField:
    """Fit on at most ``per_class`` labelled documents of each class (those of smallest id hash), whole texts."""
    known = labels.where("doc_id is not null").select("doc_id", F.col("quality").alias("label")).distinct()
    chosen = hash_sample(known.where("label = 1"), "doc_id", per_class).unionByName(
        hash_sample(known.where("label = 0"), "doc_id", per_class)
    )

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t).masks for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("doc_id"), pa.array(found, pa.list_(pa.int32()))],
                names=["label", "doc_id", "masks"],
            )

    sample = texts_of(documents, chosen).select("label", "doc_id", "text")
    rows = sample.mapInArrow(masks, "label int, doc_id long, masks array<int>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.masks))
    return fit_field([(list(r.masks), r.label) for r in rows if r.masks])


def _judge(field: LineField) -> Callable[[str | None], tuple]:
    def judge(text: str | None) -> tuple:
        m = measure(text)
        share = field.content_share(m)
        failed = m.base_failed
        kept = not failed and share >= MIN_CONTENT_SHARE
        return m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, kept, share

    return judge


_TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
ROWS_AT_ONCE = 256


def judge_lines(documents: DataFrame, field: LineField) -> DataFrame:
    """One row of ``SCHEMA`` per document."""
    judge = _judge(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                columns = zip(*map(judge, batch.column("text").to_pylist()), strict=True)
                arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *_NAMES])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def filter_documents(documents: DataFrame, field: LineField) -> DataFrame:
    """The rows of ``documents`` that are kept, all columns unchanged; no join and no shuffle."""
    judge = _judge(field)
    at_text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                kept = [judge(t)[6] for t in batch.column(at_text).to_pylist()]
                yield batch.filter(pa.array(kept, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
