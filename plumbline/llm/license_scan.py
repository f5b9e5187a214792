"""License scan: MinHash bands over text windows, then exact containment.

Templates are cut into word shingles.  Templates of alike size share a tier:
for shingle counts in ``(w / 2, w]``, a text is covered by windows of
``3 w / 2`` shingles that start every ``w / 2``, so wherever a template
stands, one window holds it whole.  Even a copy with only ``THRESHOLD`` of
its shingles then has a Jaccard similarity of at least ``0.8 / 3`` with its
window.  Each of ``BANDS`` minima is a band of its own, so the window and the
template share a band with probability ``1 - (1 - 0.8 / 3) ** 24 > 0.999``;
windows of unrelated text share a minimum only if they share a shingle, so
minima are taken only around shingles that some template of the tier has.
Retrieved templates are verified by the share of their distinct shingles that
stand in and around the window.

Templates are few and sent to the tasks in rounds of about ``ROUND_WORDS``
words; texts are read once a round, whole, and never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import texts_of
from .licenses import NOTICES, TEXTS

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS = 24
#: Words of the templates that a round sends to the tasks, in expectation.
ROUND_WORDS = 5_000_000
#: Shingles of a text that are looked at together.
STRETCH = 1 << 16
SEED = 5

_BLANKED = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_rng = np.random.default_rng(SEED)
_A = _rng.integers(1, 1 << 62, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 62, BANDS, dtype=np.uint64)

SCHEMA = "doc_id long, template string, containment double, first_word long, last_word long"


def shingles(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the word shingles of a whole text, in order."""
    words = (text or b"").lower().translate(_BLANKED).split()
    if len(words) < SHINGLE_WORDS:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = [0, *ends[: len(words) - SHINGLE_WORDS].tolist()]
    last = (ends[SHINGLE_WORDS - 1 :] - 1).tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(line[a:b]) for a, b in zip(first, last, strict=True)], dtype=np.uint64)


def _minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minimum of each permutation over the blocks that begin at ``starts``."""
    return np.stack([np.minimum.reduceat(hashes * a + b, starts) for a, b in zip(_A, _B, strict=True)])


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in ``ordered``."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Index:
    """Band index of a round of templates."""

    def __init__(self, templates: list[tuple[str, bytes]]):
        self.names, self.sets = [], []
        by_tier: dict[int, list[int]] = {}
        for name, text in templates:
            distinct = np.unique(shingles(text))
            if not len(distinct):
                continue
            full = len(shingles(text))
            by_tier.setdefault(max(2, 1 << (full - 1).bit_length()), []).append(len(self.names))
            self.names.append(name)
            self.sets.append(distinct)
        self.tiers, self.words = {}, {}
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *self.sets]))
        for width, members in by_tier.items():
            self.words[width] = np.unique(np.concatenate([self.sets[t] for t in members]))
            keys = np.concatenate([_minima(self.sets[t], np.array([0])) for t in members], axis=1)
            order = np.argsort(keys, axis=1, kind="stable")
            self.tiers[width] = (np.take_along_axis(keys, order, 1), np.array(members)[order])

    def _retrieved(self, hashes: np.ndarray, width: int) -> set[tuple[int, int]]:
        """``(first shingle of the window, template)`` of windows and templates that share a band."""
        keys, owners = self.tiers[width]
        step = width // 2
        starts = np.arange(0, len(hashes), step)
        blocks = _minima(hashes, starts)
        windows = blocks.copy()
        for k in (1, 2):
            windows[:, :-k] = np.minimum(windows[:, :-k], blocks[:, k:]) if blocks.shape[1] > k else windows[:, :-k]
        found = set()
        for band in range(BANDS):
            left = np.searchsorted(keys[band], windows[band], "left")
            hit = np.flatnonzero(keys[band][np.minimum(left, keys.shape[1] - 1)] == windows[band])
            for w in hit.tolist():
                at = int(left[w])
                while at < keys.shape[1] and keys[band, at] == windows[band, w]:
                    found.add((w * step, int(owners[band, at])))
                    at += 1
        return found

    def _stretches(self, hashes: np.ndarray, known: np.ndarray, width: int) -> list[tuple[int, int]]:
        """Parts of a text that hold a shingle of the tier, with two widths to either side."""
        own = known[_among(hashes[known], self.words[width])]
        if not len(own):
            return []
        breaks = np.flatnonzero(np.diff(own) > 2 * width)
        firsts, lasts = own[np.append(0, breaks + 1)], own[np.append(breaks, len(own) - 1)]
        return [
            (at, int(min(at + STRETCH, last) + 2 * width))
            for first, last in zip(firsts, lasts, strict=True)
            for at in range(max(0, int(first) - 2 * width), int(last) + 1, STRETCH)
        ]

    def scan(self, hashes: np.ndarray) -> list[tuple[str, float, int, int]]:
        """Best match of each template: name, containment, first and last word."""
        best: dict[int, tuple[float, int, int]] = {}
        known = np.flatnonzero(_among(hashes, self.vocabulary))
        for width in self.tiers:
            for at, end in self._stretches(hashes, known, width):
                part = hashes[at:end]
                for start, t in self._retrieved(part, width):
                    low = max(0, at + start - width // 2)
                    high = at + start + 2 * width
                    here = hashes[low:high]
                    place = np.flatnonzero(_among(here, self.sets[t]))
                    share = len(np.unique(here[place])) / len(self.sets[t])
                    if share >= THRESHOLD and share > best.get(t, (0.0,))[0]:
                        best[t] = (share, low + int(place[0]), low + int(place[-1]) + SHINGLE_WORDS - 1)
        return [(self.names[t], *found) for t, found in sorted(best.items())]


def _scan_batches(templates):
    def run(batches):
        index = Index(templates)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                rows += [(doc_id, *match) for match in index.scan(shingles(text))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["doc_id", "template", "containment", "first_word", "last_word"],
            )

    return run


def license_templates(spark) -> DataFrame:
    """``(template, text)`` of licence texts and of the sentences that declare one."""
    rows = [(f"license:{k}", v) for k, v in NOTICES.items()] + [(f"license-text:{k}", v) for k, v in TEXTS.items()]
    return spark.createDataFrame(rows, "template string, text string")


def scan_templates(
    docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, template, containment, first_word, last_word)`` of every match.

    ``templates(template, text)``.  One row for each document row and
    template that it contains, at its best place, and of equally good ones
    at the first; words count from 0.  Texts and templates of fewer than five
    words, null ones included, match nothing; equal templates all match; rows
    that repeat an id, or have none, each give their own matches; very long
    texts are scanned whole, a stretch at a time; other columns, whatever
    their names, are not read; an empty table gives an empty one.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = templates.where("template is not null and text is not null").select("template", "text")
    n_words = known.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    rounds = max(1, -(-n_words // ROUND_WORDS))
    result = None
    for k in range(rounds):
        # about ROUND_WORDS words
        own = known.where(F.pmod(F.xxhash64("template", "text"), F.lit(rounds)) == k).orderBy("template", "text").collect()
        part = slim.mapInArrow(_scan_batches([(r.template, r.text.encode()) for r in own]), SCHEMA)
        result = part if result is None else result.unionByName(part)
    return result
