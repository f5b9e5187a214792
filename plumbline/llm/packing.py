"""Hierarchical multi-length packing of tokenised documents.

Each document's ids end with an end id.  Whole windows of the largest context
size are cut off first; what is left of a document goes to the *tier* of the
smallest context size that holds it.  Tiers are packed from the longest to
the shortest: a window of a tier starts with one of its own pieces, and its
gap is filled with pieces of shorter tiers, best fit first; only when none
fits is one cut, so that the window ends full.  Windows are thus as long as
their tier, a power of two, and carry no padding; what a task has over at its
end is dealt into windows of falling powers of two.

Windows are gathered into step groups of about equal numbers of ids, each
with its share of every tier.

A task packs the rows of its own input split in buffers of about
``BUFFER_IDS`` ids, so no text is shuffled, memory is bounded by the buffer
and the longest text, and a task that is run again gives the same windows.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import texts_of

TIERS = (2048, 1024, 512, 256)
END_ID = 1
BUFFER_IDS = 1 << 20
#: Ids of a step group.
STEP_IDS = 1 << 17
#: White-space separated words whose ids a task remembers, and those that stay with its worker after it.
CACHED_WORDS = 300_000
KEPT_WORDS = 50_000
TOKENIZER = "word_bpe_49k.json"

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_id long"
)
IDS = ", ids array<int>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Texts are encoded in groups of about so many bytes.
GROUP_BYTES = 1 << 20
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Characters that stand for bytes in a byte-level vocabulary: visible ones for themselves.
_BYTE_CHARS = {
    b: b if b in _VISIBLE else 256 + sum(c not in _VISIBLE for c in range(b)) for b in range(256)
}


def _split(text: bytes) -> list[bytes]:
    """White-space separated words, A-Z lower-cased as the tokenizer does.

    Texts that may spell a special token stay as written.
    """
    return text.split() if b"<|" in text else text.lower().split()


class _Store:
    """Runs of ids by number, end to end in one array; keys hold no space."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.ends = np.zeros(1 << 16, dtype=np.int64)  # run k is ids[ends[k] : ends[k + 1]]
        self.uses = np.zeros(1 << 16, dtype=np.int64)

    def fresh(self, keys: Iterable[bytes]) -> list[bytes]:
        """Numbers the keys that have none yet and returns them in that order."""
        found = list(set(keys).difference(self.numbers))
        first = len(self.numbers)
        self.numbers.update(zip(found, range(first, first + len(found))))
        return found

    def numbered(self, keys: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))
        while len(self.numbers) > len(self.uses):
            self.uses = np.append(self.uses, np.zeros_like(self.uses))
        self.uses += np.bincount(at, minlength=len(self.uses))
        return at

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """The runs of the keys that :meth:`fresh` numbered last."""
        first = len(self.numbers) - len(sizes)
        ends = self.ends[first] + np.cumsum(sizes)
        while len(self.numbers) + 1 > len(self.ends):
            self.ends = np.append(self.ends, np.zeros_like(self.ends))
        while len(ends) and ends[-1] > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.ends[first] : self.ends[first] + len(flat)] = flat
        self.ends[first + 1 : len(self.numbers) + 1] = ends

    def forget(self, most: int) -> None:
        """Keeps the ``most`` keys used most, of those used more than once; their uses count half from then on.

        The keys that stay are copied to one string and cut out of it when all
        are gone, for a key that stays in place holds the memory around it.
        """
        uses = self.uses[: len(self.numbers)]
        often = np.argsort(-uses, kind="stable")[:most]
        often = often[uses[often] > 1]
        sizes = self.sizes(often)
        flat, uses = self.gather(often, sizes), uses[often] // 2
        keys = list(self.numbers)  # they stand in the order of their numbers
        line = b" ".join([keys[k] for k in often.tolist()])
        del keys
        self.__init__()
        if len(often):
            self.numbers.update(zip(line.split(b" "), range(len(often)), strict=True))
            self.append(flat, sizes)
            self.uses = np.append(uses, np.zeros_like(self.uses))

    def sizes(self, at: np.ndarray) -> np.ndarray:
        return self.ends[at + 1] - self.ends[at]

    def gather(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The runs with the numbers ``at``, end to end."""
        shift = self.ends[at] - (np.cumsum(sizes) - sizes)
        return self.ids[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


class WordTokenizer:
    """Encodes texts word by word.

    The tokenizer neither merges nor normalises across ASCII white space, so
    a text's ids are its words' ids in a row, and words repeat.  A word is a
    stem and the punctuation after it, which are split before merges, too.
    """

    _loaded: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.words, self.parts = _Store(), _Store()

    def forget(self, most: int) -> None:
        """Keeps the ``most`` words used most, and as many of their parts."""
        self.words.forget(most)
        self.parts.forget(most)

    @classmethod
    def load(cls, path: str) -> WordTokenizer:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @staticmethod
    def _stem(word: bytes) -> bytes:
        """The word without the punctuation at its end, or all of it where they belong together."""
        stem = word.rstrip(_PUNCTUATION)
        if len(stem) == len(word) or stem.isascii():
            return word if b"<|" in word else stem
        return stem if stem.decode().lower()[-1].isalnum() and b"<|" not in word else word

    @staticmethod
    def _plain(part: bytes) -> str | None:
        """The part as the vocabulary spells it, if it is one run of letters that normalise to themselves."""
        if part.isalpha() and part.islower():
            return part.decode()
        if part.isascii():
            return None
        letters = part.decode()
        if not letters.isalpha() or max(letters) > "\u017f" or "\u0130" in letters:
            return None
        return letters.lower().encode().decode("latin-1").translate(_BYTE_CHARS)

    def _learn(self, words: list[bytes]) -> None:
        """Ids of words that :attr:`words` has just numbered."""
        stems = list(map(self._stem, words))
        tails = [w[len(s) :] for w, s in zip(words, stems, strict=True)]
        fresh = self.parts.fresh([*stems, *tails])
        spelt = list(map(self._plain, fresh))
        odd = [p.decode() for p, s in zip(fresh, spelt, strict=True) if s is None]
        coded = iter(self.model.encode_batch_fast(odd, add_special_tokens=False) if odd else ())
        merge = self.model.model.tokenize
        ids = [next(coded).ids if s is None else [t.id for t in merge(s)] for s in spelt]
        self.parts.append(
            np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids))
        )
        halves = np.stack([self.parts.numbered(stems), self.parts.numbered(tails)], axis=1).ravel()
        sizes = self.parts.sizes(halves)
        self.words.append(self.parts.gather(halves, sizes), sizes[::2] + sizes[1::2])

    def _encode_group(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if max(len(self.words.numbers), len(self.parts.numbers)) > CACHED_WORDS:
            self.forget(CACHED_WORDS // 2)
        words: list[bytes] = []
        stops = [0]
        for text in texts:
            words += _split(text)
            stops.append(len(words))
        if fresh := self.words.fresh(words):
            self._learn(fresh)
        at = self.words.numbered(words)
        sizes = self.words.sizes(at)
        for a, b in pairwise(stops):
            yield np.append(self.words.gather(at[a:b], sizes[a:b]), np.array([END_ID], "<u4"))

    def encode(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id."""
        group, held = [], 0
        for text in texts:
            group.append(text or b"")
            held += len(group[-1])
            if held >= GROUP_BYTES:
                yield from self._encode_group(group)
                group, held = [], 0
        yield from self._encode_group(group)


@dataclass
class Piece:
    doc_id: int | None
    ids: np.ndarray
    start: int
    length: int

    def cut(self, length: int) -> tuple["Piece", "Piece"]:
        return (
            Piece(self.doc_id, self.ids, self.start, length),
            Piece(self.doc_id, self.ids, self.start + length, self.length - length),
        )


@dataclass
class Pool:
    """Pieces by length; those of one length leave in the order they came."""

    keys: list[tuple[int, int]] = field(default_factory=list)
    pieces: dict[int, Piece] = field(default_factory=dict)
    came: int = 0

    def put(self, piece: Piece) -> None:
        insort(self.keys, (piece.length, -self.came))
        self.pieces[-self.came] = piece
        self.came += 1

    def best_fit(self, room: int) -> Piece | None:
        """The longest piece of at most ``room``."""
        at = bisect_right(self.keys, (room, 1)) - 1
        return self.pieces.pop(self.keys.pop(at)[1]) if at >= 0 else None

    def shortest_above(self, room: int, below: int) -> Piece | None:
        """The shortest piece of more than ``room`` and at most ``below``."""
        at = bisect_right(self.keys, (room, 1))
        if at < len(self.keys) and self.keys[at][0] <= below:
            return self.pieces.pop(self.keys.pop(at)[1])
        return None


def pack_tiers(pieces: Iterable[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows and the pieces left over, which make up no window of the longest tier.

    Every piece is at most as long as the longest tier.
    """
    pool = Pool()
    for piece in pieces:
        pool.put(piece)
    windows: list[list[Piece]] = []
    over: list[Piece] = []
    for tier, shorter in zip(tiers, (*tiers[1:], 0), strict=True):
        while (lead := pool.best_fit(tier)) is not None:
            if lead.length <= shorter:
                pool.put(lead)
                break
            window, room = [lead], tier - lead.length
            limit = shorter or tier
            while room:
                found = pool.best_fit(min(room, limit))
                if found is None and (whole := pool.shortest_above(room, limit)) is not None:
                    found, rest = whole.cut(room)
                    pool.put(rest)
                if found is None:
                    break
                window.append(found)
                room -= found.length
            if room:
                over += window
            else:
                windows.append(window)
    over += [pool.pieces[k] for _, k in pool.keys]
    # pieces without partners in shorter tiers are joined as they stand
    window, room = [], tiers[0]
    for piece in over:
        while piece is not None and piece.length >= room:
            head, piece = piece.cut(room)
            windows.append([*window, head])
            window, room = [], tiers[0]
            piece = piece if piece.length else None
        if piece is not None:
            window.append(piece)
            room -= piece.length
    return windows, window


def deal_rest(pieces: list[Piece]) -> list[list[Piece]]:
    """Windows of falling powers of two that hold exactly ``pieces``."""
    total = sum(p.length for p in pieces)
    windows, queue = [], list(reversed(pieces))
    for power in range(total.bit_length() - 1, -1, -1):
        room = total & (1 << power)
        window = []
        while room:
            piece = queue.pop()
            if piece.length > room:
                piece, rest = piece.cut(room)
                queue.append(rest)
            window.append(piece)
            room -= piece.length
        if window:
            windows.append(window)
    return windows


def step_groups(lengths: list[int], step_ids: int = STEP_IDS) -> list[int]:
    """A group for each window: longest windows first, each to the emptiest group."""
    import heapq

    groups = [(0, g) for g in range(max(1, round(sum(lengths) / step_ids)))]
    chosen = [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        filled, g = heapq.heappop(groups)
        chosen[k] = g
        heapq.heappush(groups, (filled + lengths[k], g))
    return chosen


class _Packer:
    """Packs one task's documents and gives rows of ``SCHEMA``."""

    def __init__(self, part: int, tiers: tuple[int, ...], with_ids: bool = True):
        self.with_ids = with_ids
        self.first = part << 40
        self.sequences = self.steps = 0
        self.tiers = tiers
        self.windows: list[list[Piece]] = []
        self.pieces: list[Piece] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> bool:
        """Takes a document; true when the buffer is full."""
        full = self.tiers[0]
        whole = Piece(doc_id, ids, 0, len(ids))
        while whole.length >= full:
            head, whole = whole.cut(full)
            self.windows.append([head])
        if whole.length:
            self.pieces.append(whole)
        self.held += len(ids)
        return self.held >= BUFFER_IDS

    def flush(self, last: bool = False) -> pa.RecordBatch:
        packed, over = pack_tiers(self.pieces, self.tiers)
        windows = self.windows + packed
        if last:
            windows += deal_rest(over)
            over = []
        lengths = [sum(p.length for p in w) for w in windows]
        rows, runs = [], []
        for window, length, group in zip(windows, lengths, step_groups(lengths), strict=True):
            offset = 0
            for p in window:
                run = p.ids[p.start : p.start + p.length]
                if self.with_ids:
                    runs.append(run)
                crc = zlib.crc32(run.tobytes())
                rows.append(
                    (p.doc_id, p.start, p.length, crc, len(p.ids), self.first + self.sequences, offset, length,
                     self.first + self.steps + group)
                )
                offset += p.length
            self.sequences += 1
        self.steps += 1 + max((r[-1] - self.first - self.steps for r in rows), default=-1)
        self.windows, self.pieces, self.held = [], over, sum(p.length for p in over)
        types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        columns = list(zip(*rows, strict=True)) or [[]] * len(types)
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        if self.with_ids:
            ends = np.cumsum([0, *map(len, runs)], dtype=np.int32)
            flat = np.concatenate(runs).view("<i4") if runs else np.empty(0, "<i4")
            names.append("ids")
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
        return pa.RecordBatch.from_arrays(arrays, names)


def _pack_batches(path: str, tiers: tuple[int, ...], with_ids: bool):
    def run(batches):
        tokenizer = WordTokenizer.load(path)
        packer = _Packer(TaskContext.get().partitionId(), tiers, with_ids)
        for batch in batches:
            coded = tokenizer.encode(texts_of(batch.column(1)))
            for doc_id, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                if packer.add(doc_id, ids):
                    yield packer.flush()
        tokenizer.forget(KEPT_WORDS)  # the worker may idle beside other stages, or run them
        yield packer.flush(last=True)

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece of a document, see ``SCHEMA``.

    ``offset`` is the piece's place in its sequence, ``tier`` the sequence's
    length, ``ids`` the piece's token ids and ``ids_crc32`` the checksum of
    their bytes (unsigned, 4 bytes each, little-endian).  Without
    ``with_ids`` the last column is left out; no optimiser can prune it.

    A null or blank text is the end id alone; rows that repeat an id are
    packed as often as they occur; null ids are carried through; other
    columns, whatever their names, are not read.  A very long text is encoded
    whole and cut into windows, so a task holds it and its ids once.  Pieces
    of one length leave in the order of the input.  An empty table gives an
    empty one.
    """
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return slim.mapInArrow(
        _pack_batches(tokenizer or default_tokenizer(), tiers, with_ids), SCHEMA + (IDS if with_ids else "")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, step_id, tier, ids)``: the training sequences of :func:`pack`'s pieces, ``tier`` ids each."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.first("step_id").alias("step_id"),
        F.first("tier").alias("tier"),
        F.flatten(F.transform(pieces, lambda p: p["ids"])).alias("ids"),
    )
