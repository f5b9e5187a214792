"""SimHash near-duplicates over a Gray-order hierarchical index.

Texts become 64-bit fingerprints of their word shingles.  Two fingerprints
link when they differ in at most ``max_diff`` bits, and documents fall into
the components of those links.

Linking goes in two layers:

* Across the cluster, fingerprints are dealt by *shared masked patterns*, the
  upper nodes of the index.  With 64 bits cut into ``max_diff + m`` blocks,
  two linked fingerprints agree on ``m`` whole blocks, so every choice of
  ``m`` blocks gives a mask and ``fingerprint & mask`` is the node that a
  fingerprint hangs under.  ``m`` follows the number of distinct fingerprints,
  so that a node of unrelated fingerprints stays small at any size.
* Inside a node, members stand in Gray order (neighbours differ in few bits).
  Runs of eight are folded into groups that keep the bits all members agree
  on, groups into groups of groups, and pairs of groups are walked from the
  root: a pair whose common bits already differ in more than ``max_diff``
  places is dropped with all that hangs below it.

The members of a node with more than ``NODE_ROWS`` are dealt again in the same
way by the bits outside its mask, up to ``RESPLITS`` times; what is still
full then, almost equal fingerprints that agree everywhere, is dealt by salt
pairs, so that any two of its members still meet in some task.  A task gives
a spanning forest of its links, not all of them: nothing grows with the
square of a group of copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import texts_of
from .components import connected_components
from .rowkeys import row_key
from ..storage import keep, wrapped

SHINGLE_WORDS = 4
MAX_DIFF = 4
SEED = 42
#: Members of an index node that one task compares.
NODE_ROWS = 4096
#: Times that the members of a full node are dealt again by further bits, and blocks that must agree then.
RESPLITS = 2
RESPLIT_AGREE = 2
#: Unrelated fingerprints wanted under one node at most.
NODE_FILL = 128
#: Rows a task gathers before it compares them, at a node's end.
BUFFER_ROWS = 1 << 16
#: A text is cut into pieces of about so many bytes while it is hashed.
PIECE_BYTES = 1 << 20
FANOUT = 8

_SPACE = re.compile(rb"[ \n\t\r\x0b\x0c]")
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end where a word ends."""
    start = 0
    while len(text) - start > PIECE_BYTES:
        head = text[start : start + PIECE_BYTES]
        cut = max(head.rfind(b) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= 0:  # one word fills the piece (0 is the last cut's white space): go on to its end
            end = _SPACE.search(text, start + PIECE_BYTES)
            if end is None:
                break
            cut = end.start() - start
        yield text[start : start + cut]
        start += cut
    yield text[start:] if start else text


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a whole UTF-8 text (unsigned).

    A-Z are lower-cased, words are runs of anything but ASCII white space,
    shingles are ``shingle`` words joined by a space and count as often as
    they occur.  Shorter texts are one shingle; without a word (or null): 0.
    """
    counts = np.zeros((8, 8), dtype=np.int64)
    total, tail = 0, []
    digest = xxhash.xxh64_intdigest
    for piece in _pieces(text or b""):
        words = tail + piece.lower().split()
        if len(words) >= shingle:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            first = [0, *ends[: len(words) - shingle].tolist()]
            last = (ends[shingle - 1 :] - 1).tolist()
            hashes = np.array(
                [digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)], dtype="<u8"
            ).view(np.uint8)
            for k in range(8):
                counts[k] += np.bincount(hashes[k::8], minlength=256) @ _BITS
            total += len(first)
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not total:
        return digest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(2 * counts > total, axis=1, bitorder="little").tobytes(), "little")


def _hash_keyed_batches(batches):
    for batch in batches:
        values = np.array([fingerprint(t) for t in texts_of(batch.column(1))], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), batch.column(2)], ["doc_id", "fp", "key"])


def _hash_batches(batches):
    for batch in batches:
        values = np.array([fingerprint(t) for t in texts_of(batch.column(1))], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` is the fingerprint as a signed long."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(_hash_batches, "doc_id long, fp long")


def gray_rank(column):
    """Position of a pattern in the Gray sequence, as a signed long."""
    for shift in (1, 2, 4, 8, 16, 32):
        column = column.bitwiseXOR(F.shiftrightunsigned(column, shift))
    return column


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _chosen_blocks(bits: list[int], agree: int, max_diff: int) -> list[int]:
    """Masks of ``agree`` of the ``max_diff + agree`` blocks that ``bits`` fall into.

    ``max_diff`` differences among the bits leave one mask at least untouched.
    """
    blocks = max_diff + agree
    edges = [len(bits) * k // blocks for k in range(blocks + 1)]
    block = [sum(1 << x for x in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    found = [sum(chosen) for chosen in combinations(block, agree)]
    assert len(found) == comb(blocks, agree)
    return found


def masks(count: int, max_diff: int = MAX_DIFF) -> list[int]:
    """Bit masks of the index's upper nodes for ``count`` fingerprints."""
    agree = 1
    while agree < 4 and count / 2 ** (64 * agree / (max_diff + agree)) > NODE_FILL:
        agree += 1
    return [_signed(m) for m in _chosen_blocks(list(range(64)), agree, max_diff)]


def _further_masks(mask: int, max_diff: int) -> list[int]:
    """Masks that add to ``mask`` blocks of the bits outside it."""
    used = mask & (1 << 64) - 1
    rest = [b for b in range(64) if not used >> b & 1]
    return [_signed(used | m) for m in _chosen_blocks(rest, RESPLIT_AGREE, max_diff)]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[i] and b[i]; ``parent`` is flat before and after."""
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low != high
        if not open_.any():
            return
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent[:] = above


class _Level:
    """Groups of consecutive members: first child, and the bits all agree on."""

    def __init__(self, starts, child_and, child_or, node):
        self.starts = starts
        self.ends = np.append(starts[1:], len(child_and))
        self.all_and = np.bitwise_and.reduceat(child_and, starts)
        self.all_or = np.bitwise_or.reduceat(child_or, starts)
        self.agreed = ~(self.all_and ^ self.all_or)
        self.node = node[starts]


def spanning_links(fps: np.ndarray, node: np.ndarray, max_diff: int = MAX_DIFF) -> np.ndarray:
    """For each fingerprint the first one of its component inside its node.

    ``node`` numbers the index nodes and ascends; inside one, members stand
    in Gray order.
    """
    levels = []
    child_and = child_or = fps
    groups = node
    while not levels or len(levels[-1].starts) > len(np.unique(node)):
        fresh = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
        inside = np.arange(len(groups)) - np.repeat(fresh, np.diff(np.append(fresh, len(groups))))
        level = _Level(np.flatnonzero(inside % FANOUT == 0), child_and, child_or, groups)
        levels.append(level)
        child_and, child_or, groups = level.all_and, level.all_or, level.node
    parent = np.arange(len(fps))
    roots = np.arange(len(levels[-1].starts))
    stack = [(len(levels) - 1, roots, roots)]
    linked = 0
    while stack:
        depth, left, right = stack.pop()
        if len(left) > 1 << 14:
            stack += [(depth, left[1 << 14 :], right[1 << 14 :])]
            left, right = left[: 1 << 14], right[: 1 << 14]
        level = levels[depth]
        if linked > 4 * len(fps):
            # dense copies: what is one component already needs no further look
            low, high = parent, parent
            for each in levels[: depth + 1]:
                low, high = np.minimum.reduceat(low, each.starts), np.maximum.reduceat(high, each.starts)
            open_ = (low[left] != high[left]) | (low[right] != high[right]) | (low[left] != low[right])
            left, right = left[open_], right[open_]
        wide = level.ends[right] - level.starts[right]
        size = (level.ends[left] - level.starts[left]) * wide
        if not len(size) or not size.sum():
            continue
        pair = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        a = level.starts[left][pair] + at // wide[pair]
        b = level.starts[right][pair] + at % wide[pair]
        if depth:
            below = levels[depth - 1]
            differs = (below.all_and[a] ^ below.all_and[b]) & below.agreed[a] & below.agreed[b]
            stays = (a <= b) & (np.bitwise_count(differs) <= max_diff)
            if stays.any():
                stack.append((depth - 1, a[stays], b[stays]))
        else:
            stays = (a < b) & (np.bitwise_count(fps[a] ^ fps[b]) <= max_diff)
            linked += int(stays.sum())
            if stays.any():
                _union(parent, a[stays], b[stays])
    return parent


def _link_batches(max_diff):
    def link(columns):
        keys = np.stack(columns[:4])
        fps, reps = columns[4].view(np.uint64), columns[4]
        node = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))])
        first = spanning_links(fps, node, max_diff)
        tied = np.flatnonzero(first != np.arange(len(first)))
        return pa.RecordBatch.from_arrays(
            [pa.array(reps[tied]), pa.array(reps[first[tied]])], ["a", "b"]
        )

    def run(batches):
        held = [[] for _ in range(5)]
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for store, column in zip(held, batch.columns, strict=True):
                store.append(column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False))
            rows += batch.num_rows
            if rows < BUFFER_ROWS:
                continue
            columns = [np.concatenate(x) for x in held]
            moved = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in columns[:4]]))
            if not len(moved):
                held = [[x] for x in columns]
                continue
            cut = moved[-1] + 1
            held = [[x[cut:]] for x in columns]
            rows -= cut
            yield link([x[:cut] for x in columns])
        if rows:
            yield link([np.concatenate(x) for x in held])

    return run


def _longs(values: list[int]):
    return F.array(*[F.lit(v).cast("long") for v in values])


def _under(fingerprints_: DataFrame, chosen) -> DataFrame:
    """``fingerprints_`` once for each mask of the array ``chosen``, with the node's mask and pattern."""
    return fingerprints_.select("fp", F.explode(chosen).alias("mask")).select(
        "fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern")
    )


def _full(under: DataFrame) -> DataFrame:
    """Nodes with more than ``NODE_ROWS`` members: at most one for so many rows."""
    return keep(under.groupBy("mask", "pattern").count().where(F.col("count") > NODE_ROWS), "full-nodes")


def link_fingerprints(distinct: DataFrame, max_diff: int = MAX_DIFF) -> DataFrame:
    """Links among ``distinct(fp)``: ``(a, b)`` pairs of fingerprints.

    They connect exactly what links of at most ``max_diff`` bits connect.
    """
    chosen = masks(distinct.count(), max_diff)
    node = ["mask", "pattern"]
    open_ = _under(distinct, _longs(chosen))
    full = _full(open_)
    settled = []
    for _ in range(RESPLITS):
        if not full.head(1):
            break
        settled.append(open_.join(full, node, "left_anti"))
        used = [r[0] for r in full.select("mask").distinct().collect()]  # of the masks chosen, which are few
        further = F.create_map(
            *[x for m in used for x in (F.lit(m).cast("long"), _longs(_further_masks(m, max_diff)))]
        )
        members = open_.join(full, node, "left_semi").select("fp", F.element_at(further, F.col("mask")).alias("more"))
        # a fingerprint may come to one node by two ways
        open_ = keep(_under(members, F.col("more")).distinct(), "resplit")
        full = _full(open_)
    count = full.select(*node, F.ceil(F.col("count") / NODE_ROWS).cast("int").alias("salts"))
    dealt = open_.join(count, node, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    for part in settled:
        dealt = dealt.unionByName(part.withColumn("salts", F.lit(1)))
    dealt = (
        dealt.withColumn("salt", F.pmod(F.xxhash64("fp"), "salts").cast("long"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select(
            "mask",
            "pattern",
            F.least("salt", F.col("other").cast("long")).alias("s1"),
            F.greatest("salt", F.col("other").cast("long")).alias("s2"),
            "fp",
            gray_rank(F.col("fp")).alias("gray"),
        )
        .repartition("mask", "pattern", "s1", "s2")
        .sortWithinPartitions("mask", "pattern", "s1", "s2", "gray")
        .drop("gray")
    )
    return dealt.mapInArrow(_link_batches(max_diff), "a long, b long")


def fingerprint_classes(distinct: DataFrame, max_diff: int = MAX_DIFF) -> DataFrame:
    """``(fp, class)`` of every row of ``distinct(fp)``; linked fingerprints share a class."""
    joined = connected_components(link_fingerprints(distinct.select("fp"), max_diff))
    return distinct.join(joined, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "fp").alias("class")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_diff: int = MAX_DIFF,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each input row.

    Null, empty and blank texts have fingerprint zero and link like any other;
    very long texts are hashed in pieces; rows that repeat an id are returned
    as often as they occur; other columns, whatever their names, are not
    read.  A row whose id is null links like any other, but gives its
    component no name: a component of such rows alone has a null id.  An
    empty table gives an empty one.
    """
    hashed = keep(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = keep(hashed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    classes = keep(distinct.join(fingerprint_classes(distinct, max_diff), "fp"), "fingerprint-classes")
    lowest = classes.groupBy("class").agg(F.min("rep").alias("component_id"))
    named = classes.join(lowest, "class").select(F.col("fp").alias("fp_"), "component_id")
    return hashed.join(named, F.col("fp") == F.col("fp_")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_diff: int = MAX_DIFF) -> DataFrame:
    """One row of each near-duplicate component, with all its columns.

    It is the row with the smallest id, nulls last, and of rows that share
    that id the one with the smallest hash over all columns; of rows that are
    equal in every column one stays.  Null and empty texts are copies of one
    another.  Only keys of rows that go are joined to the texts.  An empty
    table gives an empty one.
    """
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key(docs).alias("key")
    )
    hashed = keep(keyed.mapInArrow(_hash_keyed_batches, "doc_id long, fp long, key long"), "fingerprints")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    distinct = keep(hashed.groupBy("fp").agg(F.min(place).alias("first")), "distinct-fingerprints")
    classes = distinct.join(fingerprint_classes(distinct, max_diff), "fp")
    survivors = keep(classes.groupBy("class").agg(F.min("first").alias("stays")).select("stays.doc_id", "stays.key"), "survivors")
    rows = hashed.groupBy("doc_id", "key").count()
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))
    marked = rows.join(survivors.select(F.col("doc_id").alias("i"), F.col("key").alias("k")), same, "left").select(
        F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"), F.col("k").isNotNull().alias("stays"), "count"
    )
    marks = keep(marked.where("not stays or count > 1"), "duplicates")
    whole = wrapped(docs).select("row", row_key(docs, "row.").alias("key"))
    found = F.col(f"row.`{id_col}`").cast("long").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key"))
    alone = whole.join(marks, found, "left_anti")
    if not marks.where("stays").head(1):
        return alone.select("row.*")
    # equal rows meet where they are read, one of them goes on
    repeated = whole.join(marks.where("stays"), found, "left_semi").groupBy("key", F.col(f"row.`{id_col}`")).agg(F.first("row").alias("row"))
    return alone.select("row").unionByName(repeated.select("row")).select("row.*")


__all__ = ["fingerprint", "fingerprints", "link_fingerprints", "near_duplicates", "one_of_each"]
