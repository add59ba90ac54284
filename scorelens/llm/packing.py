"""Best-fit packing of token pieces into sequences of bounded length.

Only the lengths matter to a packing, so the plan is made on the histogram of lengths (at
most ``capacity`` numbers, whatever the corpus) and each piece then finds its place from its
rank among pieces of its length.

1. Dominance reduction (Martello and Toth): for the longest remaining length, a set of one,
   two or three pieces that provably dominates every other set holding that piece is fixed as
   a sequence and leaves the instance.
2. The remainder is packed best-fit, longest first.

Both work on runs of equal pieces: a step handles all copies that are alike.

Defined cases: a null or empty text is the single id END; a null doc_id stays null; a very long
text is cut into pieces like any other, and one with long white space goes through the slower of
two libraries; rows that repeat an id or a text are packed as often as they occur; pieces of one
length are interchangeable, and which of them lies where follows from a hash; an empty table
gives an empty result; further columns, whatever their names, are left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

END = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of pieces that a task holds before it passes them on.
ROWS = 100_000
#: White space in a row from which a text is left to the exact library; the other one keeps a
#: stack of it, which a million overflow.
SPACES = 1_000

Group = tuple[tuple[tuple[int, int], ...], int]


def tokenizer(path: str, ranks_path: str | None):
    """text -> bytes of little-endian unsigned 32-bit ids, equal to those of ``path``.

    Texts of characters below U+0250 take the same vocabulary from ``ranks_path`` through a
    faster library; for those both libraries agree on letters, digits and white space.  Any
    other text, one that holds a special token's string or SPACES of white space in a row, and
    one that the faster library fails on goes through ``path`` itself.
    """
    import base64
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    odd = re.compile("|".join(["[^\\x00-ɏ]", rf"[\t-\r \x85\xa0]{{{SPACES}}}", *map(re.escape, special)]))
    fast = None
    if ranks_path:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        ids = None
        if fast is not None and not odd.search(text):
            try:
                ids = fast.encode_ordinary(text)
            except BaseException as error:  # its panics are no Exceptions
                if type(error).__name__ != "PanicException":
                    raise
        if ids is None:
            ids = exact.encode(text, add_special_tokens=False).ids
        ids.append(END)
        return np.asarray(ids, dtype="<u4").tobytes()

    return encode


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole ones last, a shorter one first."""
    first = n - capacity * ((n - 1) // capacity)
    starts = [0, *range(first, n, capacity)]
    return [(a, (first if a == 0 else capacity)) for a in starts]


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.  A null text is empty and
    gives the single id END; a null id stays null."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ((),) * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path, ranks_path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    if len(rows) == ROWS:
                        yield made(rows)
                        rows = []
            yield made(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


class _Lengths:
    """A multiset of lengths, in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v}
        self.keys = sorted(self.n)

    def take(self, length: int, copies: int) -> None:
        self.n[length] -= copies
        if not self.n[length]:
            del self.n[length]
            self.keys.remove(length)

    def put(self, length: int, copies: int) -> None:
        if length not in self.n:
            insort(self.keys, length)
        self.n[length] = self.n.get(length, 0) + copies

    def at_most(self, room: int) -> int | None:
        k = bisect_right(self.keys, room)
        return self.keys[k - 1] if k else None

    def smallest(self, k: int) -> list[int]:
        out: list[int] = []
        for x in self.keys:
            out += [x] * min(self.n[x], k - len(out))
            if len(out) == k:
                break
        return out

    def above(self, length: int, k: int) -> list[int]:
        """The k smallest that exceed ``length``."""
        out: list[int] = []
        for x in self.keys[bisect_right(self.keys, length) :]:
            out += [x] * min(self.n[x], k - len(out))
            if len(out) == k:
                break
        return out

    def best_pair(self, room: int) -> tuple[int, int] | None:
        """The two pieces of greatest sum within ``room``, larger first; of equal sums the one
        with the largest piece."""
        best, lo = None, 0
        hi = len(self.keys) - 1
        while lo <= hi:
            a, b = self.keys[hi], self.keys[lo]
            if a + b > room:
                hi -= 1
                continue
            if lo < hi or self.n[a] > 1:
                if best is None or a + b > sum(best):
                    best = (a, b)
            lo += 1
        return best


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[Group], dict[int, int]]:
    """Sets fixed by dominance, with their number, and the lengths that remain.

    For a piece of length j, what else fits beside it decides: nothing (j stands alone); a
    piece that fills the sequence, or never two (the longest that fits joins it); at most two
    (the longest that fits if it is no shorter than the best pair, or the best pair if it holds
    that longest and no pair fits whose pieces both exceed its shorter one).  Equal pieces are
    handled together while three copies of each involved length remain, as no condition can
    change before.
    """
    free, fixed = _Lengths(counts), []
    below = capacity + 1
    while (j := free.at_most(below - 1)) is not None:
        free.take(j, 1)
        room, chosen = capacity - j, None
        partner = free.at_most(room)
        if partner is None:
            chosen = ()
        elif partner == room or sum(free.smallest(2)) > room or len(free.smallest(2)) < 2:
            chosen = (partner,)
        elif len(s := free.smallest(3)) < 3 or sum(s) > room:
            a, b = free.best_pair(room)
            longer = free.above(b, 2)
            if partner >= a + b:
                chosen = (partner,)
            elif partner == a and (len(longer) < 2 or sum(longer) > room):
                chosen = (a, b)
        free.put(j, 1)
        if chosen is None:  # not decided; its pieces stay, and may still join shorter ones
            below = j
            continue
        shape = sorted((j, *chosen), reverse=True)
        used = {x: shape.count(x) for x in shape}
        times = free.n[j] if not chosen else max(1, min((free.n[x] - 3) // k for x, k in used.items()))
        for x, k in used.items():
            free.take(x, k * times)
        fixed.append((tuple(used.items()), times))
    return fixed, free.n


def best_fit(counts: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit, longest first, over runs of equal pieces and of equal sequences."""
    rooms: dict[int, list[Group]] = {}
    order: list[int] = []

    def add(room: int, group: Group) -> None:
        if group[1]:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append(group)

    def more(shape: tuple, length: int, k: int) -> tuple:
        return (*shape, (length, k)) if k else shape

    for length in sorted(counts, reverse=True):
        left = counts[length]
        at = 0
        while left and (at := next((i for i in range(len(order)) if order[i] >= length), -1)) >= 0:
            room = order[at]
            shape, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[at]
            fit = room // length
            full, rest = min(n, left // fit), 0
            if full < n:
                rest = left - full * fit if left - full * fit < fit else 0
            add(room - fit * length, (more(shape, length, fit), full))
            add(room - rest * length, (more(shape, length, rest), 1 if rest else 0))
            add(room, (shape, n - full - (1 if rest else 0)))
            left -= full * fit + rest
        fit = capacity // length
        add(capacity - fit * length, (((length, fit),), left // fit))
        if left % fit:
            add(capacity - left % fit * length, (((length, left % fit),), 1))
    return [g for room in order for g in rooms[room]]


def plan(counts: dict[int, int], capacity: int) -> list[Group]:
    """Sequences as (shape, number): a shape lists (length, copies)."""
    fixed, kept = reduce(counts, capacity)
    return fixed + best_fit(kept, capacity)


def places(groups: list[Group]) -> dict[int, np.ndarray]:
    """By length, rows of (first rank, first sequence, copies in a sequence, first offset)."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for shape, n in groups:
        offset = 0
        for length, k in shape:
            out.setdefault(length, []).append((ranks.get(length, 0), sequence, k, offset))
            ranks[length] = ranks.get(length, 0) + n * k
            offset += length * k
        sequence += n
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack(cuts: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces (see ``pieces``), each at most ``capacity`` long.

    The pieces of one length are dealt to buckets, ranked inside each, and a bucket's first
    rank is the sum of those before it: no task holds all pieces of a frequent length, nor all
    rows of an id, as the bucket also follows from the ids' checksum and the input's part.  The
    plan that is sent to tasks has at most a few rows for each of ``capacity`` lengths.
    """
    spark = cuts.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = cut(cuts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.spark_partition_id()), F.lit(buckets)).cast("int")))
    counted = cut(cuts.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    histogram = {int(r[0]): int(r[1]) for r in counted.groupBy("length").agg(F.sum("n")).collect()}
    where = places(plan(histogram, capacity))
    before = counted.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = cuts.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).cast("long").alias("rank"))
    sent = spark.sparkContext.broadcast(where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                rows = np.nonzero(length == x)[0]
                table = sent.value[int(x)]
                row = table[np.searchsorted(table[:, 0], rank[rows], side="right") - 1]
                nth = rank[rows] - row[:, 0]
                sequence[rows] = row[:, 1] + nth // row[:, 2]
                offset[rows] = row[:, 3] + nth % row[:, 2] * x
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")
