"""SimHash near-deduplication with a Gray-order hierarchical index.

Fingerprints link at ``RADIUS`` or fewer differing bits.  Links are searched among distinct
fingerprints:

- The topmost nodes fix a masked pattern: 64 bits are cut into four blocks, and of two linked
  fingerprints at least one block is equal.  A node with more than ``limit`` fingerprints is
  cut again by its free bits, up to four times; after that at most 2**21 values are possible.
- Inside a node, fingerprints lie in Gray-rank order, sixteen to a leaf, sixteen leaves to a
  node above, and so on.  Each keeps the bits that all below it share.  Two nodes are compared
  by the shared bits that their parents did not have yet; differences accumulate downwards and
  a pair of groups is dropped as soon as they exceed the radius, or if both already belong to
  one component.  What comes out is a star per component and node, never all pairs.

Stars of all nodes are joined by alternating large-star and small-star steps.

Defined cases: null text is empty; a text without words has fingerprint zero, which links like
any other; a very long text is read in parts; rows repeated give rows repeated; a component's id
is its smallest doc_id that is not null (null only if all are); an empty table gives an empty
result.  ``drop_near_duplicates`` keeps one row of each component: of its smallest id (null last),
if that repeats with different texts the one of the smallest hash, and one of rows that repeat id
and text; further columns are carried along whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, if_few

SEED = 42
RADIUS = 3
FAN = 16
LEVELS = 4
#: Pairs of nodes handled at once, and rows gathered before a search begins.
PAIRS = 20_000
ROWS = 200_000
#: Bytes of a text whose words are held at once, and what lies between words.
PART = 1 << 20
SPACE = re.compile(rb"[ \t-\r]")
#: Rows to take out that may be broadcast (24 MB).
BROADCAST_GONE = 1_000_000
#: A fingerprint with more than one in HOT rows is joined by broadcast; there are fewer than HOT.
HOT = 512


def _parts(data: bytes) -> Iterator[bytes]:
    """A text in parts of about PART bytes, cut at white space."""
    at = 0
    while len(data) - at > PART:
        cut_at = SPACE.search(data, at + PART)
        end = cut_at.start() if cut_at else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def fingerprint(text: str | None, words: int = 3) -> int:
    """The majority of the bits of XXH64 over shingles, as an unsigned number.  Of a long text
    one part's words are held at a time, and the last ones of the part before."""
    import xxhash

    digest = xxhash.xxh64_digest
    held: list[bytes] = []
    n, count = 0, np.zeros(64, np.int64)
    for part in _parts((text or "").encode().lower()):
        held += part.split()
        if len(held) < words:
            continue
        line = b" ".join(held)
        ends = np.cumsum([len(w) + 1 for w in held]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(held) - words + 1]
        data = b"".join([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)])
        rows = np.frombuffer(data, np.uint8).reshape(-1, 8)
        for k in range(0, len(rows), 1 << 16):
            count += np.unpackbits(rows[k : k + (1 << 16)], axis=1).sum(0, dtype=np.int64)
        n += len(rows)
        held = held[len(held) - words + 1 :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED) if held else 0
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), check (a hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], names=["doc_id", "fp", "check"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _check(F.col(text_col)).alias("check"))
    return rows.mapInArrow(run, "doc_id long, fp long, check long")


def _check(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def free_bits(path: int) -> np.ndarray:
    """Bits that a path of block choices leaves free, lowest first."""
    choices = []
    while path:
        choices.append((path - 1) % 4)
        path = (path - 1) // 4
    free = np.arange(64)
    for c in reversed(choices):
        free = np.delete(free, slice(*_block(len(free), c)))
    return free


def _block(n: int, c: int) -> tuple[int, int]:
    edges = [n * k // 4 for k in range(5)]
    return edges[c], edges[c + 1]


def _mask(path: int) -> np.uint64:
    bits = np.ones(64, bool)
    bits[free_bits(path)] = False
    return np.uint64(sum(1 << int(k) for k in np.nonzero(bits)[0]))


def nodes_below(rows: DataFrame) -> DataFrame:
    """Each (fp, path) four times: with another block fixed, and the pattern fixed so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, path = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for p in np.unique(path).tolist():
                own = fp[path == p]
                for c in range(4):
                    q = 4 * p + c + 1
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), q, np.int32)), pa.array((own & _mask(q)).view(np.int64))], names=["fp", "path", "pattern"])

    return rows.select("fp", "path").mapInArrow(run, "fp long, path int, pattern long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the binary reflected Gray code."""
    out = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Index:
    """A Gray-order hierarchy over the fingerprints of many top nodes.

    ``fp`` and ``group`` (the top node's number) come sorted by group and Gray rank.  Level 0
    has leaves; each level's arrays hold first and last child, shared bits and their pattern.
    """

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        self.fp, self.levels = fp, []
        members, same, mask = fp, group, np.full(len(fp), np.uint64(2**64 - 1))
        while True:
            begins = np.nonzero(np.concatenate(([True], same[1:] != same[:-1])))[0]
            if self.levels and len(begins) == len(same):
                break
            size = np.diff(np.concatenate((begins, [len(same)])))
            count = -(-size // FAN)
            first = np.repeat(begins, count) + FAN * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            last = np.minimum(first + FAN, np.repeat(begins + size, count))
            both, either = np.bitwise_and.reduceat(members, first), np.bitwise_or.reduceat(members, first)
            mask = np.bitwise_and.reduceat(mask, first) & ~(both ^ either)
            members, same = members[first], np.repeat(same[begins], count)
            self.levels.append((first, last, mask, members & mask))
        self.top_groups = same

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level, the label that all below a node share, or -1."""
        out, low, high = [], label, label
        for first, *_ in self.levels:
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            out.append(np.where(low == high, low, -1))
        return out


def _pairs(first_a, last_a, first_b, last_b, twin):
    """All child pairs of node pairs; of a node with itself each pair once, twins included."""
    a, b = first_a[:, None, None] + np.arange(FAN)[None, :, None], first_b[:, None, None] + np.arange(FAN)[None, None, :]
    good = (a < last_a[:, None, None]) & (b < last_b[:, None, None]) & (~twin[:, None, None] | (a <= b))
    owner, i, j = np.nonzero(good)
    return owner, first_a[owner] + i, first_b[owner] + j


def components_within(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each position the component among links inside its group, as the number of one."""
    n = len(fp)
    near = (group[1:] == group[:-1]) & (_distance(fp[1:], fp[:-1]) <= radius)
    label = np.concatenate(([0], np.cumsum(~near)))
    parent = np.arange(label[-1] + 1)
    index = Index(fp, group)
    uniform = index.uniform(label)
    top = len(index.levels) - 1
    count = len(index.levels[top][0])
    stack = [(top, np.arange(count), np.arange(count), np.zeros(count, np.int64), np.zeros(count, np.uint64))]
    step = max(PAIRS, n // 8)
    while stack:
        level, a, b, apart, known = stack.pop()
        if len(a) > step:
            stack += [(level, a[k : k + step], b[k : k + step], apart[k : k + step], known[k : k + step]) for k in range(0, len(a), step)]
            continue
        ua, ub = uniform[level][a], uniform[level][b]
        open_ = (ua != ub) | (ua < 0)
        a, b, apart, known = a[open_], b[open_], apart[open_], known[open_]
        if not len(a):
            continue
        first, last, *_ = index.levels[level]
        owner, i, j = _pairs(first[a], last[a], first[b], last[b], a == b)
        if level:
            _, _, mask, pattern = index.levels[level - 1]
            shared = mask[i] & mask[j]
            fresh = shared & ~known[owner]
            apart = apart[owner] + np.bitwise_count((pattern[i] ^ pattern[j]) & fresh)
            close = apart <= radius
            if close.any():
                stack.append((level - 1, i[close], j[close], apart[close], shared[close]))
            continue
        hit = (label[i] != label[j]) & (_distance(fp[i], fp[j]) <= radius)
        if not hit.any():
            continue
        links = np.unique(np.stack((label[i[hit]], label[j[hit]]), 1), axis=0)
        for x, y in links.tolist():
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label = parent[label]
        uniform = index.uniform(label)
    return label


def search(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Stars (u, v): u is in the component of v < u inside some top node."""

    def stars(fp, path, pattern):
        key = np.concatenate(([False], (path[1:] != path[:-1]) | (pattern[1:] != pattern[:-1])))
        group = np.cumsum(key)
        order = np.lexsort((gray_rank(fp), group))
        fp, group = fp[order], group[order]
        label = components_within(fp, group, radius)
        least = np.full(label.max() + 1, np.int64(2**63 - 1))
        np.minimum.at(least, label, fp.view(np.int64))
        u, v = fp.view(np.int64), least[label]
        return pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append([b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy()])
            n += b.num_rows
            if n >= ROWS:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                changes = np.nonzero((whole[1][1:] != whole[1][:-1]) | (whole[2][1:] != whole[2][:-1]))[0]
                if len(changes):
                    end = changes[-1] + 1
                    yield stars(*(x[:end] for x in whole))
                    whole = [x[end:] for x in whole]
                held, n = [whole], len(whole[0]) if len(changes) else 0
        if held:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            if len(whole[0]):
                yield stars(*whole)

    return nodes.select("fp", "path", "pattern").repartition("path", "pattern").sortWithinPartitions("path", "pattern").mapInArrow(run, "u long, v long")


def links(distinct: DataFrame, limit: int | None = None, radius: int = RADIUS) -> DataFrame:
    """Stars over the distinct fingerprints of column fp.

    At most 4 * 4,096 nodes can exceed the limit at a level, so their list may be broadcast.
    """
    n = distinct.count()
    limit = limit or max(4096, n // 4096)
    rows = nodes_below(distinct.select("fp", F.lit(0).alias("path")))
    found = []
    for _ in range(LEVELS - 1):
        large = cut(rows.groupBy("path", "pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).drop("n"))
        if large.isEmpty():
            break
        found.append(search(rows.join(F.broadcast(large), ["path", "pattern"], "left_anti"), radius))
        rows = nodes_below(rows.join(F.broadcast(large), ["path", "pattern"], "left_semi"))
    found.append(search(rows, radius))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(u, v): v is the smallest value that u is connected with, for each u that is not itself
    the smallest.  Alternating large-star and small-star steps, each cut from its lineage, until
    nothing changes, which takes a number of steps of the order of the logarithm's square."""
    e = cut(edges.where("u > v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        e = cut(star.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before:
            return e
        before = now


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS, limit: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, check, fp, and ``least``, the smallest (whether the
    id is null, doc_id, check) of its component."""
    if radius > RADIUS:
        raise ValueError("four blocks find links of at most 3 differing bits")
    fps = cut(fingerprints(docs, id_col, text_col, words))
    distinct = cut(fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "check")).alias("own"), F.count(F.lit(1)).alias("n")))
    root = connected(links(distinct, limit, radius))
    member = distinct.join(root.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("own").alias("least"))
    of = cut(member.join(least, "root").select("fp", "least", "n"))
    rows = of.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(of.where(F.col("n") * HOT > rows).drop("n"))
    cold = fps.join(hot.select("fp"), "fp", "left_anti").join(of.where(F.col("n") * HOT <= rows).drop("n"), "fp")
    return fps.join(hot, "fp").unionByName(cold)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id."""
    found = components(docs, id_col, text_col, **options)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component.

    Rows are known by id and hash of the text.  Those that go are found first and taken out by
    an anti-join, so that texts are shuffled only where the list of them is counted to be too
    long to broadcast; rows that repeat id and text of one that stays are few and meet apart.
    """
    found = cut(components(docs, id_col, text_col, **options).select(F.col("doc_id").alias("i"), F.col("check").alias("c"), (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("check") == F.col("least.check"))).alias("stays")))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), _check(F.col(text_col)).alias("check"))

    def match(t: DataFrame):
        return rows["id"].eqNullSafe(t["i"]) & (rows["check"] == t["c"])

    gone = if_few(found.where(~F.col("stays")).select("i", "c").distinct(), BROADCAST_GONE)
    again = cut(found.where("stays").groupBy("i", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    kept = rows.join(gone, match(gone), "left_anti")
    if again.isEmpty():
        return kept.select("row.*")
    once = rows.join(again, match(again), "left_semi").groupBy("id", "check").agg(F.first("row").alias("row"))
    return kept.join(again, match(again), "left_anti").select("row.*").unionByName(once.select("row.*"))
