"""Cross-entropy difference between two matched n-gram models.

A target model (documents of a given label) and a background model (all documents) count words
and pairs of a word with the one before, as they are, over one shared vocabulary: every word of
the corpus, with WORDS places at least (places without a word are for words not met).  Counts
cover every document.  The background's are scaled to the target's total, so that both smooth
alike.  A document that was counted is scored by what all others count: its own counts are taken
out first, so that neither model has seen it.  p(w | v) mixes the pair's count with p(w): (n(v w) + STRENGTH p(w)) / (n(v) + STRENGTH).
Over all w, and the chance that a text ends after v, this adds up to 1.

Documents are read in batches of about TOKENS words, which are written to the shared folder.
A batch deals its distinct words and pairs, with their counts, by a hash to buckets, of which
there are as many as the texts are long; a bucket adds up equal ones and answers each batch with
the sums.  Words and pairs are compared by their bytes; the hash only deals them.  So a frequent
pair is one entry a batch, and nothing but a few totals reaches the driver.

Defined cases: a null text, or one without words, has 0 tokens and all losses 0; a very long text
is a batch of its own; an empty table gives an empty result; further columns, whatever their
names, are left out; without target
documents (or labels) the target model is the background model and every score is 0; labels of
ids that repeat count once; rows repeated are counted and returned as often; words and pairs
that were not counted have count 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, if_few

WORDS = 1 << 18
PRIOR, STRENGTH = 0.5, 4.0
TOKENS = 1 << 20
#: Bytes of text for each bucket.
BUCKET_BYTES = 10 << 20
#: Ids of target documents that may be broadcast (16 MB); more are joined by shuffling texts once.
BROADCAST_IDS = 1_000_000


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(w, digest_size=8).digest() for w in words), np.uint64)


def _mixed(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    x = (before * np.uint64(0x9E3779B97F4A7C15) + h) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _pack(*parts) -> bytes:
    import zstandard as z

    return z.ZstdCompressor(level=9).compress(pickle.dumps(parts, protocol=5))


def _unpack(data: pa.Scalar) -> tuple:
    import zstandard as z

    return pickle.loads(z.ZstdDecompressor().decompress(data.as_buffer()))


def _narrow(n: np.ndarray) -> np.ndarray:
    return n.astype(np.min_scalar_type(int(n.max()) if len(n) else 0))


def _planes(n: np.ndarray) -> np.ndarray:
    """The bytes of numbers below 2**32 by their place."""
    return n.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()


def _unplaned(planes: np.ndarray) -> np.ndarray:
    return planes.T.copy().view("<u4").reshape(-1)


def _buffers(keys: pa.Array) -> tuple[np.ndarray, bytes]:
    """Ends and bytes of an array of strings made here (so it starts at 0)."""
    ends = np.frombuffer(keys.buffers()[1], np.int64)[: len(keys) + 1]
    return ends, memoryview(keys.buffers()[2] or b"")


def _keys(parts: list[tuple[np.ndarray, bytes]]) -> pa.Array:
    """From lengths and bytes."""
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([n.astype(np.int64) for n, _ in parts]))])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(d for _, d in parts))])


@dataclass
class Batch:
    """Documents by numbers: ``home`` holds the bucket of each distinct word, ``codes`` numbers of
    words by token.  The words themselves are kept apart, as only messages need them."""

    ids: list
    marks: list
    lengths: np.ndarray
    home: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, data: pa.Scalar) -> Batch:
        *parts, planes = _unpack(data)
        return cls(*parts, _unplaned(planes))

    def packed(self) -> bytes:
        return _pack(self.ids, self.marks, _narrow(self.lengths), _narrow(self.home), _planes(self.codes))

    def __post_init__(self) -> None:
        self.codes, self.lengths = self.codes.astype(np.int64), self.lengths.astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.later = np.ones(len(self.codes), bool)
        self.later[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = False
        after = np.nonzero(self.later)[0]
        self.pairs, self.pair = np.unique(self.codes[after - 1] * max(1, len(self.home)) + self.codes[after], return_inverse=True)

    def dealt(self, buckets: int) -> tuple[list, list]:
        """Order of words and of pairs by bucket, and where each bucket starts and ends there.  A
        pair's bucket follows from those of its words."""
        n, h = max(1, len(self.home)), self.home.astype(np.uint64)
        of = [self.home.astype(np.int64), (_mixed(h[self.pairs // n], h[self.pairs % n]) % np.uint64(buckets)).astype(np.int64)]
        order = [np.argsort(x, kind="stable") for x in of]
        return order, [np.searchsorted(x[o], np.arange(buckets + 1)) for x, o in zip(of, order, strict=True)]

    def own(self) -> np.ndarray:
        """For each token how often its document has its word, and its pair (0 for first words)."""
        out = np.zeros((2, len(self.codes)))
        _, at, n = np.unique(self.doc * max(1, len(self.home)) + self.codes, return_inverse=True, return_counts=True)
        out[0] = n[at]
        _, at, n = np.unique(self.doc[self.later] * max(1, len(self.pairs)) + self.pair, return_inverse=True, return_counts=True)
        out[1, self.later] = n[at]
        return out

    def counts(self) -> list[list[np.ndarray]]:
        """Of words and of pairs: in documents with a mark, and in all."""
        mark = np.array(self.marks, bool)[self.doc]
        return [[np.bincount(c, m, n).astype(np.int64) for m in (k, None)] for c, k, n in ((self.codes, mark, len(self.home)), (self.pair, mark[self.later], len(self.pairs)))]

    def messages(self, words: list[bytes], buckets: int, counted: bool) -> Iterator[tuple[int, bytes]]:
        """For each bucket its words and its pairs: lengths, bytes, counts (none if not counted)."""
        order, ends = self.dealt(buckets)
        n, words = max(1, len(words)), pa.array(words, pa.large_binary())
        v, w = (words.take(pa.array(x)) for x in (self.pairs[order[1]] // n, self.pairs[order[1]] % n))
        keys = [_buffers(words.take(pa.array(order[0]))), _buffers(pc.binary_join_element_wise(v, w, pa.scalar(b" ", pa.large_binary())))]
        sums = [[x[o] for x in c] for c, o in zip(self.counts(), order, strict=True)] if counted else [[], []]
        for b in range(buckets):
            parts = []
            for e, (at, data), c in zip(ends, keys, sums, strict=True):
                i, j = e[b], e[b + 1]
                parts += [_narrow(np.diff(at[i : j + 1])), bytes(data[at[i] : at[j]]), [_narrow(x[i:j]) for x in c]]
            if len(parts[0]) or len(parts[3]):
                yield b, _pack(*parts)


def _batches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[Batch, list[bytes]]]:
    """From rows of (doc_id, text, is_target); with the words of each batch."""
    ids, marks, lengths, codes, code = [], [], [], [], {}
    n = 0

    def made() -> tuple[Batch, list[bytes]]:
        """Frequent words get small numbers, which pack better."""
        numbers, words = np.array(codes, np.int64), list(code)
        order = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        words = [words[k] for k in order]
        home = (_hashes(words) % np.uint64(buckets)).astype(np.int64)
        return Batch(ids, marks, np.array(lengths, np.int64), home, place[numbers]), words

    for b in batches:
        for i, text, mark in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            words = _split(text.as_py())
            ids.append(i)
            marks.append(bool(mark))
            lengths.append(len(words))
            codes.extend([code.setdefault(w, len(code)) for w in words])
            n += len(words)
            if n >= TOKENS or len(ids) >= TOKENS:
                yield made()
                ids, marks, lengths, codes, code = [], [], [], [], {}
                n = 0
    if ids:
        yield made()


def _rows(names: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, names.values(), strict=True)], names=list(names))


@dataclass
class Models:
    """The batches to count, the documents they were made of, and what is known of them."""

    docs: DataFrame
    columns: tuple[str, str]
    batches: DataFrame
    buckets: int
    target: int
    background: int


BATCHES = "batch long, target long, background long, data binary, words binary"
MESSAGES = "bucket int, batch long, counted boolean, asks boolean, data binary"
ANSWERS = "bucket int, batch long, n_words long, data binary"


def _written(rows: DataFrame, buckets: int, base: int = 0) -> DataFrame:
    """Batches of rows (doc_id, text, is_target), with their numbers of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = base + (TaskContext.get().partitionId() << 32)
        for k, (b, words) in enumerate(_batches(batches, buckets)):
            target = int(b.lengths[np.array(b.marks, bool)].sum())
            yield _rows({"batch": pa.int64(), "target": pa.int64(), "background": pa.int64(), "data": pa.binary(), "words": pa.binary()}, [(first + k, target, len(b.codes), b.packed(), _pack(words))])

    return cut(rows.mapInArrow(run, BATCHES))


def _messages(batches: DataFrame, buckets: int, counted: bool, asks: bool) -> DataFrame:
    names = {"bucket": pa.int32(), "batch": pa.int64(), "counted": pa.bool_(), "asks": pa.bool_(), "data": pa.binary()}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            for batch, data, words in zip(r["batch"].to_pylist(), r["data"], r["words"], strict=True):
                yield _rows(names, [(k, batch, counted, asks, m) for k, m in Batch.of(data).messages(*_unpack(words), buckets, counted)])

    return batches.select("batch", "data", "words").mapInArrow(run, MESSAGES)


def _answers(messages: DataFrame) -> DataFrame:
    """The sums of the counted messages for each that asks, less its own counts, which it knows
    and which are most of the sum; n_words, the bucket's distinct counted words, is in one row."""

    def run(table: pa.Table) -> pa.Table:
        parts = list(map(_unpack, table["data"]))
        counted, n_words, found = table["counted"].to_pylist(), 0, []
        for k in (0, 3):
            keys = _keys([p[k : k + 2] for p in parts]).dictionary_encode()
            at = keys.indices.to_numpy()
            ends = np.cumsum([len(p[k]) for p in parts])[:-1]
            for j in (0, 1):
                n = np.concatenate([p[k + 2][j] if c else np.zeros(len(p[k]), np.uint8) for p, c in zip(parts, counted, strict=True)])
                total = np.bincount(at, n, len(keys.dictionary)).astype(np.int64)
                found.append(np.split(total[at] - n.astype(np.int64), ends))
                n_words = int((total > 0).sum()) if (k, j) == (0, 1) else n_words
        bucket = table["bucket"][0].as_py()
        rows = [(bucket, None, n_words, None)]
        rows += [(bucket, b, 0, _pack(*(_narrow(f[i]) for f in found))) for i, (b, a) in enumerate(zip(table["batch"].to_pylist(), table["asks"].to_pylist(), strict=True)) if a]
        return pa.Table.from_batches([_rows({"bucket": pa.int32(), "batch": pa.int64(), "n_words": pa.int64(), "data": pa.binary()}, rows)])

    return cut(messages.groupBy("bucket").applyInArrow(run, ANSWERS))


def fit(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Models:
    """What both models count; ``targets`` holds the ids of target documents."""
    ids = if_few(targets.select(F.col(id_col).alias("t_id")).where(F.col("t_id").isNotNull()).distinct(), BROADCAST_IDS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id_"))
    buckets = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES + 1
    batches = _written(rows.join(ids, F.col("id_") == F.col("t_id"), "left").select("doc_id", "text", F.col("t_id").isNotNull().alias("is_target")), buckets)
    n = batches.agg(F.sum("target"), F.sum("background")).first()
    return Models(docs, (id_col, text_col), batches, buckets, n[0] or 0, n[1] or 0)


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (their difference in nats per
    token; the lower, the more a document is like the target's).  Documents that were counted
    are not read again."""
    buckets, totals = models.buckets, (models.target, models.background)
    known = docs is models.docs and (id_col, text_col) == models.columns
    if known:
        batches = models.batches
        messages = _messages(batches, buckets, True, True)
    else:
        batches = _written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(False).alias("is_target")), buckets, 1 << 62)
        messages = _messages(models.batches, buckets, True, False).union(_messages(batches, buckets, False, True))
    found = _answers(messages)
    vocabulary = max(WORDS, found.agg(F.sum("n_words")).first()[0] or 0)

    def scored(table: pa.Table) -> pa.Table:
        parts = dict(zip(table["bucket"].to_pylist(), table["data"], strict=True))
        b = Batch.of(parts.pop(None))
        word, pair = np.zeros((2, len(b.home))), np.zeros((2, len(b.pairs)))
        (words, pairs), ends = b.dealt(buckets)
        for k, data in parts.items():
            one, two = words[ends[0][k] : ends[0][k + 1]], pairs[ends[1][k] : ends[1][k + 1]]
            word[0][one], word[1][one], pair[0][two], pair[1][two] = _unpack(data)
        if known:
            word, pair = (more + np.array(own) for more, own in zip((word, pair), b.counts(), strict=True))
        if not totals[0]:
            word[0], pair[0] = word[1], pair[1]
        n, own = np.maximum(b.lengths, 1), known * b.own()
        mark = np.array(b.marks, bool) if totals[0] else np.ones(len(n), bool)
        before, later = b.codes[np.nonzero(b.later)[0] - 1], np.nonzero(b.later)[0]
        losses = []
        for count, both, total, counted, scale in zip(word, pair, (totals[0] or totals[1], totals[1]), (mark, np.ones(len(n), bool)), (1.0, (totals[0] or totals[1]) / max(1, totals[1])), strict=True):
            mine = own * counted[b.doc]
            seen, context = np.zeros((2, len(b.codes)))
            base = ((count[b.codes] - mine[0]) * scale + PRIOR) / ((total - known * (b.lengths * counted)[b.doc]) * scale + PRIOR * vocabulary)
            seen[later], context[later] = (both[b.pair] - mine[1][later]) * scale, (count[before] - mine[0][later - 1]) * scale
            loss = -np.log((seen + STRENGTH * base) / (context + STRENGTH))
            losses.append(np.bincount(b.doc, loss, len(n)) / n)
        t, g = losses
        return pa.table([pa.array(b.ids, pa.int64()), pa.array(b.lengths), *map(pa.array, (t, g, t - g))], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    whole = batches.select(F.lit(None).cast("int").alias("bucket"), "batch", "data")
    answers = found.where("batch is not null").select("bucket", "batch", "data")
    return whole.union(answers).groupBy("batch").applyInArrow(scored, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
