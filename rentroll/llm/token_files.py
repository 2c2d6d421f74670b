"""Token ids as binary files: one concatenated id array with Elias-Fano document boundaries.

Documents are dealt to tasks by ranges of doc_id and sorted inside a task, so files in the order of their part hold all
documents in ascending doc_id. A task cuts its run into segments of about ``segment_ids`` ids. A segment is one
self-contained byte string, stored as a row (part, segment, n_docs, n_ids, data) of a Parquet table, so it can lie in
any store Spark writes to and a lost task is simply written again:

    header      magic, bytes per id, documents, documents without doc_id, ids, smallest doc_id
    boundaries  Elias-Fano, documents + 1 values: where each document's ids begin in the segment
    doc_ids     Elias-Fano of the doc_ids less the smallest
    ids         16 bits each while the vocabulary allows, else 32

A byte-level tokenizer with the usual pattern never joins across a space that follows a visible character, so texts are cut
there, equal pieces are found once per batch, and a store (bounded by pieces and by bytes) keeps those met before. Pieces
not met before go to the library as one text, in which they again can't be joined; the lengths of its tokens tell where
each piece ends. The ids are those of the whole text.
"""

import os
import struct
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from rentroll.llm import elias_fano
from rentroll.llm.shared import place
from rentroll.llm.words import buffer_of, parts_of

HEADER = struct.Struct("<4sBQQQq")
MAGIC = b"RTID"
SEGMENTS = "part int, segment int, n_docs bigint, n_ids bigint, data binary"
DOCUMENTS = "part int, segment int, doc_id bigint, in_segment bigint, n_tokens bigint, ids_crc32 bigint"
VISIBLE = np.zeros(256, bool)
VISIBLE[0x21:0x7F] = True
VISIBLE[0x80:] = True
# The last two bytes of white space beyond ASCII.
WIDE = [(0xC2, 0x85), (0xC2, 0xA0), (0x9A, 0x80), *[(0x80, b) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)], (0x81, 0x9F)]
WHITE = np.zeros(1 << 16, bool)
WHITE[[a << 8 | b for a, b in WIDE]] = True


def after_visible(raw):
    """For every byte whether it ends a visible character; some characters that end like white space count as such."""
    seen = VISIBLE[raw]
    if len(raw) > 1:
        seen[1:] &= ~WHITE[raw[:-1].astype(np.uint16) << 8 | raw[1:]]
    return seen


class Encoder:
    """Ids of texts as packed bytes, with a bounded store of the pieces seen before."""

    def __init__(self, path, keep=1_000_000, size=32_000_000, longest=100):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int32)  # a byte-level token has a character for each byte
        self.widths[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.keep, self.size, self.longest = keep, size, longest
        self.store, self.held = {}, 0

    def packed(self, texts):
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def joined(self, pieces):
        """Packed ids of pieces that begin with a space and end with a visible character."""
        text = b"".join(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, self.kind)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        reached = np.cumsum(self.widths[ids])
        at = np.searchsorted(reached, ends)
        if not np.array_equal(reached[at], ends):
            raise ValueError("a token lies across two pieces: no byte-level tokenizer with the usual pattern")
        data = ids.tobytes()
        bounds = [0, *((at + 1) * self.kind.itemsize).tolist()]
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def known(self, pieces, free):
        """Packed ids of each of the distinct pieces; ``free``: those that can be joined."""
        found = list(map(self.store.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        apart = [i for i in new if not free[i]]
        for i, ids in zip(apart, self.packed([pieces[i].decode() for i in apart])):
            found[i] = ids
        together = [i for i in new if free[i]]
        for row in range(0, len(together), 20_000):
            some = together[row : row + 20_000]
            for i, ids in zip(some, self.joined([pieces[i] for i in some])):
                found[i] = ids
        for i in new:
            if len(pieces[i]) <= self.longest and len(self.store) < self.keep and self.held < self.size:
                self.store[pieces[i]] = found[i]
                self.held += len(pieces[i]) + len(found[i])
        if len(self.store) >= self.keep or self.held >= self.size:  # the pieces met last make room
            for piece in list(islice(reversed(self.store), len(self.store) // 4)):
                self.held -= len(piece) + len(self.store.pop(piece))
        return found

    def encode(self, texts):
        """Packed ids of each text of an Arrow string array."""
        raw, at = buffer_of(texts)
        seen = after_visible(raw)
        opens = np.zeros(len(raw) + 1, bool)
        opens[1:-1] = (raw[1:] == 32) & seen[:-1]
        opens[at] = True
        data, whole = raw.tobytes(), []
        for special in self.special:  # a text that holds one stays whole
            found = data.find(special)
            while found >= 0:
                i = int(np.searchsorted(at, found, "right")) - 1
                opens[at[i] + 1 : at[i + 1]] = False
                whole.append(int(at[i]))
                found = data.find(special, int(at[i + 1]))
        edges = np.flatnonzero(opens)
        array = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]
        ).dictionary_encode()
        pieces = array.dictionary.to_pylist()
        which = array.indices.to_numpy(zero_copy_only=False)
        free = np.zeros(len(pieces), bool)  # equal pieces begin and end alike
        free[which] = (raw[edges[:-1]] == 32) & seen[edges[1:] - 1] if len(which) else False
        free[which[np.searchsorted(edges[:-1], whole)]] = False
        ids = self.known(pieces, free)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        pool = np.frombuffer(b"".join(ids), self.kind)
        begin = np.cumsum(sizes) - sizes
        n = sizes[which]
        to = np.concatenate([[0], np.cumsum(n)])
        out = pool[np.arange(to[-1], dtype=np.int32) + np.repeat((begin[which] - to[:-1]).astype(np.int32), n)].tobytes()
        bounds = (to[np.searchsorted(edges[:-1], at)] * self.kind.itemsize).tolist()
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


ENCODERS = {}


def encoder(path, keep):
    """This worker's encoder: its store lasts from task to task."""
    if (path, keep) not in ENCODERS:
        ENCODERS[path, keep] = Encoder(path, keep)
    return ENCODERS[path, keep]


def pack(kind, doc_ids, packed):
    """One segment from doc_ids (ascending, None first) and the packed ids of their documents."""
    sizes = np.array([len(p) for p in packed], np.int64) // kind.itemsize
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    head = HEADER.pack(MAGIC, kind.itemsize, len(doc_ids), len(doc_ids) - len(known), int(bounds[-1]), least)
    names = elias_fano.encode([d - least for d in known], known[-1] - least if known else 0)
    return head + elias_fano.encode(bounds, bounds[-1]) + names + b"".join(packed)


class Segment:
    """Reads a segment; ``ids(i)`` finds document i by select, without reading the others."""

    def __init__(self, data):
        magic, width, self.n_docs, self.n_null, self.n_ids, self.least = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("no segment of token ids")
        self.bounds = elias_fano.Reader(data, HEADER.size)
        self.names = elias_fano.Reader(data, self.bounds.end)
        self.array = np.frombuffer(data, f"<u{width}", self.n_ids, self.names.end)

    def doc_ids(self):
        return [None] * self.n_null + [int(v) + self.least for v in self.names.all().tolist()]

    def ids(self, i):
        return self.array[self.bounds.select(i) : self.bounds.select(i + 1)]


def write(documents, path, tokenizer, end_id=2, segment_ids=2_000_000, keep=1_000_000):
    """Write ``documents`` (doc_id, text) as segments below ``path``, in ascending doc_id, those without one first."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = {"<u2": struct.pack("<H", end_id), "<u4": struct.pack("<I", end_id)}

    def run(batches):
        coder = encoder(tokenizer, keep)
        part, segment = TaskContext.get().partitionId(), 0
        stop = end[coder.kind.str]
        names, packed, size = [], [], 0

        def flush():
            data = pack(coder.kind, names, packed)
            columns = ([part], [segment], [len(names)], [size // coder.kind.itemsize], [data])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            fields = ["part", "segment", "n_docs", "n_ids", "data"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], fields)

        for batch in batches:
            for some in parts_of(batch, "text", rows=4000, size=2 << 20):
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), coder.encode(some.column("text"))):
                    names.append(doc_id)
                    packed.append(ids + stop)
                    size += len(ids) + len(stop)
                    if size >= segment_ids * coder.kind.itemsize:
                        yield flush()
                        names, packed, size, segment = [], [], 0, segment + 1
        if names:
            yield flush()

    (
        documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.spark_partition_id().alias("source"))
        .repartitionByRange(parts, "doc_id", "source")  # the second key divides rows without a doc_id
        .sortWithinPartitions("doc_id", "source", F.xxhash64("text"))
        .select("doc_id", "text")
        .mapInArrow(run, SEGMENTS)
        .write.option("compression", "zstd")
        .parquet(path)
    )


def read(spark, path):
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (all bigint)."""
    stored = spark.read.parquet(path)

    def run(batches):
        for batch in batches:
            for part, segment, data in zip(*(batch.column(c).to_pylist() for c in ("part", "segment", "data"))):
                s = Segment(data)
                at = s.bounds.all().astype(np.int64)
                sums = [zlib.crc32(s.array[a:b].astype("<u4")) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                n = s.n_docs
                columns = [np.full(n, part, np.int32), np.full(n, segment, np.int32), s.doc_ids(), at[:-1], np.diff(at), sums]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                fields = ["part", "segment", "doc_id", "in_segment", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], fields)

    sizes = stored.select("part", "segment", "n_ids")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per task that wrote
    before = parts.select("part", F.coalesce(F.sum("n").over(earlier.orderBy("part")), F.lit(0)).alias("part_start"))
    inside = earlier.partitionBy("part").orderBy("segment")
    starts = sizes.select("part", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside")).join(before, "part")
    documents = stored.select("part", "segment", "data").mapInArrow(run, DOCUMENTS)
    return documents.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("part_start") + F.col("inside") + F.col("in_segment")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(documents, tokenizer, end_id=2, path=None, **options):
    """Write the files (below the shared folder unless ``path`` is given) and read every document back.

    Null text counts as empty: only the end id. Documents without a doc_id come before all others; documents that
    repeat a doc_id follow one another and each keeps its own ids. No documents give no segments and an empty result.
    """
    spark = documents.sparkSession
    path = path or place(spark, "token-ids")
    write(documents, path, tokenizer, end_id, **options)
    return read(spark, path)
