"""Subword pieces with the bytes they came from.

``Normalizer`` reads the compiled character map of a SentencePiece model: a double-array trie over byte strings, and the
texts that replace them. At every place the longest key that begins there is replaced (a character without a key stays),
white space is trimmed, escaped and prefixed as the model says, and each byte of the result records the place in the
source where its key or character began. All places of a batch walk the trie at once.

Pieces never lie across the mark that stands for a space and the character before it, so a normalised text is cut there
and equal cuts are encoded once per batch; a store keeps those met before, bounded by entries and bytes. The library
sees normalised cuts only: its own normalisation is switched off. The lengths of the pieces add up to the normalised text,
and through the recorded places every piece gets its span of source bytes: [begin, end).

Models with user-defined symbols, with the space mark as suffix or without byte fallback are refused.
"""

import struct
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from rentroll.llm.words import buffer_of, parts_of

MARK = "▁".encode()
PIECES = "doc_id bigint, ids array<int>, begins array<int>, ends array<int>"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6  # fixed values: kinds of pieces in the model file


def varint(data, at):
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def message(data):
    """(field, value) of a protocol buffer: integers, or bytes of a fixed or given length."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        if tag & 7 == 0:
            value, at = varint(data, at)
        else:
            size, at = varint(data, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Normalizer:
    """Normalisation by a model's specification: the fields of its message, by number."""

    def __init__(self, spec):
        charsmap = spec.get(2, b"")
        self.prefix, self.trim, self.escape = (bool(spec.get(f, 1)) for f in (3, 4, 5))
        self.units = None
        self.values = b""
        if charsmap:
            size = struct.unpack_from("<I", charsmap)[0]
            self.units = np.frombuffer(charsmap, "<u4", size // 4, 4).astype(np.int64)
            self.values = charsmap[4 + size :]
        self.space = MARK if self.escape else b" "

    def longest(self, raw, ends, starts):
        """(length, value) of the longest key at each of ``starts``, 0 and -1 where none begins; ``ends``: of its text."""
        length, value = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
        units, i = self.units, np.arange(len(starts))
        node = np.full(len(starts), self.offset(units[:1])[0])
        step = 0
        while len(i):
            inside = starts[i] + step < ends[i]
            i, node = i[inside], node[inside]
            byte = raw[starts[i] + step].astype(np.int64)
            node = node ^ byte
            unit = units[np.minimum(node, len(units) - 1)]
            fits = (node < len(units)) & (unit & (1 << 31 | 0xFF) == byte)
            i, node, unit = i[fits], node[fits], unit[fits]
            node = node ^ self.offset(unit)
            step += 1
            leaf = unit >> 8 & 1 == 1
            length[i[leaf]] = step
            value[i[leaf]] = units[node[leaf]] & (1 << 31) - 1
        return length, value

    @staticmethod
    def offset(unit):
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def __call__(self, raw, at):
        """(normalised bytes, bounds, source, ends) of texts that lie from ``at[i]`` to ``at[i + 1]`` in ``raw``.

        ``source[j]`` is the place in its text where byte j's key or character begins, ``ends[i]`` where text i ends.
        """
        n_texts = len(at) - 1
        starts = np.flatnonzero(raw & 0xC0 != 0x80).astype(np.int32)
        text = np.repeat(np.arange(n_texts, dtype=np.int32), np.diff(np.searchsorted(starts, at)))
        at = at.astype(np.int32)
        length, value = self.longest(raw, at[text + 1], starts) if self.units is not None else (None, None)
        own = np.diff(starts, append=np.int32(len(raw)))
        many = np.flatnonzero(length > own) if self.units is not None else ()
        if len(many):  # a key of several characters hides the units that would begin inside it
            hidden, last = np.zeros(len(starts), bool), 0
            for i in many.tolist():
                if starts[i] < last:
                    continue
                last = int(starts[i] + length[i])
                hidden[i + 1 : np.searchsorted(starts, last)] = True
            stay = ~hidden
            starts, text, length, value, own = starts[stay], text[stay], length[stay], value[stay], own[stay]

        # Every unit copies from a pool: the source, the escaped space, then the replacements met here.
        pool, where = [raw.tobytes(), self.space], {}
        used = len(raw) + len(self.space)
        begin, size = starts.copy(), own.copy()
        blank = raw[starts] == 32
        lead, tail = blank.astype(np.int32), blank.astype(np.int32)  # spaces that a unit begins and ends with
        alone = blank.copy()  # units that are one space
        begin[blank], size[blank] = len(raw), len(self.space)
        for v in np.unique(value[value >= 0]).tolist() if self.units is not None else ():
            new = self.values[v : self.values.index(b"\0", v)]
            said = new.replace(b" ", self.space)
            where[v] = (used, len(said), len(new) - len(new.lstrip(b" ")), len(new) - len(new.rstrip(b" ")), new == b" ")
            pool.append(said)
            used += len(said)
        if where:
            mapped = np.flatnonzero(value >= 0)
            found = np.array([where[v] for v in value[mapped].tolist()])
            begin[mapped], size[mapped], lead[mapped], tail[mapped] = found[:, :4].T
            alone[mapped] = found[:, 4] == 1

        width, place = len(self.space), starts - at[text]
        ends = np.diff(at)
        stopped = np.full(n_texts, -1)
        first = np.searchsorted(text, np.arange(n_texts + 1))
        opening, silent = first[:-1].copy(), np.zeros(n_texts, bool)
        if self.trim and len(starts):
            loud = np.flatnonzero(size > 0)  # units that leave something behind
            before = np.searchsorted(loud, np.arange(len(starts))) - 1
            earlier = loud[np.maximum(before, 0)] if len(loud) else np.zeros(len(starts), np.int64)
            open_ = (before < 0) | (text[earlier] != text) | (tail[earlier] > 0)
            cut = np.where(open_, lead, 0)
            begin, size = begin + cut * width, size - cut * width
            rest = np.flatnonzero(~alone)
            opening = rest[np.minimum(np.searchsorted(rest, first[:-1]), max(len(rest) - 1, 0))] if len(rest) else first[1:]
            opening = np.where((opening >= first[:-1]) & (opening < first[1:]), opening, first[1:])
            heard = np.flatnonzero(size > 0)
            final = np.searchsorted(heard, first[1:]) - 1
            last = np.append(heard, -1)[final]  # -1: none
            silent = (last < first[:-1]) & (opening < first[1:])  # trimming takes even the prefix
            ending = np.flatnonzero(~silent & (opening < first[1:]))
            ending = ending[tail[last[ending]] > 0]
            units = last[ending]
            size[units] -= np.minimum(tail[units] * width, size[units])
            stopped[ending] = place[units]
            if self.prefix:
                stopped[silent] = place[opening[silent]]
        ends = np.where(stopped >= 0, stopped, ends)
        live = opening < first[1:]  # texts that aren't empty or all space
        ends = np.where(live, ends, 0)
        if self.prefix and (live & ~silent).any():
            marks = opening[live & ~silent]
            begin, size = np.insert(begin, marks, len(raw)), np.insert(size, marks, width)
            place, text = np.insert(place, marks, place[marks]), np.insert(text, marks, text[marks])
        stream = np.concatenate([[0], np.cumsum(size)])
        bounds = stream[np.searchsorted(text, np.arange(n_texts + 1))]
        kind = np.int32 if max(stream[-1], used) < 1 << 31 else np.int64
        shift = (begin - stream[:-1]).astype(kind)
        out = np.frombuffer(b"".join(pool), np.uint8)[np.arange(stream[-1], dtype=kind) + np.repeat(shift, size)]
        return out, bounds, np.repeat(place, size), ends


class Coder:
    """Piece ids and source spans of texts, with a bounded store of the cuts met before."""

    def __init__(self, path, entries=400_000, size=16_000_000, longest=100):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        fields = list(message(model))
        pieces = [dict(message(v)) for k, v in fields if k == 1]
        kinds = [p.get(3, NORMAL) for p in pieces]
        training = dict(message(b"".join(v for k, v in fields if k == 2)))
        if USER in kinds or BYTE not in kinds or training.get(24):
            raise ValueError(f"{path}: user-defined symbols, no byte fallback, or the space mark as suffix")
        self.normalizer = Normalizer(dict(message(b"".join(v for k, v in fields if k == 3))))
        self.widths = np.array([1 if k == BYTE else len(p[1]) for p, k in zip(pieces, kinds)], np.int32)
        self.cuts = self.normalizer.escape and not any(self.crosses(p[1]) for p in pieces)
        # A later message of the same field overrides: no map, no prefix, no trimming, no escaping.
        plain = bytes([3 << 3 | 2, 8, 2 << 3 | 2, 0, 3 << 3, 0, 4 << 3, 0, 5 << 3, 0])
        self.library = sentencepiece.SentencePieceProcessor()
        self.library.LoadFromSerializedProto(model + plain)
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end_id = self.library.eos_id()
        self.entries, self.size, self.longest = entries, size, longest
        self.store, self.held = {}, 0

    @staticmethod
    def crosses(piece):
        """Whether a piece holds the mark after another character."""
        return MARK in piece.decode().lstrip(MARK.decode()).encode()

    def known(self, cuts):
        """Packed ids of each of the distinct cuts."""
        found = list(map(self.store.get, cuts))
        new = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(new, self.library.encode([cuts[i].decode() for i in new], num_threads=1, return_type="numpy")):
            found[i] = ids = ids.astype("<i4").tobytes()
            if len(cuts[i]) <= self.longest and len(self.store) < self.entries and self.held < self.size:
                self.store[cuts[i]] = ids
                self.held += len(cuts[i]) + len(ids)
        if len(self.store) >= self.entries or self.held >= self.size:  # the cuts met last make room
            for c in list(islice(reversed(self.store), len(self.store) // 4)):
                self.held -= len(c) + len(self.store.pop(c))
        return found

    def encode(self, raw, at):
        """(ids, token bounds, begins, ends) of the texts from ``at[i]`` to ``at[i + 1]`` in ``raw``, end ids included."""
        text, bounds, source, stops = self.normalizer(raw, at)
        opens = np.zeros(len(text) + 1, bool)
        if self.cuts and len(text) > 2:
            mark = np.zeros(len(text) + 3, bool)
            mark[: len(text) - 2] = (text[:-2] == MARK[0]) & (text[1:-1] == MARK[1]) & (text[2:] == MARK[2])
            opens[3 : len(text)] = mark[3 : len(text)] & ~mark[: len(text) - 3]
            opens[1:3] = mark[1:3]
        opens[bounds] = True
        edges = np.flatnonzero(opens)
        array = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))]
        ).dictionary_encode()
        cuts = array.dictionary.to_pylist()
        ids = self.known(cuts) + [np.array([self.end_id], "<i4").tobytes()]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), "<i4")
        widths = self.widths[pool]
        widths[-1] = 0
        begin = np.cumsum(sizes, dtype=np.int32) - sizes
        said = np.add.reduceat(widths, begin)[:-1] if cuts else np.zeros(0, np.int32)
        if not np.array_equal(said, np.fromiter(map(len, cuts), np.int32, len(cuts))):
            raise ValueError("pieces don't add up to the normalised text")
        which = array.indices.to_numpy(zero_copy_only=False)
        of = np.searchsorted(edges[:-1], bounds)  # first cut of each text
        which = np.insert(which, of[1:], len(cuts))
        n = sizes[which]
        to = np.concatenate([[0], np.cumsum(n)])
        at_pool = np.arange(to[-1], dtype=np.int32) + np.repeat((begin[which] - to[:-1]).astype(np.int32), n)
        tokens = to[of + np.arange(len(of))]  # first token of each text
        wide = widths[at_pool]
        right = np.cumsum(wide)
        counts = np.diff(tokens)
        edge, stop = np.repeat(bounds[1:], counts), np.repeat(stops.astype(np.int32), counts)
        source = np.append(source, np.int32(0))
        spans = [np.where(x == edge, stop, source[x]) for x in (right - wide, right)]
        return pool[at_pool], tokens, *spans


    def text(self, ids, at):
        """The library's decoding of the ids from ``at[i]`` to ``at[i + 1]``."""
        return self.whole.decode([ids[a:b].tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], num_threads=1)


CODERS = {}


def coder(path):
    """This worker's coder: its store lasts from task to task."""
    if path not in CODERS:
        CODERS[path] = Coder(path)
    return CODERS[path]


def encode(documents, model, decoded=False, rows=4000, size=1 << 20):
    """Pieces of every whole text: doc_id, ids (with the end id last), and the source bytes [begin, end) of each id.

    With ``decoded`` also the text that the library's decoder makes of the ids, as ``decode`` would add it. Byte pieces of one
    character lie at its begin, the last of them holds it. Null and empty texts have the end id only,
    at [0, 0). Rows without doc_id, rows that repeat one and other columns don't matter: each row is encoded alone. A task
    holds texts of about ``size`` bytes at once, or one longer text.
    """

    def run(batches):
        here = coder(model)
        for batch in batches:
            for some in parts_of(batch, "text", rows, size):
                ids, tokens, begins, ends = here.encode(*buffer_of(some.column("text")))
                offsets = pa.array(tokens, pa.int32())
                columns = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (ids, begins, ends)]
                if decoded:
                    columns.append(pa.array(here.text(ids, tokens), pa.string()))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *columns], names)

    schema = PIECES + ", decoded string" if decoded else PIECES
    names = [field.split()[0] for field in schema.split(", ")]
    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode(encoded, model, rows=1000):
    """``encoded`` (doc_id, ids) with the text that its ids stand for, by the library. Null ids give an empty text."""

    def run(batches):
        here = coder(model)
        for batch in batches:
            for row in range(0, batch.num_rows, rows):
                some = batch.slice(row, rows)
                lists = some.column("ids")
                tokens = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))])
                texts = pa.array(here.text(lists.flatten().to_numpy(zero_copy_only=False), tokens), pa.string())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), lists, texts], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def digests(decoded):
    """Per document the number of ids, and the sha256 of the decimal ids (joined by a space) and of the decoded text."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
