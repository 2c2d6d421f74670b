"""Collocations from sorted streams of phrase counts.

Every word opens a window of up to four words of its piece. A task sorts the windows of half a megabyte of text and sends
each distinct one once with its count to the part whose range of windows it lies in; there Spark sorts them in **prefix
order**. A phrase is a run of neighbouring rows, so one pass reads off the counts of all phrases of one to four words, with
no table of phrases in memory. Phrases that a cut between two parts divides (at most five at either end of a part) are added
up afterwards. The ranges come from a sample of the documents; they decide how even the parts are, not what is counted.

The phrases that are frequent enough make two streams, one in prefix order and one in **suffix order** (words reversed).
A phrase comes after its own beginnings and before its own extensions: a pass that keeps the open phrases (at most three)
on a stack gives each the counts of its beginnings, and its most frequent extension by one word; the other stream gives
endings and extensions to the left. Both streams meet in a sort-merge join. What a task misses because it begins in the
middle of a phrase's extensions is carried over from the counts: at most three beginnings and two extensions per task.

A part of a frequent phrase is at least as frequent, so leaving out rarer phrases loses nothing, and if any longer phrase
makes a shorter one redundant, then so does one that is longer by one word.

In streams the words are separated by a zero byte, which sorts before all others; the control characters below the tab are
moved up by one to make room (no word holds a tab). A window is one binary key: the language, then four words, empty ones
after the end of the piece.
"""

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from rentroll.llm.shared import save
from rentroll.llm.words import buffer_of, parts_of

LONGEST = 4
FORM = np.arange(256, dtype=np.uint8)
FORM[ord("A") : ord("Z") + 1] += 32
FORM[:9] += 1
WORD, BLANK, END = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[9, 32]] = BLANK
KIND[[10, 11, 12, 13, *b".,;:!?"]] = END
PLAIN = bytes([32, *range(9), *range(10, 256)])  # a stream's byte -> the text's
WINDOWS = "part int, window binary, n bigint"
COUNTS = "lang string, phrase string, size int, n bigint"
STREAM = (
    "part int, kind string, lang string, phrase string, said string, size int, n bigint, head1 bigint, head2 bigint,"
    " head3 bigint, extension bigint"
)


def ragged(pool, begins, sizes, pads):
    """(bytes, offsets): slices of ``pool``, each followed by so many zero bytes."""
    ends = np.concatenate([[0], np.cumsum(sizes + pads)])
    out = np.zeros(ends[-1], np.uint8)
    total = int(sizes.sum())
    step = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[step + np.repeat(ends[:-1], sizes)] = pool[step + np.repeat(begins, sizes)]
    return out, ends


def escaped(lang):
    """A language as bytes without a zero byte, in the same order."""
    return lang.encode().replace(b"\1", b"\1\2").replace(b"\0", b"\1\1")


def unescaped(data):
    return data.replace(b"\1\1", b"\0").replace(b"\1\2", b"\1").decode()


def windows_of(texts, langs):
    """Distinct windows of some texts as a record batch (window, n), sorted by language and words."""
    raw, starts = buffer_of(texts)
    kind = KIND[raw]
    inside = np.concatenate([[False], kind == WORD, [False]])
    cut = np.zeros(len(raw) + 1, bool)
    cut[starts] = True
    opens = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    closes = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    count = len(opens)
    if not count:
        return None
    at = np.concatenate([[0], np.cumsum(closes - opens + 1)])
    spaced = np.zeros(at[-1], np.uint8)
    body = np.ones(at[-1], bool)
    body[at[1:] - 1] = False
    spaced[body] = FORM[raw[kind == WORD]]

    breaks = np.cumsum(kind == END)[opens] if len(raw) else opens
    first = np.searchsorted(opens, starts)
    last = np.append(breaks[1:] != breaks[:-1], True)  # last word of its piece
    ends = first[1:][first[1:] > first[:-1]] - 1
    last[ends] = True
    stops = np.flatnonzero(last)
    left = np.minimum(np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(count) + 1, LONGEST)

    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(spaced)])
    coded = array.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()  # the zero after each word keeps prefix order
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    number = np.concatenate([rank[coded.indices.to_numpy(zero_copy_only=False)], np.zeros(LONGEST, np.int64)])
    bits = int(len(order)).bit_length()
    named = langs.fill_null("und").dictionary_encode()
    said = [escaped(x) + b"\0" for x in named.dictionary.to_pylist()]
    heads = sorted(said)
    place = {x: i for i, x in enumerate(heads)}
    of = np.array([place[x] for x in said], np.int64)
    of = np.repeat(of[named.indices.to_numpy(zero_copy_only=False)], np.diff(first))
    along = [np.where(left > k, number[k : k + count], 0) for k in range(LONGEST)]
    _, front = np.unique(of << 2 * bits | along[0] << bits | along[1], return_inverse=True)
    back_values, back = np.unique(along[2] << bits | along[3], return_inverse=True)
    _, chosen, n = np.unique(front << int(len(back_values)).bit_length() | back, return_index=True, return_counts=True)

    words = left[chosen]
    sizes = np.array([len(x) for x in heads])
    begins = len(spaced) + np.cumsum(sizes) - sizes
    pool = np.concatenate([spaced, np.frombuffer(b"".join(heads), np.uint8)])
    said = of[chosen]
    begin = np.column_stack([begins[said], at[chosen]]).ravel()
    size = np.column_stack([sizes[said], at[chosen + words] - at[chosen] - 1]).ravel()
    pads = np.column_stack([np.zeros(len(chosen), np.int64), LONGEST - words]).ravel()
    data, offsets = ragged(pool, begin, size, pads)
    window = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chosen), [None, pa.py_buffer(offsets[::2].astype(np.int64)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([window.cast(pa.binary()), pa.array(n, pa.int64())], ["window", "n"])


def word_arrays(windows):
    """Language and words of every window (each with its separator) as one array in row order, where they begin, and the
    bytes."""
    _, offsets, data = windows.buffers()
    bounds = np.frombuffer(offsets, np.int32)[windows.offset : windows.offset + len(windows) + 1]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    cuts = (np.flatnonzero(data == 0) + 1).reshape(len(windows), LONGEST)
    edges = np.concatenate([np.column_stack([bounds[:-1] - bounds[0], cuts]).ravel(), [len(data)]])
    array = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])
    return array, edges[:-1].reshape(len(windows), LONGEST + 1), data


class Runs:
    """Reads the windows of one part in prefix order: phrases with a count of at least ``least``, those that the ends of the
    part may cut, and per language the number of windows (size 0)."""

    def __init__(self, least):
        self.least, self.held = least, None
        self.open = np.zeros(LONGEST + 1, np.int64)
        self.opening = [True] * (LONGEST + 1)  # the first phrase of each size may have begun in the part before

    def read(self, window, n):
        """Phrases (lang, phrase, size, n) that end in these rows."""
        if self.held is not None:  # the last row before, with no count of its own
            window, n = pa.concat_arrays([self.held, window]), np.append(0, n)
        size, wide = len(n), LONGEST + 1
        array, edges, data = word_arrays(window)
        same = pc.equal(array[wide:], array[:-wide]).to_numpy(zero_copy_only=False).reshape(-1, wide).astype(bool)
        after = np.append(edges.ravel()[1:] - 1, len(data)).reshape(size, wide)  # where each word ends
        after[:-1, -1] += 1  # no separator after the last word
        alike = np.ones(size - 1, bool)
        found = []
        for k in range(wide):
            alike = alike & same[:, k]
            begins = np.flatnonzero(np.append(True, ~alike))
            total = np.add.reduceat(n, begins)
            total[0] += self.open[k]
            filled = (after[begins, k] > edges[begins, k]) | (k == 0)
            keep = filled & ((total >= self.least) | (k == 0))
            keep[0] |= filled[0] and self.opening[k]
            keep[-1] = False
            for i in np.flatnonzero(keep).tolist():
                row = begins[i]
                lang = data[edges[row, 0] : after[row, 0]].tobytes()
                said = data[edges[row, 1] : after[row, k]].tobytes().decode() if k else ""
                found.append((unescaped(lang), said, k, int(total[i])))
            self.opening[k] = self.opening[k] and len(begins) == 1
            self.open[k] = total[-1]
        self.held = window[size - 1 :]
        return found

    def rest(self):
        """The phrases still open."""
        lang, *words = self.held[0].as_py().split(b"\0")
        words = [w for w in words if w]
        return [(unescaped(lang), b"\0".join(words[:k]).decode(), k, int(self.open[k])) for k in range(len(words) + 1)]


def count_runs(least):
    """Pass over parts and windows in order."""

    def run(batches):
        part, reader = None, None
        for batch in batches:
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            found = []
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)] if len(parts) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if parts[a] != part:
                    found += reader.rest() if reader else []
                    part, reader = parts[a], Runs(least)
                found += reader.read(batch.column("window")[a:b], n[a:b])
            yield rows(found)
        if reader:
            yield rows(reader.rest())

    def rows(found):
        columns = list(zip(*found)) or [()] * 4
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "phrase", "size", "n"])

    return run


def places(spark, n):
    """One integer per partition that Spark deals to it among ``n``."""
    dealt = spark.range(64 * n).select(F.col("id").cast("int").alias("id")).groupBy(F.expr(f"pmod(hash(id), {n})").alias("p"))
    found = dealt.agg(F.min("id").alias("id")).collect()  # n rows
    chosen = {r.p: r.id for r in found}
    return sorted(chosen.get(p, p) for p in range(n))


def counts(documents, least, rows=4000, size=1 << 19):
    """(lang, phrase, size, n): phrases that occur at least ``least`` times, and the words of each language (size 0)."""
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select(F.col("lang").cast("string"), F.col("text").cast("string"))

    def windows(cuts, names):
        def run(batches):
            for batch in batches:
                for some in parts_of(batch, "text", rows, size):
                    found = windows_of(some.column("text"), some.column("lang"))
                    if found is not None:
                        window = found.column("window")
                        edges = [bisect_left(range(len(window)), cut, key=lambda i: window[i].as_py()) for cut in cuts]
                        part = np.repeat(np.array(names[: len(cuts) + 1], np.int32), np.diff([0, *edges, len(window)]))
                        yield pa.RecordBatch.from_arrays([pa.array(part), *found.columns], ["part", *found.schema.names])

        return run

    # A sample of 32 documents per part and of 32 of their windows per part, whatever the size of the table.
    share = min(1.0, 32 * n / max(1, texts.count()))
    some = texts.sample(share, seed=1).mapInArrow(windows([], [0]), WINDOWS)
    some = sorted(bytes(r.window) for r in some.orderBy(F.xxhash64("window"), "window").limit(32 * n).collect())
    cuts = sorted({some[i * len(some) // n] for i in range(1, n)}) if some else []
    dealt = texts.mapInArrow(windows(cuts, places(spark, n)), WINDOWS).repartition(n, "part").sortWithinPartitions("part", "window")
    found = dealt.mapInArrow(count_runs(least), COUNTS).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return save(found.filter((F.col("n") >= least) | (F.col("size") == 0)), "phrases")


def read_stream(batches):
    """Pass over phrases in stream order; see the module's text. Rows of kind ``row`` are phrases, ``need`` beginnings
    that lie before this task, ``orphan`` extensions of a phrase that lies before it."""
    part = TaskContext.get().partitionId()
    fields = [f.split()[0] for f in STREAM.split(", ")]
    kinds = [pa.int32(), *[pa.string()] * 4, pa.int32(), *[pa.int64()] * 5]
    out, stack, need, orphans = [], [], set(), {}

    def close():
        words, lang, phrase, n, heads, extension = stack.pop()
        said = phrase.encode().translate(PLAIN).decode()
        out.append((part, "row", lang, phrase, said, len(words), n, *heads, extension))

    def flush():
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], fields)

    for batch in batches:
        for lang, phrase, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase", "n"))):
            words = phrase.split("\0")
            while stack and (stack[-1][1] != lang or words[: len(stack[-1][0])] != stack[-1][0]):
                close()
            heads = [None] * (LONGEST - 1)
            for above in stack:
                heads[len(above[0]) - 1] = above[3]
            for k in range(1, len(words)):
                if heads[k - 1] is None:
                    need.add((lang, "\0".join(words[:k]), k))
            if stack and len(stack[-1][0]) == len(words) - 1:
                stack[-1][5] = max(stack[-1][5] or 0, n)
            elif len(words) > 2:
                parent = lang, "\0".join(words[:-1]), len(words) - 1
                orphans[parent] = max(orphans.get(parent, 0), n)
            stack.append([words, lang, phrase, n, heads, None])
        if len(out) >= 10_000:
            yield flush()
    while stack:
        close()
    for lang, phrase, k in need:
        out.append((part, "need", lang, phrase, None, k, None, None, None, None, None))
    for (lang, phrase, k), n in orphans.items():
        out.append((part, "orphan", lang, phrase, None, k, None, None, None, None, n))
    if out:
        yield flush()


def stream(phrases, name):
    """Counts of the beginnings of every phrase (head1 to head3) and of its most frequent extension by one word, from one
    pass in the order of ``phrase``."""
    dealt = phrases.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase")
    read = save(dealt.select("lang", "phrase", "n").mapInArrow(read_stream, STREAM), name)
    # At most three rows a task, then one; and two a task: bounded by the number of tasks, not by the rows.
    need = read.filter(F.col("kind") == "need").select("part", "lang", "phrase", "size")
    carried = phrases.drop("size").join(F.broadcast(need), ["lang", "phrase"]).groupBy("part")
    carried = carried.agg(*[F.max(F.when(F.col("size") == k, F.col("n"))).alias(f"carried{k}") for k in (1, 2, 3)])
    orphans = read.filter(F.col("kind") == "orphan").groupBy("lang", "phrase").agg(F.max("extension").alias("orphan"))
    rows = read.filter(F.col("kind") == "row").join(F.broadcast(carried), "part", "left")
    rows = rows.join(F.broadcast(orphans), ["lang", "phrase"], "left")
    heads = [F.when(F.col("size") > k, F.coalesce(f"head{k}", f"carried{k}")).alias(f"head{k}") for k in (1, 2, 3)]
    longer = F.coalesce(F.greatest("extension", "orphan"), F.lit(0)).alias("extension")
    return rows.select("lang", "phrase", "said", "size", "n", *heads, longer)


def mine(documents, least=30, best=2000, redundant=80):
    """Each language's ``best`` phrases of two to four words that occur at least ``least`` times.

    Words are cut at spaces and tabs, pieces at ``.,;:!?`` and line ends, A-Z are lower-cased. Cutting a phrase into a front
    and a rest scores floor(2000000 * a / (l + r)), a, l and r being the counts of phrase, front and rest; the lowest
    score counts, of equal ones that of the shortest front. A phrase goes if one longer phrase that holds it occurs at least
    ``redundant`` percent as often. Order: score, then a, both falling, then the phrase by its bytes.

    Null text counts as empty, null lang as ``und``; doc_id isn't read, so repeated rows count each time; columns of other
    names don't matter. No documents, or no frequent phrase, give no rows. A task holds the words of about 0.5 MB of text
    at once, or of one longer text.
    """
    found = counts(documents, least)
    phrases = found.filter(F.col("size") > 0)
    forwards = stream(phrases, "prefix-order").filter(F.col("size") > 1)
    turned = F.array_join(F.reverse(F.split("phrase", "\\x00")), "\0")
    backwards = stream(phrases.withColumn("phrase", turned), "suffix-order").filter(F.col("size") > 1)
    backwards = backwards.select(
        "lang", turned.alias("phrase"), *[F.col(f"head{k}").alias(f"tail{k}") for k in (1, 2, 3)], F.col("extension").alias("before")
    )
    both = forwards.join(backwards.hint("merge"), ["lang", "phrase"])
    longer = F.greatest("extension", "before").cast("decimal(20,0)") * 100
    alone = both.filter(longer < F.col("n").cast("decimal(20,0)") * redundant)
    cuts = []
    for k in (1, 2, 3):
        rest = F.when(F.col("size") == k + 1, F.col("tail1")).when(F.col("size") == k + 2, F.col("tail2")).otherwise(F.col("tail3"))
        alone = alone.withColumn(f"_rest{k}", rest)
        score = f"cast(n as decimal(20,0)) * 2000000 div (head{k} + _rest{k})"
        cuts.append(f"if(size > {k}, struct({score} as score, {k} as k, head{k} as l, _rest{k} as r), null)")
    lowest = alone.withColumn("_cut", F.expr(f"array_min(array({', '.join(cuts)}))"))  # skips nulls
    lowest = lowest.select("lang", F.col("said").alias("phrase"), F.col("n").alias("a"), "_cut.l", "_cut.r", "_cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    words = found.filter(F.col("size") == 0).select("lang", F.col("n").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
