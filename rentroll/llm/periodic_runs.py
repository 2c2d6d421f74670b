"""Periodic runs of words, found by minimizers on several scales.

A run is a stretch of words with smallest period q, at least ``max(shortest, 2 * q)`` long, that no neighbouring word
extends. All runs of a text are found, exactly:

* **Lag scans.** For every period below ``LAGS`` the words are compared with those that many places on.
* **Scales.** The scale of t = 64, 128, ... finds the periods from t to 2t - 1. It takes k-grams, k = t/4, and the least
  hash of every t-k+1 of them. Inside a run the windows of one period read like those of the next, so they choose the same
  place and a pair of equal minimizers lies one period apart. Pairs are seeds: each is extended to both sides over the
  words themselves, and a stretch that agrees for a whole period is a run.
* **K-grams inside a short run** (period up to k/3) choose nothing, as they'd repeat too densely; any other k-gram lies
  further than k/3 from its next copy, so a seed has at most 24 partners. A period made of nothing but such k-grams is the
  place where two neighbouring short runs meet (``seams``), and its seeds come from there.

A smaller period of the same stretch divides the larger one, so of equal stretches the smallest period stays. Texts of a
batch lie in one array with a separator of its own after each; a scale sees the texts of at least 2t words. Work grows
with the words of a text times the number of scales, never with the pairs of equal words.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rentroll.llm.words import buffer_of, mix, parts_of

LAGS = 64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

FOUND = (
    "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>,"
    " runs_sha256 string, collapsed string, collapsed_sha256 string"
)


def stretches(places, lag):
    """(start, end, lag) of the stretches that consecutive ``places`` cover, with the lag added to the end."""
    if not len(places):
        return np.zeros((0, 3), np.int64)
    breaks = np.flatnonzero(np.diff(places) != 1)
    first = places[np.concatenate([[0], breaks + 1])]
    last = places[np.concatenate([breaks, [len(places) - 1]])]
    return np.stack([first, last + 1 + lag, np.full(len(first), lag)], 1)


def smallest_periods(found):
    """Of rows (start, end, period) with equal stretch the one with the smallest period, in order of the place."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if len(found) > 1:
        found = found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(1)])]
    return found


def short_runs(x, longest, shortest):
    """Runs with periods up to ``longest``."""
    out = []
    for lag in range(1, min(longest, len(x) - 1) + 1):
        rows = stretches(np.flatnonzero(x[lag:] == x[:-lag]), lag)
        out.append(rows[rows[:, 1] - rows[:, 0] >= max(shortest, 2 * lag)])
    return smallest_periods(np.concatenate(out)) if out else np.zeros((0, 3), np.int64)


def agree(x, a, b, step):
    """How many words from a and from b on (towards ``step``) are equal."""
    n, size = 0, 64
    while True:
        room = min(size, len(x) - max(a, b) if step > 0 else min(a, b) + 1)
        if room <= 0:
            return n
        if step > 0:
            same = x[a : a + room] == x[b : b + room]
        else:
            same = x[a - room + 1 : a + 1][::-1] == x[b - room + 1 : b + 1][::-1]
        if not same.all():
            return n + int(same.argmin())
        n, a, b, size = n + room, a + step * room, b + step * room, min(size * 2, 1 << 20)


def extended(x, seeds, shortest):
    """Runs around the seeds (place, distance): both sides are extended while words a distance apart are equal."""
    out, lag, to = [], -1, -1
    seeds = np.unique(seeds, axis=0) if len(seeds) else seeds
    for d, m in seeds[np.lexsort((seeds[:, 0], seeds[:, 1]))][:, ::-1].tolist():
        if d == lag and m < to:
            continue  # inside the stretch that the last seed was extended to
        start, lag = m - agree(x, m - 1, m + d - 1, -1), d
        to = m + agree(x, m, m + d, 1)
        if to - start >= d and to + d - start >= shortest:
            out.append((start, to + d, d))
    return np.array(out, np.int64).reshape(-1, 3)


def seams(x, runs, t):
    """Seeds where two runs of one period p <= k/3 follow one another without a gap; see the module's text."""
    short = runs[(runs[:, 2] <= t // 12) & (runs[:, 1] - runs[:, 0] >= t)]
    out = []
    for p in np.unique(short[:, 2]).tolist():
        rows = short[short[:, 2] == p]
        for (b1, e1, _), (b2, e2, _) in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if b2 > e1:
                continue
            for q in range(t, t + p):
                if q <= e1 - b1 and e1 + p <= e2 and (x[e1 - q : e1 - q + p] == x[e1 : e1 + p]).all():
                    out += [(e1 - d, d) for d in range(q, min(2 * t, e1 - b1 + 1), p)]
                    break
    return np.array(out, np.int64).reshape(-1, 2)


def least_of(values, width):
    """Place of the first least value of every ``width`` consecutive ones."""
    places, step = np.arange(len(values)), 1
    while step < width:  # windows of ``step`` become windows of up to twice that
        more = min(step, width - step)
        left, right = places[:-more], places[more:]
        places = np.where(values[right] < values[left], right, left)
        step += more
    return places


def minimizer_pairs(hashes, usable, t, k):
    """Seeds (place, distance): equal minimizers at least t and less than 2t apart."""
    values = np.where(usable, hashes >> np.uint64(1), np.uint64(2**64 - 1))
    if len(values) < t - k + 1:
        return np.zeros((0, 2), np.int64)
    chosen = np.unique(least_of(values, t - k + 1))
    chosen = chosen[usable[chosen]]
    order = np.lexsort((chosen, values[chosen]))
    at, value = chosen[order], values[chosen][order]
    out, i = [], np.arange(len(at))
    for ahead in range(1, len(at)):
        i = i[i + ahead < len(at)]
        i = i[(value[i + ahead] == value[i]) & (at[i + ahead] - at[i] < 2 * t)]
        if not len(i):
            break
        far = i[at[i + ahead] - at[i] >= t]
        out.append(np.stack([at[far], at[far + ahead] - at[far]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def joined(x, bounds, least):
    """(words, place of each text, number of each text) of the texts of at least ``least`` words, each with a separator
    of its own after it."""
    sizes = np.diff(bounds)
    chosen = np.flatnonzero(sizes >= least)
    n = sizes[chosen]
    place = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.empty(place[-1], np.int64)
    inside = np.arange(place[-1]) - np.repeat(place[:-1], n + 1)
    ends = place[1:] - 1
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body] = x[(np.repeat(bounds[:-1][chosen], n + 1) + inside)[body]]
    out[ends] = -1 - np.arange(len(chosen))
    return out, place, chosen


def runs_of(x, bounds, shortest=12):
    """Rows (text, start, end, period) of the runs of all texts; ``x`` holds word numbers (0 or more) of all texts and
    text i lies from ``bounds[i]`` to ``bounds[i + 1]``. Rows are in order of text, start, period."""
    out, t, least = [], LAGS, min(shortest, LAGS // 4)  # scales ask for the short runs of a whole k-gram
    longest = int(np.diff(bounds).max(initial=0))
    words, place, chosen = joined(x, bounds, 1)
    known = short_runs(words, min(LAGS - 1, longest), least)
    text = np.searchsorted(place, known[:, 0], "right") - 1
    out.append(np.column_stack([chosen[text], known[:, :2] - place[text][:, None], known[:, 2]]) if len(known) else None)
    short = out[-1]
    while 2 * t <= longest:
        k = t // 4
        words, place, chosen = joined(x, bounds, 2 * t)
        back = np.full(len(bounds), -1)
        back[chosen] = np.arange(len(chosen))
        known = np.zeros((0, 3), np.int64)
        if short is not None:
            mine = short[(back[short[:, 0]] >= 0) & (short[:, 3] <= k // 3)]
            known = np.column_stack([mine[:, 1:3] + place[back[mine[:, 0]]][:, None], mine[:, 3]])
            known = known[np.argsort(known[:, 0], kind="stable")]
        hashes, width = mix(words.view(np.uint64)), 1
        while width < k:
            hashes = mix(hashes[:-width] * np.uint64(0x9E3779B97F4A7C15) + hashes[width:])
            width *= 2
        marks = np.zeros(len(hashes) + 1, np.int64)
        dense = known[known[:, 1] - known[:, 0] >= k]
        np.add.at(marks, dense[:, 0], 1)
        np.add.at(marks, dense[:, 1] - k + 1, -1)
        seeds = [minimizer_pairs(hashes, np.cumsum(marks[:-1]) == 0, t, k), seams(words, known, t)]
        found = extended(words, np.concatenate(seeds), least)
        if len(found):
            at = np.searchsorted(place, found[:, 0], "right") - 1
            new = np.column_stack([chosen[at], found[:, :2] - place[at][:, None], found[:, 2]])
            out.append(new)
            short = new if short is None else np.concatenate([short, new])
        t *= 2
    out = [rows for rows in out if rows is not None]
    if not out:
        return np.zeros((0, 4), np.int64)
    out = np.concatenate(out)
    out = out[out[:, 2] - out[:, 1] >= shortest]
    out = out[np.lexsort((out[:, 3], out[:, 2], out[:, 1], out[:, 0]))]
    first = np.concatenate([[True], (out[1:, :3] != out[:-1, :3]).any(1)])[: len(out)]
    out = out[first]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def words_of(texts):
    """(word numbers, bounds, spaced, at) of an Arrow string array: equal words have equal numbers; ``spaced`` holds the
    words with one space after each, and word i lies from ``at[i]`` to ``at[i + 1] - 1``."""
    raw, starts = buffer_of(texts)
    inside = np.concatenate([[False], ~SPACE[raw], [False]])
    cut = np.zeros(len(raw) + 1, bool)
    cut[starts] = True
    opens = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    closes = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    at = np.concatenate([[0], np.cumsum(closes - opens + 1)])
    spaced = np.full(at[-1], 32, np.uint8)
    body = np.ones(at[-1], bool)
    body[at[1:] - 1] = False
    spaced[body] = raw[~SPACE[raw]]
    offsets = pa.py_buffer(at.astype(np.int64))  # each word with the space after it
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(opens), [None, offsets, pa.py_buffer(spaced)])
    numbers = array.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return numbers, np.searchsorted(opens, starts), spaced, at


def repeated_tails(doc_ids, bounds):
    """For every word the place of the word that stands there once the planted tails are written out.

    With h the crc32 of the decimal doc_id and g = h // 10, a text with h % 10 = 0 goes on from word a = g % n with the
    p = 1 + (n - a) // (3 + g % 8) words that stand there, over and over. A text without doc_id stays as it is.
    """
    out = np.arange(bounds[-1])
    for i, (doc_id, n) in enumerate(zip(doc_ids, np.diff(bounds).tolist())):
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if n and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[bounds[i] + a : bounds[i + 1]] = bounds[i] + a + np.arange(n - a) % p
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def find(documents, shortest=12, rewritten=None, keep_text=True, rows=2000, size=8 << 20):
    """All periodic runs of every text, and the text without the repetitions.

    One row per document: doc_id, n_words, runs (start, length, period; by start, then period), runs_sha256 (of their
    lines), collapsed (the words that no run repeats, joined by a space: of a run its first period stays) and
    collapsed_sha256. ``rewritten(doc_ids, bounds)`` may put other words of the batch in place first.

    Null and empty texts have no words, no runs and the sha256 of nothing. Rows without doc_id, rows that repeat one and
    columns of other names don't matter: each row is judged by its own text. A task holds texts of about ``size`` bytes at
    once, or one longer text; no text is cut. Without ``keep_text`` collapsed is null.
    """

    def judged(doc_ids, texts):
        numbers, bounds, spaced, at = words_of(texts)
        source = None
        if rewritten is not None:
            source = rewritten(doc_ids, bounds)
            numbers = numbers[source]
        found = runs_of(numbers, bounds, shortest)
        first = np.searchsorted(found[:, 0], np.arange(len(doc_ids) + 1))
        moved = np.zeros(len(doc_ids), bool)
        if source is not None:
            changed = np.flatnonzero(source != np.arange(len(source)))
            moved[np.searchsorted(bounds, changed, "right") - 1] = True
        raw = spaced.tobytes()
        columns = [[], [], [], [], []]
        for i in range(len(doc_ids)):
            a, b = int(bounds[i]), int(bounds[i + 1])
            runs = [(s, e - s, q) for s, e, q in found[first[i] : first[i + 1], 1:].tolist()]
            if not runs and not moved[i]:
                text = raw[at[a] : max(at[a], at[b] - 1)]
            else:
                stays = np.ones(b - a, bool)
                for s, n, q in runs:
                    stays[s + q : s + n] = False
                words = np.flatnonzero(stays) + a
                words = words if source is None else source[words]
                text = b" ".join([raw[x : y - 1] for x, y in zip(at[words].tolist(), at[words + 1].tolist())])
            lines = "".join([f"{s},{n},{q}\n" for s, n, q in runs])
            row = (b - a, [{"start": s, "length": n, "period": q} for s, n, q in runs], sha(lines.encode()), text, sha(text))
            for column, value in zip(columns, row):
                column.append(value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        kinds = [pa.int64(), kind, pa.string(), pa.string(), pa.string()]
        columns[3] = [t.decode() for t in columns[3]] if keep_text else [None] * len(doc_ids)
        arrays = [pa.array(doc_ids, pa.int64())] + [pa.array(c, k) for c, k in zip(columns, kinds)]
        names = ["doc_id", "n_words", "runs", "runs_sha256", "collapsed", "collapsed_sha256"]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches):
        for batch in batches:
            for some in parts_of(batch, "text", rows, size):
                yield judged(some.column("doc_id").to_pylist(), some.column("text"))

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def summary(found):
    """Per document the number of runs, the longest run (ties: smallest start, then period) and both digests."""
    order = F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"]))
    best = F.array_min(order)
    length, period = -best["col1"], best["period"]
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        length.alias("length"),
        period.alias("period"),
        "runs_sha256",
        "collapsed_sha256",
    ).withColumn("exponent_milli", F.expr("1000 * length div period"))
