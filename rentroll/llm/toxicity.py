"""Toxicity by a weighted lexicon.

Text is folded first: lower case, accents and look-alike letters of other scripts to plain letters, digits and signs that
stand for letters to those letters, all else to spaces. Lexicon entries are whole words and beginnings of longer words; an
Aho-Corasick automaton finds them all in one pass. Of the entries that match one word the heaviest counts, and words
inside an exception phrase don't count. The sum of weights, also set against the text's length, goes through a logistic
curve.

Weights are learned: Spark counts in how many toxic and clean training documents each entry occurs, and an entry whose
log odds are certain enough joins the lexicon beside the seed words, which start with a few counts of their own. Curve
parameters are fitted on scores that come from the other half's lexicon. Training uses at most ``train_rows`` labelled
documents (those with the smallest hash of doc_id, never held out ones), so the model is bounded; scoring covers all text.
"""

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from rentroll.llm.shared import save, whole

# Common insults in the languages of the corpus.
SEEDS = """
idiot moron stupid scum trash worthless loser pathetic disgusting clown imbecile dumbass bastard asshole scumbag
dummkopf abschaum arschloch trottel vollidiot connard imbecile salaud ordure abruti idiota imbecil estupido basura
""".split()

# Harmless phrases that hold a lexicon word.
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "clown fish", "class clown", "idiot proof", "stupid question"]

# Look-alikes of Latin letters in Cyrillic and Greek, and digits and signs read as letters.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝвкмнтαεορυικντ", "aeopcyxijshdqwbkmhtaeopuiknt"))
DIGITS = dict(zip("0134578", "oieastb"))
SIGNS = dict(zip("@$!|", "asii"))

SEED_COUNT = 4  # a seed starts as if it had been in so many toxic documents
SEED_ENTRIES = [e for s in dict.fromkeys(SEEDS) for e in (f" {s} ", f" {s}")]
FEATURES = ["heaviest", "log", "density"]
SHORTEST, LONGEST = 4, 10
DEFAULT = (-3.0, 1.0, 1.0, 1.0)  # curve without both kinds of labels


def fold_table():
    """Translation of every character below U+2100 that isn't a plain letter, and of styled letters and digits above."""
    table = {}
    for code in range(0x2100):
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char)[0].lower()
        if "a" <= plain <= "z" or char.isalpha():
            table[code] = plain
        elif unicodedata.category(char) in ("Cf", "Mn"):
            table[code] = None
        else:
            table[code] = " "
    table |= {ord(k): v for k, v in (LOOKALIKES | DIGITS).items()}
    table |= {c: chr(c - 0xFF21 + 97) for c in range(0xFF21, 0xFF3B)} | {c: chr(c - 0xFF41 + 97) for c in range(0xFF41, 0xFF5B)}
    for code in range(0x2100, 0x20000):  # beyond are ideographs
        if unicodedata.decomposition(chr(code)):
            letters = "".join((LOOKALIKES | DIGITS).get(c, c) for c in unicodedata.normalize("NFKD", chr(code)).lower())
            if re.fullmatch("[a-z]+", letters):
                table[code] = letters
    return table


FOLD = fold_table()
SIGN = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")


def fold(text):
    """Folded text with a space at both ends."""
    if any(s in text for s in SIGNS):
        text = SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {text.lower().translate(FOLD)} "


def entries_of(text):
    """Whole words (between spaces) and beginnings of longer words (after a space) that occur in a text."""
    out = set()
    for w in set(fold(text).split()):
        out.update([f" {w[:k]}" for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1)])
        if len(w) <= LONGEST:
            out.add(f" {w} ")
    return out


class Lexicon:
    """Finds weighted entries in texts."""

    def __init__(self, weights, exceptions):
        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            entry = f" {phrase} "
            self.automaton.add_word(entry, (len(entry), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def read(self, text):
        """(heaviest word, sum of weights, sum against length)."""
        folded = fold(text)
        best, excused = {}, []
        if len(self.automaton):
            for end, (size, weight) in self.automaton.iter(folded):
                start = end - size + 1
                if weight is None:
                    excused.append((start, end))
                elif weight > best.get(start, 0.0) and (folded[end] == " " or folded[end + 1] != " "):
                    best[start] = weight
        counted_ = [w for at, w in best.items() if not any(a <= at < b for a, b in excused)]
        total = sum(counted_)
        return max(counted_, default=0.0), np.log1p(total), total / np.sqrt(1 + folded.count(" "))


def training_rows(documents, labels, train_rows):
    """doc_id, text, toxic and fold half of at most ``train_rows`` labelled documents; rows that share a doc_id count once,
    with their smallest text."""
    given = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(~held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    half = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)).cast("int")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text"))
    found = texts.join(F.broadcast(given), "doc_id")  # at most train_rows small rows
    return save(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("half", half), "training")


def held_out(column):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def counted(rows, most=100_000):
    """(entry, half, toxic, n): documents that hold an entry; entry '' counts all documents."""

    def run(batches):
        counts = Counter()
        names = ["entry", "half", "toxic", "n"]

        def out():
            columns = list(zip(*((e, h, t, n) for (e, h, t), n in counts.items()))) or [[]] * 4
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for text, half, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "half", "toxic"))):
                counts.update((e, half, toxic) for e in entries_of(text) | {""})
                if len(counts) > most:
                    yield out()
                    counts.clear()
        yield out()

    found = rows.select("text", "half", "toxic").mapInArrow(run, "entry string, half int, toxic int, n bigint")
    def of(half, toxic):
        return F.sum(F.when((F.col("half") == half) & (F.col("toxic") == toxic), F.col("n")).otherwise(0)).alias(f"{'np'[toxic]}{half}")

    return found.groupBy("entry").agg(of(0, 0), of(0, 1), of(1, 0), of(1, 1))


def weights_from(table, pos, neg, certain=3.2, least=5):
    """Entry -> log odds, for entries that are certain enough, without those that a shorter entry stands for."""
    every = table[table["entry"] == ""]
    n_pos, n_neg = (int(every[c].sum()) for c in (pos, neg))
    rows = table[table["entry"] != ""].set_index("entry")[[pos, neg]].rename(columns={pos: "p", neg: "n"})
    seeds = pd.DataFrame({"p": SEED_COUNT, "n": 0}, index=SEED_ENTRIES)
    rows = rows.add(seeds, fill_value=0)
    weight = np.log((rows["p"] + 0.5) / (n_pos + 1)) - np.log((rows["n"] + 0.5) / (n_neg + 1))
    if not n_pos or not n_neg:
        return dict.fromkeys(seeds.index, 3.0)
    z = weight / np.sqrt(1 / (rows["p"] + 0.5) + 1 / (rows["n"] + 0.5))
    chosen = weight[((z >= certain) & (rows["p"] >= least)) | (rows.index.isin(seeds.index) & (weight > 0.5))]
    out = {}
    for entry, w in sorted(chosen.items(), key=lambda x: len(x[0])):
        if not any(out.get(entry[:k], -9.0) > w - 1.0 for k in range(SHORTEST + 1, len(entry))):
            out[entry] = float(w)
    return out


def curve(features, toxic):
    """Logistic regression by Newton steps with a small penalty."""
    x, y = np.column_stack([np.ones(len(features)), features]), np.asarray(toxic, float)
    if not 0 < y.sum() < len(y):
        return DEFAULT
    b, penalty = np.zeros(x.shape[1]), np.array([1e-6] + [1e-2] * features.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * b)
    return tuple(b.tolist())


def may_count(totals, certain=3.2, least=5):
    """Condition on entries: seeds, and those in more toxic documents than others that ``weights_from`` can choose on a half
    or on both."""
    either = F.lit(False)
    for halves in ("0", "1", "01"):
        p, n = (sum([F.col(c + h) for h in halves], F.lit(0)) for c in "pn")
        n_pos, n_neg = (sum([totals[c + h] for h in halves]) for c in "pn")
        weight = F.log((p + 0.5) / (n_pos + 1)) - F.log((n + 0.5) / (n_neg + 1))
        either |= (p >= least) & (weight / F.sqrt(1 / (p + 0.5) + 1 / (n + 0.5)) >= certain - 1e-9)
    return F.col("entry").isin(SEED_ENTRIES) | ((F.col("p0") + F.col("p1") > F.col("n0") + F.col("n1")) & either)


def learn(documents, labels, train_rows=20_000):
    """(weights, curve): the model, learned from at most ``train_rows`` documents.

    Spark counts the entries and leaves out those that are too rare or too uncertain to enter the lexicon; every other
    entry is weighed.
    """
    rows = training_rows(documents, labels, train_rows)
    counts = save(counted(rows), "entry-counts")
    names = ["p0", "p1", "n0", "n1"]
    totals = counts.filter("entry = ''").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first().asDict()
    table = counts.filter((F.col("entry") == "") | may_count(totals)).toPandas()
    halves = [weights_from(table, f"p{h}", f"n{h}") for h in (0, 1)]
    table["p"], table["n"] = table["p0"] + table["p1"], table["n0"] + table["n1"]
    other = F.pandas_udf(reader_of(halves), "heaviest double, log double, density double")
    seen = rows.select(other("text", 1 - F.col("half")).alias("f"), "toxic").select("f.*", "toxic").toPandas()
    return weights_from(table, "p", "n"), curve(seen[FEATURES].to_numpy(), seen["toxic"])


def reader_of(lexicons):
    """Features of texts by the lexicon with the given number."""

    def read(texts: pd.Series, which: pd.Series) -> pd.DataFrame:
        readers = [Lexicon(w, EXCEPTIONS) for w in lexicons]
        return pd.DataFrame([readers[k].read(t) for t, k in zip(texts, which)], columns=FEATURES)

    return read


def scorer(model):
    """Column function text -> probability that the text is toxic."""
    weights, (base, *by) = model

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(weights, EXCEPTIONS)
        for texts in batches:
            z = base + np.array([lexicon.read(t) for t in texts]).reshape(-1, len(by)) @ by
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return F.pandas_udf(score, "double")


def scored(documents, labels, **options):
    """``documents`` with a ``toxic_score``; all rows and columns stay, a column of that name is replaced.

    Null text counts as empty. Without labels of both kinds the seed words alone decide. Rows of ``labels`` that repeat a
    doc_id count once (toxic if any says so), those with nulls or other values not at all.
    """
    model = learn(documents, labels, **options)
    return documents.withColumn("toxic_score", scorer(model)(whole("text")))


def judged(documents, labels, **options):
    """One row per row of ``documents``: doc_id, held_out, score, predicted."""
    rows = scored(documents.select("doc_id", "text"), labels, **options)
    return rows.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(documents, labels, **options):
    """The rows that aren't predicted toxic, with their columns."""
    return documents.filter(scorer(learn(documents, labels, **options))(whole("text")) < 0.5)
