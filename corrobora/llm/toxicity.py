"""Toxicity scores from a learned weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.session import cut_lineage

# Letters of other scripts that look like Latin ones, and digits or signs written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s"}


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {c: " " for c in range(128) if not chr(c).isalnum()}
    table |= {c: None for c in (0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF, *range(0x300, 0x370))}
    table |= {c: " " for c in (0xA0, *range(0x2010, 0x2060), *range(0x3000, 0x3003), 0xAB, 0xBB, 0xBF, 0xA1)}
    table |= {0xFF41 + i: chr(97 + i) for i in range(26)}
    table |= {ord(k): v for k, v in (LOOKALIKES | DIGITS).items()}
    return {k: "i" if v == "l" else v for k, v in table.items()} | {ord("l"): "i"}


_FOLD = _fold_table()
_INNER = re.compile(r"(?<=\w)[@$]+(?=\w)")


def fold(text: str) -> str:
    """Lower-case words separated by blanks, with look-alike letters, digits for letters and hidden characters undone.

    l, i and 1 become one letter, since 1 is written for both. Accents stay: they tell words apart in most languages.
    """
    low = text.lower()
    if "$" in low or "@" in low:
        low = _INNER.sub(lambda m: "".join(SIGNS[c] for c in m.group()), low)
    if not low.isascii() and not unicodedata.is_normalized("NFC", low):
        low = unicodedata.normalize("NFC", low)
    return low.translate(_FOLD)


@dataclass
class Lexicon:
    """Entries with weights (a trailing blank marks a whole word, else a word beginning), exception phrases and the curve.

    ``curve`` holds intercept, weight of the length-normalised sum and weight of the plain sum.
    """

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-10.0, 0.0, 0.0)

    def matcher(self):
        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(" " + entry, (len(entry), weight))
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (len(phrase) + 1, None))
        if len(machine):
            machine.make_automaton()
        return machine


def hits(machine, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the entries found, without those inside an exception phrase."""
    if not len(machine):
        return []
    found, spared = [], []
    for end, (size, weight) in machine.iter(f" {folded} "):
        (spared if weight is None else found).append((end - size, end, weight))
    if spared:
        found = [x for x in found if not any(s <= x[0] and x[1] <= e for s, e, _ in spared)]
    return found


def features(machine, text: str | None) -> tuple[float, float]:
    """(length-normalised sum, sum) of the weights of all hits, both on a log scale."""
    folded = " ".join(fold(text or "").split())
    total = sum(x[2] for x in hits(machine, folded))
    return math.log1p(100.0 * total / (20.0 + folded.count(" "))), math.log1p(total)


def score(lexicon: Lexicon, machine, text: str | None) -> float:
    near, plain = features(machine, text)
    a, b, c = lexicon.curve
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * near + c * plain))))


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: in how many toxic and clean texts every word and word beginning of 4 to 8 letters occurs."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
            own = set(fold(text.as_py() or "").split())
            own = {w[:k] for w in own for k in range(4, min(8, len(w)) + 1)} | {w + " " for w in own if len(w) < 40}
            counts[toxic.as_py()].update(own)
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in (counts[1], counts[0])]],
            names=["entry", "toxic", "clean"],
        )


def _found(lexicon: Lexicon, entries: list[str]):
    """Per labelled text: the numbers of the candidate entries in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for i, entry in enumerate(entries):
            machine.add_word(" " + entry, i)
        machine.make_automaton()
        for batch in batches:
            own = [sorted({i for _, i in machine.iter(f" {' '.join(fold(t.as_py() or '').split())} ")}) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.list_(pa.int32()))], names=["toxic", "own"])

    return run


def _phrases(lexicon: Lexicon):
    """Per labelled text: the hit words with the word before or after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.matcher()
        for batch in batches:
            own = []
            for t in batch.column(0):
                text = " ".join(fold(t.as_py() or "").split())
                near = set()
                for start, _, _ in hits(machine, text):
                    at = max(0, start)
                    before = text[max(0, at - 60) : max(0, at - 1)].split(" ")[-1] if at else ""
                    rest = text[at : at + 120].split(" ")
                    near |= {f"{before} {rest[0]}"} if before else set()
                    near |= {f"{rest[0]} {rest[1]}"} if len(rest) > 2 else set()
                own.append(sorted(near))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.list_(pa.string()))], names=["toxic", "own"])

    return run


def _measured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.matcher()
        for batch in batches:
            pairs = [features(machine, t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.float64())],
                names=["toxic", "near", "plain"],
            )

    return run


def _cover(toxic: np.ndarray, present: np.ndarray, lengths: np.ndarray, least: int, cost: float) -> list[int]:
    """Entries chosen one by one: most toxic texts not yet explained, less ``cost`` for every clean one; longer first."""
    chosen, open_texts = [], np.ones(len(toxic), dtype=bool)
    while True:
        gain = present[:, open_texts & toxic].sum(axis=1) - cost * present[:, open_texts & ~toxic].sum(axis=1)
        gain = gain * (1 + 0.03 * lengths)
        best = int(gain.argmax()) if len(gain) else -1
        if best < 0 or gain[best] < least:
            return chosen
        chosen.append(best)
        open_texts &= ~present[best]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float, float]:
    """Ridge logistic regression with slopes of at least 0, by Newton steps."""
    design, beta = np.column_stack((np.ones(len(x)), x)), np.zeros(x.shape[1] + 1)
    penalty = np.diag([1e-6, *[ridge * len(x)] * x.shape[1]]) / max(1, len(x)) * 10
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + penalty, design.T @ (y - p) - penalty @ beta)
        beta = beta + np.clip(step, -4, 4)
        beta[1:] = np.maximum(beta[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, beta))


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, sample: int = 20_000, candidates: int = 3_000, least: int = 5, exceptions: tuple[str, ...] = ()
) -> Lexicon:
    """Learns entries, weights, exception phrases and the score curve from ``labels(doc_id, toxic)`` of ``docs(doc_id, text)``.

    Only ``sample`` labelled rows, the first by hash, are used: a bounded training set, so its texts' statistics may
    come to the driver. Candidates are words and word beginnings over-represented in toxic texts; a greedy cover keeps
    those that explain at least ``least`` more toxic texts than others did, and words seen in more than ``least`` toxic
    texts and nine times as often as in clean ones stay too. A word pair around a hit that is seen
    ``least`` times, nine in ten in clean texts, becomes an exception phrase; ``exceptions`` adds given ones.

    Edge cases: no labels, one class only or no entries give a lexicon that rates every text alike, at the share of
    toxic labels. Null labels and ids are ignored; of several labels of one doc_id the highest counts.
    """
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    labelled = cut_lineage(rows.withColumn("_h", F.xxhash64("text")).dropDuplicates(["_h", "toxic"]).drop("_h"))
    sizes = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    share = (toxic + 0.5) / (toxic + clean + 1.0) if toxic + clean else 0.0
    plain = Lexicon(curve=(max(-10.0, math.log(share / (1 - share))) if share else -10.0, 0.0, 0.0))
    if not toxic or not clean:
        return plain
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    stats = (
        labelled.mapInArrow(_vocabulary, "entry string, toxic long, clean long")
        .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= least).withColumn("odds", odds).where("odds >= 1.5")
        .orderBy((F.col("toxic") * F.col("odds")).desc(), "entry").limit(candidates).collect()
    )
    if not stats:
        return plain
    entries = [r["entry"] for r in stats]
    rows = labelled.mapInArrow(_found(plain, entries), "toxic int, own array<int>").collect()
    present = np.zeros((len(entries), len(rows)), dtype=bool)
    for i, row in enumerate(rows):
        present[row["own"], i] = True
    lengths = np.array([len(e) for e in entries])
    chosen = _cover(np.array([r["toxic"] > 0 for r in rows]), present, lengths, least, cost=2.0)
    strong = [i for i, r in enumerate(stats) if r["entry"].endswith(" ") and r["toxic"] > least and r["toxic"] >= 9 * r["clean"]]
    chosen = list(dict.fromkeys(chosen + strong))
    lexicon = Lexicon({entries[i]: float(stats[i]["odds"]) for i in chosen}, [" ".join(fold(p).split()) for p in exceptions])
    phrases = (
        labelled.mapInArrow(_phrases(lexicon), "toxic int, own array<string>").select("toxic", F.explode("own").alias("phrase"))
        .groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))
        .where((F.col("n") >= least) & (F.col("toxic") * 10 <= F.col("n"))).orderBy(F.col("n").desc(), "phrase").limit(candidates)
    )
    lexicon.exceptions += [r["phrase"] for r in phrases.collect()]
    measured = labelled.mapInArrow(_measured(lexicon), "toxic int, near double, plain double").collect()
    x = np.array([[r["near"], r["plain"]] for r in measured])
    lexicon.curve = _logistic(x, np.array([r["toxic"] for r in measured], dtype=float))
    return lexicon


def score_texts(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) for every row of ``docs(doc_id, text)``; a null text is scored as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.matcher()
        for batch in batches:
            found = [score(lexicon, machine, t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; all columns stay as they are. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.matcher()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([score(lexicon, machine, t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id):
    """The rows never learnt from: crc32 of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
