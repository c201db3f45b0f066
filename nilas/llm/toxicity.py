"""Operator 1: toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first (lower case, look-alike letters, digit substitutions,
white space and signs to single blanks). Entries are folded words or word
beginnings with their log odds, learned from labelled documents; matches inside
an exception phrase don't count. The score is a logistic function of whether
anything matched and of the matched weight, plain and by length.

Learning reads at most `most_labelled` labelled documents (the ids with the
smallest hashes, and where an id stands on several texts the texts with the
smallest), folds them once and counts on what it folded. That bound and the
share of toxic documents that an entry stands in bound all that reaches the
driver. Entries are whole words and beginnings of 4 to 8 letters, by rule.
Scoring reads whole texts, however long.

Null or empty text: no match, the score of a clean document. Null labels are
not learned from; without labels of both kinds the lexicon is empty and every
score is the share of toxic labels (0 if there are none). Repeated rows are
scored alike, null ids stay null, an empty table gives an empty one. Ties of
entries and phrases are broken by their letters. Only the named columns are
read (`keep` passes others on), so others may clash with the output's names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nilas.llm.common import written

#: Letters of other scripts, digits and signs that stand in for Latin letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "х": "x", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "|": "i",
}
FOLDS = str.maketrans(LOOK_ALIKE | {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
APART = re.compile(r"[\W_]+")
#: Harmless phrases that hold a word of many lexicons; learned ones are added.
PHRASES = ("trash can", "trash bin", "trash bag", "clown fish", "idiot proof", "scum line")


def fold(text: str) -> str:
    """Folded words between single blanks, with a blank at both ends."""
    return f" {APART.sub(' ', text.lower().translate(FOLDS)).strip()} "


@dataclass
class Lexicon:
    """Entries start with a blank; those that end with one are whole words, others word beginnings."""

    entries: dict[str, float] = field(default_factory=dict)
    phrases: tuple[str, ...] = PHRASES
    model: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def matcher(self) -> Callable[[str], list[tuple[int, str]]]:
        """A function from a folded text to its matches (place of the first letter, entry) outside exception phrases."""
        import ahocorasick

        if not self.entries:
            return lambda text: []
        automaton = ahocorasick.Automaton()
        for entry in self.entries:
            automaton.add_word(entry, (len(entry), entry, False))
        for phrase in self.phrases:
            if (p := f" {phrase}") not in self.entries:
                automaton.add_word(p, (len(p), p, True))
        automaton.make_automaton()

        def matches(text: str) -> list[tuple[int, str]]:
            found, excused = [], []
            for end, (n, entry, harmless) in automaton.iter(text):
                (excused if harmless else found).append((end - n + 1, entry))
            if excused and found:
                spans = [(a, a + len(p)) for a, p in excused]
                found = [(a, e) for a, e in found if not any(lo <= a and a + len(e.rstrip()) <= hi for lo, hi in spans)]
            return found

        return matches

    def features(self, folded: str, matches: Callable) -> tuple[float, float, float]:
        weight = sum(self.entries[e] for _, e in matches(folded))
        return float(weight > 0), float(np.log1p(weight)), float(np.log1p(100 * weight / (folded.count(" ") + 9)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        w = np.array(self.model)
        return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> tuple[float, ...]:
    """Weights (constant first) of a ridge logistic regression, by damped Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    pull = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + pull, x.T @ (y - p) - pull @ w)
        w = w + step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def counted(sample: DataFrame, count: Callable[[Iterable[tuple[str, int]]], dict[str, Iterable[int]]], columns: tuple[str, ...]) -> DataFrame:
    """Sums over the sample of what `count` finds in the (folded text, label) rows of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        found = count(rows)
        cols = zip(*found.values(), strict=True) if found else [[] for _ in columns]
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), *[pa.array(c, pa.int64()) for c in cols]], names=["entry", *columns])

    made = sample.mapInArrow(run, "entry string, " + ", ".join(f"{c} long" for c in columns))
    return made.groupBy("entry").agg(*[F.sum(c).alias(c) for c in columns])


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([fold(t) for t in b.column(0).to_pylist()], pa.string()), b.column(1)], names=["_text", "_y"])


def beginnings(rows: Iterable[tuple[str, int]]) -> dict[str, tuple[int]]:
    """How many toxic documents hold each word and each beginning of four to eight letters."""
    n: Counter[str] = Counter()
    for text, label in rows:
        if label:
            words = set(text.split())
            n.update({f" {w[:k]}" for w in words for k in range(4, min(9, len(w) + 1))} | {f" {w} " for w in words})
    return {k: (v,) for k, v in n.items()}


def unevenness(n: int, of: int, m: int, out: int) -> float:
    """Log-likelihood ratio (G) of n of `of` and m of `out` against one common share."""
    p = (n + m) / (of + out)
    terms = ((n, of * p), (of - n, of * (1 - p)), (m, out * p), (out - m, out * (1 - p)))
    return 2 * sum(x * np.log(x / e) for x, e in terms if x > 0)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    train: Column | None = None,
    most_labelled: int = 20_000,
    least_docs: int = 3,
    least_share: float = 0.01,
    least_weight: float = 2.5,
    doubt: float = 1.0,
) -> Lexicon:
    """A lexicon from the labelled documents; `train`, a condition on the labels' id column, names the rows to learn from.

    An entry stands in `least_docs` and the share `least_share` of the toxic
    documents at least, has a weight of `least_weight`, and so uneven counts that
    chance alone is expected to show them in at most `doubt` of all candidates.
    Copies of one text count once.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if train is not None:
        known = known.where(train)
    known = known.select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(most_labelled)  # bounded, so it can be broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    met = texts.join(F.broadcast(known), "_id").select("_text", "_y").distinct()
    sample = written(met.mapInArrow(folded, "_text string, _y int"), "labelled")
    if sample.count() > most_labelled:  # an id on several texts
        sample = written(sample.orderBy(F.xxhash64("_text"), "_text", "_y").limit(most_labelled), "labelled")
    sizes = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        share = toxic / max(1, toxic + clean)
        return Lexicon(model=(float(np.log((share + 1e-12) / (1 - share + 1e-12))), 0.0, 0.0, 0.0))

    first = counted(sample, beginnings, ("n",)).where(F.col("n") >= max(least_docs, least_share * toxic))
    candidates = {r["entry"]: r["n"] for r in first.collect()}  # a toxic document has few words of that share
    probe = Lexicon({c: 1.0 for c in candidates}, ())

    def in_clean(rows: Iterable[tuple[str, int]]) -> dict[str, tuple[int]]:
        matches, n = probe.matcher(), Counter()
        for text, label in rows:
            if not label:
                n.update({e for _, e in matches(text)})
        return {k: (v,) for k, v in n.items()}

    harmless = {r["entry"]: r["n"] for r in counted(sample, in_clean, ("n",)).collect()}  # at most the candidates
    weights = {
        e: float(np.log((n + 0.5) / (toxic + 1)) - np.log((harmless.get(e, 0) + 0.5) / (clean + 1))) for e, n in candidates.items()
    }
    enough = 2 * np.log(max(1, len(candidates)) / doubt)
    # A longer entry adds nothing to a beginning that is itself one.
    entries: dict[str, float] = {}
    for e in sorted(weights, key=lambda e: (len(e), e)):
        if weights[e] >= least_weight and unevenness(candidates[e], toxic, harmless.get(e, 0), clean) >= enough and not any(e[:k] in entries for k in range(2, len(e))):
            entries[e] = weights[e]
    lexicon = Lexicon(entries)

    def around(rows: Iterable[tuple[str, int]]) -> dict[str, tuple[int, int]]:
        """In how many clean and toxic documents each matched word stands with each neighbour."""
        matches, n = lexicon.matcher(), {}
        for text, label in rows:
            pairs = set()
            for at, _ in matches(text):
                stop = text.find(" ", at)
                before, word, after = text[text.rfind(" ", 0, at - 1) + 1 : at - 1], text[at:stop], text[stop + 1 : text.find(" ", stop + 1)]
                pairs |= {f"{x} {y}" for x, y in ((before, word), (word, after)) if x and y}
            for p in pairs:
                old = n.get(p, (0, 0))
                n[p] = (old[0] + (not label), old[1] + label)
        return n

    phrases = counted(sample, around, ("clean", "toxic")).where((F.col("clean") >= 5) & (F.col("toxic") == 0))
    lexicon.phrases = (*PHRASES, *sorted(r["entry"] for r in phrases.collect()))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = lexicon.matcher()
        for b in batches:
            x = np.array([lexicon.features(t, matches) for t in b.column(0).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T.copy()), b.column(1)], names=["a", "b", "c", "y"])

    fit = np.array(sample.mapInArrow(features, "a double, b double, c double, y int").collect(), dtype=float)  # bounded as the sample
    fit = fit[np.lexsort(fit.T)]
    lexicon.model = logistic(fit[:, :3], fit[:, 3])
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, score and predicted of every row, and the columns named in `keep` (the text can be one of them)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_k_{c}") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = lexicon.matcher()
        for b in batches:
            x = np.array([lexicon.features(fold(t or ""), matches) for t in b.column(1).to_pylist()]).reshape(-1, 3)
            s = lexicon.scores(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *b.columns[2:], pa.array(s), pa.array((s >= 0.5).astype("int32"))],
                names=["doc_id", *[f"_k_{c}" for c in keep], "score", "predicted"],
            )

    kinds = ", ".join(f"`{n}` {k}" for n, k in slim.dtypes if n != "_text")
    return slim.mapInArrow(run, f"{kinds}, score double, predicted int")
