"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents. Words that look disguised (leetspeak,
letters spaced apart, letters repeated) become lattices of any length whose best path under that model is found
with Viterbi: a character can be read as a letter, as a letter it stands for, or, at a price, as nothing, and a blank
can lie between letters that stood apart. Letters apart without a sign where words meet are split by the words of the
labelled documents; two neighbouring scraps that no labelled document has as words, and that make one of the lexicon,
are joined. The restored words are scored against a lexicon learned from the labelled rows and calibrated to a probability.

Null or empty text has no words and gets the score of a text without evidence; texts of any length are read whole. Repeated
rows and ids get equal scores; of equally likely readings the first by its letters is taken. Further columns are kept,
but for one named score. Without labels of both kinds every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, table

#: Features of a task that are counted before they go to the shuffle.
HELD_FEATURES = 100_000
#: What a disguising character can stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
BLANK, OTHER = len(LETTERS), len(LETTERS) + 1
SIZE = len(LETTERS) + 2
_CODES = {c: i for i, c in enumerate(LETTERS)}
_LOOKUP = np.full(256, OTHER, dtype=np.int64)
for _c, _i in _CODES.items():
    _LOOKUP[ord(_c)] = _i
for _c in " \t\n\r\x0b\x0c":
    _LOOKUP[ord(_c)] = BLANK
_EDGE = ".,;:!?\"'()[]{}<>|*&%$#-_/\\…«»„“”=+~^`"
_ONE = rf"[{LETTERS}0-9@$!|]"
_SPACED = re.compile(rf"(?<!\S)(?:{_ONE}[ \t]+){{3,}}{_ONE}(?!\S)")
_DISGUISED = re.compile(rf"[{LETTERS}][^{LETTERS}\s]+[{LETTERS}]|^[0-9@$!|+(€]+[{LETTERS}]{{2}}|(.)\1\1")
#: Single characters with separators between them ("m.o.r.o.n"); words can meet at any separator.
_CHAIN = re.compile(rf"{_ONE}(?:[^{LETTERS}0-9@$!|\s]+{_ONE}){{3,}}")
#: Cost of reading a repeated letter as one; among letters set apart, two words can meet in one letter.
REPEAT, REPEAT_APART = -0.1, -4.0
#: Cost of reading a sign within a word, or a repeated digit, as nothing when it can stand for a letter.
DROPPED = -3.0
#: Log probability that a word is none of the vocabulary.
UNKNOWN = -7.0
#: Most frequent words of the labelled documents, by which runs without gaps are split into words.
VOCABULARY_WORDS = 50_000
_PLAIN = re.compile(_ONE)
_STRETCHED = re.compile(r"(.)\1{3,}")


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where(points < 256, _LOOKUP[np.minimum(points, 255)], OTHER)


def character_model(docs: DataFrame) -> np.ndarray:
    """Trigram log probabilities over all texts: SIZE**3 cells, whatever the size of the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, pending, length = np.zeros(SIZE**3, dtype=np.int64), [], 0
        gap = np.array([BLANK, BLANK])

        def add() -> None:
            nonlocal length
            c = np.concatenate([gap, *pending])
            total[:] += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
            pending.clear()
            length = 0

        for batch in batches:
            for text in batch["text"]:
                if text:
                    pending.append(_codes(text))
                    pending.append(gap)
                    length += len(pending[-2])
                    if length > 1_000_000:
                        add()
        add()
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells, "n": total[cells]})

    counted = docs.select("text").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    grid = np.zeros(SIZE**3)
    for row in counted.collect():  # at most SIZE**3 rows
        grid[row["cell"]] = row["n"]
    grid = grid.reshape(SIZE, SIZE, SIZE)
    pair, single = grid.sum(axis=0), grid.sum(axis=(0, 1))
    unigram = (single + 1) / (single.sum() + SIZE)
    bigram = (pair + 5 * unigram) / (pair.sum(axis=1, keepdims=True) + 5)
    return np.log((grid + 5 * bigram) / (grid.sum(axis=2, keepdims=True) + 5))


def decode(token: str, model: np.ndarray, gaps: list[bool | None] | None = None, repeat: float = REPEAT) -> str:
    """Best reading of a disguised token: Viterbi over its lattice, states being the last two letters.

    gaps tells for each character whether a blank can (False) or must (True) come before it; the reading then
    has blanks between its words. Time and memory are linear in the length of the token.
    """
    states: dict = {(BLANK, BLANK): (0.0, None)}  # score and path, as (path before, letter)
    last = ""
    for at, char in enumerate(token):
        if gaps and gaps[at] is not None:
            parted = {}
            for (a, b), (score, path) in states.items():
                key, value = ((b, BLANK), score + model[a, b, BLANK]) if b != BLANK else ((a, b), score)
                if key not in parted or value > parted[key][0]:
                    parted[key] = (value, (path, " ") if b != BLANK else path)
            states = parted if gaps[at] else {**states, **parted}
        repeated, last = char == last, char
        arcs = []  # (letter, cost)
        if char in _CODES:
            arcs.append((char, 0.0))
        arcs += [(c, -0.5) for c in LEET.get(char, "")]
        within = 0 < at < len(token) - 1
        if char not in _CODES and char not in LEET:
            arcs.append(("", -0.5))
        elif char in "!|+(":
            arcs.append(("", DROPPED if within and not repeated else -0.5))
        if repeated:
            arcs.append(("", repeat if char in _CODES or char in "!|+(" else min(repeat, DROPPED)))
        following: dict = {}
        for (a, b), (score, path) in states.items():
            for letter, cost in arcs or [("", -1.0)]:
                if letter:
                    code = _CODES[letter]
                    key, value = (b, code), score + cost + model[a, b, code]
                else:
                    key, value = (a, b), score + cost
                if key not in following or value > following[key][0]:
                    following[key] = (value, (path, letter) if letter else path)
        states = following
    path = max((score + (model[a, b, BLANK] if b != BLANK else 0.0), n, path)
               for n, ((a, b), (score, path)) in enumerate(states.items()))[2]
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters)).strip()


def split_words(letters: str, model: np.ndarray, vocabulary: dict[str, float]) -> list[str]:
    """Most likely words of letters without blanks: known words by their log probability, others letter by letter."""
    longest = max(map(len, vocabulary), default=0)
    codes = [BLANK, BLANK, *(_CODES[c] for c in letters)]
    best, strange = [(0.0, 0)], [(-np.inf, 0)]  # score and begin of the last word, known or not
    for end in range(1, len(letters) + 1):
        cost = model[codes[end - 1], codes[end], codes[end + 1]]
        fresh = best[end - 1][0] + UNKNOWN + model[BLANK, BLANK, codes[end + 1]]
        strange.append(max((fresh, end - 1), (strange[end - 1][0] + cost, strange[end - 1][1])))
        found = strange[end]
        for begin in range(max(0, end - longest), end):
            p = vocabulary.get(letters[begin:end])
            if p is not None and best[begin][0] + p > found[0]:
                found = (best[begin][0] + p, begin)
        best.append(found)
    words, end = [], len(letters)
    while end:
        begin = best[end][1]
        words.append(letters[begin:end])
        end = begin
    return words[::-1]


def read_apart(letters: str, model: np.ndarray, vocabulary: dict[str, float]) -> list[str]:
    """Words of characters that stood apart, with no sign where words meet."""
    read = decode(letters, model, [None] + [False] * (len(letters) - 1), REPEAT_APART)
    return split_words(read.replace(" ", ""), model, vocabulary) if vocabulary else read.split()


def spaced(run: str, model: np.ndarray, vocabulary: dict[str, float]) -> list[str]:
    """Words of a run of characters spaced apart; where some gaps are wider, these part the words."""
    pieces = re.split(r"([ \t]+)", run)
    widths = [len(g) for g in pieces[1::2]]
    letters = "".join(pieces[::2])
    if min(widths) == max(widths):
        return read_apart(letters, model, vocabulary)
    return decode(letters, model, [None, *[True if w > min(widths) else None for w in widths]]).split()


class Restorer:
    """Restores the words of a text; decoded tokens are remembered in a bounded table."""

    KNOWN = 100_000

    def __init__(self, model: np.ndarray, vocabulary: dict[str, float] | None = None, lexicon: dict[str, float] | None = None):
        self.model, self.vocabulary, self.known = model, vocabulary or {}, {}
        self.whole = {w for w in lexicon or () if w.isalpha() and len(w) > 3}
        self.heads = {w[:n] for w in self.whole for n in range(1, len(w))}

    def word(self, token: str) -> str:
        found = self.known.get(token)
        if found is None:
            bare = token.strip(_EDGE)
            probe = bare if bare and bare == token.rstrip(_EDGE) else token.rstrip(_EDGE.replace("$", "")) if token[:1] in "$!|+(" else bare
            if _CHAIN.fullmatch(probe):
                found = " ".join(read_apart("".join(_PLAIN.findall(probe)), self.model, self.vocabulary))
            else:
                found = decode(_STRETCHED.sub(r"\1\1\1", probe), self.model) if _DISGUISED.search(probe) else bare
            if len(self.known) > self.KNOWN:
                self.known.clear()
            self.known[token] = found
        return found

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        lowered = text.lower()
        words = " ".join([self.word(t) for t in lowered.split()]).split(" ")
        if self.whole:
            words += self.joined(words)
        for match in _SPACED.finditer(lowered):
            words += spaced(match.group(), self.model, self.vocabulary)
        return words

    def joined(self, words: list[str]) -> list[str]:
        """Lexicon words that a blank parts into two scraps, neither a word of its own."""
        heads, known = self.heads, self.vocabulary
        return [both for a, b in zip(words, words[1:]) if a in heads and a not in known and b not in known and (both := a + b) in self.whole]


def features(word: str) -> list[str]:
    """The word and its beginnings of five to seven letters."""
    return [word] + [f"{word[:n]}*" for n in (5, 6, 7) if len(word) > n] if len(word) > 2 else []


def _evidence(words: list[str], weights: dict[str, float], memory: dict[str, float]) -> tuple[float, float, float]:
    total, strongest, seen = 0.0, 0.0, set()
    hits = 0
    for word in words:
        w = memory.get(word)
        if w is None:
            w = max((weights.get(f, 0.0) for f in features(word)), default=0.0)
            if len(memory) > Restorer.KNOWN:
                memory.clear()
            memory[word] = w
        if w:
            hits += 1
            if word not in seen:
                seen.add(word)
                total += w
                strongest = max(strongest, w)
    return float(np.log1p(total)), strongest, hits / np.sqrt(len(words) + 20.0)


_EVIDENCE = "total double, strongest double, density double"


def _logistic(rows: DataFrame) -> np.ndarray | None:
    """Ridge logistic regression of toxic on the evidence, by Newton steps; each step is one row of sums over all rows."""
    x = [F.lit(1.0), F.col("total"), F.col("strongest"), F.col("density")]
    beta = np.zeros(len(x))
    for _ in range(30):
        z = sum((F.lit(float(b)) * c for b, c in zip(beta, x)), F.lit(0.0))
        p, pairs = F.col("p"), [(i, j) for i in range(len(x)) for j in range(i + 1)]
        scored = rows.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))
        sums = scored.agg(*[F.sum(c * (F.col("toxic") - p)) for c in x], *[F.sum(x[i] * x[j] * p * (1 - p)) for i, j in pairs]).first()
        if sums[0] is None:
            return None
        hessian = 0.1 * np.eye(len(x))
        for (i, j), value in zip(pairs, sums[len(x):]):
            hessian[i, j] += value
            hessian[j, i] = hessian[i, j]
        step = np.linalg.solve(hessian, np.array(sums[:len(x)]) - 0.1 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Learns the model from all labelled rows whose crc32(doc_id) mod 5 is not 0: folds 1 to 3 give the lexicon, fold 4 the calibration.

    Only the lexicon, the most frequent words and sums come to the driver.
    """
    model = character_model(docs)
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fold", fold).where("fold <> 0")
    # shuffled whatever the number of labels, which grows with the corpus; only these are hashed, so that no text is sorted
    rows = docs.select("doc_id", "text").join(known.hint("shuffle_hash"), "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, found = Restorer(model), {0: Counter(), 1: Counter()}

        def drain() -> pd.DataFrame:
            out = pd.DataFrame(
                [(f, n, y) for y in found for f, n in found[y].items()], columns=["feature", "n", "toxic"])
            for y in found:
                found[y].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = set(restorer.words(text))
                seen = {f for w in words for f in features(w)} | {w for w in words if w and len(w) < 3}
                found[int(toxic == 1)].update(seen)
                found[int(toxic == 1)][""] += 1
                if len(found[0]) + len(found[1]) > HELD_FEATURES:
                    yield drain()
        yield drain()

    counted = (
        rows.where("fold < 4").mapInPandas(count, "feature string, n long, toxic int")
        .groupBy("feature")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
             F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    )
    counted = cut(counted)
    plain = counted.where(F.col("feature").rlike(f"^[{LETTERS}]+$")).withColumn("n", F.col("bad") + F.col("good")).where("n >= 5")
    frequent = {r["feature"]: r["n"] for r in plain.orderBy(F.desc("n"), "feature").limit(VOCABULARY_WORDS).collect()}
    occurring = sum(frequent.values())
    vocabulary = {w: float(np.log(n / occurring)) for w, n in frequent.items()}
    head = counted.where("feature = ''").first()
    if head is None or not head["good"]:
        return {"model": model, "weights": {}, "beta": None, "vocabulary": vocabulary}
    odds = F.log((F.col("bad") + 0.5) / (head["bad"] + 1.0)) - F.log((F.col("good") + 0.5) / (head["good"] + 1.0))
    sure = F.col("w") / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    chosen = counted.where("bad >= 3 and feature <> ''").withColumn("w", odds).where((F.col("w") >= 1.5) & ((sure >= 3) | (F.col("good") == 0) & (F.col("w") >= 3)))
    weights = {r["feature"]: r["w"] for r in chosen.select("feature", "w").collect()}

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, memory = Restorer(model, vocabulary, weights), {}
        for batch in batches:
            out = pd.DataFrame([_evidence(restorer.words(t), weights, memory) for t in batch["text"]],
                               columns=["total", "strongest", "density"])
            out["toxic"] = (batch["toxic"] == 1).astype("int32").to_numpy()
            yield out

    beta = _logistic(cut(rows.where("fold = 4").mapInPandas(gather, f"{_EVIDENCE}, toxic int")))
    return {"model": model, "weights": weights, "beta": beta, "vocabulary": vocabulary}


def score_toxicity(docs: DataFrame, fitted: dict) -> DataFrame:
    """All columns of docs and score (0 to 1)."""
    model, weights, beta = fitted["model"], fitted["weights"], fitted["beta"]
    shared = docs.sparkSession.sparkContext.broadcast((model, weights, fitted["vocabulary"]))  # bounded by alphabet, vocabulary and lexicon

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, weights, vocabulary = shared.value
        restorer, memory = Restorer(model, vocabulary, weights), {}
        for texts in batches:
            x = np.array([_evidence(restorer.words(t), weights, memory) for t in texts]).reshape(-1, 3)
            z = beta[0] + x @ beta[1:] if beta is not None else np.full(len(x), -30.0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn("score", F.pandas_udf(score, "double")(F.col("text")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = fit(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, fitted).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
