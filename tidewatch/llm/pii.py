"""Personal data by candidate generators and gradient-boosted trees.

The base patterns give spans that always stay. High-recall generators propose further, overlapping spans
(secrets, long hexadecimal keys, account and identity numbers, local telephone numbers, disguised mail
addresses). Boosted trees on format and context features score each; they are fitted on the candidates of all documents,
counted by bins of their features, and on made-up sentences for forms that the corpus lacks, under weak labels from validators (checksums, number
ranges, number plans, assignments to keywords), since no table marks personal data. Each kind's threshold is calibrated on held-out candidates: the least one that keeps
PRECISION; a kind with fewer than MIN_HELD of them, or that never gets there, takes the threshold of all kinds together.
Selected spans never overlap a base span or each other.

Null or empty text has no spans; texts of any length are read whole. Repeated rows and ids give equal results. Of
overlapping candidates the one with the higher score stays, of equal scores the one that starts first, of these the longer.
Further columns are kept, but for those named like the results. An empty table, or candidates of one label only, give
trees that select nothing.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, table

#: Least share of the made-up sentences among the examples that trees are fitted on, and tasks that add up counts for them.
MADE_SHARE, SUM_TASKS = 0.02, 32
PRECISION, MIN_HELD = 0.9, 30
#: Threshold of a candidate where none could be calibrated: nothing is selected.
NEVER = 1.1
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("secret", "key", "iban", "ssn", "local", "disguised")
KINDS = BASE_KINDS + EXTRA_KINDS

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EXTRA = {
    "secret": re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|auth)\b[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?([^\s\"']{8,}+)"),
    "key": re.compile(r"(?<![0-9A-Za-z])([0-9a-fA-F]{32,}+)(?![0-9A-Za-z])"),
    "iban": re.compile(r"(?<![A-Z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
    "local": re.compile(r"(?<![0-9+])(\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4})(?![0-9])"),
    "disguised": re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,}+)++)"),
}
_DATE = re.compile(r"(?:[12][0-9]{3}([ .-])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([ .-])[0-3]?[0-9]\2[12][0-9]{3})(?:[ .-][0-9]{2})*")
_CALL = re.compile(r"(?i)\b(?:tele)?(?:phone|fon|fax)|\btel\b|\bcall|\bmobil|\bhandy|\bt[ée]l[ée]")
_CONTEXT = [re.compile(w) for w in (
    r"(?i)token|secret|key|auth|passw", r"(?i)phone|tel|call|mobile|fax", r"(?i)card|visa|credit", r"(?i)iban|account|bank",
    r"(?i)ssn|social|identity|tax", r"(?i)mail|contact", r"[:=]\s*[\"']?\Z")]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards, in linear time."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_SET:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        floor = found.end() if found else at + 1
        if found:
            yield start, found.end()
        at = text.find("@", floor)


def _valid(kind: str, text: str) -> bool:
    digits = _digits(text)
    if kind == "ip":
        parts = [p.lstrip("0") for p in text.split(".")]
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then start."""
    if not text:
        return []
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    for kind, form in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        spans += [(kind, m.start(), m.end()) for m in form.finditer(text) if _valid(kind, m.group())]
    return spans


def candidates(text: str | None) -> list[tuple[str, int, int]]:
    """Overlapping proposals of the further generators."""
    if not text:
        return []
    found, digit, low = [], bool(_DIGIT.search(text)), text.lower()
    # a long s, which lower() leaves, also counts as an s where case is ignored
    named = "\u017f" in text or any(word in low for word in ("token", "secret", "passw", "pwd", "api", "auth"))
    possible = {"secret": named, "iban": digit, "ssn": digit, "local": digit, "disguised": "at" in text and "dot" in text}
    for kind, form in _EXTRA.items():
        if possible.get(kind, True):
            found += [(kind, m.start(1), m.end(1)) for m in form.finditer(text)]
    return found


def _named_secret(text: str, start: int, end: int) -> bool:
    """A value that a keyword is assigned: no placeholder, and no word of a sentence that goes on after a colon."""
    span = text[start:end]
    plain = span.strip(".,;:!?()[]{}<>*")
    if len(set(plain)) < 3 or span[0] in "<{%" or span.startswith("$" + "{"):
        return False
    if not plain.isalpha() or text[start - 1] in "\"'" or "=" in text[max(0, start - 6):start]:
        return True
    return not re.match(r"[^\S\n]*+[^\W_]", text[end:end + 64])


def _dialled(text: str, start: int, end: int) -> bool:
    """A telephone number by plan (trunk prefix, area in brackets, 3-3-4) or by the words before it; no date."""
    span = text[start:end]
    groups = re.findall("[0-9]+", span)
    n = sum(map(len, groups))
    if not 7 <= n <= 15 or _DATE.fullmatch(span):
        return False
    if [len(g) for g in groups] == [3, 3, 4] and groups[0][0] > "1" and groups[1][0] > "1":
        return True
    return n >= 9 and span[0] in "(0" or bool(_CALL.search(text[max(0, start - 32):start]))


def _weak_label(text: str, kind: str, start: int, end: int) -> int:
    """Validators that serve as labels: checksums, ranges, number plans and assignments, none of which is a feature."""
    span = text[start:end]
    digits = _digits(span)
    if kind in BASE_KINDS:
        return int(_valid(kind, span))
    if kind == "secret":
        return int(_named_secret(text, start, end))
    if kind == "key":
        return int(len(set(span)) > 4 and len(digits) < len(span))
    if kind == "iban":
        plain = span.replace(" ", "")
        return int(15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1)
    if kind == "ssn":
        return int(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000")
    if kind == "local":
        return int(_dialled(text, start, end))
    return 1


def _features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before = text[start:end], text[max(0, start - 32):start]
    counts = Counter(span)
    n = len(span)
    groups = [len(g) for g in re.split("[^0-9]+", span) if g] or [0]
    return [
        KINDS.index(kind), n, sum(c.isdigit() for c in span) / n, sum(c.isupper() for c in span) / n,
        sum(c in " -.()" for c in span), -sum(k / n * math.log2(k / n) for k in counts.values()), len(counts) / n,
        float(text[end:end + 1].isalnum()), float(before[-1:].isalnum()),
        groups[0], groups[-1], float(before[-1:] in ("'", '"')), *[float(bool(w.search(before))) for w in _CONTEXT],
    ]


#: Bounds of the bins that trees split at, by feature.
_SHARES, _COUNTS = np.arange(1, 32, 2) / 32, np.arange(8) + 0.5
_BOUNDS = [
    np.arange(len(KINDS) - 1) + 0.5, np.array([*np.arange(4, 24), 28, 31, 33, 36, 39, 47, 63, 95, 127, 255, 511]) + 0.5, _SHARES, _SHARES, _COUNTS,
    np.arange(2, 24) / 4, _SHARES, np.array([0.5]), np.array([0.5]), np.array([*np.arange(13), 15, 18]) + 0.5, np.array([*np.arange(13), 15, 18]) + 0.5,
    *[np.array([0.5])] * (1 + len(_CONTEXT))]
_BINS = 1 + max(map(len, _BOUNDS))
#: Residuals are added as whole numbers of this unit, so that sums do not depend on their order.
_UNIT = 1 << 20


def _binned(x: np.ndarray) -> np.ndarray:
    """Bin of each feature: value <= bound j where bin <= j."""
    return np.stack([np.searchsorted(b, x[:, f]) for f, b in enumerate(_BOUNDS)], axis=1).astype(np.uint8)


class BoostedTrees:
    """Gradient boosting of small regression trees for the logistic loss, on bounds of bins. sums(trees, splits) gives the
    residuals, curvatures and counts of all examples together, by open node, feature and bin."""

    def __init__(self, rounds: int = 24, depth: int = 3, rate: float = 0.3):
        self.rounds, self.depth, self.rate, self.trees, self.bias = rounds, depth, rate, [], -30.0

    def fit(self, positives: int, total: int, sums: Callable[[BoostedTrees, dict], dict[int, np.ndarray]]) -> BoostedTrees:
        if total < 20 or positives in (0, total):
            return self
        self.bias = math.log(positives / (total - positives))
        for _ in range(self.rounds):
            splits, values = {}, {}
            for level in range(self.depth):
                found = sums(self, splits)
                for node, (g, h, n) in found.items():
                    whole = g[0].sum(), h[0].sum(), n[0].sum()
                    values[node] = float(whole[0] / (whole[1] + 1.0))
                    best = self._split(g, h, n, *whole)
                    if best:
                        splits[node], (left, right) = best
                        values[2 * node + 1], values[2 * node + 2] = left, right
                if not any(2 ** level - 1 <= node for node in splits):
                    break
            self.trees.append(self._built(0, splits, values))
        return self

    @staticmethod
    def _split(g, h, n, g_all, h_all, n_all):
        """((feature, bin), values of both sides) of the greatest gain, of equal ones the first; None where none gains."""
        best, score = None, g_all ** 2 / (h_all + 1.0) + 1e-6
        if n_all < 20:
            return None
        for f, bounds in enumerate(_BOUNDS):
            gl, hl, nl = (np.cumsum(v[f])[:len(bounds)] for v in (g, h, n))
            gain = np.where((nl >= 5) & (nl <= n_all - 5), gl ** 2 / (hl + 1.0) + (g_all - gl) ** 2 / (h_all - hl + 1.0), -1.0)
            j = int(gain.argmax())
            if gain[j] > score:
                best, score = ((f, j), (float(gl[j] / (hl[j] + 1.0)), float((g_all - gl[j]) / (h_all - hl[j] + 1.0)))), gain[j]
        return best

    def _built(self, node: int, splits: dict, values: dict):
        if node not in splits:
            return values[node]
        f, j = splits[node]
        return f, float(_BOUNDS[f][j]), self._built(2 * node + 1, splits, values), self._built(2 * node + 2, splits, values)

    def _tree(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], self._tree(tree[2], x), self._tree(tree[3], x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + self.rate * sum((self._tree(t, x) for t in self.trees), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))


#: A value of each bin.
_INSIDE = [np.array([*b, b[-1] + 1.0]) for b in _BOUNDS]


def _node_sums(codes: np.ndarray, n: np.ndarray, positives: np.ndarray, trees: BoostedTrees, splits: dict) -> dict[int, np.ndarray]:
    """Whole-number sums (residuals, curvatures, examples) of the nodes at the open level, by feature and bin."""
    p = trees.predict(np.stack([v[codes[:, f]] for f, v in enumerate(_INSIDE)], axis=1))
    g = positives * _UNIT - n * np.rint(p * _UNIT)
    h = n * np.rint(p * (1 - p) * _UNIT)
    node = np.zeros(len(codes), dtype=np.int64)
    for at, (f, j) in sorted(splits.items()):
        inside = node == at
        node[inside] = 2 * at + 1 + (codes[inside, f] > j)
    first = max((2 ** (int(math.log2(at + 1)) + 1) - 1 for at in splits), default=0)
    out = {}
    for at in np.unique(node[node >= first]).tolist():
        rows = node == at
        out[at] = np.array([[np.bincount(codes[rows, f], v[rows], _BINS) for f in range(len(_BOUNDS))] for v in (g, h, n)])
    return out


#: Thresholds that are tried, from the highest.
_STEPS = np.linspace(0.95, 0.3, 27)


def _tallies(p: np.ndarray, positives: np.ndarray, n: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Examples and positive ones, by kind and the highest threshold that they reach (the last: none)."""
    reached = (p[:, None] < _STEPS[None, :]).sum(axis=1)
    out = np.zeros((len(KINDS), len(_STEPS) + 1, 2))
    np.add.at(out, (kinds, reached, 0), n)
    np.add.at(out, (kinds, reached, 1), positives)
    return out


def _thresholds(tallies: np.ndarray, precision: float) -> dict[str, float]:

    def least(counts: np.ndarray) -> float:
        n, positives = counts.cumsum(axis=0)[:len(_STEPS)].T
        good = np.nonzero((n > 0) & (positives >= precision * n - 1e-9))[0]
        return float(_STEPS[good[-1]]) if len(good) else NEVER

    out = {"": least(tallies.sum(axis=0))}
    for k, kind in enumerate(KINDS):
        own = least(tallies[k]) if tallies[k, :, 0].sum() >= MIN_HELD else NEVER
        out[kind] = own if own < NEVER else out[""]
    return out


def calibrate(p: np.ndarray, truth: np.ndarray, kinds: np.ndarray, precision: float = PRECISION) -> dict[str, float]:
    """Threshold of each kind, and of all together under the empty name, from held-out scores and labels."""
    return _thresholds(_tallies(p, truth, np.ones(len(p)), kinds), precision)


def rendered(n: int = 400) -> list[str]:
    """Made-up sentences with values in forms that a corpus may lack, and with look-alikes: training examples only."""
    draw = random.Random(11)
    digits = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    words = lambda k: " ".join("".join(draw.choice("aeiorstnl") for _ in range(draw.randint(2, 8))) for _ in range(k))

    def iban() -> str:
        body = digits(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    forms = [
        lambda: f"{draw.choice(('call', 'tel', 'phone', 'ring', 'mobile'))}{draw.choice((' ', ': '))}0{digits(2)} {digits(4)} {digits(4)}",
        lambda: f"0{digits(draw.choice((2, 3)))}{draw.choice(' -.')}{digits(3)}{draw.choice(' -.')}{digits(4)}",
        lambda: f"{draw.choice('23456789')}{digits(2)}-{draw.choice('23456789')}{digits(2)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"20{digits(2)}-0{draw.randint(1, 9)}-{draw.randint(10, 28)}", lambda: f"{digits(2)} {digits(2)} {digits(2)}", lambda: ".".join(digits(3) for _ in range(4)),
        lambda: f"{draw.randint(100, 665)}-{draw.randint(10, 99)}-{draw.randint(1000, 9999)}", lambda: f"000-{digits(2)}-{digits(4)}", iban, lambda: f"DE{digits(20)}",
        lambda: f"{words(1)} [at] {words(1)} [dot] org", lambda: f"{draw.choice(('password', 'token', 'api_key'))} = {words(1)}{digits(6)}", lambda: f"the token: {words(1)} and {words(2)}",
        lambda: f"password: {'*' * draw.randint(8, 12)}", lambda: "".join(draw.choice("0123456789abcdef") for _ in range(40)), lambda: digits(34)]
    return [f"{words(3)} {draw.choice(forms)()} {words(3)}" for _ in range(n)]


_CELL = "codes binary, held boolean, n long, positives long"


def _cells(texts: list[str | None]) -> pd.DataFrame:
    """Candidates of the texts by the bins of their features: how many, and how many of weak label 1. Equal values are held out together."""
    x, keys = [], []
    for text in texts:
        if text:
            failed = [("card", m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() > 8]
            for kind, a, b in {*base_spans(text), *candidates(text), *failed}:
                x.append(_features(text, kind, a, b))
                keys.append((zlib.crc32(text[a:b].encode("utf-8", "replace")) % 4 == 0, _weak_label(text, kind, a, b)))
    counts: dict[tuple[bytes, bool], list[int]] = {}
    for codes, (held, y) in zip(_binned(np.array(x)) if x else (), keys):
        cell = counts.setdefault((codes.tobytes(), held), [0, 0])
        cell[0] += 1
        cell[1] += y
    return pd.DataFrame([(c, held, n, y) for (c, held), (n, y) in counts.items()], columns=["codes", "held", "n", "positives"])


def _arrays(cells: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(cells["codes"]), dtype=np.uint8).reshape(-1, len(_BOUNDS))
    return codes, cells["n"].to_numpy(dtype=float), cells["positives"].to_numpy(dtype=float)


def _summed(cells: DataFrame, own: pd.DataFrame, sums: Callable[[pd.DataFrame], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """sums over the cells of all tasks and the made-up ones; a task sends its sums alone, and tasks are at most SUM_TASKS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, value in sums(batch).items():
                total[key] = total[key] + value if key in total else value
        yield pd.DataFrame({"key": list(total), "sums": [v.astype("<i8").tobytes() for v in total.values()]})

    total = {k: v.astype(np.int64) for k, v in sums(own).items()}
    for row in cells.mapInPandas(run, "key long, sums binary").collect():
        shape = (len(KINDS), len(_STEPS) + 1, 2) if row["key"] < 0 else (3, len(_BOUNDS), _BINS)
        value = np.frombuffer(row["sums"], dtype="<i8").reshape(shape)
        total[row["key"]] = total[row["key"]] + value if row["key"] in total else value
    return total


def fit(docs: DataFrame, precision: float = PRECISION) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees and thresholds from the candidates of all documents, a fourth of them held out for the thresholds.

    One pass over the texts counts candidates by the bins of their features; the counts are written once, and every level of a
    tree is one sum over them. The made-up sentences are weighted to keep a share of MADE_SHARE where the candidates are many.
    """

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _cells(batch["text"].tolist())

    counted = docs.select("text").mapInPandas(gather, _CELL).groupBy("codes", "held").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    cells = cut(counted.coalesce(SUM_TASKS))
    size = {r["held"]: r for r in cells.groupBy("held").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives")).collect()}
    if not size:
        return BoostedTrees(), {}
    own = _cells(rendered())
    learned, made, held = cells.where("not held"), own[~own["held"]], own[own["held"]]
    n, positives = (size[False]["n"], size[False]["positives"]) if False in size else (0, 0)
    weight = max(1, round(MADE_SHARE * n / made["n"].sum()))
    made = made.assign(n=made["n"] * weight, positives=made["positives"] * weight)

    def sums(trees: BoostedTrees, splits: dict) -> dict[int, np.ndarray]:
        found = _summed(learned, made, lambda batch: _node_sums(*_arrays(batch), trees, splits))
        return {node: (v[0] / _UNIT, v[1] / _UNIT, v[2]) for node, v in sorted(found.items())}

    trees = BoostedTrees().fit(int(positives + made["positives"].sum()), int(n + made["n"].sum()), sums)
    if not trees.trees:
        return trees, {}

    def scores(batch: pd.DataFrame) -> dict[int, np.ndarray]:
        codes, n, positives = _arrays(batch)
        p = trees.predict(np.stack([v[codes[:, f]] for f, v in enumerate(_INSIDE)], axis=1))
        return {-1: _tallies(p, positives, n, codes[:, 0].astype(int))}

    return trees, _thresholds(_summed(cells.where("held"), held, scores)[-1], precision)


def select_spans(text: str | None, trees: BoostedTrees, thresholds: dict[str, float]) -> tuple[list, list]:
    """(base spans, further spans selected by the trees)."""
    base, proposed = base_spans(text), candidates(text)
    if not proposed:
        return base, []
    scores = trees.predict(np.array([_features(text, *c) for c in proposed]))
    taken = sorted((a, b) for _, a, b in base)
    extra = []
    ranked = sorted((-s, c[1], -c[2], c) for s, c in zip(scores, proposed) if s >= thresholds.get(c[0], NEVER))
    covered = bytearray(len(text))
    for a, b in taken:
        covered[a:b] = b"\x01" * (b - a)
    for _, a, b, c in ranked:
        if not any(covered[a:-b]):
            covered[a:-b] = b"\x01" * (-b - a)
            extra.append(c)
    return base, sorted(extra, key=lambda c: (KINDS.index(c[0]), c[1]))


_SPAN = "array<struct<kind:string,a:long,b:long>>"


def find_pii(docs: DataFrame, fitted: tuple[BoostedTrees, dict[str, float]]) -> DataFrame:
    """All columns of docs, pii_base and pii_extra (kind, start and end in code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [[[{"kind": k, "a": a, "b": b} for k, a, b in s] for s in select_spans(t, *shared.value)] for t in texts]
            yield pd.DataFrame(rows, columns=["base", "extra"])

    found = docs.withColumn("__pii", F.pandas_udf(find, f"struct<base:{_SPAN},extra:{_SPAN}>")(F.col("text")))
    return found.select(*[c for c in docs.columns if c not in ("pii_base", "pii_extra")], F.col("__pii.base").alias("pii_base"), F.col("__pii.extra").alias("pii_extra"))


def redact(docs: DataFrame, fitted: tuple[BoostedTrees, dict[str, float]]) -> DataFrame:
    """The columns of docs with every span found in text replaced by its kind in brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def clean(text: str | None) -> str | None:
        base, extra = select_spans(text, *shared.value)
        out, at = [], 0
        for kind, a, b in sorted(base + extra, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]]) if out else text

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([clean(t) for t in texts], dtype=object)

    return docs.withColumn("text", F.pandas_udf(run, "string")(F.col("text")))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, fit(docs))

    def joined(name: str):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    spans = F.concat_ws(",", F.nullif(joined("pii_base"), F.lit("")), F.nullif(joined("pii_extra"), F.lit("")))
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined("pii_base"), 256).alias("base_sha256"), spans.alias("spans"))
