"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

The distinct pieces of a buffer of documents lie, in sorted order, in linked lists of tokens, some thousands in one. An inverted index holds, for every rank, the
places where a pair of that rank stands; ranks are applied in order, each at all its places, and only the pairs with the
two neighbours of a merged place enter the index anew. A pair that appears with a lower rank than the one at hand comes
first in its word, as a merge of least rank would have it. Each piece is merged once however often it occurs, and the
tokens of pieces met before are remembered within a process, about REMEMBERED of them; when these are reached, those that no
later buffer had are forgotten.

Buffers are runs of whole documents within a task, so that nothing is shuffled: a dictionary of the whole corpus would
have to be joined back to every occurrence of every word. Tokens do not depend on the buffers.

Null or empty text has no tokens. Repeated rows are encoded like any other; further columns stay, except those named as
results, which are replaced. An empty table gives an empty one. Null ids decode to null; ids outside the vocabulary fail.
"""

from __future__ import annotations

import base64
import gc
import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of a buffer (one longer text is a buffer of its own); pieces and pairs that a task remembers.
BUFFER_BYTES, REMEMBERED, PAIRS = 4_000_000, 400_000, 1_000_000
#: Pieces of one replay, in sorted order, so that its lists and pairs stay near each other in memory.
REPLAYED = 4_000


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Pairs(dict):
    """Id, which is the rank, of two tokens' concatenation, by left * width + right; -1 if it is no token."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.texts = ranks, {i: t for t, i in ranks.items()}
        self.width = max(self.texts) + 2
        self.edge = self.width - 1  # stands between words and merges with nothing

    def __missing__(self, key: int) -> int:
        left, right = divmod(key, self.width)
        found = -1 if self.edge in (left, right) else self.ranks.get(self.texts[left] + self.texts[right], -1)
        if len(self) >= PAIRS:
            self.clear()
        self[key] = found
        return found


class Replay:
    """Merges of many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pairs = Pairs(ranks)
        self.single = [ranks[bytes([b])] for b in range(256)]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word (none of them empty)."""
        gc.disable()  # millions of short lists without cycles
        try:
            return self._merge(words)
        finally:
            gc.enable()

    def _merge(self, words: list[bytes]) -> list[list[int]]:
        pairs, width, edge, single = self.pairs, self.pairs.width, self.pairs.edge, self.single
        tokens, edges = [edge], [0]
        for word in words:
            tokens += [single[b] for b in word]
            edges.append(len(tokens))
            tokens.append(edge)
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        index: dict[int, list[int]] = {}
        for p, r in enumerate(map(pairs.__getitem__, [a * width + b for a, b in zip(tokens, tokens[1:])])):
            if r >= 0:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
        heap = list(index)
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            r = pop(heap)
            places = index.pop(r)
            places.sort()
            waiting_until = 0
            for p in places:
                if p < waiting_until:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        push(heap, r)
                    continue
                left, q = tokens[p], after[p]
                if left < 0 or pairs[left * width + tokens[q]] != r:  # gone with another merge
                    continue
                tokens[p], tokens[q] = r, -1
                q = after[p] = after[q]
                before[q] = p
                b = before[p]
                right, left = pairs[r * width + tokens[q]], pairs[tokens[b] * width + r]
                for k, at in ((right, p), (left, b)):
                    if k >= 0:
                        if k in index:
                            index[k].append(at)
                        else:
                            index[k] = [at]
                            push(heap, k)
                if 0 <= right < r or 0 <= left < r:  # the rest of this word waits for the lower pair
                    waiting_until = edges[bisect_right(edges, p)]
        return [[t for t in tokens[a + 1:b] if t >= 0] for a, b in zip(edges, edges[1:])]


@lru_cache(maxsize=1)
def unicode_classes() -> tuple[str, str, str]:
    """Letters and numbers as ranges of the tiktoken library, and the characters that the regex library classes otherwise.

    The two libraries follow different versions of Unicode.
    """
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single, odd, classes = {bytes([b]): b for b in range(256)}, set(), []
    for kind in (r"\p{L}", r"\p{N}"):
        matcher = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
        chars = bytes(matcher.encode_ordinary(everything)).decode()
        odd |= set(chars) ^ set(regex.findall(kind, everything))
        codes = np.array([ord(c) for c in chars])
        first = np.flatnonzero(np.diff(codes, prepend=-2) != 1)
        last = np.append(first[1:], len(codes)) - 1
        classes.append("".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(codes[first], codes[last])))
    return classes[0], classes[1], "".join(sorted(odd))


class Splitter:
    """Matches of the tokenizers' pattern, as the tiktoken library finds them."""

    def __init__(self, letters: str, numbers: str, odd: str):
        pattern = public_tokenizers.PATTERN
        self.plain, self.odd = regex.compile(pattern), frozenset(odd)
        # the same over ASCII, for the faster library
        narrow = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.ascii = re.compile(narrow.replace(r"\s", r"[\t-\r ]").replace(r"\S", r"[^\t-\r ]"))
        inside = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]")
        self.exact = regex.compile(inside.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]"))

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text)
        return (self.plain if self.odd.isdisjoint(text) else self.exact).findall(text)


class Encoder:
    """Tokens of texts as packed little-endian unsigned 32-bit ids."""

    def __init__(self, ranks: dict[bytes, int], classes: tuple[str, str, str]):
        self.replay, self.split, self.known, self.again = Replay(ranks), Splitter(*classes), {}, set()

    def learn(self, pieces: set[str]) -> None:
        rest = []
        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            whole = self.replay.pairs.ranks.get(raw)
            if whole is None:
                rest.append((piece, raw))
            else:
                self.known[piece] = whole.to_bytes(4, "little")
        rest.sort()
        for start in range(0, len(rest), REPLAYED):
            part = rest[start:start + REPLAYED]
            for (piece, _), ids in zip(part, self.replay.merge([raw for _, raw in part])):
                self.known[piece] = np.array(ids, dtype="<u4").tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [self.split(t or "") for t in texts]
        pieces = set().union(*split)
        new = pieces.difference(self.known)
        self.again |= pieces - new
        if len(self.known) + len(new) > REMEMBERED:
            # what came again stays, unless that is too much as well; this buffer's pieces are needed in any case
            kept = self.again if 2 * len(self.again) < REMEMBERED else pieces - new
            self.known, self.again = {p: self.known[p] for p in kept}, set()
        self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, found)) for found in split]


@lru_cache(maxsize=1)
def encoder(path: str, classes: tuple[str, str, str]) -> Encoder:
    """One encoder for all tasks of a process, with what it remembers."""
    return Encoder(load_ranks(path), classes)


def _buffers(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about BUFFER_BYTES in a column, a longer value in a slice of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        reach = (ends[start - 1] if start else 0) + BUFFER_BYTES
        stop = max(start + 1, int(np.searchsorted(ends, reach, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _appended(df: DataFrame, source: str, results: list[str], make, dropped: tuple[str, ...] = ()) -> DataFrame:
    """df with binary columns made from another by buffers; make() gives the function of a task, which gives one list a result."""
    kept = [c for c in df.columns if c.lower() not in {r.lower() for r in (*results, *dropped)}]
    given = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias("__source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = make()
        for batch in batches:
            for part in _buffers(batch, len(kept)):
                values = [pa.array(v, pa.binary()) for v in convert(part.column(len(kept)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], *values], names=[*kept, *results])

    schema = given.select(*[F.col(f"`{c}`") for c in kept], *[F.lit(None).cast("binary").alias(r) for r in results]).schema
    return given.mapInArrow(run, schema)


def _decoder(path: str):
    get = {i: t for t, i in load_ranks(path).items()}.__getitem__
    return lambda packed: [None if p is None else b"".join(map(get, np.frombuffer(p, "<u4").tolist())) for p in packed]


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, decoded: str | None = None, keep_text: bool = True) -> DataFrame:
    """df with the token ids of a text column, packed as little-endian unsigned 32-bit integers.

    decoded names a further column for the bytes that these ids stand for, decoded in the same pass. Without keep_text the
    text column goes.
    """
    path, classes = path or public_tokenizers.path(VOCABULARY), unicode_classes()

    def make():
        encode_texts, decode_ids = encoder(path, classes), _decoder(path) if decoded else None

        def convert(texts):
            packed = encode_texts(texts)
            return [packed, decode_ids(packed)] if decoded else [packed]

        return convert

    return _appended(df, text, [ids, decoded] if decoded else [ids], make, () if keep_text else (text,))


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the bytes that packed token ids stand for."""
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        decode_ids = _decoder(path)
        return lambda packed: [decode_ids(packed)]

    return _appended(df, ids, [decoded], make)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded", keep_text=False)
    return docs.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
