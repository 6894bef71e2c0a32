"""Order-preserving packing of tokenized documents by dynamic programming.

Each task streams the documents of its partition in their order and cuts the stream into windows of at
most 2048 tokens. Cuts are allowed at ends of documents and sentences and, at a higher penalty, every
16 tokens within a sentence; the dynamic programme over the cut points minimises padding plus a penalty for cutting a
document, with a monotone queue for the window minimum, over buffers of BUFFER_SEQUENCES sequences. The
last, open window of a buffer goes on in the next. What remains at the end of a partition is cut into
powers of two, which need no padding.

Null or empty text is its closing id alone. Repeated rows are packed like any other, in the order met.
An empty table gives no pieces. Further columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm.common import table

LENGTH = 2048
CLOSING_ID = 1
BUFFER_SEQUENCES = 64
SENTENCE_PENALTY = 8
WORD_PENALTY = 24
#: Only a sentence of more than so many tokens can be cut within, after every so many of its tokens.
LONG_SENTENCE, WORD_STEP = 64, 16
SENTENCE_ENDS = (".", "!", "?", "...")
_PIECES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def choose_cuts(points: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> list[int]:
    """Cheapest increasing cuts among points (the last is always one), windows at most length wide."""
    places = [0, *points.tolist()]
    # least cost up to each place, with the place itself added: the padding of a window then needs no difference
    keys, back = [0] * len(places), [0] * len(places)
    queue: deque[int] = deque([0])
    for i, penalty in enumerate(penalties.tolist(), 1):
        reach = places[i] - length
        while places[queue[0]] < reach:
            queue.popleft()
        back[i] = queue[0]
        keys[i] = key = keys[queue[0]] + length + penalty
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(i)
    cuts, i = [], len(places) - 1
    while i:
        cuts.append(places[i])
        i = back[i]
    return cuts[::-1]


def _points(parts: list[tuple], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut points of a buffer of (doc_id, ids, start, total) and their penalties; ends tells of each id whether it ends a sentence."""
    points, penalties, at = [], [], 0
    for _, ids, _, _ in parts:
        inner = np.flatnonzero(ends[ids[:-1]]) + 1
        bounds = np.concatenate([[0], inner, [len(ids)]])
        wide = np.flatnonzero(np.diff(bounds) > LONG_SENTENCE)
        if len(wide):
            steps = np.concatenate([np.arange(bounds[k] + WORD_STEP, bounds[k + 1], WORD_STEP) for k in wide])
            inner, step = np.concatenate([inner, steps]), np.repeat([SENTENCE_PENALTY, WORD_PENALTY], [len(inner), len(steps)])
            order = np.argsort(inner, kind="stable")
            inner, step = inner[order], step[order]
        else:
            step = np.full(len(inner), SENTENCE_PENALTY)
        points += [inner + at, [at + len(ids)]]
        penalties += [step, [0]]
        at += len(ids)
    return np.concatenate(points), np.concatenate(penalties)


def _binary(total: int) -> list[int]:
    """Cuts of a remainder into powers of two, the largest first."""
    cuts, at = [], 0
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        cuts.append(at)
    return cuts


class Merges:
    """Byte-pair merges of many words at once: in every round each word merges its pair of least rank, leftmost first."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, vocabulary: dict[str, int], merges: list):
        shown = [n for n in range(256) if 33 <= n <= 126 or 161 <= n <= 172 or n >= 174]
        letters = {n: chr(n) for n in shown} | {n: chr(256 + i) for i, n in enumerate(n for n in range(256) if n not in shown)}
        self.inner = np.array([vocabulary[letters[n]] for n in range(256)], dtype=np.int32)
        self.final = np.array([vocabulary[letters[n] + "</w>"] for n in range(256)], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int32)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], dtype=np.int64)
        self.levels, rest = [], np.arange(len(keys))
        while len(rest):  # a few hash tables, each for the pairs that met a taken slot in the one before
            factor = np.int64(0x9E3779B97F4A7C15 - 2**64 + 2 * 7919 * len(self.levels))
            slots = self._slots(keys[rest], factor)
            chosen = rest[np.unique(slots, return_index=True)[1]]
            held, ranks = np.full(1 << 20, -1, dtype=np.int64), np.full(1 << 20, self.NONE, dtype=np.int32)
            at = self._slots(keys[chosen], factor)
            held[at], ranks[at] = keys[chosen], chosen
            self.levels.append((factor, held, ranks))
            rest = np.setdiff1d(rest, chosen)

    @staticmethod
    def _slots(keys: np.ndarray, factor: np.int64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * factor).view(np.uint64) >> np.uint64(44)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        found = np.full(len(keys), self.NONE, dtype=np.int32)
        for factor, held, ranks in self.levels:
            slots = self._slots(keys, factor)
            hit = held[slots] == keys
            found[hit] = ranks[slots[hit]]
        return found

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in order and their number per word; a word goes from its start to the next."""
        word = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(symbols))))
        rank = np.append(self.ranks(symbols[:-1], symbols[1:]), self.NONE)
        rank[starts[1:] - 1] = self.NONE
        done = []
        while len(symbols):
            sizes = np.diff(np.append(starts, len(symbols)))
            best = np.minimum.reduceat(rank, starts)
            live = best < self.NONE
            if not live.all():
                every = np.repeat(live, sizes)
                done.append((word[~every], symbols[~every]))
                word, symbols, rank, sizes, best = word[every], symbols[every], rank[every], sizes[live], best[live]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])]
            symbols[at] = self.merged[best]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            word, symbols, rank = word[keep], symbols[keep], rank[keep]
            at -= np.arange(len(at))
            starts = np.cumsum(sizes - 1) - (sizes - 1)
            for left in (at, at[at > starts] - 1):
                right = np.minimum(left + 1, len(symbols) - 1)
                rank[left] = np.where((word[right] == word[left]) & (right > left), self.ranks(symbols[left], symbols[right]), self.NONE)
        word, symbols = (np.concatenate(c) for c in zip(*done)) if done else (word, symbols)
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=0)


class Encoder:
    """Ids of whole texts, exactly as the tokenizer gives them.

    No token of this tokenizer crosses a blank, so a text's ids are those of its pieces between ASCII blanks. Arrow
    numbers the pieces of a batch; the distinct ones are tokenized together by Merges. Pieces of more than LONG
    bytes, or with characters other than Latin letters, digits and ASCII signs, are left to the tokenizer itself, as
    are texts with its special tokens and all texts where the tokenizer's file has other rules. Nothing is kept from
    batch to batch.
    """

    BATCH_CHARS, LONG = 4 << 20, 64
    LETTER, DIGIT, SIGN = 1, 2, 3
    #: Fixed value: how words part in the tokenizer's file whose rules Merges follows.
    SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for w in SENTENCE_ENDS if (i := self.tokenizer.token_to_id(f"{w}</w>")) is not None]] = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        known = [spec["normalizer"] and [n["type"] for n in spec["normalizer"].get("normalizers", [])],
                 spec["pre_tokenizer"] and [p.get("pattern", {}).get("Regex", p["type"]) for p in spec["pre_tokenizer"].get("pretokenizers", [])],
                 model["type"], model.get("end_of_word_suffix"), model.get("dropout"), model.get("ignore_merges")]
        as_known = known == [["NFC", "Replace", "Lowercase"], [self.SPLIT, "ByteLevel"], "BPE", "</w>", None, False]
        self.merges = Merges(model["vocab"], model["merges"]) if as_known else None
        kinds = np.zeros(256, dtype=np.uint8)
        kinds[[n for n in range(33, 127) if n != 39]] = self.SIGN
        kinds[[n for n in range(128) if chr(n).isalpha()] + [0xC3]] = self.LETTER
        kinds[48:58] = self.DIGIT
        self.kinds, self.lower = kinds, np.array([n + 32 if 65 <= n <= 90 else n for n in range(256)], dtype=np.uint8)

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _values(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and their number per piece."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset:pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        sizes = np.diff(offsets)
        kinds, low = self.kinds[data], self.lower[data]
        latin = np.append(False, data[:-1] == 0xC3) & (data != 0x97) & (data != 0xB7)
        kinds[latin] = self.LETTER
        low[latin & (data <= 0x9E)] += 0x20
        strange = np.append(0, np.cumsum(kinds == 0))
        plain = (strange[offsets[1:]] == strange[offsets[:-1]]) & (sizes <= self.LONG) & (self.merges is not None)
        counts, flat = np.zeros(len(pieces), dtype=np.int64), []
        taken = np.repeat(plain, sizes)
        if taken.any():
            first = np.zeros(len(data) + 1, dtype=bool)
            first[offsets] = True
            first = first[:-1][taken]
            kinds, low = kinds[taken], low[taken]
            first |= np.append(True, kinds[1:] != kinds[:-1]) | (kinds == self.DIGIT)
            starts = np.flatnonzero(first)
            symbols = self.merges.inner[low]
            finals = np.append(starts[1:], len(low)) - 1
            symbols[finals] = self.merges.final[low[finals]]
            ids, numbers = self.merges.merge(symbols, starts)
            owner = np.repeat(np.arange(len(pieces)), sizes)[taken][starts]
            counts += np.bincount(owner, numbers, len(pieces)).astype(np.int64)
            flat.append(ids)
        rest = np.flatnonzero(~plain)
        if len(rest):
            found = self._alone(pieces.take(pa.array(rest)).to_pylist())
            counts[rest] = [len(f) for f in found]
            flat += found
        place = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), dtype=np.int32)
        order = np.append(np.flatnonzero(plain), rest)
        some = counts[order]
        out[np.repeat(place[order] - (np.cumsum(some) - some), some) + np.arange(len(out))] = np.concatenate(flat) if flat else []
        return out, counts

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        numbered = split.flatten().dictionary_encode()
        flat, sizes = self._values(numbered.dictionary)
        starts, at = np.cumsum(sizes) - sizes, numbered.indices.to_numpy()
        counts = sizes[at]
        ends = np.append(0, np.cumsum(counts))
        ids = flat[np.repeat(starts[at] - ends[:-1], counts) + np.arange(ends[-1])].astype(np.uint32)
        bounds = ends[split.offsets.to_numpy()].tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield np.append(ids[a:b], np.uint32(CLOSING_ID))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text and the closing id."""
        held, size = [], 0
        for text in texts:
            special = "<|" in text
            if held and (special or size + len(text) > self.BATCH_CHARS):
                yield from self._encode(held)
                held, size = [], 0
            if special:
                yield np.append(self._alone([text])[0].astype(np.uint32), np.uint32(CLOSING_ID))
            else:
                held.append(text)
                size += len(text)
        if held:
            yield from self._encode(held)


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> Encoder:
    """The encoder of this worker process, for all tasks that the worker runs."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


class Packer:
    def __init__(self, first_sequence: int, ends: np.ndarray):
        self.sequence, self.ends, self.parts, self.held = first_sequence, ends, [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.parts.append((doc_id, ids, 0, len(ids)))
        self.held += len(ids)

    def drain(self, final: bool) -> list[tuple]:
        if not self.held:
            return []
        cuts = choose_cuts(*_points(self.parts, self.ends))
        if final:
            start = cuts[-2] if len(cuts) > 1 else 0
            cuts = cuts[:-1] + [start + c for c in _binary(self.held - start)]
        else:
            cuts = cuts[:-1]
        rows, rest, offset, at, k = [], [], 0, 0, 0
        for doc_id, ids, start, total in self.parts:
            used = 0
            while used < len(ids) and k < len(cuts):
                take = min(len(ids) - used, cuts[k] - at)
                piece = ids[used:used + take]
                rows.append((doc_id, start + used, take, zlib.crc32(piece.astype("<u4").tobytes()), total, self.sequence, offset))
                used, at, offset = used + take, at + take, offset + take
                if at == cuts[k]:
                    k, offset, self.sequence = k + 1, 0, self.sequence + 1
            if used < len(ids):
                rest.append((doc_id, ids[used:], start + used, total))
        self.parts, self.held = rest, sum(len(p[1]) for p in rest)
        return rows


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_PIECES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(_PIECES))


def pack(docs: DataFrame, tokenizer: str | None = None, release: bool = False) -> DataFrame:
    """One row per piece; a sequence belongs to one partition, whose number is in the high bits of its id.

    With release a task gives its encoder (65 MB) back at its end, for workers that go on to other work.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 40, encoder.ends)
        for batch in batches:
            texts, rows = ["" if t is None else t for t in batch.column(1).to_pylist()], []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
                packer.add(doc_id, ids)
                if packer.held > BUFFER_SEQUENCES * LENGTH:
                    rows += packer.drain(False)
            yield _pieces(rows)
        yield _pieces(packer.drain(True))
        if release:
            shared_encoder.cache_clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{c} long" for c in _PIECES))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
