"""Best-fit packing of tokenised documents into sequences of fixed length.

Texts become token ids, with an end id behind each document; documents longer than a sequence are cut
into full pieces and a rest. Pieces arrive in blocks, longest first, and go to the open bin with the
least free space that still holds them. The open bins of a task are a fixed number, in a bitset keyed
by free space; if none fits and the number is reached, the fullest closes. A task packs
`tokens_per_task` tokens, so its last open bins are a vanishing share at every size.

Defined results: a null or empty text is the end id alone; repeated rows are documents of their own; a
null id is kept; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwave.llm.common import Work

# Below this code point texts need no composition and lower-case sign by sign.
PLAIN_LIMIT = 0x0130
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
# The rules of the word vocabulary, which `WordIds` follows by itself. Any other file goes by its own tokenizer.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def word_rules(own) -> bool:
    """Whether a tokenizer has the normaliser, split rule, byte signs and special strings of the word vocabulary."""
    shown = json.loads(own.to_str())
    split, signs = (((shown["pre_tokenizer"] or {}).get("pretokenizers") or []) + [{}, {}])[:2]
    return (shown["normalizer"] == NORMALIZER and split.get("pattern") == {"Regex": SPLIT} and split.get("invert") is True and split.get("behavior") == "Removed"
            and signs.get("type") == "ByteLevel" and not signs.get("add_prefix_space") and signs.get("use_regex") is False
            and {t["content"] for t in shown["added_tokens"]} == set(SPECIAL))


def plain_pattern() -> re.Pattern:
    """The word vocabulary's split rule for signs below the limit: contractions, letter runs, single digits, other runs."""
    signs = [chr(i) for i in range(PLAIN_LIMIT)]
    letters = "".join(re.escape(c) for c in signs if unicodedata.category(c)[0] == "L")
    digits = "".join(c for c in signs if unicodedata.category(c)[0] == "N")
    spaces = "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+")


def byte_signs() -> list[str]:
    """The sign that stands for each byte in the vocabulary: printable Latin-1 as it is, others from 256 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(i if i in printable else next(others)) for i in range(256)]


class WordCache(dict):
    """Little-endian 32-bit ids of words; a word is encoded when it is first met."""

    def __init__(self, model, most: int):
        super().__init__()
        self.model, self.most, self.signs = model, most, byte_signs()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        shown = "".join(map(self.signs.__getitem__, word.encode()))
        self[word] = ids = np.array([t.id for t in self.model.tokenize(shown)], dtype="<u4").tobytes()
        return ids


class WordIds:
    """Ids of texts as little-endian 32-bit bytes; under the lower-casing word vocabulary each distinct word is encoded once."""

    def __init__(self, path: str, words: int = 400_000):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.by_word, self.cache = word_rules(self.own), WordCache(self.own.model, words)
        self.pattern, self.other = plain_pattern(), re.compile(f"[^\x00-{chr(PLAIN_LIMIT - 1)}]")

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if not self.by_word or self.other.search(text) or SPECIAL[0] in text or SPECIAL[1] in text:
                yield np.array(self.own.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                yield b"".join(map(self.cache.__getitem__, self.pattern.findall(text.lower())))


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, if asked for, ids) of every text, in the order of the table."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    closing = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = WordIds(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[list] = [[], [], [], [], [], []]
                for row, raw in enumerate(encode([x or "" for x in part.column(1).to_pylist()])):
                    raw += closing
                    for i, start in enumerate(range(0, len(raw), 4 * length)):
                        cut = raw[start:start + 4 * length]
                        for column, value in zip(rows, (row, i, start // 4, len(cut) // 4, zlib.crc32(cut), cut if ids else None), strict=True):
                            column.append(value)
                columns = [part.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32())]
                columns += [pa.array(c, pa.int64()) for c in rows[2:5]] + ([pa.array(rows[5], pa.binary())] if ids else [])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


class OpenBins:
    """Bounded-space best fit: bins keyed by free space, the set of free spaces as bits of one integer."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.by_free: dict[int, list[int]] = {}
        self.bits, self.open, self.made = 0, 0, 0

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        number = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, need: int) -> tuple[int, int]:
        """(bin, offset) for a piece of `need` tokens."""
        fitting = self.bits >> need
        if fitting:
            free = (fitting & -fitting).bit_length() - 1 + need
            number = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.size, self.made
            self.made += 1
        if free > need:
            self.by_free.setdefault(free - need, []).append(number)
            self.bits |= 1 << (free - need)
            self.open += 1
        return number, self.size - free


def best_fit(pieces: DataFrame, size: str = "length", capacity: int = 2048, open_bins: int = 4096, block: int = 4096) -> DataFrame:
    """Adds sequence_id and offset, packing each partition in its order; sizes are from 1 to the capacity."""
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, task = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                needs = part.column(size).to_numpy(zero_copy_only=False)
                placed = np.empty((len(needs), 2), dtype=np.int64)
                for row in np.argsort(-needs, kind="stable").tolist():
                    placed[row] = bins.place(int(needs[row]))
                yield part.append_column("sequence_id", pa.array(placed[:, 0] + task)).append_column("offset", pa.array(placed[:, 1]))

    return pieces.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, key: str = "doc_id", text: str = "text", ids: bool = False,
         tokens_per_task: int = 64 << 20, open_bins: int = 4096) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    The pieces are written once; one scalar, the sum of their lengths, decides into how many tasks they
    are dealt, evenly whatever their keys, and in an order that a repeated task finds again.
    """
    work = Work(docs.sparkSession, "packing")
    pieces = work.save(token_pieces(docs, tokenizer, length, key=key, text=text, ids=ids), "pieces")
    total = pieces.agg(F.sum("length").alias("n")).first()["n"] or 0
    dealt = pieces.repartition(max(1, round(total / tokens_per_task)))
    ordered = dealt.sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "length", "ids_crc32")
    return best_fit(ordered, capacity=length, open_bins=open_bins)
