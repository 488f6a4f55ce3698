"""Best-fit packing of tokenised documents into sequences of fixed length, certified by lower bounds.

Each document becomes its token ids and an end id. Only longer documents are cut, into pieces of the sequence length
(the last may be shorter). Pieces are dealt evenly into partitions of bounded size; each is packed best-fit decreasing,
and dual feasible functions give a lower bound on the sequences it needs. A partition at its bound is done. Partitions
with a gap give the pieces of their loosely filled sequences to a common pool, which is dealt anew and packed again; the
new packing is taken if it needs fewer sequences, and the rounds end when it does not.

Defined results: a null or empty text is the end id alone. Every row is packed by itself, so repeated rows and ids are
kept. A null id stays null; ids are whole numbers. A text of any length is tokenised whole. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remembers, text_batches, work_of

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Pieces in a partition: what one task packs.
PART = 20_000
#: Words, and parts of words, that a worker remembers the ids of.
REMEMBERED = 500_000
#: Letters under this one have one form only, in either case.
LATIN_END = "\u0250"
#: Marks that are one part together; the apostrophe may begin an ending of its own.
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'

_loaded: dict[str, WordEncoder] = {}
remembers("packing", _loaded.clear)


class WordEncoder:
    """Ids of texts for a tokenizer that lower-cases, drops white space and never joins letters with other characters.

    Spaces and line ends part words, and a word of letters with a mark behind it is parted there, so that each word and
    each run of letters is encoded once and then remembered. The result is that of encoding the whole text; what is not
    of that simple form is left to the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.parts = Tokenizer.from_file(path), {}, {}
        self.pieces = self.tokenizer.model.tokenize
        shown = [b for b in range(256) if chr(b).isprintable() and chr(b) not in " \xa0\xad"]  # byte-level BPE shows a byte as itself
        hidden = [b for b in range(256) if b not in set(shown)]  # ... or as a letter from 256 on
        self.as_letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    @staticmethod
    def split(word: str) -> tuple[str, ...]:
        """Parts whose ids, joined, are the word's: lower-cased letters and the marks behind them, else the word."""
        low = word.lower()
        head = low.rstrip(MARKS)
        if head.isalpha() and (head.isascii() or max(head) < LATIN_END):
            return (head,) if len(head) == len(low) else (head, low[len(head) :])
        return (word,)

    def _ids(self, part: str) -> bytes:
        """A part of letters needs no normaliser or splitting and goes straight to the BPE model."""
        if part.isalpha() and part.islower() and (part.isascii() or max(part) < LATIN_END):
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.as_letters)
            return array("I", [p.id for p in self.pieces(shown)]).tobytes()
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        known, parts = self.known, self.parts
        for word in set().union(*words).difference(known):
            ids = b""
            for p in self.split(word):
                if p not in parts:
                    parts[p] = self._ids(p)
                ids += parts[p]
            known[word] = ids
        return [np.frombuffer(b"".join(map(known.__getitem__, ws)), "<u4") for ws in words]


def tokenise(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """Rows of PIECES."""
    text_batches(docs.sparkSession)

    @work_of("packing")
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder.of(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"], encoder.encode(batch["text"].tolist()), strict=True):
                ids = np.concatenate([ids, end])
                rows += [(doc, i, s, len(p := ids[s : s + size]), zlib.crc32(p.tobytes())) for i, s in enumerate(range(0, len(ids), size))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInPandas(pieces, PIECES)


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, room left in the sequence) of each piece. A bit set of the rooms that occur finds the tightest."""
    sequence, offset, room = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8"), []
    open_by_room: list[list[int]] = [[] for _ in range(size + 1)]
    occurs = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = occurs >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            s = open_by_room[r].pop()
            if not open_by_room[r]:
                occurs ^= 1 << r
        else:
            r, s = size, len(room)
            room.append(size)
        sequence[i], offset[i], room[s] = s, size - r, r - n
        if r > n:
            open_by_room[r - n].append(s)
            occurs |= 1 << (r - n)
    return sequence, offset, np.array(room, "i8")[sequence] if room else offset


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Sequences needed at least: the largest of two families of dual feasible functions.

    Threshold a: pieces over size - a count whole, those under a not at all. Rounding k: a piece counts
    floor((k + 1) x / size) / k, or x / size where (k + 1) x / size is whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype("i8")
    total = np.concatenate([[0], np.cumsum(count)])  # of lengths under i
    mass = np.concatenate([[0], np.cumsum(count * np.arange(size + 1))])
    a = np.arange(1, size // 2 + 1)
    whole = total[size + 1] - total[size - a + 1]
    part = mass[size - a + 1] - mass[a]
    best = int((whole + -(-part // size)).max())
    x = np.arange(size + 1)
    for k in range(1, 33):
        exact = (k + 1) * x % size == 0
        value = np.where(exact, x * k, (k + 1) * x // size * size)  # times k * size
        best = max(best, -(-int((value * count).sum()) // (k * size)))
    return max(best, -(-int(mass[-1]) // size))


def _packer(size: int, number: int):
    """Packs one partition; adds sequence_id, offset, room, gap (sequences over the bound)."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        lengths = part["length"].to_numpy("i8")
        sequence, offset, room = best_fit_decreasing(lengths, size)
        gap = int(sequence.max()) + 1 - lower_bound(lengths, size)
        base = (number << 58) + (int(part["_part"].iloc[0]) << 24)
        return part.drop(columns="_part").assign(doc_id=part["doc_id"].astype("Int64"), sequence_id=base + sequence, offset=offset, room=room, gap=gap)

    return pack


PACKED = PIECES + ", sequence_id bigint, offset bigint, room bigint, gap bigint"


def _pack_round(pieces: DataFrame, size: int, number: int, part: int) -> DataFrame:
    """``pieces`` is a written table, so that rows keep their numbers. Rows are dealt in turn, by no key."""
    parts = max(1, -(-pieces.count() // part))
    dealt = pieces.withColumn("_part", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(parts)))
    return cut(dealt.groupBy("_part").applyInPandas(_packer(size, number), PACKED), f"packed{number}")


def pack(pieces: DataFrame, *, size: int = 2048, part: int = PART, rounds: int = 4, loose: int | None = None) -> DataFrame:
    """PACKED rows for rows of PIECES. Sequences with less than ``loose`` free places (by default size / 64) stay in their
    partition. Partitions with a gap are packed anew together up to ``rounds`` - 1 times, or until that saves no sequence;
    what is open then keeps its last packing, whose column gap says by how many sequences it may exceed the bound."""
    columns, loose = pieces.columns, max(1, size // 64) if loose is None else loose
    done, pool, n = None, _pack_round(cut(pieces, "pieces"), size, 0, part), 0
    while True:
        open_ = (F.col("gap") > 0) & (F.col("room") >= loose)
        kept, pool = pool.filter(~open_), cut(pool.filter(open_), "pool")
        done = kept if done is None else done.unionByName(kept)
        n += 1
        before = pool.filter(F.col("offset") == 0).count()
        if n >= rounds or not before:
            return done.unionByName(pool)
        again = _pack_round(pool.select(*columns), size, n, part)
        if again.filter(F.col("offset") == 0).count() >= before:
            return done.unionByName(pool)
        pool = again
