"""The most similar of a few sequences for each chain, by the ratio of matching blocks: filter and verify.

The ratio is twice the letters in matching blocks over the letters of both. Blocks are found by the longest common substring
(the earliest of equal ones, in the chain first), then left and right of it in the same way. The letters two sequences
share, as multisets, bound the blocks from above, so the candidates of a chain are verified by falling bound, until the
bound is below the best ratio found.

Defined results: a null sequence counts as empty, and two empty ones are equal. Of equal ratios the query with the lower
index wins. Without queries no chain has a match. Letters outside ASCII count as one and the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Query sequences that are sent to every task.
QUERIES = 10_000
#: Matches of texts up to SHORT letters that a task keeps from batch to batch, about KNOWN of them.
SHORT, KNOWN = 32, 100_000


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common substring."""
    best, before = (0, 0, 0), np.zeros(len(a) + 1, "i4")
    for j, letter in enumerate(b.tolist()):
        here = np.zeros(len(a) + 1, "i4")
        here[1:] = np.where(a == letter, before[:-1] + 1, 0)
        end = int(here.argmax())
        size = int(here[end])
        if size and (size > best[2] or size == best[2] and end - size < best[0]):
            best = (end - size, j + 1 - size, size)
        before = here
    return best


def matching_letters(a: np.ndarray, b: np.ndarray) -> int:
    """Letters in the matching blocks of two arrays of bytes."""
    total, todo = 0, [(a, b)]
    while todo:
        a, b = todo.pop()
        if len(a) and len(b):
            i, j, size = _longest(a, b)
            if size:
                total += size
                todo += [(a[:i], b[:j]), (a[i + size :], b[j + size :])]
    return total


def ratio(matched: float, letters: float) -> float:
    return 2.0 * matched / letters if letters else 1.0


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("ascii", "replace"), "u1")


def most_similar(chains: DataFrame, queries: DataFrame) -> DataFrame:
    """chain, q_idx, ratio, bound (the match's upper bound), verified (candidates compared) for each chain (chain, fasta) and
    the queries (q_idx, query), of which there may be QUERIES at most."""
    asked = queries.select("q_idx", "query").limit(QUERIES + 1).collect()
    if len(asked) > QUERIES:
        raise ValueError(f"more than {QUERIES} query sequences")
    asked = sorted(((r["q_idx"], _bytes(r["query"])) for r in asked), key=lambda x: x[0])
    letters = np.array([np.bincount(q, minlength=256) for _, q in asked]).reshape(-1, 256)

    def match(text: str | None) -> tuple:
        chain = _bytes(text)
        shared = np.minimum(letters, np.bincount(chain, minlength=256)).sum(1)
        bounds = [ratio(s, len(chain) + len(q)) for s, (_, q) in zip(shared.tolist(), asked, strict=True)]
        best, verified = (-1.0, 0), 0
        for i in sorted(range(len(asked)), key=lambda i: (-bounds[i], i)):
            if bounds[i] < best[0]:
                break
            verified += 1
            r = ratio(matching_letters(chain, asked[i][1]), len(chain) + len(asked[i][1]))
            if r > best[0] or r == best[0] and i < best[1]:
                best = (r, i)
        return (asked[best[1]][0], best[0], bounds[best[1]], verified) if asked else (None,) * 4

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.float64(), pa.float64(), pa.int32())
        known: dict[str | None, tuple] = {}
        for batch in batches:
            texts = batch["fasta"].dictionary_encode(null_encoding="encode")
            if len(known) > KNOWN:
                known.clear()
            rows = []
            for text in texts.dictionary.to_pylist():  # each distinct text of a batch once
                row = known.get(text)
                if row is None:
                    row = match(text)
                    if len(text or "") <= SHORT:
                        known[text] = row
                rows.append(row)
            columns = zip(*rows) if rows else [()] * 4
            found = pa.RecordBatch.from_arrays([batch["chain"], *[pa.array(x, k).take(texts.indices) for x, k in zip(columns, kinds, strict=True)]], ["chain", "q_idx", "ratio", "bound", "verified"])
            yield found.filter(found["q_idx"].is_valid())

    kind = chains.schema["chain"].dataType.simpleString()
    return chains.select("chain", "fasta").mapInArrow(find, f"chain {kind}, q_idx int, ratio double, bound double, verified int")


def best_match(chains: DataFrame, queries: DataFrame) -> DataFrame:
    """chain, q_idx, ratio of the most similar query; chains equal to their match are left out."""
    return most_similar(chains, queries).filter(F.col("ratio") < 1).select("chain", "q_idx", "ratio")
