"""Token counts by byte-pair merging with a heap and a linked list; no token ids are made.

A text is cut into units that the tokenizer treats alone (a run of other characters with the one space before it, or
white space). The vocabulary's own pre-tokenizer splits a unit into pieces; for each piece the adjacent pair of
lowest rank is popped from a heap again and again, and the count is the number of initial symbols less the merges.
Counts of short units and pieces are remembered, at most ``remember`` of each, so a frequent word is merged once per worker.

Defined results: NULL counts as empty text (0 bytes, 0 tokens). Every row is counted by itself, so repeated rows, ties
and NULL ids need no rule, and an empty table gives an empty result. A special string inside a text is one token, as
in the library's default. Units of any length work: merging n symbols takes n log n steps.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.llm.common import bounded_batches, worker_state

#: Unicode's White_Space; Python's own class also has four control characters.
SPACE = "\t-\r \x85\xa0  -     　"
UNITS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


#: The vocabulary's own pattern for the pieces of a unit. Up to LATIN_END the regex module and the tokenizers library
#: know the same letters; beyond, their Unicode versions differ and the library is asked.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
LATIN_END = "\u0250"
PLACE = (1 << 40) - 1


def merged_length(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> int:
    """Number of symbols left when no adjacent pair has a rank.

    ``ranks`` has the rank of a pair under ``first << 32 | second``, ``merged`` the symbol that a rank makes. A heap
    entry is a rank and the place of the pair's first symbol in one number, so equal ranks come from left to right.
    """
    n = left = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = ranks.get
    heap = [r << 40 | i for i in range(n - 1) if (r := rank(symbols[i] << 32 | symbols[i + 1])) is not None]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i, r = entry & PLACE, entry >> 40
        j = after[i]
        if j >= n or rank(symbols[i] << 32 | symbols[j]) != r:
            continue  # one of the two was merged meanwhile
        symbols[i] = symbol = merged[r]
        symbols[j] = -1
        after[i] = k = after[j]
        after[j] = n
        left -= 1
        if k < n:
            before[k] = i
            if (r := rank(symbol << 32 | symbols[k])) is not None:
                heappush(heap, r << 40 | i)
        if (h := before[i]) >= 0 and (r := rank(symbols[h] << 32 | symbol)) is not None:
            heappush(heap, r << 40 | h)
    return left


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def counter(path: str, remember: int = 400_000) -> Callable[[str], int]:
    """A function from a text to its number of tokens, for a byte-level vocabulary file of the tokenizers library."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    number = spec["model"]["vocab"]
    ranks = {number[a] << 32 | number[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
    merged = [number[a + b] for a, b in pairs]
    letter = byte_letters()
    start = [number[letter[b]] for b in range(256)]
    symbol_of = {letter[b]: number[letter[b]] for b in range(256)}
    special = [t["content"] for t in spec["added_tokens"]]
    cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
    library = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    units: dict[str, int] = {}
    known: dict[str, int] = {}

    def piece_count(piece: str) -> int:
        if (n := known.get(piece)) is None:
            n = merged_length([start[b] for b in piece.encode()], ranks, merged)
            if len(piece) <= 64:
                if len(known) >= remember:
                    known.clear()
                known[piece] = n
        return n

    def unit_count(unit: str) -> int:
        if max(unit) < LATIN_END:
            n = sum(map(piece_count, PIECES.findall(unit)))
        else:
            n = sum(merged_length([symbol_of[c] for c in piece], ranks, merged) for piece, _ in library(unit))
        if len(unit) <= 64:
            if len(units) >= remember:
                units.clear()
            units[unit] = n
        return n

    def plain(text: str) -> int:
        get = units.get
        return sum(n if (n := get(u)) is not None else unit_count(u) for u in UNITS.findall(text))

    def count(text: str) -> int:
        if cut is None or not cut.search(text):
            return plain(text)
        parts = cut.split(text)
        return len(parts) - 1 + sum(map(plain, parts))

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row of ``docs``."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("bigint")
    def n_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = worker_state(f"counter {path}", lambda: counter(path))
        for batch in texts:
            yield pd.Series([count(t) for t in batch], dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), n_tokens(text).alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit)
