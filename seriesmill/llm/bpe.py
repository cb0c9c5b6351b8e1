"""Token counts by byte-pair merging, without making tokens.

A text is split at the vocabulary's special strings (one token each) and then into words by the
byte-level pattern. A word of n bytes starts as n symbols in a linked list; a heap holds the
adjacent pairs that the vocabulary merges, lowest rank first, leftmost first among equals. Each
pop merges one pair. The word has n minus merges tokens; identifiers are never looked up.

Words repeat, so each task keeps the counts of words it has met, up to `MEMO_WORDS` of them.
Scale: a scan with one vectorised function, no shuffle; a text is one row, and its words are
counted one at a time, so a very long text or word needs memory in proportion to itself.

Defined results: null is the empty text and has no tokens; rows are counted one by one, repeated
ids and texts included; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import named

OVER_LIMIT = 512
MEMO_WORDS = 300_000

#: Fixed by the vocabulary format: the words of byte-level splitting.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the other bytes for 256, 257, ...
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def merges_of(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges a word takes."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    symbols = [*symbols, ""]
    heap = [(rank, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        merges += 1
        symbols[i], symbols[j] = left + right, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
    return merges


class WordCounts(dict):
    """Tokens of each word met so far."""

    def __init__(self, ranks):
        self.ranks, self.symbols = ranks, byte_symbols()

    def __missing__(self, word: str) -> int:
        symbols = [self.symbols[b] for b in word.encode()]
        count = len(symbols) - merges_of(symbols, self.ranks)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = count
        return count


class Counter:
    """Counts the tokens of texts by a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        merges = vocabulary["model"]["merges"]
        pairs = (tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in merges)
        self.counts = WordCounts({pair: rank for rank, pair in enumerate(pairs)})
        self.words = regex.compile(WORDS)
        special = sorted((x["content"] for x in vocabulary["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        counts, words = self.counts, self.words
        return len(parts) - 1 + sum(counts[m.group()] for part in parts for m in words.finditer(part))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of a text. The file is read in each task: from `path`, or as installed there."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = Counter(path or vocabulary_path())
        for texts in batches:
            yield pd.Series([tokens(x) for x in texts], dtype="int64")

    return count(text)


def token_counts(docs: DataFrame, id_col="doc_id", text_col="text", limit: int = OVER_LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    text = named(text_col)
    counted = docs.select(
        named(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(text, path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
