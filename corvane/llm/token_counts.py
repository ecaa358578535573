"""Token counts: how many pieces a SentencePiece BPE vocabulary makes of each text, without their identifiers."""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import held

#: Chunks whose counts a worker keeps at most, and the longest chunk it keeps.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48


class PieceCounter:
    """Counts by heap-and-linked-list merging over the vocabulary of a SentencePiece BPE model.

    The model file is only read for its pieces and scores. A vocabulary in which a space mark follows another
    character inside a piece is refused: only without one do chunks that start at spaces merge independently.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        pieces = {sp.id_to_piece(i).replace("▁", " "): -sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}
        if any(" " in p.lstrip(" ") or "\n" in p for p in pieces):
            raise ValueError("a piece of this vocabulary spans a space or a line end")
        self.rank = pieces
        self.byte_fallback = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        self.cache: dict[str, int] = {}
        #: Runs of spaces with the word after them; a line end is no part of any piece.
        self.chunks = re.compile(r" *[^ \n]+|\n| +").findall

    def merged(self, chunk: str) -> int:
        """Initial symbols less merges, where the pair of the lowest rank merges first, the leftmost among equals.

        A symbol outside the vocabulary counts as its UTF-8 bytes if the model falls back to bytes, else as one.
        """
        n, rank = len(chunk), self.rank
        end = list(range(1, n + 1))  # of the symbol that begins at an index; 0 once it has merged into the one before
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(chunk[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, stop = heapq.heappop(heap)
            right = end[left]
            if not right or right >= n or end[right] != stop:  # one of the two has merged meanwhile
                continue
            merges += 1
            end[left], end[right] = stop, 0
            if stop < n:
                before[stop] = left
                if (r := rank.get(chunk[left : end[stop]])) is not None:
                    heapq.heappush(heap, (r, left, end[stop]))
            if (b := before[left]) >= 0 and (r := rank.get(chunk[b:stop])) is not None:
                heapq.heappush(heap, (r, b, stop))
        count = n - merges
        if self.byte_fallback:
            at = 0
            while at < n:
                if end[at] == at + 1 and chunk[at] not in rank:
                    count += len(chunk[at].encode("utf-8", "surrogatepass")) - 1
                at = end[at]
        return count

    def count(self, text: str) -> int:
        """Pieces of the text, with the space that the model puts before it."""
        if not text:
            return 0
        cache, total = self.cache, 0
        for chunk in self.chunks(" " + text.replace("▁", " ")):
            if (k := cache.get(chunk)) is None:
                k = self.merged(chunk)
                if len(chunk) <= CACHE_CHARS:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[chunk] = k
            total += k
        return total


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """docs with n_bytes (long, UTF-8), n_tokens (long) and over_limit (n_tokens > limit).

    Counts are those of the SentencePiece library for the whole text, without begin or end tokens; names of
    special tokens inside a text are ordinary text. A null text counts as an empty one: 0 and 0. Rows stay as
    they are, repeated ones too; columns of docs that bear one of the new names are replaced.

    One pass without a shuffle. Each Python worker keeps counts of short chunks up to a fixed number of
    entries; a chunk without any space, of whatever length, costs n log n.
    """

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        count = held(("pieces", model_file), lambda: PieceCounter(model_file)).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": tokens(text)}).withColumn("over_limit", F.col("n_tokens") > limit)
