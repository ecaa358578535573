"""Packing: documents cut and laid into training sequences of balanced attention cost."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import held

#: Cost of a piece of n tokens: LINEAR * n + n * n. The ratio of the two is that of a model 768 wide whose
#: layers take 24 * width**2 operations a token and 4 * width for each pair of tokens.
LINEAR = 6.0 * 768
#: The pattern by which byte-level tokenizer files cut a text before they merge; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space for which the pattern's look-ahead runs too deep for one of the two libraries.
LONG_SPACE = re.compile(r"\s{5000}").search


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids of byte strings under a tokenizer file's content, if they are also the ranks of its merges, else None.

    That is so for a plain byte-level BPE: no normalizer, no options, and merges that make the ids after the
    256 bytes in turn. Such files write a byte that has no printable character as one from code point 256 on.
    """
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not spec["normalizer"] and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"].get("".join(m)) != 256 + i for i, m in enumerate(pairs)) or len(model["vocab"]) != 256 + len(pairs):
        return None
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}


class TextEncoder:
    """Ids of whole texts by a tokenizer file, without special ones.

    The tokenizers library reads the file and encodes all texts under a file that is no plain byte-level BPE,
    texts that hold the string of a special token, and texts with very long white space. All others get the
    same ids from tiktoken over the file's own ranks, at a sixth of the time and without the library's strings
    and offsets of each token.
    """

    def __init__(self, file: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = byte_ranks(json.loads(self.tokenizer.to_str()))
        self.fast = ranks and tiktoken.Encoding(file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str, last: int) -> np.ndarray:
        """The text's ids and then the id last."""
        if not self.fast or any(s in text for s in self.special) or len(text) > 5000 and LONG_SPACE(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast(text)
        ids.append(last)
        return np.array(ids, dtype="<u4")


def pack_lengths(lengths: list[int], capacity: int, linear: float = LINEAR) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these token counts.

    Each full capacity of a document is a sequence of its own. The rests, longest first, go to the sequence of
    the lowest cost among those with room for them, in as many sequences as their sum needs; a rest that fits
    nowhere is cut to fill the roomiest one and goes on. So all but capacity - 1 tokens' room is used.
    Sequences are numbered from 0; ties go to the one with less room, then to the smaller number.
    """
    pieces, rests, n_seq = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((doc, start, capacity, n_seq, 0))
            n_seq += 1
        if n % capacity:
            rests.append((-(n % capacity), doc))
    rests.sort()
    bins = -(-sum(-n for n, _ in rests) // capacity)
    # sequences by the room that is left in them: heaps of (cost, sequence), and the cost on top of each
    rooms: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    rooms[capacity] = [(0.0, n_seq + i) for i in range(bins)]
    top = np.full(capacity + 1, np.inf)
    if bins:
        top[capacity] = 0.0

    def put(doc: int, start: int, n: int, room: int) -> None:
        cost, seq = heapq.heappop(rooms[room])
        top[room] = rooms[room][0][0] if rooms[room] else np.inf
        pieces.append((doc, start, n, seq, capacity - room))
        if room > n:
            heapq.heappush(rooms[room - n], (cost + linear * n + n * n, seq))
            top[room - n] = rooms[room - n][0][0]

    for neg, doc in rests:
        n, end = -neg, lengths[doc]
        while n:
            room = n + int(np.argmin(top[n:]))
            if top[room] == np.inf:  # nowhere whole
                room = int(np.flatnonzero(top < np.inf)[-1])
            part = min(n, room)
            put(doc, end - n, part, room)
            n -= part
    return pieces


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 1, capacity: int = 2048, window_tokens: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset (long) and ids (binary, little-endian uint32).

    A document's tokens are its text's ids without special ones, then end_id; a null or empty text has that one
    alone. Each lies in exactly one piece; start is the number before it in its document, offset its place in
    the sequence, gapless from 0. Sequences hold at most capacity tokens and are to be padded to it.

    Each task packs its rows as they come, in windows of about window_tokens tokens, each of which leaves less
    than one capacity of padding: no shuffle, and memory for one window, or for one document if that is longer.
    A sequence's id is the task's partition and a number there. Rows without an id are packed with a null
    doc_id; repeated rows are packed each; among documents of one length the earlier row goes first; an empty
    table gives no piece. Other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = held(("ids", tokenizer_file), lambda: TextEncoder(tokenizer_file)).encode, TaskContext.get().partitionId() << 33
        ids: list = []
        tokens: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, size
            pieces = pack_lengths([len(t) for t in tokens], capacity)
            for at in range(0, len(pieces), 512):
                part = pieces[at : at + 512]
                doc, start, length, seq, offset = (list(x) for x in zip(*part, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[d] for d in doc], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([len(tokens[d]) for d in doc], pa.int64()), pa.array([first + s for s in seq], pa.int64()), pa.array(offset, pa.int64()), pa.array([tokens[d][s : s + n].tobytes() for d, s, n, _, _ in part], pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )
            first += max((p[3] for p in pieces), default=-1) + 1
            ids.clear()
            tokens.clear()
            size = 0

        for batch in batches:
            for i, text in zip(*batch.columns, strict=True):
                ids.append(i.as_py())
                tokens.append(encode(text.as_py() or "", end_id))
                size += len(tokens[-1])
                if size >= window_tokens:
                    yield from flush()
        if tokens:
            yield from flush()

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
