"""SentencePiece encoding and decoding: each distinct chunk is segmented once, its ids joined back by position."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import held

#: A block of documents ends after so many distinct chunks, characters or documents.
BLOCK_CHUNKS, BLOCK_CHARS, BLOCK_DOCS = 400_000, 32_000_000, 200_000
#: Chunks whose ids a task keeps at most while it segments; more begin anew, with the same results.
KEPT_CHUNKS = 500_000
#: Ids of one batch of documents.
BATCH_IDS = 250_000
#: The chunks of at most so many characters that the first documents of the first tasks hold most often have numbers of their own.
COMMON_CHUNKS, COMMON_CHARS, COMMON_DOCS, COMMON_TASKS = 200_000, 24, 1_000, 8


def processor(model_file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def chunk_ids(sp, chunks: list[str]) -> list[list[int]]:
    """Ids of chunks as they stand inside a text: each is encoded after a line end, which joins with nothing, and whose ids go."""
    begin = len(sp.encode("\n"))
    return [ids[begin:] for ids in sp.encode(["\n" + c for c in chunks], num_threads=1)]


def check_pieces(model_file: str) -> None:
    """Raises ValueError where chunks aren't independent: pieces that hold a space mark after another character, or a line end, texts that are normalised, no bytes for other characters."""
    sp = processor(model_file)
    if sp.decode(sp.encode(odd := "  a  ﬁ\n ")) != odd or not any(sp.is_byte(i) for i in range(sp.get_piece_size())):
        raise ValueError("this vocabulary normalises texts, or has no bytes")
    for i in range(sp.get_piece_size()):
        if "▁" in (piece := sp.id_to_piece(i)).lstrip("▁") or "\n" in piece:
            raise ValueError("a piece of this vocabulary spans a space or a line end")


#: Space marks with what follows them up to the next one, and line ends, which no piece holds.
CHUNKS = re.compile("▁*[^▁\n]+|\n|▁+").findall


def chunks_of(text: str) -> list[str]:
    """The text's chunks, with the space mark that the model puts before a text; none of an empty text."""
    return CHUNKS("▁" + text.replace(" ", "▁")) if text else []


def packed(numbers: list[int] | np.ndarray) -> bytes:
    """Numbers as bytes of 7 bits, the lowest first; the last byte of a number is below 128."""
    v = np.asarray(numbers, dtype=np.uint32)
    out = np.zeros((len(v), 5), dtype=np.uint8)
    stay = np.zeros((len(v), 5), dtype=bool)
    for k in range(5):
        stay[:, k] = (v > 0) | (k == 0)
        out[:, k] = (v & 127) | ((v > 127).astype(np.uint8) << 7)
        v = v >> 7
        if not v.any():
            break
    return out[stay].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(raw < 128)
    begins = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), begins)


_ZSTD = pa.Codec("zstd", compression_level=3)


def squeezed(data: bytes) -> bytes:
    """The data compressed, after its length; short data stay as they are, after a zero."""
    small = _ZSTD.compress(data, asbytes=True) if len(data) > 64 else data
    return (len(data).to_bytes(4, "little") + small) if len(small) < len(data) else bytes(4) + data


def expanded(data: bytes) -> bytes:
    n = int.from_bytes(data[:4], "little")
    return _ZSTD.decompress(data[4:], n, asbytes=True) if n else data[4:]


def common_chunks(texts: DataFrame) -> list[str]:
    """Chunks that a bounded number of documents hold most often. They only spare shuffled bytes: any list gives the same ids."""
    n, docs, tasks = COMMON_CHUNKS, COMMON_DOCS, COMMON_TASKS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() >= tasks:
            return
        counts: Counter[str] = Counter()
        for text in islice((t for batch in batches for t in batch.column("text")), docs):
            counts.update(c for c in chunks_of(text.as_py() or "") if len(c) <= COMMON_CHARS)
        most = counts.most_common(n)
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in most], pa.string()), pa.array([k for _, k in most], pa.int64())], ["chunk", "n"])

    some = texts.select("text").mapInArrow(counted, "chunk string, n long")
    return [r.chunk for r in some.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(n).collect()]


_DOC, _WORDS = 1, 0


def _fields(row: T.DataType) -> T.StructType:
    long, binary = T.LongType(), T.BinaryType()
    return T.StructType([T.StructField("block", long), T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("row", row), T.StructField("data", binary), T.StructField("words", binary)])


_NAMES = ["block", "kind", "bucket", "row", "data", "words"]


def _chunked(buckets: int, common):
    """Rows (row, text) become documents of chunk numbers; after each block come its chunks by bucket, in the order of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, docs, chars = TaskContext.get().partitionId() << 32, 0, 0
        known = {c: i for i, c in enumerate(common.value)}
        numbers = dict(known)

        def words(row_type: pa.DataType) -> pa.RecordBatch:
            by: dict[int, tuple[list[int], list[str]]] = {}
            for word, k in islice(numbers.items(), len(known), None):
                at = by.setdefault(zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets, ([], []))
                at[0].append(k)
                at[1].append(word)
            n = len(by)
            data = [packed(np.diff(k, prepend=0)) for k, _ in by.values()]
            packs = [squeezed("\n".join(w).encode("utf-8", "surrogatepass")) for _, w in by.values()]
            columns = [pa.array([block] * n, pa.int64()), pa.array([_WORDS] * n, pa.int32()), pa.array(list(by), pa.int32()), pa.nulls(n, row_type), pa.array(data, pa.binary()), pa.array(packs, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, _NAMES)

        row_type = None
        for batch in batches:
            row_type = batch.schema.field("row").type
            in_block, place, data, ended = [], [], [], []
            for text in batch.column("text"):
                found = chunks_of(text.as_py() or "")
                data.append(squeezed(packed([numbers.setdefault(c, len(numbers)) for c in found])))
                in_block.append(block)
                place.append(docs)
                docs, chars = docs + 1, chars + sum(map(len, found))
                if len(numbers) - len(known) >= BLOCK_CHUNKS or chars >= BLOCK_CHARS or docs >= BLOCK_DOCS:
                    ended.append(words(row_type))
                    block, docs, chars = block + 1, 0, 0
                    numbers = dict(known)
            n = len(data)
            yield pa.RecordBatch.from_arrays([pa.array(in_block, pa.int64()), pa.array([_DOC] * n, pa.int32()), pa.array(place, pa.int32()), batch.column("row"), pa.array(data, pa.binary()), pa.nulls(n, pa.binary())], _NAMES)
            yield from ended
        if len(numbers) > len(known):
            yield words(row_type)

    return run


def _segmented(model_file: str):
    """Rows of chunks become rows of their ids; a chunk of a task's bucket is segmented once. Documents go through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = held(("chunks", model_file), lambda: processor(model_file))
        known: dict[str, bytes] = {}  # ids of 4 bytes, a quarter of what a list takes
        for batch in batches:
            is_words = pc.is_valid(batch.column("words"))
            yield batch.filter(pc.invert(is_words))
            batch = batch.filter(is_words)
            data = []
            for numbers, pack in zip(batch.column("data"), batch.column("words"), strict=True):
                words = expanded(pack.as_py()).decode("utf-8", "surrogatepass").split("\n")
                if len(known) >= KEPT_CHUNKS:
                    known.clear()
                if new := [w for w in words if w not in known]:
                    known.update((w, array("i", x).tobytes()) for w, x in zip(new, chunk_ids(sp, new), strict=True))
                ids = [known[w] for w in words]
                # numbers, then how many ids each chunk has, then the ids
                parts = [numbers.as_py(), packed([len(x) // 4 for x in ids]), packed(np.frombuffer(b"".join(ids), dtype=np.int32))]
                data.append(squeezed(b"".join((*(len(p).to_bytes(4, "little") for p in parts[:2]), *parts))))
            columns = [batch.column(k) for k in _NAMES[:4]] + [pa.array(data, pa.binary()), pa.nulls(len(data), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, _NAMES)

    return run


Table = tuple[np.ndarray, np.ndarray, np.ndarray]


def _table(rows: list[bytes], common: Table) -> Table:
    """Where the ids of each number's chunk begin, how many they are, and all ids: those of common chunks, then a block's own."""
    start, size, ids = common
    numbers, counts, own = [], [], []
    for r in map(expanded, rows):
        a, b = int.from_bytes(r[:4], "little"), int.from_bytes(r[4:8], "little")
        numbers.append(np.cumsum(unpacked(r[8 : 8 + a])))
        counts.append(unpacked(r[8 + a : 8 + a + b]))
        own.append(unpacked(r[8 + a + b :]).astype(np.int32))
    if not rows:
        return common
    place, count = np.concatenate(numbers) - len(start), np.concatenate(counts)
    own_start, own_size = np.zeros((2, len(place)), dtype=np.int64)
    own_size[place], own_start[place] = count, np.cumsum(count) - count + len(ids)
    return np.concatenate([start, own_start]), np.concatenate([size, own_size]), np.concatenate([ids, *own])


def common_table(model_file: str, chunks: list[str]) -> Table:
    ids = chunk_ids(processor(model_file), chunks)
    size = np.array([len(x) for x in ids], dtype=np.int64)
    return np.cumsum(size) - size, size, np.array([x for each in ids for x in each], dtype=np.int32)


def _joined(common, decoder: str | None = None):
    """Documents (row, ids, and decoded if a model is given for it): rows come sorted by block, its chunks before its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, table = None, [], None
        sp = held(("decode", decoder), lambda: processor(decoder)) if decoder else None
        for batch in batches:
            blocks, kinds, data = batch.column("block").to_pylist(), batch.column("kind").to_pylist(), batch.column("data")
            at, lengths, values, texts, held_ids = [], [0], [], [], 0

            def made(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                flat = pa.array(np.concatenate(values) if values else np.zeros(0, dtype=np.int32), pa.int32())
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), flat)
                columns = {"row": batch.column("row").take(pa.array(at)), "ids": ids} | ({"decoded": pa.array(texts, pa.string())} if sp else {})
                return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

            for i, (b, kind) in enumerate(zip(blocks, kinds, strict=True)):
                if b != block:
                    block, rows, table = b, [], None
                if kind == _WORDS:
                    rows.append(data[i].as_py())
                    continue
                if table is None:
                    table, rows = _table(rows, common.value), []
                at.append(i)
                chunk = unpacked(expanded(data[i].as_py()))
                if len(chunk):
                    start, size, ids = table
                    n = size[chunk]
                    values.append(ids[np.repeat(start[chunk] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
                    lengths.append(len(values[-1]))
                    held_ids += lengths[-1]
                else:
                    lengths.append(0)
                if sp:
                    texts.append(sp.decode(values[-1].tolist()) if len(chunk) else "")
                if held_ids >= BATCH_IDS:
                    yield made()
                    at, lengths, values, texts, held_ids = [], [0], [], [], 0
            if at:
                yield made()

    return run


def encode(docs: DataFrame, model_file: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """docs without the text and with ids (array of int), those of the SentencePiece library for the whole text.

    If asked for, also with decoded, as decode() gives it: the worker that has joined a text's ids decodes them, where
    decode() would put a second worker beside each.

    Neither begin nor end ids, no sampling; names of special tokens inside a text are ordinary text. A null or
    empty text has no ids. Rows stay, repeated ones too, in any order; an empty table gives an empty one. A
    column ids of docs is replaced. A vocabulary whose pieces cross space marks is refused.

    Documents become numbers of chunks (space marks with the characters after them), numbered inside blocks
    of documents. A block's distinct chunks go to buckets by their hash, where each is segmented once, and their
    ids come back to the block and are put in place of the numbers. Two shuffles, of numbers and of each
    block's distinct chunks, never of texts; a task holds the chunks of one block, or the ids of a bounded number.
    A chunk of any length is one chunk. Up to 200,000 short chunks, a few MB, that the first 1,000 documents of
    each of the first 8 tasks hold most often are segmented by the driver and broadcast: nearly every block has them.
    """
    check_pieces(model_file)
    replaced = {"ids", "decoded"} if decoded else {"ids"}
    row = F.struct(*(docs[c] for c in docs.columns if c != text_col and c.lower() not in replaced))
    given = docs.select(row.alias("row"), docs[text_col].alias("text"))
    schema, spark = _fields(given.schema["row"].dataType), docs.sparkSession
    chunks = ["\n", *(c for c in common_chunks(given) if c != "\n")]  # lists of other chunks are joined by line ends
    # two broadcasts, as no worker needs both
    common, common_ids = spark.sparkContext.broadcast(chunks), spark.sparkContext.broadcast(common_table(model_file, chunks))
    chunked = given.mapInArrow(_chunked(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), common), schema)
    to_bucket = F.when(F.col("kind") == _WORDS, F.col("bucket").cast("long")).otherwise(F.xxhash64("block", "bucket"))
    segmented = chunked.repartition(to_bucket).mapInArrow(_segmented(model_file), schema)
    ordered = segmented.drop("words", "bucket").repartition("block").sortWithinPartitions("block", "kind")
    more = [T.StructField("decoded", T.StringType())] if decoded else []
    out = ordered.mapInArrow(_joined(common_ids, model_file if decoded else None), T.StructType([T.StructField("row", schema["row"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), *more]))
    return out.select("row.*", *(c for c in out.columns if c != "row"))


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids") -> DataFrame:
    """encoded with decoded, the text that the library makes of the ids; null or no ids give an empty one. Null entries are left out."""

    @F.arrow_udf("string")
    def texts(ids: pa.Array) -> pa.Array:
        sp = held(("decode", model_file), lambda: processor(model_file))
        return pa.array(("" if x.values is None else sp.decode(x.values.drop_null().to_pylist()) for x in ids), pa.string())

    return encoded.withColumn("decoded", texts(F.col(ids_col)))
