"""MinHash near-dedup: a chosen-path set similarity join, and the components of its links.

Trees branch documents by the minwise tokens of their shingle sets. A node is the set of documents that agree
on the tokens chosen on its path. Small nodes are compared exhaustively; large ones branch again, three times by
three tokens each that the node chooses: a pair at 80 percent is then copied more often than it is lost, one
below 69 percent lost more often than it is copied. Independent trees bring the recall to its target. All
candidates are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.storage import durable
from corvane.llm.common import LOWER, UPPER, held, join_summed

#: Minwise tokens of a document in its sketch. Trees begin with the first ones.
TOKENS = 32
#: Further minwise tokens, of a byte each, among which nodes that branch choose.
DEEP = 512
#: Longs that hold the parities of a set, 64 each.
PARITIES = 4
#: Branches of a large node, and the tokens that the documents of a branch agree on.
BRANCHES, TOGETHER = 3, 3
#: What nodes carry of a document.
FIGURES = ("doc", "n", "sketch", *(f"q{i}" for i in range(PARITIES)))
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
_U = np.uint64
_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, TOKENS, dtype=np.uint64) | _U(1)
_DEEP_SEEDS = np.random.default_rng(21).integers(1, 1 << 32, DEEP, dtype=np.uint32) | np.uint32(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sets of shingle hashes (64 bits) of texts. Hashes of words that come often are kept, up to a number."""

    def __init__(self, size: int, keep: int = 300_000):
        import xxhash

        self.size, self.keep, self.hash = size, keep, xxhash.xxh64_digest
        self.known: dict[bytes, int] = {}
        self.hashes = np.zeros(0, _U)

    def words(self, text: str) -> np.ndarray:
        # UTF-8 has bytes of ASCII for its characters only, and split() of bytes knows exactly the six white spaces
        found = text.encode("utf-8", "surrogatepass").translate(_LOWERED).split()
        known = self.known
        if len(known) > self.keep:
            known.clear()
        if unseen := [w for w in set(found) if w not in known]:  # a difference of sets would walk through all that is known
            n = len(known)
            if n + len(unseen) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes[:n], np.zeros(n + len(unseen) + 10_000, _U)])
            self.hashes[n : n + len(unseen)] = np.frombuffer(b"".join(map(self.hash, unseen)), ">u8")
            known.update(zip(unseen, range(n, n + len(unseen)), strict=True))
        return self.hashes[np.fromiter(map(known.__getitem__, found), np.int64, len(found))]

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; of a text with fewer words than a shingle, that of the whole sequence."""
        h = self.words(text) if text else np.zeros(0, _U)
        if not len(h):
            return h
        k = min(self.size, len(h))
        out = np.full(len(h) - k + 1, k, _U)
        for i in range(k):
            out *= _U(0x9E3779B97F4A7C15)
            out += h[i : len(h) - k + 1 + i]
        out = _mixed(out)
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def minwise(sets: np.ndarray) -> np.ndarray:
    """For each of TOKENS orders the hash of the set's first token."""
    out = np.empty(TOKENS, _U)
    for at in range(0, TOKENS, 8):
        x = sets[None, :] * _SEEDS[at : at + 8, None]
        out[at : at + 8] = (x ^ (x >> _U(32))).min(axis=1)
    return _mixed(out * _SEEDS)


def deep_tokens(sets: np.ndarray) -> bytes:
    """For each of DEEP orders, other than those of minwise(), a byte of the set's first token."""
    out, x = np.empty(DEEP, np.uint32), sets.astype(np.uint32)
    step = max(1, 65536 // len(x))
    for at in range(0, DEEP, step):
        out[at : at + step] = (x[None, :] * _DEEP_SEEDS[at : at + step, None]).min(axis=1)
    out ^= out >> np.uint32(15)
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def sketch(tokens: np.ndarray) -> np.uint64:
    """Two bits of each token."""
    return np.bitwise_or.reduce((tokens & _U(3)) << (_U(2) * np.arange(TOKENS, dtype=_U)))


def parities(sets: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITIES classes of tokens whether the set has an odd number of them."""
    counts = np.bincount((sets & _U(64 * PARITIES - 1)).view(np.int64), minlength=64 * PARITIES)
    return np.packbits((counts & 1).astype(np.uint8)).view(_U)


def _shingler(size: int) -> Shingler:
    return held(("shingles", size), lambda: Shingler(size))


def signatures(docs: DataFrame, shingle_words: int, trees: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (shingles), s1 and s2 (128 bits that tell sets apart), sketch, parities, tokens and deep tokens of each row."""
    kinds = {**dict.fromkeys(("doc_id", "n", "s1", "s2", *FIGURES[2:]), "long"), "tokens": "array<long>", "deep": "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _shingler(shingle_words).shingles
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, s1, s2, sk, odd, tokens, deep = [], [], [], [], [], [], []
                for text in part.column(1).to_pylist():
                    x = shingles(text)
                    n.append(len(x))
                    weighed = _mixed(x + _U(1))
                    s1.append(np.add.reduce(x * _SEEDS[0], dtype=_U))
                    s2.append(np.add.reduce(weighed, dtype=_U))
                    t = minwise(x) if len(x) else np.zeros(TOKENS, _U)
                    tokens.append(t[:trees])
                    deep.append(deep_tokens(x) if len(x) else b"")
                    sk.append(sketch(t))
                    odd.append(parities(x))
                long = lambda v: pa.array(np.array(v, _U).view(np.int64))
                flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, trees), pa.int32()), pa.array(flat))
                odds = np.array(odd, _U).reshape(-1, PARITIES).T
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), long(s1), long(s2), long(sk), *map(long, odds), lists, pa.array(deep, pa.binary())], list(kinds))

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def shingle_sets(docs: DataFrame, shingle_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and set (sorted array of shingle hashes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _shingler(shingle_words).shingles
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t).view(np.int64) for t in part.column(1).to_pylist()]
                offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets) if sets else []).cast(pa.int64()))], ["doc_id", "set"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, set array<long>")


def alike(a: str, b: str, percent: int, least_equal: int = 16) -> Column:
    """Whether two rows may be linked, by sizes and parities (exactly) and sketches.

    Each token that one set has and the other has not turns one parity, so parities differ in at most as many
    places as sets do in tokens, and sets with links differ in a known share of their sizes. For sets of up to
    some 500 tokens this tells pairs at 60 percent from links; more places would let fewer pairs just below the
    threshold pass, and make all rows wider. Sketches serve longer ones: those of sets as
    similar as 80 percent agree in 27 of 32 places on average and in fewer than 16 of them once in some ten
    million pairs.
    """
    apart = F.col(f"{a}sketch").bitwiseXOR(F.col(f"{b}sketch"))
    places = apart.bitwiseOR(F.shiftrightunsigned(apart, 1)).bitwiseAND(F.lit(0x5555555555555555))
    turned = reduce(Column.__add__, (F.bit_count(F.col(f"{a}q{i}").bitwiseXOR(F.col(f"{b}q{i}"))) for i in range(PARITIES)))
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * turned <= (100 - percent) * (n + m)) & (TOKENS - F.bit_count(places) >= least_equal)


def confirmed(pairs: DataFrame, docs: DataFrame, shingle_words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Those of the pairs (a, b) that are linked on their full sets; only texts of pairs are shingled again."""
    named = pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(named, "_id", "left_semi")
    sets = shingle_sets(texts, shingle_words, "_id", "_text")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """doc_id and component (its least member) of all that edges (a, b) reach.

    Labels fall to the least among neighbours and then to their label's label until none changes: a number of
    rounds about the logarithm of the longest chain. A round shuffles edges and labels and is written to the
    shared folder.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = durable(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("doc_id").alias("b"), F.col("component").alias("_c")), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("_c").alias("_c"))
        lower = labels.join(near, "doc_id").select("doc_id", F.col("component").alias("_old"), F.least("component", "_c").alias("_new"))
        up = labels.select(F.col("doc_id").alias("_new"), F.col("component").alias("_above"))
        new = durable(lower.join(up, "_new").select("doc_id", "_old", F.least("_new", "_above").alias("component")))
        done = new.where(F.col("_old") != F.col("component")).isEmpty()
        labels = new.select("doc_id", "component")
        if done:
            return labels


def _starred(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows in nodes of several documents, with star: the node's pivot, its least document, where the row's may be linked with it."""
    least = rows.groupBy("node").agg(F.count(F.lit(1)).alias("_size"), F.min("doc").alias("p_doc")).where(F.col("_size") > 1).drop("_size")
    pivots = least.join(sets.select(*(F.col(k).alias(f"p_{k}") for k in FIGURES)), "p_doc")
    met = join_summed(rows, pivots, ["node"])
    return met.select("node", *FIGURES, F.when((F.col("doc") != F.col("p_doc")) & alike("", "p_", percent), F.col("p_doc")).alias("star"))


def branches(node: str, deep: str) -> Column:
    """The nodes to which a document of a large node goes; the node chooses the tokens that each looks at."""
    token = lambda i: F.substring(deep, F.pmod(F.xxhash64(node, F.lit(i)), F.lit(DEEP)).cast("int") + 1, F.lit(1))
    return F.array(*(F.xxhash64(node, F.lit(i), *(token(i * TOGETHER + k) for k in range(TOGETHER))) for i in range(BRANCHES)))


def links(sets: DataFrame, docs: DataFrame, shingle_words: int, percent: int, trees: int, small: int, depth: int, id_col: str, text_col: str) -> DataFrame:
    """Components of documents of different sets: doc_id (of those that are linked) and component.

    sets has a row per different set: FIGURES, tokens and deep tokens. In the first nodes of all trees each document is
    first held against the node's pivot only, which joins most of a group of near copies without pairing it up.
    Then nodes whose documents are not all in one component yet compare those of different components, if
    these pairs are at most `small` times the node's documents, or else branch; at the last depth whatever is
    left is compared. So no link between components is lost, and none inside one is looked for again.
    """
    rows = sets.select(*FIGURES, F.posexplode(F.slice("tokens", 1, trees)).alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), *FIGURES)
    first = durable(_starred(rows, sets, percent))
    stars = first.where(F.col("star").isNotNull()).select(F.col("star").alias("a"), F.col("doc").alias("b")).distinct()
    edges = durable(confirmed(durable(stars), docs, shingle_words, percent, id_col, text_col))
    known = components(edges)
    level, pairs = first.select(F.lit(0).cast("long").alias("family"), "node", *FIGURES), []
    for d in range(depth + 1):
        named = level.join(known.withColumnRenamed("doc_id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        parts = named.groupBy("node", "component").agg(F.count(F.lit(1)).alias("c"))
        stats = parts.groupBy("node").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("_squares"), F.count(F.lit(1)).alias("_parts")).where(F.col("_parts") > 1)
        crossing = (F.col("size") * F.col("size") - F.col("_squares")) / 2
        sized = stats.select("node", (crossing > small * F.col("size")).alias("large") if d < depth else F.lit(False).alias("large"))
        open_nodes = durable(join_summed(named, sized, ["node"]))
        others = F.collect_list("node").over(Window.partitionBy("doc", "family").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
        carried = (*FIGURES, "component", "others")
        x = open_nodes.where(~F.col("large")).withColumn("others", others).select("node", *(F.col(k).alias(f"x_{k}") for k in carried))
        y = x.select(F.col("node").alias("y_node"), *(F.col(f"x_{k}").alias(f"y_{k}") for k in carried))
        first_met = ~F.arrays_overlap("x_others", "y_others")  # among roots, or branches of one node, a pair is given in the first it shares
        meet = x.join(y, (F.col("node") == F.col("y_node")) & (F.col("x_doc") < F.col("y_doc")) & (F.col("x_component") != F.col("y_component")) & alike("x_", "y_", percent) & first_met)
        pairs.append(meet.select(F.col("x_doc").alias("a"), F.col("y_doc").alias("b")))
        large = open_nodes.where("large")
        if d == depth or large.isEmpty():
            break
        children = large.select("node", "doc").join(sets, "doc").select(F.col("node").alias("family"), F.explode(branches("node", "deep")).alias("node"), *FIGURES)
        level = durable(children)
    rest = durable(reduce(DataFrame.union, pairs).distinct())
    more = confirmed(rest, docs, shingle_words, percent, id_col, text_col)
    return components(edges.union(more))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, trees: int = 10, small: int = 2048, depth: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (long) and kept of each row.

    A document's set has the distinct shingles of shingle_words words of its text, A-Z lower-cased; with fewer
    words the whole sequence is one, without words the set is empty and linked with nothing. Documents are
    linked if 100 * intersection >= percent * union, checked on full sets of 64-bit hashes. component_id is the
    smallest id that links reach, kept whether it is the row's own.

    A pair at 80 percent is in a root of a tree with 0.8, and in one of three branches that agree on three tokens
    with 0.88. Roots have a token of their own each; nodes that branch choose among DEEP others, which all share,
    so a pair that few of these favour is lost more often. The binomial sum over how many do: ten trees miss a
    pair at 80 percent once in ten million times where roots are small, and 0.6, 2.5, 5.0 and 10.9 times in
    100,000 where all its nodes branch once, twice, three and six times (0.5, 1.6, 2.7 and 4.4 if no token were
    shared). `small` is an estimate of the comparisons that cost as much as branching a document.

    Nulls and ties: rows without id are linked with nothing, have a null component and are kept. Rows of one
    id are one document, linked by whatever any of them is like. Null and empty texts have no words. An empty
    table gives no row. Other columns are not read.

    Documents of equal sets are one from the start (a group of copies costs its rows once). Figures of a few
    hundred bytes a document are written to the shared folder; texts are read twice, and only sets of candidate
    pairs are shuffled.
    """
    rows = durable(signatures(docs, shingle_words, trees, id_col, text_col))
    full = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    sets = full.groupBy("s1", "s2").agg(F.min(F.struct(F.col("doc_id").alias("doc"), *FIGURES[1:], "tokens", "deep")).alias("r")).select("s1", "s2", "r.*")
    sets = durable(sets)
    linked = links(sets.select(*FIGURES, "tokens", "deep"), docs, shingle_words, percent, trees, small, depth, id_col, text_col)
    leaders = sets.select("s1", "s2", F.col("doc").alias("_doc")).join(linked.select(F.col("doc_id").alias("_doc"), "component"), "_doc", "left").select("s1", "s2", F.coalesce("component", "_doc").alias("_c"))
    own = F.when(F.col("n") > 0, F.coalesce("_c", "doc_id")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", "n", "s1", "s2").join(leaders, ["s1", "s2"], "left").withColumn("component_id", own)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
