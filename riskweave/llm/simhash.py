"""SimHash near-duplicates by multi-index hashing.

A fingerprint is the bitwise majority of its word shingles' XXH64 values. Two 64-bit fingerprints that differ in at
most ``distance`` bits differ in at most ``distance // segments`` bits of one of their segments. So every distinct
fingerprint enters a table under each of its segments, each fingerprint looks up the small Hamming ball around each of
its own segments there, and matches are kept by their complete distance. Copies of a fingerprint are aggregated first:
links are only ever made between different fingerprints.

The pipeline's ``near_classes`` does so with fingerprints of different shingles and compares linked texts whole.
``similar`` finds all texts of a similarity without fingerprints, by exact prefix filtering; its joins grow with the
square of the texts that share a shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.shared import clean_shuffles, connected, drop, slices, stage

BITS = 64
SEED = 42


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words (the whole sequence if shorter; none without words)."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    one = xxhash.xxh64_intdigest
    if n <= size:
        return np.array([one(joined, SEED)], np.uint64)
    return np.array([one(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; zero for none. Signed, as Spark's long."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def words_of(text: str | None) -> list[bytes]:
    """Words of the A-Z lower-cased text: ``bytes.lower`` changes only A-Z, ``bytes.split`` cuts at x20, x09-x0D."""
    return text.encode().lower().split() if text else []


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row's whole text. A null or empty text has fingerprint zero, like one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = [majority(shingle_hashes(words_of(x), size)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def balls(width: int, radius: int) -> list[int]:
    """Masks of every change of at most ``radius`` among ``width`` bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _probe(probes: DataFrame, table: DataFrame, near: Column) -> DataFrame:
    """Probes that meet a table's entry. Sorted, never broadcast: the planner takes probes to be as small as the
    fingerprints that they are made of."""
    return probes.hint("merge").join(table.hint("merge"), (probes.seg == table.seg) & (probes.key == table.key) & near).select("a", "b")


def links(fps: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """Pairs (a < b) of distinct values ``fp`` that differ in 1 to ``distance`` bits: all of them, each once or more.

    ``fps`` has one row per distinct fingerprint. Each of the ``segments`` parts is probed with the ball of radius
    ``distance // segments``, which by the pigeonhole principle finds every pair.
    """
    width, radius = BITS // segments, distance // segments
    masks = F.array(*(F.lit(m).cast("long") for m in balls(width, radius)))
    keep = F.lit((1 << width) - 1).cast("long")
    parts = F.array(*(F.struct(F.lit(i).cast("int").alias("seg"), F.shiftrightunsigned("fp", i * width).bitwiseAND(keep).alias("key")) for i in range(segments)))
    own = fps.select("fp", F.explode(parts).alias("p"))
    table = own.select(F.col("p.seg").alias("seg"), F.col("p.key").alias("key"), F.col("fp").alias("b"))
    probes = own.select(F.col("p.seg").alias("seg"), F.col("fp").alias("a"), F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("p.key")))).alias("key"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return _probe(probes, table, near)


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) per row: component is the smallest id reachable over links of at most ``distance`` bits.

    Rows with a null id keep a fingerprint, take no part in links and have a null component; repeated ids are one
    node; an empty table gives an empty result.
    """
    prints = stage(fingerprints(docs, size, id_col, text_col), "simhash")
    nodes = stage(prints.groupBy("fp").agg(F.min("id").alias("node")).where("node is not null"), "simhash-nodes")
    pairs = stage(links(nodes.select("fp"), distance), "simhash-links")
    by_fp = connected(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    grouped = nodes.join(by_fp, nodes.fp == by_fp.id, "left").select("fp", "node", F.coalesce("component", "fp").alias("group"))
    least = grouped.groupBy("group").agg(F.min("node").alias("component"))
    labelled = grouped.join(least, "group").select("fp", "component")
    out = prints.join(labelled, "fp", "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


#: Counters of how many texts have a shingle, shared by shingles of equal upper bits; only the order of shingles hangs on them.
COUNTERS_BITS = 20


def _grams(text: str | None, size: int) -> np.ndarray:
    """The text's different shingle hashes, sorted."""
    return np.unique(shingle_hashes(words_of(text), size))


def _counters(docs: DataFrame, size: int) -> np.ndarray:
    """How many texts of ``docs`` (id, text) have a shingle, by its hash's upper bits. A task sends its counters as
    blocks of bytes, which are added up as they come; what is collected is bounded by the number of counters."""
    per_block = 1 << 8

    def rows_of(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        blocks = total.reshape(-1, per_block)
        used = np.nonzero(blocks.any(axis=1))[0]
        for i in range(0, len(used), 1 << 10):
            part = used[i : i + (1 << 10)]
            raw = [x.astype(np.uint8 if x.max() < 1 << 8 else np.int64).tobytes() for x in blocks[part]]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(raw, pa.binary())], ["block", "counts"])

    def add(batch: pa.RecordBatch | pa.Table, total: np.ndarray) -> None:
        for block, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            total[block * per_block : (block + 1) * per_block] += np.frombuffer(raw, np.uint8 if len(raw) == per_block else np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS_BITS, np.int64)
        for b in slices(batches, "text"):
            for x in b.column(1).to_pylist():
                # different shingles of one text may share a counter
                np.add.at(total, (_grams(x, size) >> np.uint64(64 - COUNTERS_BITS)).astype(np.int64), 1)
        yield from rows_of(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS_BITS, np.int64)
        for b in batches:
            add(b, total)
        yield from rows_of(total)

    schema = "block long, counts binary"
    got = docs.mapInArrow(count, schema).repartition("block").mapInArrow(merge, schema).toArrow()
    out = np.zeros(1 << COUNTERS_BITS, np.int64)
    add(got, out)
    return out


def _prefixes(docs: DataFrame, size: int, similarity: float, counters: np.ndarray) -> DataFrame:
    """(id, fp: hash of the shingle set, n: its size, prefix) of ``docs`` (id, text). In the order of their counters,
    then hashes, sets that are alike share one of their first n - ceil(similarity n) + 1 shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps, sizes, firsts = [], [], []
            for x in b.column(1).to_pylist():
                g = _grams(x, size)
                most = len(g) - math.ceil(similarity * len(g) - 1e-9) + 1 if len(g) else 0
                order = np.argsort(counters[(g >> np.uint64(64 - COUNTERS_BITS)).astype(np.int64)], kind="stable")
                fps.append(int(np.uint64(xxhash.xxh3_64_intdigest(g.tobytes(), SEED)).view(np.int64)))
                sizes.append(len(g))
                firsts.append(g[order[:most]].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))], ["id", "fp", "n", "prefix"])

    return docs.mapInArrow(run, "id long, fp long, n long, prefix array<long>")


def _shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(fp, set of shingle hashes) of ``docs`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [_grams(x, size) for x in b.column(1).to_pylist()]
            fps = [int(np.uint64(xxhash.xxh3_64_intdigest(g.tobytes(), SEED)).view(np.int64)) for g in sets]
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array([g.view(np.int64) for g in sets], pa.list_(pa.int64()))], ["fp", "grams"])

    return docs.mapInArrow(run, "fp long, grams array<long>")


def _may_reach(shared: Column, n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles that share ``shared`` of their prefixes can be alike. Up to the prefix that ends
    first in the order, what both have stands in both prefixes; beyond it that set has ceil(similarity n) - 1 more."""
    behind = F.greatest(*(F.ceil(similarity * x - 1e-9) - 1 for x in (n, m)))
    return shared + behind >= similarity / (1 + similarity) * (n + m) - 1e-9


def _within_reach(firsts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (left, right: fp) whose prefixes leave it open that they are alike, staged: of the others only
    a prefix each is moved. ``firsts`` has one row (fp, n, prefix) per fp."""
    l, r = (firsts.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"p_{x}")) for x in ("left", "right"))
    joined = pairs.join(r, "right").join(l, "left")
    shared = F.size(F.array_intersect("p_left", "p_right"))
    return stage(joined.where(_may_reach(shared, F.col("n_left"), F.col("n_right"), similarity)).select("left", "right"), "similar-reach")


def _verified(plain: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (left, right: fp) whose whole shingle sets are alike, staged."""
    asked = stage(pairs.select(F.explode(F.array("left", "right")).alias("fp")).distinct().join(nodes, "fp").select("fp", "node"), "similar-asked")
    texts = plain.join(asked.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select("id", "text")
    grams = stage(_shingle_sets(texts, size).join(asked.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "similar-grams")
    l, r = (grams.select(F.col("fp").alias(x), F.col("grams").alias(y)) for x, y in (("left", "l"), ("right", "r")))
    common = F.size(F.array_intersect("l", "r"))
    alike = pairs.join(r, "right").join(l, "left").where(common >= similarity * (F.size("l") + F.size("r") - common) - 1e-9).select(F.col("left").alias("src"), F.col("right").alias("dst"))
    out = stage(alike, "similar-alike")
    drop(asked, grams)
    return out


def similar(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): classes of texts linked by sets of ``size``-word shingles of at least that Jaccard similarity.

    All such links count, and no others: equal sets are one node; of other sets the pairs that share a shingle of their
    prefixes, rare shingles first, hold every pair that is alike, and are compared whole. Each text
    is compared first with one that is some shingle's first text, then with the first texts of its other shingles that
    aren't of its class yet, then with all others that aren't, so that a large group of near copies isn't compared pair
    by pair. Null ids have no class; texts with one id are one node each, and the rows of an
    id have their own text's class. A null text counts as empty, texts without words are equal sets, an empty table gives
    an empty result. The result is staged; what it is made of is dropped.
    """
    with clean_shuffles(docs.sparkSession):
        return _classes(docs, size, similarity, id_col, text_col)


def _classes(docs: DataFrame, size: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    sketches = stage(_prefixes(plain, size, similarity, _counters(plain, size)), "similar")
    nodes = stage(sketches.groupBy("fp").agg(F.min("id").alias("node")), "similar-nodes")
    firsts = sketches.join(nodes, (sketches.fp == nodes.fp) & (sketches.id == nodes.node), "left_semi").dropDuplicates(["fp"])
    tokens = firsts.select(F.explode("prefix").alias("token"), "fp", "n")
    heads = tokens.groupBy("token").agg(F.min(F.struct("fp", "n")).alias("head"), F.count("*").alias("texts")).where("texts > 1").select("token", "head")
    # shingles of at least two texts' prefixes
    shared_tokens = stage(tokens.join(heads, "token"), "similar-tokens")
    fits = lambda n, m: F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9
    c = F.col
    heads_of = shared_tokens.where((c("fp") != c("head.fp")) & fits(c("n"), c("head.n"))).groupBy(c("head.fp").alias("left"), c("fp").alias("right"))
    to_heads = stage(heads_of.agg(F.count("*").alias("shared")), "similar-heads")
    # the head that shares most of a set's prefix first, then heads of another class
    best = stage(to_heads.groupBy("right").agg(F.max(F.struct("shared", "left")).alias("b")).select("b.left", "right"), "similar-best")
    # of the prefixes, those of texts in a pair
    asked = to_heads.select(F.explode(F.array("left", "right")).alias("fp")).distinct()
    prefixes = stage(firsts.select("fp", "n", "prefix").join(asked, "fp", "left_semi"), "similar-prefixes")
    first = _within_reach(prefixes, best, similarity)
    near = _verified(plain, nodes, first, size, similarity)
    part = stage(connected(near), "similar-parts")
    l, r = (part.select(c("id").alias(x), c("component").alias(f"part_{x}")) for x in ("left", "right"))
    apart = to_heads.join(best, ["left", "right"], "left_anti").join(l, "left", "left").join(r, "right", "left").where(F.coalesce("part_left", "left") != F.coalesce("part_right", "right"))
    apart = _within_reach(prefixes, apart.select("left", "right"), similarity)
    drop(part, prefixes)
    far = _verified(plain, nodes, apart, size, similarity)
    drop(best, first, apart)
    alike = near.unionByName(far)
    known = stage(connected(alike), "similar-known")
    members = shared_tokens.join(known.withColumnRenamed("id", "fp"), "fp", "left").select("token", "fp", "n", F.coalesce("component", "fp").alias("part"))
    several = members.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("token")
    members = stage(members.join(several, "token", "left_semi"), "similar-members")
    drop(shared_tokens, known)
    a, b = (members.select("token", *(c(x).alias(f"{x}_{s}") for x in ("fp", "n", "part"))) for s in "ab")
    parts = members.select("token", "part").distinct()
    cross = parts.select("token", c("part").alias("part_a")).join(parts.select("token", c("part").alias("part_b")), "token").where("part_a < part_b")
    found = cross.join(a, ["token", "part_a"]).join(b, ["token", "part_b"]).where(fits(c("n_a"), c("n_b")))
    # sets of two classes meet at every shingle that both prefixes have
    once = found.groupBy(F.least("fp_a", "fp_b").alias("left"), F.greatest("fp_a", "fp_b").alias("right")).agg(F.count("*").alias("shared"), F.any_value(F.struct("n_a", "n_b")).alias("n"))
    rest = once.where(_may_reach(c("shared"), c("n.n_a"), c("n.n_b"), similarity)).select("left", "right")
    tried = to_heads.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"))
    rest = stage(rest.join(tried, ["left", "right"], "left_anti"), "similar-rest")
    drop(members, to_heads)
    more = _verified(plain, nodes, rest, size, similarity)
    final = connected(alike.unionByName(more))
    grouped = nodes.join(final, nodes.fp == final.id, "left").select("fp", "node", F.coalesce("component", "fp").alias("group"))
    least = grouped.groupBy("group").agg(F.min("node").alias("component"))
    labels = grouped.join(least, "group").select("fp", "component")
    out = stage(sketches.select("id", "fp").join(labels, "fp").select("id", "component"), "similar-classes")
    drop(sketches, nodes, near, far, rest, more)
    return out


def _prints(docs: DataFrame, size: int, shingles: int | None = None) -> DataFrame:
    """(id, fp: fingerprint of the different ``size``-word shingles) of ``docs`` (id, text), so that a line that a text
    repeats weighs no more than another; with ``shingles`` also grams, the set of that many words' shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = b.column(1).to_pylist()
            columns = [b.column(0), pa.array([majority(_grams(x, size)) for x in texts], pa.int64())]
            if shingles:
                columns.append(pa.array([_grams(x, shingles).view(np.int64) for x in texts], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["id", "fp", "grams"][: len(columns)])

    return docs.mapInArrow(run, "id long, fp long" + ", grams array<long>" * bool(shingles))


def near_classes(docs: DataFrame, size: int = 3, distance: int = 5, segments: int = 3, shingles: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): classes of texts whose fingerprints differ in at most ``distance`` bits and whose sets of
    ``shingles``-word shingles have at least that Jaccard similarity.

    The fingerprints are those of different shingles; the first text of each stands for all of its texts. All pairs
    within the distance are found (see ``links``) and compared whole, so texts that only have near fingerprints are left
    alone. Null ids have no class; the rows of an id have their own text's class. A null text counts as empty, texts
    without words are one class, an empty table gives an empty result. The result is staged; what it is made of is
    dropped.
    """
    with clean_shuffles(docs.sparkSession):
        plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
        prints = stage(_prints(plain, size), "near")
        nodes = stage(prints.groupBy("fp").agg(F.min("id").alias("node")), "near-nodes")
        # a pair is found by each segment in which it is near
        pairs = stage(links(nodes.select("fp"), distance, segments).distinct(), "near-links")
        asked = stage(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(nodes, "fp").select("fp", F.col("node").alias("id")), "near-asked")
        texts = plain.join(asked.select("id").distinct(), "id", "left_semi").select("id", "text")
        grams = stage(_prints(texts, size, shingles).join(asked, ["id", "fp"], "left_semi").dropDuplicates(["fp"]).select("fp", "grams"), "near-grams")
        l, r = (grams.select(F.col("fp").alias(x), F.col("grams").alias(y)) for x, y in (("a", "l"), ("b", "r")))
        common = F.size(F.array_intersect("l", "r"))
        alike = pairs.join(r, "b").join(l, "a").where(common >= similarity * (F.size("l") + F.size("r") - common) - 1e-9)
        alike = stage(alike.select(F.col("a").alias("src"), F.col("b").alias("dst")), "near-alike")
        drop(pairs, asked, grams)
        by_fp = connected(alike)
        grouped = nodes.join(by_fp, nodes.fp == by_fp.id, "left").select("fp", "node", F.coalesce("component", "fp").alias("group"))
        least = grouped.groupBy("group").agg(F.min("node").alias("component"))
        labels = grouped.join(least, "group").select("fp", "component")
        out = stage(prints.join(labels, "fp").select("id", "component"), "near-classes")
        drop(prints, nodes, alike)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their class of near duplicates (smallest id;
    of rows with that id all stay); rows without an id stay."""
    classes = near_classes(docs, id_col=id_col, text_col=text_col)
    others = stage(classes.where("id <> component").select("id").distinct(), "near-others")
    drop(classes)
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    own = F.col(names[docs.columns.index(id_col)]).cast("long")
    return docs.toDF(*names).join(others, own == F.col("id"), "left_anti").toDF(*docs.columns)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract of op2: doc_id, fingerprint (16 hex digits), component_id, by 3-word shingles and 3 bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
