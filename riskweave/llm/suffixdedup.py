"""Suffix-array deduplication by a distributed difference cover, bounded in depth.

A byte goes if a string of WINDOW bytes that covers it also starts earlier in the corpus. For that, suffixes need
only be told apart by their first WINDOW bytes. Among any two equal windows there is a common offset at which both
stand on a position sampled by a difference cover modulo V (for all residues a, b there is a k < V with a + k and b + k
in the cover). So:

1. exact copies of a text are represented by the one with the smallest id: all windows of the others start earlier;
2. the sampled suffixes are named by their first WINDOW - V + 1 bytes; names are sorted (dealt by their leading bits)
   and those that occur once are dropped. As WINDOW bytes are the whole depth, names needn't be recursed on;
3. the remaining suffixes are merged: only one with a repeated name among its first V positions can equal another;
   their windows are sorted, adjacent equal ones compared, and each class's first place is found.

Positions are handled as arrays per unit (some MB of whole documents). Units stay where they are, in a bucketed table;
what is shuffled are sorted names, one per unit and different window, and bit maps in reply. Names are 64-bit hashes
(128 bits for a large corpus) of the bytes.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.shared import Rolling, clean_shuffles, drop, drop_path, shared_root, slices, stage

WINDOW = 100
#: Difference covers modulo V (fixed values, from perfect difference sets).
COVERS = {7: [0, 1, 3], 13: [0, 1, 3, 9], 21: [0, 1, 4, 14, 16], 31: [0, 1, 3, 8, 12, 18], 57: [0, 1, 3, 13, 32, 36, 43, 52]}
UNIT_BYTES = 4 << 20
UNITS_PER_PARTITION = 8
#: Bytes of corpus from which a window's name has 128 bits.
WIDE_FROM = 1 << 31

UNIT = "unit int, ids binary, shas binary, ends binary, data binary"
NAMES = "bucket int, unit int, keys binary, more binary, docs binary, dictionary binary"
REPLY = "unit int, kind int, bucket int, bits binary"
RESULT = "sha binary, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_ends array<long>, kept binary"


def _cover(window: int) -> tuple[int, list[int]]:
    v = max((v for v in COVERS if v <= max(7, window * 3 // 5)), default=7)
    if window < v:
        raise ValueError(f"windows of under {v} bytes aren't supported")
    return v, COVERS[v]


def _buffer(column: str, table: pa.Table) -> bytes:
    return table.column(column)[0].as_py()


class Unit:
    """One unit's documents and hashes as arrays."""

    def __init__(self, table: pa.Table, window: int) -> None:
        self.number = table.column("unit")[0].as_py()
        self.ids = np.frombuffer(_buffer("ids", table), np.int64)
        self.shas = _buffer("shas", table)
        self.ends = np.frombuffer(_buffer("ends", table), np.int64)
        self.data = np.frombuffer(_buffer("data", table), np.uint8)
        self.window = window
        self.v, cover = _cover(window)
        self.starts = np.concatenate([np.zeros(1, np.int64), self.ends[:-1]]) if len(self.ends) else self.ends
        sizes = self.ends - self.starts
        at = np.arange(len(self.data), dtype=np.int32)
        place = at - np.repeat(self.starts, sizes).astype(np.int32)
        self.left = np.repeat(self.ends, sizes).astype(np.int32) - at
        inside = np.zeros(self.v, bool)
        inside[cover] = True
        self.gram = window - self.v + 1
        self.sample = np.nonzero(inside[place % self.v] & (self.left >= self.gram))[0]
        self.rolling = _rolling(1)
        self.prefix = self.rolling.prefix(self.data)

    def names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sampled grams' different names, sorted; which each sample has; how many have it."""
        h = self.rolling.of(self.prefix, self.sample, self.sample + self.gram)
        different, which, n = np.unique(h, return_inverse=True, return_counts=True)
        return different, which, n

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of windows with a repeated name; ``repeated``: by sample."""
        flags = np.zeros(len(self.data) + self.v + 1, np.int32)
        flags[self.sample[repeated] + 1] = 1
        np.cumsum(flags, out=flags)
        n = len(self.data)
        return np.nonzero((flags[self.v : self.v + n] > flags[:n]) & (self.left >= self.window))[0]

    def windows(self, at: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
        """Different windows at ``at``, sorted by name: names, further name bits, index of the first in ``at``, and which each has."""
        h = self.rolling.of(self.prefix, at, at + self.window)
        if not wide:
            different, first, which = np.unique(h, return_index=True, return_inverse=True)
            return different, None, first, which
        second = _rolling(2)
        h2 = second.of(second.prefix(self.data), at, at + self.window)
        order = np.lexsort((np.arange(len(h)), h2, h))
        a, b = h[order], h2[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        return a[new], b[new], order[new], which


_made: dict[int, Rolling] = {}


def _rolling(k: int) -> Rolling:
    if k not in _made:
        _made[k] = Rolling(7919 * k)
    return _made[k]


def _cut(sorted_names: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (leading bits) that occur in sorted names, and the places where each begins, with the end."""
    bucket = (sorted_names >> np.uint64(64 - bits)).astype(np.int64)
    first = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0] if len(bucket) else np.zeros(0, np.int64)
    return bucket[first], np.append(first, len(bucket))


def _name_rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in range(6)]
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in NAMES.split(", ")])


def _sample_names(window: int, bits: int, size: int):
    """Phase 2, per unit: each different sampled name once, cut to ``size`` bytes below the bucket's bits."""

    def run(table: pa.Table) -> pa.Table:
        u = Unit(table, window)
        different, _, _ = u.names()
        keys = ((different << np.uint64(bits)) >> np.uint64(64 - 8 * size)).view(np.uint8).reshape(-1, 8)[:, :size]
        buckets, cuts = _cut(different, bits)
        return _name_rows([(int(b), u.number, keys[s:e].tobytes(), b"", b"", b"") for b, s, e in zip(buckets, cuts, cuts[1:])])

    return run


def _unpack(parts: list[bytes], size: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, size)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :size] = raw
    return out.reshape(-1).view(np.uint64)


def _replies(kind: int, table: pa.Table, counts: list[int], flags: np.ndarray) -> pa.Table:
    ends = np.cumsum(counts)
    units, buckets = table.column("unit").to_pylist(), table.column("bucket").to_pylist()
    bits = [np.packbits(flags[e - n : e]).tobytes() for n, e in zip(counts, ends)]
    return pa.Table.from_arrays([pa.array(units, pa.int32()), pa.array([kind] * len(units), pa.int32()), pa.array(buckets, pa.int32()), pa.array(bits, pa.binary())], names=["unit", "kind", "bucket", "bits"])


def _repeated(size: int):
    """Phase 2, per bucket: which names occur in more than one unit."""

    def run(table: pa.Table) -> pa.Table:
        parts = table.column("keys").to_pylist()
        keys = _unpack(parts, size)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        flags = np.zeros(len(keys), bool)
        flags[order[1:][same]] = True
        flags[order[:-1][same]] = True
        return _replies(0, table, [len(p) // size for p in parts], flags)

    return run


def _read_bits(replies: pa.Table, kind: int, buckets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A unit's reply of one kind, in the order of its sorted names."""
    got = {b: bits for k, b, bits in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "bits"))) if k == kind}
    out = np.zeros(int(cuts[-1]), bool)
    for b, s, e in zip(buckets.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
        out[s:e] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=e - s)
    return out


def _remaining(u: Unit, replies: pa.Table, bits: int) -> np.ndarray:
    different, which, n = u.names()
    again = _read_bits(replies, 0, *_cut(different, bits)) | (n > 1)
    return u.candidates(again[which])


def _window_names(window: int, bits: int, below: int, wide: bool):
    """Phase 3, per unit: each different window of the remaining suffixes once, with the document where it is first."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _name_rows([])
        u = Unit(left, window)
        at = _remaining(u, right, bits)
        names, more, first, _ = u.windows(at, wide)
        doc = np.searchsorted(u.ends, at[first], side="right")
        keys = ((names << np.uint64(8)) >> np.uint64(8)).view(np.uint8).reshape(-1, 8)[:, :7]
        rows = []
        buckets, cuts = _cut(names, below)
        for b, s, e in zip(buckets, cuts, cuts[1:]):
            own, index = np.unique(doc[s:e], return_inverse=True)
            index = index.astype(np.uint16 if len(own) < 1 << 16 else np.uint32)
            rows.append((int(b), u.number, keys[s:e].tobytes(), more[s:e].tobytes() if wide else b"", index.tobytes(), u.ids[own].tobytes()))
        return _name_rows(rows)

    return run


def _first_units(below: int, wide: bool):
    """Phase 3, per bucket: in which unit each window is first (smallest id)."""

    def run(table: pa.Table) -> pa.Table:
        parts = table.column("keys").to_pylist()
        counts = [len(p) // 7 for p in parts]
        keys = _unpack(parts, 7)
        ids = []
        for index, own in zip(table.column("docs").to_pylist(), table.column("dictionary").to_pylist()):
            own = np.frombuffer(own, np.int64)
            ids.append(own[np.frombuffer(index, np.uint16 if len(own) < 1 << 16 else np.uint32)])
        ids = np.concatenate(ids)
        if wide:
            more = np.frombuffer(b"".join(table.column("more").to_pylist()), np.uint64)
            order = np.lexsort((more, keys))
            new = np.ones(len(order), bool)
            new[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
        else:
            order = np.argsort(keys, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = keys[order][1:] != keys[order][:-1]
        begin = np.nonzero(new)[0]
        least = np.minimum.reduceat(ids[order], begin)
        flags = np.empty(len(order), bool)
        flags[order] = ids[order] == np.repeat(least, np.diff(np.append(begin, len(order))))
        return _replies(1, table, counts, flags)

    return run


def _removal(window: int, bits: int, below: int, wide: bool, with_text: bool):
    """Last phase, per unit: bytes that go, by document."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            u = Unit(left, window)
            at = _remaining(u, right, bits)
            names, _, first, which = u.windows(at, wide)
            here = _read_bits(right, 1, *_cut(names, below))
            keeps = here[which]
            keeps &= first[which] == np.arange(len(at))
            gone = at[~keeps]
            change = np.zeros(len(u.data) + 1, np.int32)
            change[gone] += 1
            change[gone + window] -= 1  # two windows never end at the same place
            removed = np.cumsum(change[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(removed)])
            for k, (doc, s, e) in enumerate(zip(u.ids.tolist(), u.starts.tolist(), u.ends.tolist())):
                sha, n = u.shas[32 * k : 32 * k + 32], int(total[e] - total[s])
                starts, ends, kept_sha = [], [], sha.hex()
                kept = u.data[s:e]
                if n:
                    edges = np.diff(np.concatenate([[0], removed[s:e].view(np.int8), [0]]))
                    starts, ends = np.nonzero(edges == 1)[0].tolist(), np.nonzero(edges == -1)[0].tolist()
                    kept = kept[~removed[s:e]]
                    kept_sha = hashlib.sha256(kept.tobytes()).hexdigest()
                rows.append((sha, doc, e - s, n, len(starts), kept_sha, starts, ends, kept.tobytes().decode("utf-8", "ignore").encode() if with_text and n else None))
        columns = list(zip(*rows)) if rows else [[] for _ in range(9)]
        types = [pa.binary(), *[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def _once_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text that a task has sent already is sent as its id alone, and that only if it is smaller: a group of copies
    is one row per task."""
    sent: dict[bytes, int] = {}
    least: dict[bytes, int] = {}
    # one schema for all: the input's says that its columns have no nulls
    batch = lambda *columns: pa.RecordBatch.from_arrays(list(columns), ["id", "sha", "text"])
    for b in slices(batches, "text"):
        keep, shas = [], b.column(1).to_pylist()
        for i, (doc, sha) in enumerate(zip(b.column(0).to_pylist(), shas)):
            if sha not in sent:
                sent[sha] = doc
                keep.append(i)
            elif doc < sent[sha]:
                least[sha] = min(doc, least.get(sha, doc))
        if keep:
            yield batch(*b.take(pa.array(keep, pa.int64())).columns)
    if least:
        yield batch(pa.array(list(least.values()), pa.int64()), pa.array(list(least), b.schema.field(1).type), pa.nulls(len(least), b.schema.field(2).type))


def _to_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's different texts, with their smallest ids, as units' rows (a unit's documents in the order of id)."""
    texts: dict[bytes, bytes] = {}
    least: dict[bytes, tuple[int, int]] = {}
    for b in batches:
        for unit, doc, sha, text in zip(*(c.to_pylist() for c in b.columns)):
            if text is not None:
                texts[sha] = text
            least[sha] = min(least.get(sha, (unit, doc)), (unit, doc))
    by_unit: dict[int, list] = {}
    for sha, (unit, doc) in least.items():
        by_unit.setdefault(unit, []).append((doc, sha))
    for unit, docs in sorted(by_unit.items()):
        docs.sort()
        parts = [texts.pop(sha) for _, sha in docs]
        ids, ends = np.array([d for d, _ in docs], np.int64), np.cumsum([len(p) for p in parts], dtype=np.int64)
        row = [[unit], [ids.tobytes()], [b"".join(sha for _, sha in docs)], [ends.tobytes()], [b"".join(parts)]]
        yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *(pa.array(x, pa.binary()) for x in row[1:])], ["unit", "ids", "shas", "ends", "data"])


def removals(docs: DataFrame, window: int = WINDOW, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(ids, results): ids has (id, sha, n_bytes) per row; results has per different text its first id, what is removed
    there (span_starts, span_ends: byte offsets) and, if wanted, the text kept where any byte is removed (characters cut
    apart go whole). Both are staged.

    Nulls in the text count as empty; null ids count as last; rows with the same id and text are one document; of rows
    with the same id and different texts, either may come first. An empty table gives empty results.
    """
    spark = docs.sparkSession
    last = F.lit((1 << 63) - 1)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), text.alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    with clean_shuffles(spark):
        ids = stage(base.select("id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "suffix-ids")
        n_bytes = ids.agg(F.sum("n_bytes")).first()[0] or 0
        units = max(1, math.ceil(n_bytes / UNIT_BYTES))
        n = max(1, math.ceil(units / UNITS_PER_PARTITION), min(units, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        once = base.select("id", "sha", "text").mapInArrow(_once_per_task, "id long, sha binary, text binary")
        dealt = once.withColumn("unit", F.pmod(F.xxhash64("sha"), F.lit(units)).cast("int")).select("unit", "id", "sha", "text").repartition(n, "unit")
        name = f"riskweave_units_{uuid.uuid4().hex}"
        path = f"{shared_root(spark)}/{name}"
        dealt.mapInArrow(_to_units, UNIT).write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, "unit").saveAsTable(name)
        try:
            table = spark.table(name)
            wide = n_bytes > WIDE_FROM
            # names' buckets hold some hundred thousand different ones; a name's further bytes tell apart all but few
            bits = max(4, math.ceil(math.log2(max(1, n_bytes * 0.14 / 400_000))))
            size = 4 if n_bytes < 1 << (bits + 24) else 7
            below = max(8, math.ceil(math.log2(max(1, n_bytes / (4 << 20)))))
            sent = table.groupBy("unit").applyInArrow(_sample_names(window, bits, size), NAMES)
            samples = stage(sent.groupBy("bucket").applyInArrow(_repeated(size), REPLY), "suffix-names")
            left = table.groupBy("unit")
            sent = left.cogroup(samples.groupBy("unit")).applyInArrow(_window_names(window, bits, below, wide), NAMES)
            firsts = stage(sent.groupBy("bucket").applyInArrow(_first_units(below, wide), REPLY), "suffix-firsts")
            both = samples.unionByName(firsts)
            done = left.cogroup(both.groupBy("unit")).applyInArrow(_removal(window, bits, below, wide, with_text), RESULT)
            result = stage(done, "suffix-result")
            drop(samples, firsts)
            return ids, result
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(spark, path)


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, their texts without repeated windows; n_chars, if there, is counted
    anew. Rows of which no word is left go; those that had none from the start stay."""
    _, results = removals(docs, window, False, id_col, text_col)
    r = results.where(F.col("n_bytes") >= window).select("sha", F.col("id").alias("owner"), F.col("span_starts").alias("starts"), F.col("span_ends").alias("ends"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    place = docs.columns.index(text_col)
    rows = docs.toDF(*names)
    text = F.coalesce(F.col(names[place]).cast("string"), F.lit(""))
    own = F.coalesce(F.col(names[docs.columns.index(id_col)]).cast("long"), F.lit((1 << 63) - 1))
    joined = rows.withColumn("sha", F.unhex(F.sha2(text.cast("binary"), 256))).join(r, "sha", "left")
    copy = F.col("owner").isNotNull() & (own != F.col("owner"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, names[place]):
            out, keep, columns = [], [], list(b.columns)
            gone, starts, ends = (c.to_pylist() for c in columns[-3:])
            for t, whole, s, e in zip(columns[place].to_pylist(), gone, starts, ends):
                if whole or s:
                    raw = t.encode()
                    t = "" if whole else b"".join(raw[x:y] for x, y in zip([0, *e], [*s, len(raw)])).decode("utf-8", "ignore")
                    keep.append(bool(t.split()))
                else:
                    keep.append(True)
                out.append(t)
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*columns[:-3], pa.array([bool(w or s) for w, s in zip(gone, starts)], pa.bool_())], [*names, "changed"]).filter(pa.array(keep, pa.bool_()))

    flat = joined.select(*(F.col(n).cast("string" if i == place else t).alias(n) for i, (n, (_, t)) in enumerate(zip(names, docs.dtypes))), copy.alias("gone"), "starts", "ends")
    schema = ", ".join(f"{n} {'string' if i == place else t}" for i, (n, (_, t)) in enumerate(zip(names, docs.dtypes)))
    out = flat.mapInArrow(run, schema + ", changed boolean")
    if "n_chars" in docs.columns:
        n = names[docs.columns.index("n_chars")]
        out = out.withColumn(n, F.when(F.col("changed"), F.length(names[place])).otherwise(F.col(n)).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*names).toDF(*docs.columns)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract of op7: a text's first copy has what its windows lose, all others lose every window."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids, results = removals(docs)
    r = results.select(F.col("sha").alias("key"), F.col("id").alias("first"), "n_removed", "n_spans", "kept_sha256")
    joined = ids.join(r, F.col("sha") == F.col("key"))
    copy = F.col("id") != F.col("first")
    whole = F.col("n_bytes") >= WINDOW
    return joined.select(
        F.nullif(F.col("id"), F.lit((1 << 63) - 1)).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.when(whole, F.col("n_bytes")).otherwise(0)).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.when(whole, 1).otherwise(0)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex("sha")))).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
