"""Best-fit packing by bin completion over the histogram of piece lengths.

Documents become token pieces of at most one sequence. Only lengths matter for where a piece can go, and there are no
more different ones than a sequence has tokens. So the search runs on the counts per length, whose size doesn't grow
with the corpus, and decides for whole groups of equal bins at once: around the largest remaining length it enumerates
undominated fillings of the gap, takes them in the order of their waste, and turns back where the waste spent already
exceeds what a solution better than the incumbent may waste. Best-fit decreasing gives the first incumbent.

Pieces then get their places by their rank among those of equal length, found with two small steps (counts per range
of a hash, then ranks within one), so that a length which most pieces have isn't gathered in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.shared import slices, stage
from riskweave.llm.tokens import encoder

CAPACITY = 4096
#: Text bytes tokenized together: each needs some dozen bytes of arrays.
TOKENIZED = 2 << 20
END = 1
#: Ranges of a hash among which the pieces of one length are dealt out for ranking.
RANGES = 512
#: Solutions that the search tries after its first if that misses the lower bound, and fillings at a node.
TRIES, WIDTH = 24, 4

Packed = list[tuple[tuple[int, ...], int]]  # (lengths in a bin, descending; number of such bins)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, crc[, ids]): the ids of a row's whole text, then END, cut only where over capacity."""
    schema = "id long, piece int, start long, length long, crc long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in slices(batches, "text", TOKENIZED):
            flat, at = encode.ids([x or "" for x in b.column(1).to_pylist()])
            rows: list[tuple] = []
            for i, doc in enumerate(b.column(0).to_pylist()):
                ids = np.append(flat[at[i] : at[i + 1]], np.uint32(END)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((doc, k, start, len(own), zlib.crc32(own.tobytes()), own.tolist() if with_ids else None))
            doc, k, start, n, crc, own = zip(*rows)
            columns = [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, n, crc))]
            names = ["id", "piece", "start", "length", "crc"]
            if with_ids:
                columns, names = [*columns, pa.array(own, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: int) -> Packed:
    """Best-fit decreasing, for groups of equal bins at once."""
    room: dict[int, Counter] = {}
    done: Counter = Counter()

    def put(bin_: tuple[int, ...], n: int) -> None:
        rest = capacity - sum(bin_)
        if rest < least:
            done[bin_] += n
        else:
            room.setdefault(rest, Counter())[bin_] += n

    least = min(counts, default=1)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = [r for r in room if r >= length]
            if not fits:
                each = min(capacity // length, left)
                put((length,) * each, left // each)
                left -= left // each * each
                continue
            r = min(fits)
            bin_, n = room[r].popitem()
            if not room[r]:
                del room[r]
            n_used = min(n, left)
            if n > n_used:
                room.setdefault(r, Counter())[bin_] += n - n_used
            put((*bin_, length), n_used)
            left -= n_used
    for bins in room.values():
        done.update(bins)
    return list(done.items())


def _pairs(count: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths that remain and fit the gap, the longest second piece beside each (0: none), and what both fill."""
    sizes = np.nonzero(count[: gap + 1] > 0)[0]
    below = np.zeros(gap + 1, np.int64)
    below[sizes] = sizes
    np.maximum.accumulate(below, out=below)
    second = below[gap - sizes]
    twice = (second == sizes) & (count[sizes] < 2)
    second[twice] = below[np.maximum(sizes[twice] - 1, 0)]
    return sizes, second, np.where(second > 0, sizes + second, 0)


def _longest(count: np.ndarray, gap: int) -> tuple[int, ...]:
    """The filling that ``fillings`` puts first for one try per step. A loop, as very short pieces make thousands of steps."""
    rest, steps, out = count.copy(), [], ()
    while gap > 0:
        if gap < len(rest) and rest[gap] > 0:
            out = (gap,)
            break
        sizes, second, pair = _pairs(rest, gap)
        if not sizes.size:
            break
        top, best = int(sizes[-1]), int(pair.max())
        base = (top,)
        if best > top:
            i = np.nonzero(pair >= best - (best < gap) * 2)[0][-1]
            if pair[i] > top:
                base = tuple(sorted((int(sizes[i]), int(second[i])), reverse=True))
        if best >= gap:
            out = base
            break
        steps.append((top, best, base))
        rest[top] -= 1
        gap -= top
    for top, best, base in reversed(steps):
        out = (top, *out) if top + sum(out) > best else base
    return out


def fillings(count: np.ndarray, gap: int, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Undominated fillings of ``gap`` from the lengths that remain, least waste first, ``width`` of them at most.

    One piece that fills the gap dominates all else. A pair no longer than the longest single piece that fits is
    dominated by it, and so on: only fillings longer than those of fewer pieces are kept.
    """
    if gap <= 0:
        return [()]
    if gap < len(count) and count[gap] > 0:
        return [(gap,)]
    sizes, second, pair = _pairs(count, gap)
    if not sizes.size:
        return [()]
    found: dict[tuple[int, ...], int] = {(int(sizes[-1]),): int(sizes[-1])}
    best = int(pair.max())
    if best > sizes[-1]:
        for a in sizes[pair >= best - (best < gap) * 2][::-1][:width]:
            b = int(second[np.searchsorted(sizes, a)])
            found[tuple(sorted((int(a), b), reverse=True))] = int(a) + b
    if best < gap:  # go on with the longest pieces, the rest filled likewise
        for a in sizes[::-1][:width]:
            rest = count.copy()
            rest[a] -= 1
            whole = tuple(sorted((int(a), *_longest(rest, gap - int(a))), reverse=True))
            if sum(whole) > best:
                found[whole] = sum(whole)
    return [f for f, _ in sorted(found.items(), key=lambda x: (-x[1], tuple(-y for y in x[0])))][:width]


def complete(counts: dict[int, int], capacity: int, turns: dict[int, int], most: int) -> tuple[Packed | None, int]:
    """One descent of the search: at decision d it takes filling ``turns.get(d, 0)``. None where the waste bound ``most`` cuts it."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        count[length] = n
    out: Packed = []
    waste = depth = 0
    top = capacity
    while True:
        while top and count[top] == 0:
            top -= 1
        if not top:
            return out, depth
        count[top] -= 1
        options = fillings(count, capacity - top)
        count[top] += 1
        bin_ = (top, *options[min(turns.get(depth, 0), len(options) - 1)])
        depth += 1
        need = Counter(bin_)
        n = min(int(count[x]) // k for x, k in need.items())
        waste += n * (capacity - sum(bin_))
        # the last bin may stay as empty as it is
        if waste - (capacity - sum(bin_)) > most:
            return None, depth
        for x, k in need.items():
            count[x] -= n * k
        out.append((bin_, n))


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Packed:
    """Bins for ``counts`` (pieces by length): branch and bound with discrepancies from the least waste, after best fit."""
    if not counts:
        return []
    total = sum(x * n for x, n in counts.items())
    bound = -(-total // capacity)
    # pieces over half a sequence can't share one
    bound = max(bound, sum(n for x, n in counts.items() if 2 * x > capacity))
    best = best_fit(counts, capacity)
    size = sum(n for _, n in best)
    turns: dict[int, int] = {}
    rng = np.random.default_rng(1)
    for _ in range(1 + TRIES):
        if size <= bound:
            break
        got, depth = complete(counts, capacity, turns, (size - 1) * capacity - total)
        if got and sum(n for _, n in got) < size:
            best, size = got, sum(n for _, n in got)
        turns = {int(rng.integers(0, max(1, depth))): int(rng.integers(1, WIDTH)) for _ in range(1 + int(rng.integers(0, 3)))}
    return best


def places(packed: Packed) -> tuple[np.ndarray, ...]:
    """Where ranks among pieces of equal length go: key (length << 44 | first rank), first sequence, pieces of that
    length per sequence, their first offset; sorted by key. At most some entries per different length and bin kind."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for bin_, n in packed:
        offset = 0
        for length, k in sorted(Counter(bin_).items(), reverse=True):
            rows.append((length << 44 | used[length], sequence, k, offset))
            used[length] += n * k
            offset += length * k
        sequence += n
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows))) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def assign(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``parts`` (id, piece, length, ...), a staged table. Collects one count per
    length, ``capacity`` at most."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, firsts, each, offsets = places(solve(counts, capacity))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(RANGES)).cast("int"))
    per = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    per = per.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    ranked = salted.join(per, ["length", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece")) - 1).select(*parts.columns, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            since = rank - (keys[at] & ((1 << 44) - 1))
            new = [pa.array(firsts[at] + since // each[at], pa.int64()), pa.array(offsets[at] + since % each[at] * length, pa.int64())]
            kept = [i for i, name in enumerate(b.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *new], [*(b.schema.names[i] for i in kept), "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in parts.dtypes)
    return ranked.mapInArrow(run, schema + ", sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, crc, sequence_id, offset of every row's pieces.

    A null or empty text is one piece of the end id alone; repeated rows and null ids are packed like any others
    (their pieces have equal ids); an empty table gives an empty result; other columns are ignored.
    """
    return assign(stage(pieces(docs, path, capacity, False, id_col, text_col), "pieces"), capacity)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Contract of op4 over the whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pack(docs, vocabulary())
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
