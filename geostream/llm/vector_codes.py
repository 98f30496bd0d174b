"""Product codes of vectors: codebooks by exact integer k-means with the adaptive bounds of Drake and Hamerly.

Each part of a vector keeps, from round to round, its entry, the b entries next to it with lower bounds of their distances in
ascending order, and one outer bound for all others. When entries move, bounds fall by the movements; the exact distance
to a part's own entry then says how many of the bounds it reaches. Those entries alone are compared, in integers; where
the outer bound is reached, all are. After a round b falls to the most that any part needed. What is uncertain by rounding
counts as reached, so that codes and errors are those of a full search.

References: J. Drake, G. Hamerly, Accelerated k-means with adaptive distance bounds, OPT 2012.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostream.llm.common import captured, release, stage

#: Components are multiples of 1/1024; beyond this integer they are cut off, so that they fit a long.
SCALE, LIMIT = 1024, 1 << 62
#: Relative error that is allowed to bounds: some units in the last place of single precision, in which they are stored.
SLACK = 1e-6
_LARGEST = (1 << 63) - 1


def whole_parts(values: np.ndarray, lengths: np.ndarray, width: int, parts: int) -> np.ndarray:
    """(rows, parts, width) integers floor(1024 x) of vectors back to back, zeros behind the end of shorter ones."""
    out = np.zeros((len(lengths), parts * width), np.int64)
    if len(values):
        x = np.floor(np.asarray(values, np.float64) * SCALE)
        whole = np.where(np.abs(x) < LIMIT, x, 0).astype(np.int64)
        whole[x >= LIMIT], whole[x <= -LIMIT] = LIMIT, -LIMIT
        begin = np.cumsum(lengths) - lengths
        out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(begin, lengths)] = whole
    return out.reshape(len(lengths), parts, width)


def in_doubles(x: np.ndarray, entries: np.ndarray) -> bool:
    """Whether all sums of squared distances of the rows of both stay below 2**53."""
    top = max((int(np.abs(v).max()) for v in (x, entries) if v.size), default=0)
    return 4 * max(1, x.shape[-1]) * top * top < 1 << 53


def squared(x: np.ndarray, entries: np.ndarray, exact: bool) -> np.ndarray:
    """Exact squared distances of rows x (n, w) and entries (k, w) or (n, q, w): whole numbers in doubles if they fit, else Python integers."""
    x, entries = (v.astype(np.float64 if exact else object) for v in (x, entries))
    if entries.ndim == 2 and exact:
        return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None, :]
    off = x[:, None, :] - (entries[None] if entries.ndim == 2 else entries)
    return (off * off).sum(2) if off.shape[2] else np.zeros(off.shape[:2])


def _below(d2: np.ndarray) -> np.ndarray:
    return (np.sqrt(d2.astype(np.float64)) * (1 - SLACK)).astype(np.float32)


def _above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + SLACK)


class State:
    """Entry, near entries, bounds and exact squared distance of one part of each row of a batch."""

    def __init__(self, own, near, low, outer, d2):
        self.own, self.near, self.low, self.outer, self.d2 = own, near, low, outer, d2


def full_search(x: np.ndarray, entries: np.ndarray, b: int, exact: bool) -> State:
    """State of rows that are compared with every entry; ties go to the lower index."""
    d2 = squared(x, entries, exact)
    order = np.argsort(d2, axis=1, kind="stable")
    ranked = np.take_along_axis(d2, order, axis=1)
    low = _below(ranked[:, 1 : b + 1])
    outer = _below(ranked[:, b + 1]) if ranked.shape[1] > b + 1 else np.full(len(x), np.inf, np.float32)
    return State(order[:, 0].astype(np.int64), order[:, 1 : b + 1].astype(np.int64), low, outer, ranked[:, 0])


def _ascending(low: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Bounds with the outer one behind them, none above a later one: each holds for all entries from its place on."""
    return np.minimum.accumulate(np.concatenate([low, outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]


def adapt(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, s: State, b: int, exact: bool) -> tuple[State, int]:
    """(state after entries moved, most of the b near entries that a row had to be compared with). moved: upper bounds of the movements."""
    held = _ascending(s.low.astype(np.float64), s.outer.astype(np.float64))
    near = s.near[:, :b]
    bounds = _ascending(held[:, :b] - moved[near], held[:, b] - moved.max(initial=0.0)) * (1 - SLACK)
    d2 = squared(x, entries[s.own][:, None, :], exact)[:, 0]
    reached = (bounds <= _above(d2)[:, None]).sum(axis=1)  # of b near entries; b + 1: the outer bound too
    out = State(s.own.copy(), near.copy(), bounds[:, :b].astype(np.float32), bounds[:, b].astype(np.float32), d2)
    for q in np.unique(reached[(reached > 0) & (reached <= b)]).tolist():
        rows = np.flatnonzero(reached == q)
        tried = np.concatenate([s.own[rows][:, None], near[rows][:, :q]], axis=1)
        tried.sort(axis=1)  # so that a stable sort by distance leaves ties to the lower index
        found = squared(x[rows], entries[tried], exact)
        order = np.argsort(found, axis=1, kind="stable")
        tried, found = (np.take_along_axis(v, order, axis=1) for v in (tried, found))
        out.own[rows], out.d2[rows] = tried[:, 0], found[:, 0]
        out.near[rows, :q] = tried[:, 1:]
        out.low[rows, :q] = _below(found[:, 1:])
    if len(rows := np.flatnonzero(reached > b)):
        anew = full_search(x[rows], entries, b, exact)
        out.own[rows], out.near[rows], out.low[rows], out.outer[rows], out.d2[rows] = anew.own, anew.near, anew.low, anew.outer, anew.d2
    return out, int(reached[reached <= b].max(initial=0))


#: kind 0: a vector with the state of its parts; kind 1: sums of a task's parts by entry, and the most near entries used.
ROUND = "kind int, vec_id long, label string, vector binary, own binary, near binary, low binary, outer binary, error decimal(38,0), part int, entry int, n long, used int, sums array<decimal(38,0)>"


def _assign(books: np.ndarray, before: np.ndarray | None, b: int, last: bool):
    """A round: assign every part to books (parts, k, width), by bounds if books were before a round ago; b near entries are kept. last: errors in place of state and sums."""
    parts, k, width = books.shape
    schema = pa.schema([("kind", pa.int32()), ("vec_id", pa.int64()), ("label", pa.string()), *[(c, pa.binary()) for c in ("vector", "own", "near", "low", "outer")], ("error", pa.decimal128(38, 0)), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("used", pa.int32()), ("sums", pa.list_(pa.decimal128(38, 0)))])
    moved = None if before is None else [_above(squared_pairs(books[p], before[p])) for p in range(parts)]

    def table(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches):
        sums, counts, used = np.zeros((parts, k, width), object), np.zeros((parts, k), np.int64), 0
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<i8").reshape(m, parts, width)
            states = []
            if before is not None:
                own, near, low, outer = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in (("own", np.uint8), ("near", np.uint8), ("low", "<f4"), ("outer", "<f4")))
                own, near, low, outer = own.reshape(m, parts).astype(np.int64), near.reshape(m, parts, len(near) // (m * parts)).astype(np.int64), low.reshape(m, parts, len(low) // (m * parts)), outer.reshape(m, parts)
            for p in range(parts):
                exact = in_doubles(x[:, p], books[p])
                if before is None:
                    states.append(full_search(x[:, p], books[p], b, exact))
                else:
                    s, most = adapt(x[:, p], books[p], moved[p], State(own[:, p], near[:, p], low[:, p], outer[:, p], None), b, exact)
                    states.append(s)
                    used = max(used, most)
                if not last:
                    small = int(np.abs(x[:, p]).max(initial=0)) * m < 1 << 62
                    batch_sums = np.zeros((k, width), np.int64 if small else object)
                    np.add.at(batch_sums, states[p].own, x[:, p] if small else x[:, p].astype(object))
                    sums[p] += batch_sums.astype(object)
                    counts[p] += np.bincount(states[p].own, minlength=k)
            pack = lambda values, kind: [row.tobytes() for row in np.stack(values, axis=1).astype(kind)]
            out = {"kind": np.zeros(m, np.int32), "vec_id": batch.column("vec_id"), "label": batch.column("label"), "own": pack([s.own for s in states], np.uint8)}
            if last:
                whole = all(s.d2.dtype != object for s in states)
                out["error"] = pa.array(sum(s.d2.astype(np.int64) for s in states), pa.int64()).cast(pa.decimal128(38, 0)) if whole else [Decimal(int(e)) for e in sum(s.d2.astype(object) for s in states)]
            else:
                out |= {"vector": batch.column("vector"), "near": pack([s.near for s in states], np.uint8), "low": pack([s.low for s in states], "<f4"), "outer": pack([s.outer for s in states], "<f4")}
            yield table(**out)
        part, entry = np.nonzero(counts)
        if len(part):
            yield table(kind=np.ones(len(part), np.int32), part=part.astype(np.int32), entry=entry.astype(np.int32), n=counts[part, entry], used=np.full(len(part), used, np.int32), sums=[[Decimal(int(v)) for v in sums[i, j]] for i, j in zip(part, entry)])

    return run


def squared_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of equally many rows of a and b."""
    off = a.astype(object) - b.astype(object)
    return np.array([sum(int(v) * int(v) for v in row) for row in off], object)


def _integers(width: int, parts: int):
    def run(batches):
        for batch in batches:
            vector = batch.column("vector")
            x = whole_parts(vector.flatten().to_numpy(zero_copy_only=False), vector.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), width, parts)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([row.astype("<i8").tobytes() for row in x], pa.binary())], ["vec_id", "label", "vector"])

    return run


def moved_books(books: np.ndarray, sums: list) -> np.ndarray:
    """Each entry that has parts becomes the floor of their mean, component by component; others stay. sums: (part, entry, n, sums)."""
    out = books.copy()
    for part, entry, n, total in sums:
        out[part, entry] = [int(v) // n for v in total]
    return out


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def fine(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, near: int = 16) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each vector without null or non-finite components; others are left out.

    Components become floor(1024 x), vectors parts pieces of equal width; a shorter vector, or one whose length parts doesn't
    divide, has zeros behind its end, so that all have the width of the longest (an empty one is all zeros). The codebooks start with
    the vectors of the smallest ids (ties by the vector, a null id behind all others); with fewer than entries vectors they
    have fewer entries. rounds times all parts go to the nearest entry (ties: lower index) and entries to the floor of their
    mean; then parts are assigned again. code: two hex digits for each part; error: squared distances of all parts, at most 2**63 - 1;
    label_error: error summed over the label, null labels together, at most 2**63 - 1. Components beyond 2**52 are cut off
    there. Repeated rows are vectors of their own. No vectors: no rows. Other columns are ignored.

    near: b of the first round. A round reads the state of all parts from the shared folder and writes the next, some
    parts * (10 + 5 near) bytes for each vector beside its integers; tasks hold the codebooks, 8 * entries * length bytes, and
    give sums by entry, of which entries * parts rows come to the driver. Nothing else is gathered anywhere.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number has two hex digits: from 1 to 256 entries")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).filter(fine(F.col("vector")))
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    lengths = np.array([len(r[0]) for r in first], np.int64)
    books = whole_parts(np.concatenate([np.zeros(0), *[np.array(r[0], np.float64) for r in first]]), lengths, width, parts).transpose(1, 0, 2).copy()
    if not first:
        books = np.zeros((parts, 1, width), np.int64)
    state, before, scratch = rows.mapInArrow(_integers(width, parts), "vec_id long, label string, vector binary"), None, []
    b = min(near, books.shape[1] - 1)
    for turn in range(rounds + 1):
        with captured(latest := []):
            done = stage(state.mapInArrow(_assign(books, before, b, turn == rounds), ROUND), "vector-codes")
        release(spark, scratch)
        scratch = latest
        if turn == rounds:
            break
        sums = done.filter("kind = 1").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("used").alias("used"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums") if width else F.array().cast("array<decimal(38,0)>").alias("sums")).collect()  # entries * parts rows
        if turn:
            b = min(b, max([1, *(r["used"] for r in sums)]))
        before, books = books, moved_books(books, [(r["part"], r["entry"], r["n"], r["sums"]) for r in sums])
        state = done.filter("kind = 0").select("vec_id", "label", "vector", "own", "near", "low", "outer")
    coded = done.filter("kind = 0").select("vec_id", "label", F.lower(F.hex("own")).alias("code"), "error")
    totals = stage(coded.groupBy("label").agg(F.sum("error").alias("total")), "vector-label-errors")
    long = lambda c: F.least(F.col(c), F.lit(Decimal(_LARGEST))).cast("long")
    joined = coded.alias("c").join(totals.alias("t"), F.col("c.label").eqNullSafe(F.col("t.label")))
    return joined.select("vec_id", "code", long("error").alias("error"), long("total").alias("label_error"), F.lit(books_digest(books)).alias("codebooks_sha256"))
