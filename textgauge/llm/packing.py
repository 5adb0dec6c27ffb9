"""Packing documents into token sequences by a linear grouping scheme (operator 2).

A document's ids are those of its text (null: empty) and an end id. Documents longer than a sequence are
cut into full pieces after a first piece that may be shorter; nothing else is cut.

What must be packed is known from how many pieces there are of each length, a table of at most
``capacity`` rows at any corpus size. From it the driver plans:

1. pieces over a part of the capacity (``SMALL``) are sorted by length and divided into ``GROUPS`` groups of equal
   cardinality; each group's lengths are rounded up to its largest;
2. the configurations of these few sizes are optimised as a linear program by column generation
   (a knapsack prices new configurations) and rounded down;
3. the configurations get the actual lengths of the groups instead of the rounded ones;
4. what rounding down left over and the small pieces go, longest first, where they fit best.

The plan is a short list of runs (configuration, number of sequences, first sequence). Pieces get their
places without being gathered: each takes its rank among the pieces of its length, counted by partition,
and the rank gives the run, sequence and offset.

An empty table gives an empty result; an empty text is the end id alone; rows repeating an id, or without
one, are packed each for itself. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textgauge.llm.common import saved, tidy
from textgauge.llm.tokens import byte_level_chunks, encoder, str_texts

CAPACITY = 1024
GROUPS = 72
#: Pieces up to the capacity divided by one of these are small; the plan with the fewest sequences is taken.
SMALL = (2, 4)
END_ID = 2

Run = tuple[tuple[int, ...], int]


def grouped(lengths: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """(length, count), longest first, as groups of equal cardinality, each a list of [length, count]."""
    total = sum(n for _, n in lengths)
    size = max(1, -(-total // groups))
    out: list[list[list[int]]] = []
    room = 0
    for length, n in lengths:
        while n:
            if not room:
                out.append([])
                room = size
            took = min(n, room)
            out[-1].append([length, took])
            n, room = n - took, room - took
    return out


def best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits, by dynamic programming over the room used."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    gain = np.maximum(value, 0)
    for room in range(int(sizes.min()), capacity + 1):
        fits = sizes <= room
        options = np.where(fits, best[np.where(fits, room - sizes, 0)] + gain, -1.0)
        i = int(options.argmax())
        if options[i] > best[room - 1] + 1e-12:
            best[room], took[room] = options[i], i
        else:
            best[room], took[room] = best[room - 1], -1
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= int(sizes[took[room]])
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, steps: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each: the linear program's optimum by column generation."""
    s, d = np.array(sizes), np.array(demand, float)
    k = len(s)
    basis = np.diag(capacity // s).astype(float)
    inverse = np.linalg.inv(basis)
    for step in range(steps):
        duals = inverse.sum(axis=0)
        value, column = best_configuration(s, duals, capacity)
        if value <= 1 + 1e-9:
            break
        x, move = inverse @ d, inverse @ column
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        row = inverse[out] / move[out]
        inverse = inverse - np.outer(move, row)
        inverse[out] = row
        if step % 64 == 63:
            inverse = np.linalg.inv(basis)
    x = np.linalg.solve(basis, d)
    return [(basis[:, j].astype(int), float(x[j])) for j in range(k)]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: tuple[int, ...] = SMALL) -> list[Run]:
    """Runs (lengths in a sequence, how many such sequences) that hold every piece. ``small`` has the
    divisors of the capacity that are tried as the border of small pieces."""
    return min((plan_at(counts, capacity, groups, capacity // s) for s in small), key=lambda runs: sum(n for _, n in runs))


def plan_at(counts: dict[int, int], capacity: int, groups: int, small: int) -> list[Run]:
    runs: list[Run] = [((capacity,), counts[capacity])] if counts.get(capacity) else []
    large = [(n, c) for n, c in sorted(counts.items(), reverse=True) if small < n < capacity and c]
    left = {n: c for n, c in counts.items() if n <= small and c}
    by_slack: list[list[list]] = [[] for _ in range(capacity + 1)]

    def put(pattern: tuple[int, ...], n: int) -> None:
        if n:
            by_slack[capacity - sum(pattern)].append([pattern, n])

    if large:
        members = grouped(large, groups)
        chosen = configurations([g[0][0] for g in members], [sum(c for _, c in g) for g in members], capacity)
        for column, x in sorted(chosen, key=lambda y: -y[1]):
            n = int(x + 1e-7)
            slots = [i for i, c in enumerate(column) for _ in range(c)]
            n = min([n, *(sum(c for _, c in members[i]) // column[i] for i in set(slots))])
            taken = []
            for i in slots:  # the next n actual lengths of the group
                need, own = n, []
                while need:
                    head = members[i][0]
                    c = min(need, head[1])
                    own.append([head[0], c])
                    head[1] -= c
                    need -= c
                    if not head[1]:
                        members[i].pop(0)
                taken.append(own)
            while n:
                c = min(own[0][1] for own in taken)
                put(tuple(sorted((own[0][0] for own in taken), reverse=True)), c)
                n -= c
                for own in taken:
                    own[0][1] -= c
                    if not own[0][1]:
                        own.pop(0)
        for g in members:
            for length, c in g:
                left[length] = left.get(length, 0) + c
    for length in sorted(left, reverse=True):
        c = left[length]
        slack = length
        while c:
            while slack <= capacity and not by_slack[slack]:
                slack += 1
            if slack > capacity:
                each = capacity // length
                put((length,) * each, c // each)
                put((length,) * (c % each), 1 if c % each else 0)
                break
            pattern, n = by_slack[slack].pop()
            took = min(c, n)
            if n > took:
                by_slack[slack].append([pattern, n - took])
            put((*pattern, length), took)
            c -= took
            slack = min(slack, max(length, slack - length))
    return runs + [(tuple(p), n) for runs_of in by_slack for p, n in runs_of]


def slots(runs: list[Run], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """For each length its places: from rank ``rank`` on, sequences from ``first`` on at ``offset``.
    Sorted by (length, rank)."""
    rows, ranks, first = [], {}, 0
    for pattern, n in runs:
        offset = 0
        for length in pattern:
            rank = ranks.get(length, 0)
            rows.append((length, rank, first, offset))
            ranks[length] = rank + n
            offset += length
        first += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "first": a[:, 2], "offset": a[:, 3]}


def _pieces(path: str, capacity: int, end: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, totals = encoder(path, byte_level_chunks).encode(str_texts(batch.column(1)), end)
            own, piece, start, length, crc = [], [], [], [], []
            base = 0
            for row, n in enumerate(totals.tolist()):
                at, i = 0, 0
                while at < n:
                    size = capacity if at or n % capacity == 0 else n % capacity
                    own.append(row)
                    piece.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[base + at : base + at + size]))
                    at, i = at + size, i + 1
                base += n
            sizes = np.array(length, np.int64)
            order = np.argsort(sizes, kind="stable")
            ordered = sizes[order]
            firsts = np.searchsorted(ordered, ordered)
            local = np.empty(len(sizes), np.int64)
            local[order] = np.arange(len(sizes)) - firsts + seen[ordered]
            seen += np.bincount(sizes, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(np.full(len(sizes), part, np.int32)), pa.array(local)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"],
            )

    return run


def _places(places: dict[str, np.ndarray]):
    def run(batches):
        import pyarrow as pa

        key = places["length"] << 44 | places["rank"]
        for batch in batches:
            rank = batch.column("local").to_numpy() + batch.column("before").to_numpy()
            at = np.searchsorted(key, batch.column("length").to_numpy() << 44 | rank, side="right") - 1
            sequence = places["first"][at] + rank - places["rank"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(places["offset"][at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, groups: int = GROUPS, end: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = saved(docs.mapInArrow(tidy("pack", _pieces(tokenizer, capacity, end)), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"), "pack-pieces")
    by_part = saved(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "pack-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = slots(plan(counts, capacity, groups), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "pack-offsets")
    ranked = cut.join(offsets, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", "local", "before")
    return ranked.mapInArrow(tidy("place", _places(places)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
