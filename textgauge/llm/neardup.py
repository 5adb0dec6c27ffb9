"""MinHash near-duplicate detection with fast similarity sketches (operator 8).

A document's set holds its distinct k-word shingles (words are split at ASCII white space, A-Z lower-cased);
with fewer than k words the whole sequence is its one shingle; with no words the set is empty and the
document is linked with nothing. Documents are linked if 100 * |A & B| >= percent * |A | B|, confirmed on
the full sets of words, never on hashes alone.

Steps, each a distributed table:

1. sketch: ``SKETCH`` bins are filled in rounds. In round i < t every shingle is hashed to one bin with the
   value (i, hash); in round t + b every shingle competes for bin b. So each bin fills at the latest in
   round 2t, most documents end after a few rounds, and equal coordinates estimate the Jaccard similarity
   with the concentration of independent samples.
2. copies: documents of one set collapse to the smallest id (128-bit set fingerprint, pre-aggregated).
3. banding: ``BANDS`` bands of ``ROWS`` coordinates; a pair at 0.8 shares no band with chance 7e-6.
4. verification: in each bucket all members are tested with one pivot, the smallest id, which joins most
   copies at once. Then buckets that still hold several components are cut into tiles; a tile compares the
   sketches of members of different components. Only pairs that agree in fewer than ``AGREE`` of the
   coordinates, 4.5 standard deviations below what 0.8 gives, are left out (chance 4e-6 for a pair at
   0.8); the others are tested, each in the first band it shares, the most similar first, unless tests of
   the same tile have connected them by then. No cap on members, candidates or pairs.
5. components by alternating large-star and small-star steps over the confirmed links.

Nulls and ties: a null or blank text has an empty set; rows with a null id are returned with a null
component and kept = false and link nothing; rows repeating an id count as one document. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.llm.common import mix, saved, texts_of, tidy

ROWS = 5
BANDS = 30
SKETCH = ROWS * BANDS
#: Sketch coordinates that a pair must share to be tested beyond the pivots.
AGREE = 98
#: Members of a bucket in a tile.
TILE = 1024
#: Bits of the filter of ids whose texts are needed again.
FILTER_BITS = 1 << 26

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a document's shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = len(h) - k + 1
    if n < 1:
        k, n = len(h), 1
    x = mix(h[:n] ^ np.uint64(k))
    for j in range(1, k):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(x)


def sketches(sets: list[np.ndarray], t: int = SKETCH) -> np.ndarray:
    """One row of t filled coordinates for each non-empty set (empty sets keep the empty value)."""
    n = len(sets)
    out = np.full(n * t, _EMPTY, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    x = np.concatenate(sets) if n else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(n), sizes)
    low = np.uint64((1 << 40) - 1)
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x ^ mix(np.full(1, i + 1, np.uint64)))
        value = (h & low) | np.uint64(i << 40)
        bins = ((h >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24) if i < t else np.full(len(x), i - t, np.uint64)
        np.minimum.at(out, doc * t + bins.astype(np.int64), value)
        open_docs = (out.reshape(n, t) == _EMPTY).any(axis=1)
        keep = open_docs[doc]
        if not keep.all():
            x, doc = x[keep], doc[keep]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.empty((len(sketch), bands), np.uint64)
    for b in range(bands):
        x = np.full(len(sketch), b + 1, np.uint64)
        for j in range(rows):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + sketch[:, b * rows + j])
        keys[:, b] = x
    return keys.view(np.int64)


def _sketch_batches(k: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_hashes(t.lower().split(), k) for t in texts_of(batch.column(1))]
            keys = band_keys(sketches(sets))
            marks = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                ["id", "n", "mark", "bands"],
            )

    return run


def _confirm(k: int, percent: int):
    def shingles(words: list[bytes]) -> set:
        return set(zip(*(words[j:] for j in range(k)))) if len(words) >= k else {tuple(words)}

    def run(batches):
        import pyarrow as pa

        last, known = None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            keep = []
            for x, s, t in zip(a.to_pylist(), ta.cast(pa.binary()).to_pylist(), tb.cast(pa.binary()).to_pylist()):
                if last != (x, s):
                    last, known = (x, s), shingles(s.lower().split())
                other = shingles(t.lower().split())
                both = len(known & other)
                keep.append(100 * both >= percent * (len(known) + len(other) - both))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets are similar enough."""
    text = saved(docs, "neardup-texts")
    left = text.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = text.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return saved(both.mapInArrow(tidy("neardup", _confirm(k, percent)), "a long, b long"), "neardup-links")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id on a link: the smallest id it is connected with."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc-edges")
    while True:
        n, n_ids = edges.agg(F.count("*"), F.countDistinct("u")).first()
        if n == n_ids and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break  # stars around their smallest ids
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.filter("u <> v").distinct(), "cc-large")
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _described(k: int):
    """Set, short sketch and band keys of single texts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_hashes(t.lower().split(), k) for t in texts_of(batch.column(1))]
            full = sketches(sets)
            keys = band_keys(full)
            short = (full & np.uint64(0xFFFF)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([r.tobytes() for r in short], pa.binary()), pa.array([r.tobytes() for r in keys], pa.binary())], ["id", "shingles", "short", "keys"])

    return run


def _rows(column, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _pairs(key, table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of a tile's pairs of different components whose sketches agree enough, in the first band they
    share, and in how many coordinates they agree."""
    bucket, i, j = (x.as_py() for x in key)
    side, ids, label = table["tile"].to_numpy(), table["id"].to_numpy(), table["label"].to_numpy()
    short, keys = _rows(table["short"], np.uint16, SKETCH), _rows(table["keys"], np.int64, BANDS)
    band = (keys == bucket).argmax(axis=1)
    rows, columns = np.flatnonzero(side == i), np.flatnonzero(side == j)
    a, b, agree = [], [], []
    for x in rows:
        ys = columns[(label[columns] != label[x]) & (ids[columns] > ids[x] if i == j else True)]
        if len(ys):
            n = (short[ys] == short[x]).sum(axis=1)
            ys, n = ys[n >= AGREE], n[n >= AGREE]
            first = (keys[ys] == keys[x]).argmax(axis=1) == band[x]
            a.append(np.full(first.sum(), x))
            b.append(ys[first])
            agree.append(n[first])
    return tuple(np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b, agree))


def _close(key, table):
    """The members of a tile that are in some pair."""
    a, b, _ = _pairs(key, table)
    return table.select(["bucket", "i", "j", "tile", "id", "label"]).take(np.unique(np.concatenate([a, b])))


def _tested(percent: int):
    def run(key, table):
        import pyarrow as pa

        sets = [frozenset(np.frombuffer(s, np.uint64).tolist()) for s in table["shingles"].to_pylist()]
        parent = list(range(len(sets)))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found = []
        a, b, agree = _pairs(key, table)
        for n in np.argsort(-agree, kind="stable").tolist():
            x, y = int(a[n]), int(b[n])
            if root(x) == root(y):
                continue
            both = len(sets[x] & sets[y])
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                parent[root(x)] = root(y)
                found.append((x, y))
        ids = table["id"].to_numpy()
        return pa.table({"a": pa.array([ids[x] for x, _ in found], pa.int64()), "b": pa.array([ids[y] for _, y in found], pa.int64())})

    return run


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents that have one of the ids, and a few others: a bitmap of fixed size, ``FILTER_BITS`` at any
    number of ids, drops most of the rest before their texts are dealt out."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    parts = ids.select(place.alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    for r in parts.collect():
        bitmap[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    # bit 0 of bucket 1 stands for 1: positions follow from the same functions as the bitmaps
    at = docs.withColumn("h", place).selectExpr("id", "text", "CAST((bitmap_bucket_number(h) - 1) * 32768 + bitmap_bit_position(h) AS BIGINT) AS h")

    def run(batches):
        import pyarrow as pa

        bits = shared.value
        for batch in batches:
            h = batch.column(2).to_numpy()
            keep = (bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["id", "text"]).filter(pa.array(keep.astype(bool)))

    return at.filter("id is not null and text is not null").mapInArrow(tidy("neardup", run), "id long, text string")


def _tile_links(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between members (bucket, id, label) of different components within a bucket."""
    about = saved(_only(docs, members.select("id").distinct()).mapInArrow(tidy("neardup", _described(k)), "id long, shingles binary, short binary, keys binary"), "neardup-described")
    sizes = saved(members.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "neardup-tiles")
    placed = members.join(sizes, "bucket").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select("bucket", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "label")
    rows = placed.join(about.select("id", "short", "keys"), "id")
    close = rows.groupBy("bucket", "i", "j").applyInArrow(_close, "bucket long, i int, j int, tile int, id long, label long")
    close = saved(close, "neardup-close")
    tested = close.join(about, "id").groupBy("bucket", "i", "j").applyInArrow(_tested(percent), "a long, b long")
    return saved(tested, "neardup-links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (see the module's text)."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = saved(docs.mapInArrow(tidy("neardup", _sketch_batches(k)), "id long, n long, mark binary, bands array<bigint>"), "neardup-sketch")
    some = sketched.filter("id is not null and mark is not null")
    reps = saved(some.groupBy("mark").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "neardup-reps")
    spread = saved(reps.select(F.explode("bands").alias("bucket"), F.col("rep").alias("id")).distinct(), "neardup-buckets")
    shared = saved(spread.groupBy("bucket").agg(F.count("*").alias("m"), F.min("id").alias("pivot")).filter("m > 1"), "neardup-shared")
    members = saved(spread.join(shared, "bucket"), "neardup-members")
    pairs = saved(members.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "neardup-pairs")
    links = _links(pairs, _only(docs, members.select("id").distinct()), k, percent)
    found = saved(components(links), "neardup-components")
    # Buckets of two are tested by now; of the others, those of several components are open.
    labelled = members.filter("m > 2").join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("label"))
    labelled = saved(labelled, "neardup-labelled")
    mixed = saved(labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket"), "neardup-mixed")
    more = _tile_links(saved(labelled.join(mixed, "bucket"), "neardup-open"), docs, k, percent)
    if not more.isEmpty():
        found = saved(components(links.unionByName(more)), "neardup-components")

    named = reps.select("mark", "rep")
    named = named.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("mark", F.coalesce("component", "rep").alias("component"))
    named = saved(named, "neardup-named")
    out = sketched.select("id", "n", "mark").join(named, "mark", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"),
    )
