"""Quality classifier by an interpolated modified Kneser-Ney n-gram model (operator 3).

The units are UTF-8 bytes, ``ORDER`` to an n-gram, so that unseen words are judged by their letters; a text has
``ORDER - 1`` zero bytes before it and one after it. An n-gram is one long, its context a shift and its shorter
suffixes masks, so all of the model is counts in tables joined by keys.

1. Counts: every task adds up the n-grams of its texts, and how often trusted texts have them; a grouped
   sum makes one table. Trusted are documents with label quality = 1, but for the held-out fold, which
   calibrates. It follows the corpus: no sample, no bound.
2. Model: raw counts for the highest order, continuation counts below, three discounts for each order from
   its counts of counts, and interpolation down to the uniform distribution over bytes. Each order is a few
   joins by n-gram and context, sharded by these keys.
3. Scores: texts are dealt into blocks of about ``BLOCK`` bytes, compressed on the way; each block's distinct
   n-grams join the model and come back to the block, which adds up the log probabilities of its texts.
4. Thresholds: the ``QUANTILE`` of the perplexities of held-out trusted texts of the language. It is no language's largest
   value, for languages with fewer than ``MIN_CALIBRATION`` such texts take the quantile over all languages. Short
   texts' perplexities spread widely: one of fewer than ``MIN_BYTES`` bytes neither calibrates nor is rejected. Every text is kept when nothing was trusted.

A null text counts as empty. Rows repeating an id are scored each for itself; null ids are scored and never
trusted; an id labelled several times is trusted if one label says so. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.llm.common import fold, language, saved, text_key, texts_of, tidy, tidy_group

ORDER = 5
BLOCK = 16 << 20
QUANTILE = 0.995
MIN_CALIBRATION = 400
MIN_BYTES = 200
#: Trusted ids go to the scan as a broadcast up to so many, else by a join.
BROADCAST_IDS = 4_000_000
#: Bytes that a row counts in its block beside its text.
ROW = 64
_CHUNK = 1 << 20
_FLUSH = 1 << 19


def ngrams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at each byte of each text and at its end, and how many each text has."""
    pad = bytes(order - 1)
    joined = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    keys = np.zeros(max(0, len(joined) - order + 1), np.int64)
    for j in range(order):
        keys = keys << 8 | joined[j : j + len(keys)]
    starts = np.cumsum(sizes + order - 1) - (sizes + order - 1)  # a text's n-grams start at its padding
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return keys[at], sizes


def _chunks(texts: list[bytes]):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > _CHUNK:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _counts(order: int):
    def run(batches):
        import pyarrow as pa

        key, count = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            k = np.concatenate([key, *(a for a, _ in waiting)])
            c = np.concatenate([count, *(b for _, b in waiting)])
            u, inverse = np.unique(k, return_inverse=True)
            return u, np.bincount(inverse, weights=c, minlength=len(u)).astype(np.int64)

        def out(k, c):
            for i in range(0, len(k), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 200_000]), pa.array(c[i : i + 200_000])], ["g", "c"])

        for batch in batches:
            texts, trusted = texts_of(batch.column(0)), batch.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                keys, sizes = ngrams(texts[lo:hi], order)
                own = np.repeat(np.array(trusted[lo:hi], bool), sizes)
                k, n = np.unique(keys[own], return_counts=True)
                waiting.append((k, n))
                k = np.unique(keys[~own])
                waiting.append((k, np.zeros(len(k), np.int64)))
                size += len(n) + len(k)
                if size > _FLUSH:
                    key, count = merged()
                    waiting, size = [], 0
                    if len(key) > 2 * _FLUSH:
                        yield from out(key, count)
                        key, count = key[:0], count[:0]
        yield from out(*merged())

    return run


def _discounts(table: DataFrame) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (x or 0 for x in table.agg(*(F.count_if(F.col("c") == i) for i in range(1, 5))).first())
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1, d2, d3 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9
    return min(max(d1, 0.05), 1.0), min(max(d2, 0.05), 2.0), min(max(d3, 0.05), 3.0)


def model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, logp) for every n-gram in ``counts`` (g, c), trusted or not."""
    tables = {order: saved(counts.filter("c > 0").select("g", "c"), "kn-counts")}
    for k in range(order - 1, 0, -1):
        mask = (1 << (8 * k)) - 1
        tables[k] = saved(tables[k + 1].groupBy(F.col("g").bitwiseAND(F.lit(mask)).alias("g")).agg(F.count("*").alias("c")), "kn-counts")
    wanted = {order: counts.select("g")}
    for k in range(order - 1, 0, -1):
        mask = (1 << (8 * k)) - 1
        wanted[k] = saved(wanted[k + 1].select(F.col("g").bitwiseAND(F.lit(mask)).alias("g")).distinct(), "kn-wanted")
    lower = None
    for k in range(1, order + 1):
        d1, d2, d3 = _discounts(tables[k])
        c = F.col("c")
        discount = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        context = F.shiftright("g", 8).alias("context")
        totals = tables[k].groupBy(context).agg(F.sum("c").alias("total"), F.sum(discount).alias("free"))
        entries = tables[k].withColumn("above", F.greatest(c - discount, F.lit(0.0))).select("g", "above")
        rows = wanted[k].withColumn("context", F.shiftright("g", 8)).join(totals, "context", "left").join(entries, "g", "left")
        if lower is None:
            below = rows.withColumn("p0", F.lit(1 / 256))
        else:
            mask = (1 << (8 * (k - 1))) - 1
            below = rows.withColumn("h", F.col("g").bitwiseAND(F.lit(mask))).join(lower.select(F.col("g").alias("h"), F.col("p").alias("p0")), "h")
        p = F.when(F.col("total").isNull(), F.col("p0")).otherwise((F.coalesce("above", F.lit(0.0)) + F.col("free") * F.col("p0")) / F.col("total"))
        lower = saved(below.select("g", p.alias("p")), "kn-p")
    return lower.select("g", F.log("p").cast("float").alias("logp"))


_LISTS = {"ids": "bigint", "keys": "bigint", "langs": "string", "copies": "bigint", "sizes": "bigint"}


def _blobs(batches):
    """Texts of a task gathered by block and compressed; rows that are equal in id, language and text once, with their number."""
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "string": pa.string()}

    def out(waiting):
        blocks = list(waiting)
        for i in range(0, len(blocks), 64):
            some = [[(*row, n, len(text)) for (*row, text), n in waiting[b].items()] for b in blocks[i : i + 64]]
            blobs = [pa.compress(b"".join(text for *_, text in waiting[b]), codec="zstd", asbytes=True) for b in blocks[i : i + 64]]
            lists = [pa.array([[x[k] for x in own] for own in some], pa.list_(kinds[t])) for k, t in enumerate(_LISTS.values())]
            yield pa.RecordBatch.from_arrays([pa.array(blocks[i : i + 64], pa.int32()), *lists, pa.array(blobs, pa.binary())], ["block", *_LISTS, "data"])

    waiting: dict[int, dict] = {}
    size = 0
    for batch in batches:
        for b, *row, text in zip(*(batch.column(k).to_pylist() for k in range(4)), texts_of(batch.column(4))):
            own = waiting.setdefault(b, {})
            row = (*row, text)
            if row not in own:
                size += len(text) + ROW
            own[row] = own.get(row, 0) + 1
        if size > 24 << 20:
            yield from out(waiting)
            waiting, size = {}, 0
    yield from out(waiting)


def _unpacked(table) -> tuple[dict[str, list], list[bytes]]:
    """The lists and the texts of a block."""
    import pyarrow as pa

    lists = {c: [x for own in table[c].to_pylist() for x in own] for c in _LISTS}
    texts = []
    for sizes, data in zip(table["sizes"].to_pylist(), table["data"].to_pylist()):
        total, at = sum(sizes), 0
        whole = pa.decompress(data, decompressed_size=total, codec="zstd", asbytes=True) if total else b""
        for size in sizes:
            texts.append(whole[at : at + size])
            at += size
    return lists, texts


def _distinct(order: int):
    def run(key, table):
        import pyarrow as pa

        _, texts = _unpacked(table)
        found = np.empty(0, np.int64)
        waiting = []
        for lo, hi in _chunks(texts):
            waiting.append(np.unique(ngrams(texts[lo:hi], order)[0]))
            if len(waiting) == 8:
                found, waiting = np.unique(np.concatenate([found, *waiting])), []
        found = np.unique(np.concatenate([found, *waiting]))
        return pa.table({"block": pa.array(np.full(len(found), key[0].as_py(), np.int32)), "g": pa.array(found)})

    return run


def _sums(order: int):
    def run(left, right):
        import pyarrow as pa

        lists, texts = _unpacked(left)
        g, logp = right["g"].to_numpy(), right["logp"].to_numpy().astype(np.float64)
        by = np.argsort(g)
        g, logp = g[by], logp[by]
        total, n = [], []
        for lo, hi in _chunks(texts):
            keys, sizes = ngrams(texts[lo:hi], order)
            some, inverse = np.unique(keys, return_inverse=True)
            each = logp[np.searchsorted(g, some)][inverse]
            total.append(np.add.reduceat(each, np.cumsum(sizes) - sizes))
            n.append(sizes)
        total = np.concatenate(total) if total else np.empty(0)
        n = np.concatenate(n) if n else np.empty(0, np.int64)
        copies = np.array(lists["copies"], np.int64)
        perplexity = np.exp(-total / np.maximum(n, 1))
        same = pa.array(np.repeat(np.arange(len(copies)), copies))
        whole = pa.table({"row": pa.array(lists["ids"], pa.int64()), "text_key": pa.array(lists["keys"], pa.int64()), "lang": pa.array(lists["langs"], pa.string()), "n_bytes": pa.array(n - 1, pa.int64()), "perplexity": pa.array(perplexity, pa.float64())})
        return whole.take(same)

    return run


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, text_key, lang, n_bytes, perplexity) of every row of docs (doc_id, lang, text), by the model of the trusted ids."""
    n_ids = trusted.count()
    ids = trusted.select("doc_id", F.lit(True).alias("trusted"))
    known = docs.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "doc_id", "left")
    flagged = known.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counted = flagged.mapInArrow(tidy("kn", _counts(order)), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    probabilities = model(saved(counted, "kn-ngrams"), order)
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW)).first()[0] or 0
    n_blocks = int(max(1, -(-size // BLOCK)))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"), "doc_id", text_key("text").alias("key"), "lang", "text")
    lists = ", ".join(f"{c} array<{t}>" for c, t in _LISTS.items())
    blocks = dealt.mapInArrow(tidy("kn", _blobs), f"block int, {lists}, data binary")
    some = blocks.groupBy("block").applyInArrow(tidy_group("kn", _distinct(order)), "block int, g long")
    needed = some.join(probabilities, "g").select("block", "g", "logp")
    scored = blocks.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(tidy_group("kn", _sums(order)), "row long, text_key long, lang string, n_bytes long, perplexity double")
    return scored.withColumnRenamed("row", "doc_id")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, text_key, lang, n_bytes, perplexity, threshold, kept: one row per document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), language(lang_col).alias("lang"))
    good = saved(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("doc_id is not null and quality = 1").select("doc_id").distinct(), "kn-good")
    scored = saved(perplexities(docs, good.filter(fold("doc_id") != 0)), "kn-scored")
    held = saved(scored.filter(F.col("n_bytes") >= MIN_BYTES).join(good.filter(fold("doc_id") == 0), "doc_id").select("lang", "perplexity"), "kn-held")
    at = F.percentile_approx("perplexity", QUANTILE, 10_000)
    overall = held.agg(at.alias("t")).first()["t"]
    own = held.groupBy("lang").agg(at.alias("t"), F.count("*").alias("n")).filter(F.col("n") >= MIN_CALIBRATION).select("lang", F.col("t").alias("own"))
    judged = scored.join(own, "lang", "left").withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")))
    kept = F.col("threshold").isNull() | (F.col("n_bytes") < MIN_BYTES) | (F.col("perplexity") <= F.col("threshold"))
    return judged.select("doc_id", "text_key", "lang", "n_bytes", "perplexity", "threshold", kept.alias("kept"))
