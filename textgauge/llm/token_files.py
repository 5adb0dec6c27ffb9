"""Token ids as Parquet files for training readers (operator 9).

The format: one folder of Parquet files in ascending order of document id, each row a document with its id,
its place within the file, its number of ids and the ids as a list column. Token pages are dictionary
encoded as long as that is shorter, else delta encoded (writer version 2); ids, places and numbers of ids are delta encoded. Rows are grouped by a row group
size, pages by a page size and a number of rows, and page indexes let a reader skip to the pages of some documents (``read_tokens``), or read the
metadata columns without any token page (``read_metadata``).

Writing deals the documents out by ranges of their id, sorts each range, and encodes it. Where many rows repeat
an id or have none, ranges are also by a hash of the text, so that such rows needn't be in one task. Reading takes the
number of ids of each file first (metadata columns only), adds them up in file order, and so knows each
document's start without a global sort.

A null text counts as empty and has the end id alone; a null id sorts first; rows repeating an id are kept,
in the order of a hash of their texts. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textgauge.llm.common import saved, scratch, tidy
from textgauge.llm.tokens import encoder, str_texts, word_chunks

END_ID = 2
#: Bytes of a row group and of a page, and rows of a page.
ROW_GROUP = 16 << 20
PAGE = 64 << 10
PAGE_ROWS = 256
#: Ranges are by the id alone if at least so many of the rows have an id of their own.
OWN_IDS = 0.9

SCHEMA = "doc_id long, file int, row long, n_tokens long, tokens array<int>"


def _encode(path: str, end: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        row = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, totals = encoder(path, word_chunks).encode(str_texts(batch.column(1)), end)
            offsets = np.concatenate([[0], np.cumsum(totals)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(totals), part, np.int32)), pa.array(np.arange(row, row + len(totals))), pa.array(totals.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))],
                ["doc_id", "file", "row", "n_tokens", "tokens"],
            )
            row += len(totals)

    return run


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the files under ``path``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n, own = docs.agg(F.count("*"), F.approx_count_distinct("doc_id", 0.02)).first()
    # ranges by the id alone where that will do: the sample that finds them then reads no texts
    by = ["doc_id"] if own >= OWN_IDS * n else ["doc_id", F.xxhash64("text")]
    ordered = docs.repartitionByRange(*by).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(tidy("token-files", _encode(tokenizer, end)), SCHEMA).write.options(
        **{
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "true",
            "parquet.enable.dictionary#doc_id": "false",
            "parquet.enable.dictionary#row": "false",
            "parquet.enable.dictionary#n_tokens": "false",
            "parquet.block.size": str(ROW_GROUP),
            "parquet.page.size": str(PAGE),
            "parquet.page.row.count.limit": str(PAGE_ROWS),
            "parquet.page.write-checksum.enabled": "true",
            "compression": "zstd",
        }
    ).parquet(path)


def read_metadata(spark, path: str) -> DataFrame:
    """doc_id, file, row, n_tokens, start, from the metadata columns alone."""
    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "file", "row", "n_tokens")
    sums = saved(rows.groupBy("file").agg(F.sum("n_tokens").alias("n")), "token-file-sums")
    starts, at = [], 0
    for r in sums.orderBy("file").toLocalIterator():  # one row a file
        starts.append((r["file"], at))
        at += r["n"]
    files = spark.createDataFrame(starts, "file int, before long")
    own = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    return rows.join(files, "file").select("doc_id", "file", "row", "n_tokens", (F.col("before") + F.col("inside")).alias("start"))


def read_tokens(spark, path: str, low: int, high: int) -> DataFrame:
    """doc_id, n_tokens, tokens of the documents with low <= doc_id <= high: the filter reaches the scan, which by
    the files' statistics and page indexes skips files, row groups and pages of other documents."""
    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "n_tokens", "tokens")
    return rows.filter(F.col("doc_id").between(low, high))


def _digest(batches):
    import pyarrow as pa

    for batch in batches:
        tokens = batch.column(3)
        offsets = tokens.offsets.to_numpy()
        ids = tokens.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        n = pa.array(np.diff(offsets).astype(np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), n, pa.array(crc, pa.int64())], ["doc_id", "file", "row", "n_tokens", "ids_crc32"])


def token_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    tokens = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "file", "row", "tokens")
    digests = tokens.mapInArrow(tidy("token-digests", _digest), "doc_id long, file int, row long, n_tokens long, ids_crc32 long")
    starts = read_metadata(spark, path).select("file", "row", "start")
    return digests.join(starts, ["file", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files to the shared folder and returns their digests."""
    path = f"{scratch(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer, path)
    return token_digests(docs.sparkSession, path)
