"""Operators 1, 2 and 9 against the tokenizer libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import by_id, empty, messy, messy_rows

from textgauge.llm import packing, pieces, token_files

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS), sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_the_library(spark, libraries):
    sp = libraries[2]
    got = by_id(pieces.round_trip(messy(spark), PIECES), "doc_id", "n_pieces", "ids_crc32", "round_trip")
    want = []
    for r in messy_rows():
        ids, text = sp.encode(r[1] or ""), r[1] or ""
        want.append((r[0], len(ids), crc(ids), "▁" not in text))
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def test_pieces_decode(spark):
    docs = messy(spark)
    back = pieces.decode(pieces.encode(docs, PIECES), PIECES)
    want = [(r[0], (r[1] or "").replace("▁", " ")) for r in messy_rows()]
    assert by_id(back, "doc_id", "text") == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert pieces.round_trip(empty(spark), PIECES).count() == 0


def test_pieces_random_strings(libraries):
    model, sp, rng = pieces.Pieces(PIECES), libraries[2], random.Random(3)
    alphabet = "aabeehinorst  \n.,-1é▁ß=_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    assert model.encode(texts) == sp.encode(texts)


def test_packing(spark, libraries):
    tokenizer = libraries[0]
    want = {}
    for r in messy_rows():
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.setdefault((r[0], p, a, b - a, crc(ids[a:b])), 0)
            want[(r[0], p, a, b - a, crc(ids[a:b]))] += 1
    rows = packing.pack(messy(spark), BYTES).collect()
    got = {}
    for r in rows:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        got[key] = got.get(key, 0) + 1
    assert got == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 1024) + 2
    assert packing.pack(empty(spark), BYTES).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_piece_and_are_tight(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(3000 * (seed + 1)):
        n = rng.randint(1, 1024) if seed % 2 else min(1024, max(1, int(rng.lognormvariate(5.5, 1))))
        counts[n] = counts.get(n, 0) + 1
    runs, held = packing.plan(counts), {}
    for pattern, n in runs:
        assert sum(pattern) <= 1024 and n > 0
        for x in pattern:
            held[x] = held.get(x, 0) + n
    assert held == counts
    assert sum(n for _, n in runs) <= 1.02 * sum(k * v for k, v in counts.items()) / 1024 + 2


def test_configurations_reach_the_linear_optimum():
    # halves, thirds: 10 of 512 and 9 of 341 need 5 + 3 sequences
    found = packing.configurations([512, 341], [10, 9], 1024)
    assert sum(x for _, x in found) == pytest.approx(8)


def test_token_files(spark, libraries):
    tokenizer = libraries[1]
    rows = sorted(messy_rows(), key=lambda r: (r[0] is not None, r[0]))  # the repeated id has one text
    want, start = [], 0
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], start, len(ids), crc(ids)))
        start += len(ids)
    got = by_id(token_files.token_files(messy(spark), WORDS), "start", "doc_id", "n_tokens", "ids_crc32")
    assert [(d, s, n, c) for s, d, n, c in got] == want
    assert token_files.token_files(empty(spark), WORDS).count() == 0


def test_token_files_of_one_id(spark, libraries, monkeypatch):
    """Most rows share an id or have none: they are dealt out by their texts."""
    texts = [f"word number {i} " + "more " * (i % 9) for i in range(400)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    got = token_files.token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), WORDS).collect()
    crcs = sorted(crc(libraries[1].encode(t, add_special_tokens=False).ids + [2]) for t in texts)
    assert sorted(r["ids_crc32"] for r in got) == crcs
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))


def columns_of(meta, group):
    group = meta.metadata.row_group(group)
    return {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}


def test_token_files_format(spark, tmp_path):
    import pyarrow.parquet as pq

    path = "file://" + str(tmp_path / "tokens")
    token_files.write_token_files(messy(spark), WORDS, path)
    files = sorted((tmp_path / "tokens").glob("*.parquet"))
    last = None
    for f in files:
        meta = pq.ParquetFile(f)
        columns = columns_of(meta, 0)
        assert "RLE_DICTIONARY" in columns["tokens"].encodings
        for name in ("doc_id", "row", "n_tokens"):
            assert "DELTA_BINARY_PACKED" in columns[name].encodings and "RLE_DICTIONARY" not in columns[name].encodings
        assert all(c.has_column_index and c.has_offset_index for c in columns.values())
        ids = [x for x in meta.read(columns=["doc_id"])["doc_id"].to_pylist() if x is not None]
        assert ids == sorted(ids) and (last is None or not ids or ids[0] >= last)
        last = ids[-1] if ids else last


def scanned_rows(df):
    """Rows that left the scan of an executed DataFrame."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


def test_token_files_are_read_selectively(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(token_files, "ROW_GROUP", 100_000)
    n = 6000
    rng = random.Random(1)
    rows = [(i, " ".join(f"{rng.randint(0, 10**6)}" for _ in range(20))) for i in range(n)]
    path = "file://" + str(tmp_path / "tokens")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), WORDS, path)
    groups = [columns_of(pq.ParquetFile(f), g)["tokens"].total_uncompressed_size for f in (tmp_path / "tokens").glob("*.parquet") for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) > 3 and max(groups) <= 2 * 100_000
    some = token_files.read_tokens(spark, path, 3000, 3009)
    assert "GreaterThanOrEqual(doc_id,3000)" in some._jdf.queryExecution().toString()
    assert sorted(r["doc_id"] for r in some.collect()) == list(range(3000, 3010))
    assert all(r["n_tokens"] == len(r["tokens"]) for r in some.collect())
    assert 10 <= scanned_rows(some) <= 2 * token_files.PAGE_ROWS  # pages beside those asked for aren't decoded
    metadata = token_files.read_metadata(spark, path)._jdf.queryExecution().toString()
    assert "tokens:array" not in metadata.split("== Physical Plan ==")[1]


def test_long_texts_in_slices(spark, libraries, monkeypatch):
    """Long texts are cut and looked up in parts, and the memo is emptied on the way, without a trace in the ids."""
    from textgauge.llm import tokens

    monkeypatch.setattr(tokens, "SLICE", 300)
    monkeypatch.setattr(tokens, "LOOK_UP", 100)
    monkeypatch.setattr(tokens, "KEEP_BYTES", 20_000)
    rng = random.Random(9)
    alphabet = ["the", "river's", "l'eau", "ÉTÉ", "naïve,", "x=1", "...", "don't", "\n", " ", "日本", "İstanbul", "\tTab", "A.B.C.", "\n\nPara", "fi'n", "straße!", "▁m", "\u3000wide", "e\u0301", "<|x|>", "2024-01-02,", "\x00"]
    texts = [" ".join(rng.choice(alphabet) if rng.random() < 0.6 else "w%dq" % rng.randint(0, 5000) for _ in range(rng.choice([0, 3, 40, 3000]))) for _ in range(40)]
    for path, chunks, library in ((BYTES, tokens.byte_level_chunks, libraries[0]), (WORDS, tokens.word_chunks, libraries[1])):
        for some in (texts, texts[::-1]):
            ids, sizes = tokens.Encoder(path, chunks).encode(some, 2)
            want = [library.encode(x, add_special_tokens=False).ids + [2] for x in some]
            assert sizes.tolist() == [len(x) for x in want]
            assert ids.tolist() == [i for x in want for i in x]
    assert pieces.Pieces(PIECES).encode(texts) == libraries[2].encode(texts)


def test_repeated_chunks_are_looked_up_once(libraries):
    """The work in Python follows the distinct chunks of some texts and not all their places."""
    from textgauge.llm import tokens

    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    texts = ["The lamp, the river.\nThe lamp: a walk"] * 500
    for path, chunks, library in ((BYTES, tokens.byte_level_chunks, libraries[0]), (WORDS, tokens.word_chunks, libraries[1])):
        encoder, Counted.asked = tokens.Encoder(path, chunks), 0
        encoder.index = Counted()
        ids, sizes = encoder.encode(texts, 2)
        assert Counted.asked < 100
        want = library.encode(texts[0], add_special_tokens=False).ids + [2]
        assert sizes.tolist() == [len(want)] * 500 and ids.tolist() == want * 500


def test_odd_texts_are_told_from_plain_ones():
    """The patterns in Arrow's dialect match what the splits by more than bytes look for."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from textgauge.llm import tokens

    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    column = pa.array(chars, pa.string())
    assert pc.match_substring_regex(column, tokens._ODD_BYTES).to_pylist() == [bool(tokens._ODD_SPACE.search(c)) for c in chars]
    words = [bool(tokens._ODD_SPLIT.search(c) or tokens._COMBINING.search(c)) or c > "\x7f" and c.isspace() for c in chars]
    assert pc.match_substring_regex(column, tokens._ODD_WORDS).to_pylist() == words


def test_plain_chunks_are_cut_into_pretokens(libraries):
    """A word with and without marks is one entry of the memo."""
    import pyarrow as pa

    from textgauge.llm import tokens

    text = "\nÉté, a: \n Àl!? \n, \n ,b x1. d×! (e) don't \n\nf; É\n"
    cut = tokens.cut_at_bytes(pa.array([text, "g,", "", ",h"], pa.string()), False)
    assert cut[0].to_pylist() == ["\n", "Été", ",", " a", ":", " \n Àl!?", " \n,", " \n ,b", " x1.", " d×!", " (e)", " don't", " \n\nf;", " É", "\n", "g", ",", ",h"]
    assert cut[1].tolist() == [15, 2, 0, 1]
    chunks, n = tokens.cut_at_bytes(pa.array(["Été, a: ×b c1! (D) E", "f;g h"], pa.string()), True)
    assert chunks.to_pylist() == ["Été", ",", "a", ":", "×b", "c1!", "(d)", "e", "f;g", "h"] and n.tolist() == [8, 2]
    texts = [f"stone{mark} lamp{mark}" for mark in ("", *"!,.:;?)")]
    for path, split, library in ((BYTES, tokens.byte_level_chunks, libraries[0]), (WORDS, tokens.word_chunks, libraries[1])):
        encoder = tokens.Encoder(path, split)
        ids, _ = encoder.encode(texts, 2)
        assert ids.tolist() == [i for x in texts for i in library.encode(x, add_special_tokens=False).ids + [2]]
        assert len(encoder.index) == 2 + 7 + 1


@pytest.mark.parametrize("words", [False, True])
def test_cut_at_bytes(words):
    import pyarrow as pa

    from textgauge.llm import tokens

    split = tokens.word_chunks if words else tokens.byte_level_chunks
    texts = ["", "Ab cé", " ", "x", "", "\n\n a  b\n", "日本 Ω", "  ", "end "]
    for some in (texts, texts[::-1], [""], [], [" "]):
        chunks, n = tokens.cut_at_bytes(pa.array(some, pa.string()), words)
        assert chunks.to_pylist() == [c for x in some for c in split(x)]
        assert n.tolist() == [len(split(x)) for x in some]


def test_memory_of_a_batch_of_long_texts():
    """What encoding needs beside texts and ids is bounded: 40 MB of text of 6 million chunks."""
    import subprocess
    import sys

    code = f"""
import random, resource
from textgauge.llm import tokens
rng = random.Random(2)
words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
texts = [" ".join(rng.choices(words, k=50_000)) for _ in range(100)]
e = tokens.Encoder({WORDS!r}, tokens.word_chunks)
e.encode(texts[:1], 2)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids, sizes = e.encode(texts, 2)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before - 2 * ids.nbytes // 1024)
"""
    kb = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0]).stdout)
    assert kb < 100_000
