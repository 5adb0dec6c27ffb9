"""SentencePiece encoding and decoding by suffix-array matching (operator 1).

The model's kind is byte-pair encoding with byte fallback. Its pieces hold the space mark only at their
start, so a text is cut before each run of spaces (and around line ends, which no piece holds) into chunks that are
encoded each for itself; a batch's unseen chunks are the batch text:

1. index: the batch text's positions are sorted by what follows them, as far as the longest piece reaches;
2. match: two binary searches for each piece give the range of its occurrences;
3. the occurrences are edges (start, end, piece), sorted by position;
4. relax: a path over the edges is the encoding if and only if each two neighbours on it stay as they are when the
   two alone are encoded. So each position keeps the one edge that ends there, starts where the path
   from the left goes on, and stands next to that path's last piece. Characters without a piece are edges
   of their own that become bytes.

Whether two pieces stay apart is found by merging their characters once and remembered.

Decoding joins the pieces' bytes, turns space marks into spaces and drops the first one, which encoding added.
Spaces become marks before the cut, as the library has it, so a text that holds the mark itself gets it back as a space; all
other texts come back as they were.

A null text counts as empty and has no pieces; rows repeating an id are encoded each for itself; null ids stay
null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.llm import tokens
from textgauge.llm.common import on_change, texts_of, tidy
from textgauge.llm.tokens import str_texts

#: Characters of unseen chunks that are indexed at once.
INDEX = 200_000

_MARK = "▁"
_CHUNK = re.compile(f"{_MARK}*[^{_MARK}\n]+|{_MARK}+|\n")
_CUT = re.compile(f"(?<=[!-~]){_MARK}")
_END = "\x00"


class Pieces(tokens.Memo):
    """A model's pieces, and the ids of the chunks met so far."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = {int(n[3:5], 16): i for i, n in enumerate(self.names) if sp.is_byte(i)}
        plain = [i for i in range(len(self.names)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.rank = {self.names[i]: -sp.get_score(i) for i in plain}
        self.id = {self.names[i]: i for i in plain}
        if any("\n" in n or _MARK in n.lstrip(_MARK) for n in self.id):
            raise ValueError("the pieces of this model reach over chunks")
        self.raw = [bytes([int(n[3:5], 16)]) if sp.is_byte(i) else n.replace(_MARK, " ").encode() for i, n in enumerate(self.names)]
        self.longest = max(map(len, self.id))
        self.apart: dict[tuple[int, int], bool] = {}
        reachable = [n for n in self.id if len(n) == 1 or self.merged(n) == [n]]
        reachable.sort()
        self.matched = np.array(reachable)
        self.matched_ids = np.array([self.id[n] for n in reachable])
        self.matched_len = np.array([len(n) for n in reachable])
        self.above = np.array([n + "\U0010ffff" for n in reachable])
        self.is_byte = np.zeros(len(self.names), bool)
        self.is_byte[list(self.byte.values())] = True

    def merged(self, text: str) -> list[str]:
        """Pair merging of a short text, best rank first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay_apart(self, a: int, b: int) -> bool:
        key = (a, b)
        got = self.apart.get(key)
        if got is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            x, y = self.names[a], self.names[b]
            got = self.apart[key] = self.merged(x + y) == [x, y]
        return got

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of all pieces in a text, sorted by where they end: start, end, id."""
        points = np.frombuffer((text + _END * self.longest).encode("utf-32-le"), np.uint32)
        windows = np.lib.stride_tricks.sliding_window_view(points, self.longest)[: len(text)]
        rank = points.astype(np.int64)
        reach = 1
        while reach < self.longest:  # positions ranked by their first `reach` characters, then by twice as many
            ahead = np.concatenate([rank[reach:], np.zeros(reach, np.int64)])
            rank = np.unique(rank << 32 | ahead, return_inverse=True)[1].astype(np.int64)
            reach *= 2
        order = np.argsort(rank[: len(text)], kind="stable")
        suffixes = np.ascontiguousarray(windows[order]).view(f"<U{self.longest}").ravel()
        low = np.searchsorted(suffixes, self.matched)
        high = np.searchsorted(suffixes, self.above)
        n = high - low
        start = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        end = start + np.repeat(self.matched_len, n)
        by = np.argsort(end, kind="stable")
        return start[by], end[by], np.repeat(self.matched_ids, n)[by]

    def _add(self, new: list[str]) -> None:
        for c in new:  # the chunk separator is U+0000; a text's own is a chunk for itself
            if c == _END:
                self._put(c, [self.byte[0]])
        chunks = [c for c in new if c != _END]
        lo = 0
        while lo < len(chunks):
            size, hi = 0, lo
            while hi < len(chunks) and (hi == lo or size < INDEX):
                size += len(chunks[hi]) + 1
                hi += 1
            self._learn(chunks[lo:hi])
            lo = hi

    def _learn(self, chunks: list[str]) -> None:
        text = _END.join(chunks)
        start, end, ids = self.edges(text)
        first = np.searchsorted(end, np.arange(len(text) + 2)).tolist()
        start, ids = start.tolist(), ids.tolist()
        apart = self.apart
        base = 0
        for chunk in chunks:
            stop = base + len(chunk)
            last: list[int] = [0] * (len(chunk) + 1)  # the piece that ends at each position; -1: bytes
            since: list[int] = [base] * (len(chunk) + 1)
            for e in range(base + 1, stop + 1):
                piece, come = -1, e - 1
                for k in range(first[e], first[e + 1]):
                    s = start[k]
                    if s < base:
                        continue
                    if s > base:
                        before = last[s - base]
                        if before >= 0:
                            ok = apart.get((before, ids[k]))
                            if not (self.stay_apart(before, ids[k]) if ok is None else ok):
                                continue
                    piece, come = ids[k], s
                    break
                last[e - base], since[e - base] = piece, come
            out: list[int] = []
            e = stop
            while e > base:
                piece, s = last[e - base], since[e - base]
                if piece < 0:
                    out.extend(self.byte[b] for b in reversed(text[s:e].encode()))
                else:
                    out.append(piece)
                e = s
            out.reverse()
            self._put(chunk, out)
            base = stop + 1

    def _row(self, text: str):
        if text:
            for part in tokens.slices((_MARK + text).replace(" ", _MARK), _CUT):
                yield _CHUNK.findall(part) if _END not in part else _split_end(part)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and each text's number of ids."""
        return self.encode_slices(map(self._row, texts))

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, sizes = self.encode_flat(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")[1:]


def _split_end(text: str) -> list[str]:
    return [c for part in re.split(f"({_END})", text) for c in ([part] if part == _END else _CHUNK.findall(part))]


_MODELS: dict[str, Pieces] = {}
on_change(_MODELS.clear)


def pieces(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def _encode(path: str):
    def run(batches):
        import pyarrow as pa

        model = pieces(path)
        for batch in batches:
            ids = model.encode(str_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        import pyarrow as pa

        model = pieces(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def _digest(path: str):
    def run(batches):
        import pyarrow as pa

        model = pieces(path)
        for batch in batches:
            texts = texts_of(batch.column(1))
            flat, size = model.encode_flat([t.decode() for t in texts])
            ends = np.cumsum(size)
            ids = np.split(flat, ends[:-1]) if texts else []
            crc = [zlib.crc32(x) for x in ids]
            sums = np.concatenate([[0], np.cumsum(model.is_byte[flat])])
            fallback = sums[ends] - sums[ends - size]
            ids = [x.tolist() for x in ids]
            back = [model.decode(x) for x in ids]
            same = [b.encode() == t for b, t in zip(back, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(fallback, pa.int64()), pa.array(crc, pa.int64()), pa.array([zlib.crc32(b.encode()) for b in back], pa.int64()), pa.array(same)], ["doc_id", "n_pieces", "n_bytes", "ids_crc32", "decoded_crc32", "round_trip"])

    return run


def _named(docs: DataFrame, id_col: str, col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(col))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the pieces of every text."""
    return _named(docs, id_col, text_col).mapInArrow(tidy("pieces", _encode(model)), "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every list of ids."""
    return _named(rows, id_col, ids_col).mapInArrow(tidy("pieces", _decode(model)), "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, n_bytes, ids_crc32, decoded_crc32, round_trip: encoded and decoded again."""
    return _named(docs, id_col, text_col).mapInArrow(tidy("pieces", _digest(model)), "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
