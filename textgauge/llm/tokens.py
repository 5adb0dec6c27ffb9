"""Exact token ids for many texts at a bounded cost.

Both tokenizer files split a text into pretokens that never reach over a run of white space, so a text's
ids are the concatenated ids of its white-space chunks. Each Python worker keeps the ids of the chunks it
has met (about ``KEEP_BYTES``; beyond, those met most often stay) and sends only unseen chunks to the library.
Texts are cut at the bytes of an Arrow column, many at once, and a chunk is looked up once for all its places there;
a chunk of a line end, letters and marks is cut into these, which are pretokens.
Texts with white space for which that split isn't safe go to the library whole. Long texts are cut into slices at
places that no pretoken reaches over, and chunks are looked up some at a time, so memory doesn't follow a batch's texts.
"""

from __future__ import annotations

import re
from array import array
from itertools import repeat

import numpy as np

from textgauge.llm.common import on_change, texts_of

#: Bytes of a worker's memo, about; chunks that are looked up at once where they come as lists; characters that are cut up at once.
KEEP_BYTES = 72 << 20
LOOK_UP = 100_000
SLICE = 1 << 20
#: What the memo needs for a chunk beside its characters and ids.
_ENTRY = 160

#: A chunk is a run of spaces and line ends with the run of other characters after it.
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: A special token of both files.
_PART = "<|endoftext|>"
_ODD_SPACE = re.compile("[^\\S \\n]|[\u180e\u200b\ufeff]")
_ODD_SPLIT = re.compile("[\x1c-\x1f\u180e\u200b\ufeff]")
_COMBINING = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff]")
#: The texts that ``byte_level_chunks`` and ``word_chunks`` take apart by more than bytes, in Arrow's dialect: with white space
#: beyond the bytes of ``_SPACES``, or what either looks for.
_WIDE_SPACE = r"\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_ODD_BYTES = rf"[\t\x0b-\r{_WIDE_SPACE}]"
_ODD_WORDS = rf"[{_WIDE_SPACE}\x{{300}}-\x{{36f}}\x{{1ab0}}-\x{{1aff}}\x{{1dc0}}-\x{{1dff}}\x{{20d0}}-\x{{20ff}}]|<\|"
_SPACES = np.isin(np.arange(256), [*b" \t\n\x0b\x0c\r"])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Where a long text may be cut: between a visible ASCII character and the space or line end after it.
_CUT = re.compile(r"(?<=[!-~])[ \n]")
#: Letters with at most one space before them, or marks: a pretoken each, whatever stands around a chunk of them. In Arrow's dialect.
_PLAIN = r"\A(?: ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-/:-@\[-`{-~]+)\z"
#: Kinds of bytes in the order that they have in a plain chunk.
_LINE, _BLANK, _LETTER, _MARK, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
for _bytes, _kind in ((b"\n", _LINE), (b" ", _BLANK), (bytes([*range(65, 91), *range(97, 123)]), _LETTER), (bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]), _MARK)):
    _KIND[[*_bytes]] = _kind


def slices(text: str, cut: re.Pattern = _CUT) -> list[str]:
    """The text in slices of about ``SLICE`` characters that chunks don't reach over."""
    out, at = [], 0
    while len(text) - at > SLICE and (m := cut.search(text, at + SLICE)):
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def byte_level_chunks(text: str) -> list[str] | None:
    return None if _ODD_SPACE.search(text) else _CHUNK.findall(text)


def word_chunks(text: str) -> list[str] | None:
    """Words of a tokenizer that drops white space and lower-cases. A-Z are lowered here already, which is
    the same unless a combining mark follows, or the letters belong to something like a special token."""
    if _ODD_SPLIT.search(text):
        return None
    if not _COMBINING.search(text) and "<|" not in text:
        text = text.encode().lower().decode()
    return text.split()


def cut_at_pretokens(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where chunks start, and within chunks of at most one line end, at most one space, letters and marks these."""
    kind = _KIND[data]
    latin = np.flatnonzero(data == 0xC3)  # the first byte of À to ÿ, × and ÷
    latin = latin[~np.isin(data[latin + 1], (0x97, 0xB7))]
    kind[latin] = kind[latin + 1] = _LETTER
    now, before = kind[1:], kind[:-1]
    inside = ~first[1:]
    bad = kind == _OTHER
    bad[1:] |= inside & ((now < before) | (now == before) & (now < _LETTER))
    cut = 1 + np.flatnonzero(inside & (now > before) & ((before == _LINE) | (before == _LETTER)))
    # no letter after a line end and a space
    ahead = np.minimum(cut + 1, len(data) - 1)
    cut = cut[(kind[cut] != _BLANK) | (ahead > cut) & ~first[ahead] & (kind[ahead] == _LETTER)]
    # a line end before marks alone
    cut = cut[(kind[cut] != _MARK) | (kind[cut - 1] == _LETTER)]
    starts = np.flatnonzero(first)
    rough = np.zeros(len(starts), bool)
    rough[np.searchsorted(starts, np.flatnonzero(bad), side="right") - 1] = True
    cut = cut[~rough[np.searchsorted(starts, cut, side="right") - 1]]
    return np.insert(starts, np.searchsorted(starts, cut), cut)


def cut_at_bytes(column, words: bool):
    """All chunks of a string column without odd texts, one after the other as a string array, and each text's number of chunks."""
    import pyarrow as pa

    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[: len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)[: at[-1]]
    space = _SPACES[data]
    first = space != words  # a chunk starts with white space, a word after it
    first[1:] &= space[1:] != space[:-1]
    own = at[:-1][np.diff(at) > 0]
    first[own] = ~space[own] if words else True
    if words:
        at = np.append(0, np.cumsum(~space, dtype=np.int32))[at]
        data, first = _LOWER[data[~space]], first[~space]
    starts = cut_at_pretokens(data, first) if len(data) else np.empty(0, np.int64)
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)), np.diff(np.searchsorted(starts, at))


def strings(column) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Memo:
    """The ids of chunks met so far, one after the other in an array."""

    def __init__(self) -> None:
        self._clear()

    def _add(self, new: list[str]) -> None:
        """Puts chunks that were not met before."""
        raise NotImplementedError

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = array("I")
        self.start = array("q")
        self.length = array("q")
        self.met = np.zeros(0, np.int64)
        self.size = 0

    def _trim(self) -> None:
        """Keeps the chunks met most often, about a third of the bytes, and none that was met once."""
        n = len(self.start)
        met = np.concatenate([self.met, np.zeros(max(0, n - len(self.met)), np.int64)])[:n]
        most = min(max(1, n // 3), KEEP_BYTES // (3 * _ENTRY))
        keep = np.flatnonzero(met >= max(2, int(np.partition(met, n - most)[n - most])))
        start, length = np.frombuffer(self.start, np.int64)[keep], np.frombuffer(self.length, np.int64)[keep]
        ends = np.cumsum(length)
        flat = np.frombuffer(self.flat, np.uint32)[np.repeat(start - (ends - length), length) + np.arange(length.sum())]
        names, met = list(self.index), met[keep] // 2  # the index is in the order of its numbers
        kept = [names[i] for i in keep.tolist()]
        self._clear()
        self.index = dict(zip(kept, range(len(kept))))
        self.flat, self.start, self.length = array("I", flat.tobytes()), array("q", (ends - length).tobytes()), array("q", length.tobytes())
        self.met = met
        self.size = sum(len(x) for x in kept if isinstance(x, str)) + _ENTRY * len(kept) + 4 * len(flat)

    def _put(self, chunk: str, ids) -> None:
        self.index[chunk] = len(self.start)
        self.start.append(len(self.flat))
        self.length.append(len(ids))
        self.flat.extend(ids)
        self.size += _ENTRY + (len(chunk) if isinstance(chunk, str) else 0) + 4 * len(ids)

    def _put_all(self, chunks: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        """Chunks that all are new, and their ids one after the other."""
        n, ends = len(self.start), len(self.flat) + np.cumsum(length)
        self.index.update(zip(chunks, range(n, n + len(chunks))))
        self.start.frombytes((ends - length).astype(np.int64).tobytes())
        self.length.frombytes(length.astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.uint32).tobytes())
        self.size += _ENTRY * len(chunks) + sum(map(len, chunks)) + 4 * len(ids)

    def _known(self, chunk: str) -> array | None:
        i = self.index.get(chunk)
        return None if i is None else self.flat[self.start[i] : self.start[i] + self.length[i]]

    def _numbers(self, flat: list[str]) -> np.ndarray:
        """Each chunk's number in the memo, where unseen ones are put."""
        which = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(which < 0)
        if len(missing):
            unseen = [flat[k] for k in missing.tolist()]
            self._add(list(dict.fromkeys(unseen)))
            which[missing] = [self.index[x] for x in unseen]
        return which

    def _ids(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of numbered chunks, and how many there are before each chunk and after the last."""
        start, length = np.frombuffer(self.start, np.int64)[which], np.frombuffer(self.length, np.int64)[which]
        ends = np.concatenate([[0], np.cumsum(length)])
        return np.frombuffer(self.flat, np.uint32)[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])], ends

    def _meet(self, which: np.ndarray) -> None:
        seen = np.bincount(which)
        if len(seen) > len(self.met):
            self.met = np.concatenate([self.met, np.zeros(2 * len(seen), np.int64)])
        self.met[: len(seen)] += seen

    def look_up(self, flat: list[str], last: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks, and how many there are before each place in ``last``."""
        which = self._numbers(flat)
        self._meet(which)
        ids, ends = self._ids(which)
        return ids, ends[np.array(last, np.int64)]

    def encode_slices(self, rows) -> tuple[np.ndarray, np.ndarray]:
        """All ids of rows (each an iterable of lists of chunks) one after the other, and each row's number of
        ids. At most about ``LOOK_UP`` chunks are held at once."""
        out, sizes = [], []
        flat: list = []
        owner: list[int] = []
        last: list[int] = []

        def flush() -> None:
            ids, ends = self.look_up(flat, last)
            if self.size > KEEP_BYTES:
                self._trim()
            out.append(ids)
            np.add.at(total, np.array(owner), np.diff(ends, prepend=0))
            flat.clear(), owner.clear(), last.clear()

        total = np.zeros(0, np.int64)
        for n, row in enumerate(rows):
            if n == len(total):
                total = np.concatenate([total, np.zeros(max(512, n), np.int64)])
            for chunks in row:
                flat += chunks
                owner.append(n)
                last.append(len(flat))
                if len(flat) > LOOK_UP:
                    flush()
            sizes.append(n)
        if flat:
            flush()
        return np.concatenate(out) if out else np.empty(0, np.uint32), total[: len(sizes)]


class Encoder(Memo):
    """Ids of texts by a tokenizers file; ``chunks`` splits a text, or says None if it must stay whole."""

    def __init__(self, path: str, chunks) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chunks = chunks
        self.part = self.tokenizer.token_to_id(_PART)
        # the printable stand-ins of bytes that byte-level models are written in
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = np.arange(256, dtype="<u4")
        self.shown[np.setdiff1d(np.arange(256), shown)] = 256 + np.arange(256 - len(shown))

    def _pretokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pretokens without line ends, and each one's number of ids. They go straight to the library's model,
        for nothing before it changes such ones."""
        joined = "\n".join(texts)
        if self.chunks is word_chunks:
            joined = joined.lower()
        shown = self.shown[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids, length = array("I"), array("q")
        for some in map(self.model.tokenize, shown.split(chr(self.shown[10])) if texts else ()):
            length.append(len(some))
            ids.extend([t.id for t in some])
        return np.array(ids, np.uint32), np.array(length, np.int64)

    def _add(self, new: list[str]) -> None:
        """Pretokens go to the model; the other chunks go to the library many at a time, parted
        by a special token, which it takes out of a text before it looks at the rest."""
        import pyarrow as pa
        import pyarrow.compute as pc

        put = self._put
        plain = pc.match_substring_regex(pa.array(new, pa.string()), _PLAIN).to_numpy(zero_copy_only=False)
        some = [new[i] for i in np.flatnonzero(plain).tolist()]
        self._put_all(some, *self._pretokens(some))
        other, marked = [], []
        for i in np.flatnonzero(~plain).tolist():
            (marked if "<|" in new[i] or "|>" in new[i] else other).append(new[i])
        for i in range(0, len(other), 500):
            some = other[i : i + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([_PART.join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.part)
            for x, a, b in zip(some, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]):
                put(x, ids[a:b].tolist())
        for x in marked:
            put(x, self.tokenizer.encode(x, add_special_tokens=False).ids)

    def _block(self, parts: list[str], closed: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts' parts, ``end`` after the ``closed`` ones, and each part's number of ids."""
        import pyarrow as pa
        import pyarrow.compute as pc

        words = self.chunks is word_chunks
        column = pa.array(parts, pa.string())
        odd = np.flatnonzero(pc.match_substring_regex(column, _ODD_WORDS if words else _ODD_BYTES).to_numpy(zero_copy_only=False))
        if len(odd):
            beside = set(odd.tolist())
            column = pa.array(["" if i in beside else x for i, x in enumerate(parts)], pa.string())
        chunks, n = cut_at_bytes(column, words)
        coded = chunks.dictionary_encode()
        which = self._numbers(strings(coded.dictionary))[coded.indices.to_numpy()]
        if len(odd):
            own = [got if (got := self.chunks(parts[i])) is not None else [parts[i]] for i in odd.tolist()]
            more = np.array([len(x) for x in own])
            which = np.insert(which, np.repeat(np.cumsum(n)[odd], more), self._numbers([c for x in own for c in x]))
            n[odd] = more
        if end not in self.index:  # the end id is kept like a chunk, under its number
            self._put(end, [end])
        which = np.insert(which, np.cumsum(n)[closed], self.index[end])
        self._meet(which)
        ids, ends = self._ids(which)
        if self.size > KEEP_BYTES:
            self._trim()
        return ids, np.diff(ends[np.cumsum(n + closed)], prepend=0)

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, ``end`` after each text, and each text's number of ids."""
        out, total = [], np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            own = np.array(owner)
            ids, n = self._block(parts, np.append(own[1:] != own[:-1], closes), end)
            out.append(ids)
            np.add.at(total, own, n)
            parts.clear(), owner.clear()

        for i, text in enumerate(texts):
            closes = True  # the last part so far ends its text
            for part in slices(text):
                if parts and size + len(part) > SLICE:
                    flush()
                    size = 0
                parts.append(part)
                owner.append(i)
                size += len(part)
                closes = False
        closes = True
        if parts:
            flush()
        return np.concatenate(out) if out else np.empty(0, np.uint32), total


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, chunks) -> Encoder:
    """One encoder for each file in a worker process, kept between tasks of the same work."""
    key = (path, chunks.__name__)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, chunks)
    return _ENCODERS[key]


on_change(_ENCODERS.clear)


def str_texts(column) -> list[str]:
    return [x.decode() for x in texts_of(column)]
