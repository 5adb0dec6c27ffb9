"""What counts a text's tokens and words and compares its sentences with each other: entropies, repeats, sentence graph, term vectors.

Comparisons work from the words that sentences share, never from all pairs of sentences, so a text of many thousand
sentences costs little more than reading it. The functions run in Arrow batches over strings in which the row's own
expressions have set the tokens apart, so both engines agree on what a letter is; texts are never shuffled or joined for them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from textgauge.functions import lexicons as lex

#: Words of more sentences than this are held as bit sets.
FREQUENT = 64
#: Sentences of a text up to which each word's sentences are held as the bits of one number.
SMALL = 2048
#: Texts, and sentences of theirs, that are compared in one go.
TOGETHER, SENTENCES = 512, 20_000
#: Distinct tokens of a text up to which three of them make one number.
DISTINCT = 2_000_000


def _places(sentences: list) -> dict[str, list[int]]:
    where: dict[str, list[int]] = {}
    for i, words in enumerate(sentences):
        for w in words:
            where.setdefault(w, []).append(i)
    return where


def _common(sentences) -> set[str]:
    """Words of more than one sentence."""
    seen, common = set(), set()
    for words in sentences:
        common |= seen & words
        seen |= words
    return common


def _bits(at: list[int], n: int) -> int:
    row = np.zeros(n, bool)
    row[at] = True
    return int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")


def shared_pairs(content: list, gap: int = 2) -> int:
    """How many pairs of sentences at least ``gap`` apart share a word; each sentence's words are distinct.

    The sentences that share a word with one are a union: of bit sets for frequent words, of short lists for others."""
    where = _places(content)
    masks = {w: _bits(at, len(content)) for w, at in where.items() if len(at) > FREQUENT}
    total = 0
    for i, words in enumerate(content):
        union, few = 0, set()
        for w in words:
            mask = masks.get(w)
            if mask is None:
                few.update(where[w])
            else:
                union |= mask
        total += (union >> (i + gap)).bit_count()
        total += sum(1 for j in few if j >= i + gap and not union >> j & 1)
    return total


def page_rank_variation(content: list, alpha: float = 0.85, most: int = 100) -> float | None:
    """Variation coefficient of the weighted PageRank over a text's sentence graph: a chain of weight 1, and forward
    edges between sentences further apart weighted by the number of words they share. None below two sentences.

    A step runs over (word, sentence) entries: what flows into a sentence by a word is the running sum over the
    word's earlier sentences."""
    n = len(content)
    if n < 2:
        return None
    where = _places(content)
    sentence = np.array([i for at in where.values() for i in at], np.int64)
    sizes = np.array([len(at) for at in where.values()], np.int64)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.arange(len(sentence))
    previous = np.where(order > first, sentence[order - 1], -2) if len(sentence) else sentence
    neighbour = previous == sentence - 1  # the chain takes the place of the edge to the sentence before
    after = np.repeat(np.cumsum(sizes), sizes) - order - 1
    out = np.bincount(sentence, weights=after, minlength=n)
    out -= np.bincount(previous[neighbour], minlength=n)
    out[:-1] += 1
    hanging = out == 0
    rank = np.full(n, 1 / n)
    for _ in range(most):
        give = np.divide(rank, out, out=np.zeros(n), where=~hanging)
        flow = np.concatenate([[0.0], give[:-1]])
        if len(sentence):
            each = give[sentence]
            before = np.concatenate([[0.0], np.cumsum(each)])
            into = before[order] - before[first] - np.where(neighbour, give[previous], 0.0)
            flow += np.bincount(sentence, weights=into, minlength=n)
        new = alpha * (flow + rank[hanging].sum() / n) + (1 - alpha) / n
        close = np.abs(new - rank).sum() < n * 1e-6
        rank = new
        if close:
            break
    return float(rank.std() / rank.mean())


def twins(sets: list, share: float = 0.7) -> int:
    """How many pairs of sentences have more than ``share`` of the smaller one's words in common.

    Equal sentences count together. Of a smaller sentence's words, rarest first, so many are looked up that a
    larger one without any of them can't share enough."""
    groups = Counter(frozenset(s) for s in sets if len(s))
    found = sum(c * (c - 1) // 2 for c in groups.values())
    kinds = sorted(groups, key=len)
    common = _common(kinds)
    where: dict[str, list[int]] = {}
    for a, words in enumerate(kinds):
        size = len(words)
        enough = math.floor(share * size)
        while enough <= share * size:
            enough += 1
        if len(words & common) < enough:
            continue
        where = where or _places(kinds)
        probe = sorted(words, key=lambda w: (len(where[w]), w))[: size - enough + 1]
        for b in {b for w in probe if where[w][-1] > a for b in where[w] if b > a}:
            if len(words & kinds[b]) >= enough:
                found += groups[words] * groups[kinds[b]]
    return found


def term_scores(terms: list) -> tuple[float | None, float | None]:
    """Coherence and topic focus from the TF-IDF vectors of a text's sentences; none without terms or a second sentence.

    Coherence is 1.5 times the mean cosine of neighbours, topic focus 1 - 2 (1 - the mean cosine with the
    centroid), both held in [0, 1]."""
    n = len(terms)
    index: dict[str, int] = {}
    entries = Counter((index.setdefault(w, len(index)), s) for s, words in enumerate(terms) for w in words)
    if n < 2 or not entries:
        return None, None
    keys = sorted(entries)
    term, sentence = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
    seen = np.bincount(term)
    raw = np.array([entries[k] for k in keys], float) * (np.log((1 + n) / (1 + seen[term])) + 1)
    w = raw / np.sqrt(np.bincount(sentence, weights=raw * raw, minlength=n))[sentence]
    follows = (term[1:] == term[:-1]) & (sentence[1:] == sentence[:-1] + 1)
    centroid = np.bincount(term, weights=w) / n
    along = (w * centroid[term]).sum() / math.sqrt((centroid * centroid).sum()) / n
    bound = lambda x: float(min(1.0, max(0.0, x)))
    return bound(1.5 * (w[1:] * w[:-1])[follows].sum() / (n - 1)), bound(1 - 2 * (1 - along))


def _spread_of(counts: np.ndarray) -> np.ndarray:
    """c log2 c of each count, 0 of none."""
    return counts * np.log2(np.maximum(counts, 1))


def _repeated(keys: np.ndarray) -> int:
    """How many distinct values occur more than once."""
    keys = np.sort(keys)
    same = keys[1:] == keys[:-1]
    return int(same[:1].sum() + (same[1:] & ~same[:-1]).sum())


def token_counts(tokens: list) -> tuple:
    """Number of tokens, distinct tokens, sum of c log2 c over their counts; repeated sequences of two and three tokens (none below
    four tokens); number and variance of the entropies of the text's parts, a fifth each (none below ten tokens)."""
    n = len(tokens)
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in tokens], np.int64)
    repeated, parts = None, 0
    variance = None
    if n >= 4:
        two = ids[:-1] * len(index) + ids[1:]
        left = two if len(index) < DISTINCT else np.unique(two, return_inverse=True)[1]
        repeated = float(_repeated(two) + _repeated(left[:-1] * len(index) + ids[2:]))
    if n >= 10:
        size = max(n // 5, 3)
        parts = (n - 3) // size + 1  # a part has three tokens at least
        here = ids[: parts * size]
        lengths = np.full(parts, size)
        lengths[-1] = len(here) - (parts - 1) * size
        of = np.arange(len(here)) // size
        keys, counts = np.unique(of * len(index) + here, return_counts=True)
        h = np.log2(lengths) - np.bincount(keys // len(index), weights=_spread_of(counts)) / lengths
        variance = float(np.square(h - h.mean()).mean())
    return n, len(index), float(_spread_of(np.bincount(ids)).sum()) if n else 0.0, repeated, parts, variance


def _tokens(marked: pd.Series) -> pd.DataFrame:
    rows = [token_counts(x.split()) for x in marked]  # bytes split at ASCII white space, which is what tokens are without
    types = {"n_tokens": "int64", "n_distinct": "int64", "spread": "float64", "repeated": "float64", "parts": "int64", "part_var": "float64"}
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=t) for i, (c, t) in enumerate(types.items())})


_CODE = re.compile(lex.CODE)
#: Characters that later versions of Unicode leave as they are: Latin letters and common punctuation.
_OTHER = re.compile("[^\x00-\u024f\u2000-\u206f]")
#: Vowels, white space and others.
_SOUNDS = {i: "a" if chr(i) in lex.VOWELS else "\n" if chr(i).isspace() else " " for i in (*range(0x250), *range(0x2000, 0x2070))}
_ASCII_SOUNDS = "".join(_SOUNDS[i] for i in range(128)).encode() + b" " * 128
_MARKS_ASCII = bytes(i for i in range(256) if not (i < 128 and chr(i).isalnum()))


def _prose(texts: pd.Series) -> pd.DataFrame:
    """Words, letters and digits, sentences, groups of vowels, and words with three of them; none for texts with other characters."""
    rows = []
    for x in texts:
        if x.isascii():
            raw = x.encode()
            chars, sounds = len(raw.translate(None, _MARKS_ASCII)), raw.lower().translate(_ASCII_SOUNDS).split(b"\n")
        elif _OTHER.search(low := x.lower()) or _OTHER.search(x):
            rows.append((None,) * 5)
            continue
        else:
            chars, sounds = sum(map(str.isalnum, x)), low.translate(_SOUNDS).split("\n")
        groups = [len(w.split()) for w in sounds]
        rows.append((len(x.split()), chars, max(1, sum(1 for p in _ENDS.split(x) if p.strip(" "))), sum(groups), sum(1 for g in groups if g > 2)))
    names = ["prose_wc", "prose_chars", "prose_sents", "syllables", "complex_words"]
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype="Int64" if i == 0 else "Float64") for i, c in enumerate(names)})


_ENDS = re.compile("[.!?]+")


def _words(texts: pd.Series) -> pd.DataFrame:
    """Numbers of words, and of words that look like code: none in lower case, or with a capital at its start alone."""
    rows = []
    for x in texts:
        words = x.split()
        rows.append((len(words), sum(1 for w in words if not (w.isalpha() and (w.islower() or w.istitle())) and _CODE.search(w))))
    return pd.DataFrame(rows, columns=["n_words", "n_code"], dtype="int64")


def _lengths(lines: pd.Series) -> pd.DataFrame:
    """Mean and variance of the sentences' numbers of words."""
    rows = []
    for x in lines:
        n = [len(line.split()) for line in _cut(x)]
        mean = sum(n) / len(n) if n else None
        rows.append((mean, sum((k - mean) * (k - mean) for k in n) / len(n) if n else None))
    return pd.DataFrame(rows, columns=["mean", "var"], dtype="float64")


_STOP = frozenset(lex.STOP_WORDS)


def _letters(line: str) -> set[str]:
    """A sentence's distinct runs of three and more letters, without stop words."""
    words = [w for w in line.split() if len(w) > 2]
    if not all(map(str.isalpha, words)):
        words = [r for w in words for r in ("".join(g) for k, g in groupby(w, str.isalpha) if k) if len(r) > 2]
    return set(words) - _STOP


def _shared(content: list) -> int:
    """``shared_pairs``, by one number a word where the text is short."""
    if len(content) > SMALL:
        return shared_pairs(content)
    masks: dict[str, int] = {}
    for i, words in enumerate(content):
        for w in words:
            masks[w] = masks.get(w, 0) | 1 << i
    total = 0
    for i, words in enumerate(content):
        union = 0
        for w in words:
            union |= masks[w]
        total += (union >> i + 2).bit_count()
    return total


def _numbered(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of many texts, each a list of sentences: the texts' numbers of sentences, the sentences' texts, and the words, numbered anew
    in each text, with the sentences they are in."""
    n = np.array([len(t) for t in texts], np.int64)
    words: list[int] = []
    lengths: list[int] = []
    base = 0
    for t in texts:
        index: dict[str, int] = {}
        for sentence in t:
            words += [index.setdefault(w, len(index)) + base for w in sentence]
            lengths.append(len(sentence))
        base += len(index)
    return n, np.repeat(np.arange(len(texts)), n), np.array(words, np.int64), np.repeat(np.arange(len(lengths)), lengths)


def page_ranks(texts: list, alpha: float = 0.85, most: int = 100) -> np.ndarray:
    """``page_rank_variation`` of each of many texts, all of which take their steps together; a text stands still once its ranks do."""
    found = np.full(len(texts), np.nan)
    left = np.array([k for k, t in enumerate(texts) if len(t) > 1], np.int64)
    if not len(left):
        return found
    n, text, word, sentence = _numbered([texts[k] for k in left])
    size = n[text].astype(float)
    starts = np.cumsum(n) - n
    linked = np.bincount(word)[word] > 1 if len(word) else np.zeros(0, bool)  # a word of one sentence links nothing
    word, sentence = word[linked], sentence[linked]
    order = np.lexsort((sentence, word))
    word, sentence = word[order], sentence[order]
    begins = np.r_[True, word[1:] != word[:-1]] if len(word) else linked[:0]
    heads = np.flatnonzero(begins)
    counts = np.diff(np.r_[heads, len(word)])
    first = np.repeat(heads, counts)
    previous = np.where(begins, -2, np.r_[-2, sentence[:-1]][: len(sentence)])
    neighbour = previous == sentence - 1  # the chain takes the place of the edge to the sentence before
    out = np.bincount(sentence, weights=np.repeat(heads + counts, counts) - np.arange(len(word)) - 1, minlength=len(text))
    out -= np.bincount(previous[neighbour], minlength=len(text))
    chained = np.ones(len(text), bool)
    chained[starts] = False
    out[:-1] += chained[1:]
    hanging = out == 0
    share = np.divide(1.0, out, out=np.zeros(len(text)), where=~hanging)
    rank = 1 / size
    moving = np.ones(len(left), bool)
    for _ in range(most):
        give = rank * share
        flow = np.where(chained, np.r_[0.0, give[:-1]], 0.0)
        if len(sentence):
            before = np.r_[0.0, np.cumsum(give[sentence])]
            into = before[:-1] - before[first] - np.where(neighbour, give[previous], 0.0)
            flow += np.bincount(sentence, weights=into, minlength=len(text))
        loose = np.bincount(text, weights=rank * hanging, minlength=len(left))
        new = alpha * (flow + loose[text] / size) + (1 - alpha) / size
        close = np.add.reduceat(np.abs(new - rank), starts) < n * 1e-6
        rank = np.where(moving[text], new, rank)
        moving &= ~close
        if not moving.any():
            break
    mean = np.add.reduceat(rank, starts) / n
    found[left] = np.sqrt(np.add.reduceat((rank - mean[text]) ** 2, starts) / n) / mean
    return found


def many_term_scores(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """``term_scores`` of each of many texts, NaN for none."""
    scores = np.full(len(texts), np.nan), np.full(len(texts), np.nan)
    left = np.array([k for k, t in enumerate(texts) if len(t) > 1 and any(t)], np.int64)
    if not len(left):
        return scores
    n, text, word, sentence = _numbered([texts[k] for k in left])
    keys, tf = np.unique(word * len(text) + sentence, return_counts=True)
    term, sentence = keys // len(text), keys % len(text)
    of = text[sentence]
    raw = tf * (np.log((1 + n[of]) / (1 + np.bincount(term)[term])) + 1)
    w = raw / np.sqrt(np.bincount(sentence, weights=raw * raw))[sentence]
    follows = np.flatnonzero((term[1:] == term[:-1]) & (sentence[1:] == sentence[:-1] + 1))
    near = np.bincount(of[follows], weights=w[follows] * w[follows + 1], minlength=len(left)) / (n - 1)
    owner = np.zeros(term[-1] + 1, np.int64)
    owner[term] = of
    centroid = np.bincount(term, weights=w) / n[owner]
    length = np.sqrt(np.bincount(owner, weights=centroid * centroid, minlength=len(left)))
    along = np.bincount(of, weights=w * centroid[term], minlength=len(left)) / length / n
    scores[0][left] = np.clip(1.5 * near, 0, 1)
    scores[1][left] = np.clip(1 - 2 * (1 - along), 0, 1)
    return scores


def _groups(lines: list) -> list[slice]:
    """Texts to compare in one go."""
    out, start, sentences = [], 0, 0
    for k, x in enumerate(lines):
        sentences += x.count("\n") + 1
        if k + 1 - start == TOGETHER or sentences >= SENTENCES:
            out.append(slice(start, k + 1))
            start, sentences = k + 1, 0
    return out + [slice(start, len(lines))]


def _cut(text: str) -> list[str]:
    return text.split("\n") if text else []


def _graphs(spaced: pd.Series) -> pd.DataFrame:
    shared, ranks = [], []
    texts = spaced.tolist()
    for part in _groups(texts):
        content = []
        for x in texts[part]:  # words of one sentence link nothing
            words = [_letters(line) for line in _cut(x)]
            common = _common(words)
            content.append([w & common for w in words])
        shared += map(_shared, content)
        ranks.append(page_ranks(content))
    rank = pd.Series(np.concatenate(ranks)).astype(object)
    return pd.DataFrame({"shared": pd.Series(shared, dtype="int64"), "rank_cv": rank.where(rank.notna(), None)})


def _vectors(spaced: pd.Series) -> pd.DataFrame:
    found = []
    texts = spaced.tolist()
    for part in _groups(texts):
        found.append(many_term_scores([[[w for w in line.split() if len(w) > 1 and w not in _STOP] for line in _cut(x)] for x in texts[part]]))
    both = (pd.Series(np.concatenate([f[i] for f in found])).astype(object) for i in (0, 1))
    return pd.DataFrame({c: x.where(x.notna(), None) for c, x in zip(("coherence", "topic_focus"), both)})


_MARKS = ".,!?;:"


def _twins(lines: pd.Series) -> pd.DataFrame:
    rows = []
    for x in lines:
        sets = [{w.strip(_MARKS) for w in line.split() if len(w) > 2} for line in _cut(x)]
        rows.append((twins(sets), sum(1 for s in sets if s)))
    return pd.DataFrame(rows, columns=["pairs", "filled"], dtype="int64")


#: Words that a sentence of each kind holds one of.
_KIND_WORDS = [frozenset(ws) for ws in lex.KIND_WORDS.values()]
_ANY_KIND = frozenset().union(*_KIND_WORDS)


def _kinds(spaced: pd.Series) -> pd.Series:
    """Of each sentence, as bits, the kinds whose markers it may hold, by its words."""
    rows = []
    for x in spaced:
        words = [line.split() for line in _cut(x)]
        rows.append([0 if _ANY_KIND.isdisjoint(line) else sum(1 << k for k, ws in enumerate(_KIND_WORDS) if not ws.isdisjoint(line)) for line in words])
    return pd.Series(rows)


_VOCABULARY = frozenset(lex.VOCABULARY)


def _vocabulary(spaced: pd.Series) -> pd.DataFrame:
    """The words of the lists, each as often as the text has it, and how many other content words there are."""
    known, content = [], []
    for x in spaced:
        words = x.split()
        known.append([w for w in words if w in _VOCABULARY])
        content.append(sum(1 for w in set(words) - _STOP if len(w) > 2))
    return pd.DataFrame({"known": known, "content": pd.Series(content, dtype="int64")})


#: Functions by the name that an expression calls them with, and what they return.
FUNCTIONS = {
    "token_counts": (_tokens, "n_tokens long, n_distinct long, spread double, repeated double, parts long, part_var double"),
    "word_counts": (_words, "n_words long, n_code long"),
    "prose_counts": (_prose, "prose_wc long, prose_chars double, prose_sents double, syllables double, complex_words double"),
    "sentence_lengths": (_lengths, "mean double, var double"),
    "vocabulary": (_vocabulary, "known array<string>, content long"),
    "sentence_kinds": (_kinds, "array<int>"),
    "sentence_graph": (_graphs, "shared long, rank_cv double"),
    "sentence_twins": (_twins, "pairs long, filled long"),
    "term_vectors": (_vectors, "coherence double, topic_focus double"),
}


def column(call: str):
    """The column of ``@name(argument)``."""
    name, _, argument = call.removeprefix("@").removesuffix(")").partition("(")
    function, returns = FUNCTIONS[name]
    return F.pandas_udf(function, returns)(argument)
