"""Quality rules by distribution divergence (operator 10).

Words are runs of characters other than ASCII white space. Base counts of a text: its words, their code
points, symbols out of ``#*$%&|<>``, lines (split at line ends) with a word that equal an earlier line, and
words in 5-word windows that the text holds at least twice. The base rules fail a text of fewer than
``MIN_WORDS`` words or with more than 20 % of its words in such windows.

The method's verdict compares two histograms of a text with those of its language, taken from all
documents: character classes, and the language's ``COMMON`` most frequent words against all others. The
distance is Jensen-Shannon's (base 2, so 0 to 1). Texts shorter than the guards have no verdict against
them, nor have texts of a language whose reference has too few words.

Languages are codes of two or three letters; any other value, null too, is one group named ``und``. So the
references have a bound (18,253 codes x ``COMMON`` words) and go to the executors as constants.

A null text counts as empty: no words, so base_failed. Rows repeating an id are judged each for itself. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textgauge.llm.common import saved, texts_of, tidy

MIN_WORDS = 10
COMMON = 100
#: Guards: least letters for the character classes, least words for the common words, least words of a reference.
GUARD_CHARS = 100
GUARD_WORDS = 30
GUARD_REFERENCE = 2000
#: A text fails over these distances.
MAX_CHARS = 0.32
MAX_WORDS = 0.52

#: Character classes of UTF-8 bytes; bytes inside a character count nothing.
CLASSES = ("vowel", "consonant", "upper", "digit", "space", "stop", "symbol", "beyond")
_FLUSH = 300_000


def _class_matrix() -> np.ndarray:
    m = np.zeros((256, len(CLASSES)))
    for b in range(128):
        c = chr(b)
        i = 0 if c in "aeiou" else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in ".,;:!?'\"-()" else 6
        m[b, i] = 1
    m[0xC0:, 7] = 1
    return m


_MATRIX = _class_matrix()
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def histograms(texts: list[bytes]) -> np.ndarray:
    """Byte counts, a row for each text."""
    return np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts]).reshape(-1, 256)


def repeat_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows of ``window`` words that occur at least twice, the first time included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    one = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    size = len(ids)
    key, bound = one, size
    for j in range(1, window):
        if bound > (1 << 62) // max(size, 1):
            key = np.unique(key, return_inverse=True)[1]
            bound = int(key.max()) + 1
        key = key[: len(words) - j] * size + one[j:]
        bound *= size
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    if not len(at):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of p from the row of q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


_MARKS = (b".", b",", b";", b":", b"!", b"?")


def plain(word: bytes) -> bytes:
    """A word as it counts in a histogram, in a reference's as in a text's: without one mark at its end."""
    return word[:-1] if len(word) > 1 and word.endswith(_MARKS) else word


def _count(batches):
    """Words and character classes by language, added up within a task."""
    from collections import Counter

    import pyarrow as pa

    words: dict[str, Counter] = {}
    classes: dict[str, np.ndarray] = {}

    def out():
        lang, term, n = [], [], []
        for k, raw in words.items():
            c: Counter = Counter()
            for w, times in raw.items():
                c[plain(w)] += times
            lang.extend([k] * len(c))
            term.extend(c.keys())
            n.extend(c.values())
        words.clear()
        for i in range(0, len(lang), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(lang[i : i + 50_000], pa.string()), pa.array(term[i : i + 50_000], pa.binary()), pa.array(n[i : i + 50_000], pa.int64())], ["lang", "term", "n"])

    for batch in batches:
        texts = texts_of(batch.column(1))
        if not texts:
            continue
        counts = histograms(texts) @ _MATRIX
        for i, lang in enumerate(batch.column(0).to_pylist()):
            words.setdefault(lang, Counter()).update(texts[i].lower().split())
            classes[lang] = classes.get(lang, 0) + counts[i]
        if sum(map(len, words.values())) > _FLUSH:
            yield from out()
    yield from out()
    for lang, c in classes.items():  # a class goes under a name that no word has
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(CLASSES)), pa.array([b" " + x.encode() for x in CLASSES], pa.binary()), pa.array(c.astype(np.int64))], ["lang", "term", "n"])


def references(docs: DataFrame) -> dict[str, dict]:
    """By language: character-class shares, the common words with their shares, words in all."""
    counts = saved(docs.select("lang", "text").mapInArrow(tidy("rules", _count), "lang string, term binary, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")), "rules-counts")
    is_class = F.substring(F.col("term").cast("string"), 1, 1) == " "
    total = {r["lang"]: r["n"] for r in counts.filter(~is_class).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "term")
    top = counts.filter(~is_class).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= COMMON)
    out = {k: {"words": {}, "classes": np.zeros(len(CLASSES)), "total": n} for k, n in total.items()}
    for r in top.collect():
        out[r["lang"]]["words"][bytes(r["term"])] = r["n"]
    for r in counts.filter(is_class).collect():
        if r["lang"] in out:
            out[r["lang"]]["classes"][CLASSES.index(bytes(r["term"]).decode()[1:])] = r["n"]
    return out


def _judge(refs: dict[str, dict]):
    tables = {}
    for lang, ref in refs.items():
        order = sorted(ref["words"], key=lambda w: (-ref["words"][w], w))
        # all words that ``plain`` turns into a common word
        index = {t: i for i, w in enumerate(order) for t in (w, *(w + mark for mark in _MARKS)) if plain(t) == w}
        share = np.array([ref["words"][w] for w in order], float) / max(ref["total"], 1)
        tables[lang] = (index, np.append(share, max(0.0, 1 - share.sum())), ref["classes"] / max(ref["classes"].sum(), 1), ref["total"] >= GUARD_REFERENCE)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = texts_of(batch.column(2))
            if not texts:
                continue
            langs = batch.column(1).to_pylist()
            counts = histograms(texts)
            space = counts[:, 32] + counts[:, 9:14].sum(axis=1)
            points = counts.sum(axis=1) - counts[:, 0x80:0xC0].sum(axis=1)
            classes = counts @ _MATRIX
            rows = []
            for i, (text, lang) in enumerate(zip(texts, langs)):
                words = text.split()
                far_chars = far_words = None
                if (ref := tables.get(lang)) and ref[3]:
                    index, common, letters, _ = ref
                    if points[i] >= GUARD_CHARS:
                        far_chars = float(divergence(classes[i : i + 1] / classes[i].sum(), letters[None])[0])
                    if len(words) >= GUARD_WORDS:
                        n = len(common) - 1
                        found = np.bincount([index.get(w, n) for w in text.lower().split()], minlength=n + 1) / len(words)
                        far_words = float(divergence(found[None], common[None])[0])
                rows.append((len(words), dup_lines(text), repeat_words(words), far_chars, far_words))
            got = pd.DataFrame(rows, columns=["n_words", "n_dup_lines", "n_repeat_words", "js_chars", "js_words"])
            failed = (got.n_words < MIN_WORDS) | (100 * got.n_repeat_words > 20 * got.n_words)
            far = (got.js_chars.astype(float) > MAX_CHARS) | (got.js_words.astype(float) > MAX_WORDS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(got.n_words, pa.int64()),
                    pa.array(points - space, pa.int64()),
                    pa.array(counts[:, _SYMBOLS].sum(axis=1), pa.int64()),
                    pa.array(got.n_dup_lines, pa.int64()),
                    pa.array(got.n_repeat_words, pa.int64()),
                    pa.array(failed.to_numpy()),
                    pa.array((~failed & ~far).to_numpy()),
                    pa.array([r[3] for r in rows], pa.float64()),
                    pa.array([r[4] for r in rows], pa.float64()),
                    *batch.columns[3:],
                ],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_chars", "js_words", *batch.schema.names[3:]],
            )

    return run


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, js_chars double, js_words double"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document with the base counts, the distances and the verdict. Columns named in ``carry``
    follow, named ``c_<name>``."""
    code = F.lower(F.col(lang_col))
    lang = F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise("und")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text"), *(F.col(f"`{c.replace('`', '``')}`").alias(f"c_{c}") for c in carry))
    schema = StructType([*StructType.fromDDL(SCHEMA).fields, *(docs.schema[f"c_{c}"] for c in carry)])
    return docs.mapInArrow(tidy("rules", _judge(references(docs))), schema)
