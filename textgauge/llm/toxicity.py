"""Toxicity by weak supervision (operator 4).

1. Voters: single words and word stems (the first 4 and 5 letters), once, or at least 2 or 4 times, that are far more frequent in the training
   rows labelled toxic, and patterns (a general lexicon of insults, a second person next to one, shouting).
   Such a voter that matches a text votes toxic, else it abstains. Two voters vote for the other class: one where
   no toxic voter matches, one where at most one does.
2. A generative label model: each voter fires with one rate for each class. The rates, the class balance and
   the correlations of voters given the class are estimated by expectation maximisation from the votes alone: it starts
   from the share of toxic votes among a text's votes, and no label enters it;
   correlated voters share their weight, so that a stem and its words don't count as independent.
3. A linear classifier (logistic regression with ridge penalty) on words and stems is trained on the label
   model's posteriors and then scores every whole text.

Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0, and only choose voters and features. At most ``MAX_FIT`` labelled rows are
used (those of the smallest hash of their id), which bounds all that reaches the driver; features and voters are all
those over the thresholds below, without a number of their own. Scores use the text alone.

A null or empty text has no features and the score of the intercept. Without training rows of both labels
every score is the share of toxic rows (0 without any). Rows repeating an id are scored each for itself; a null
id is never a training row and not held out. Repeated labels of an id count as toxic if one of them does. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.llm.common import fold, saved, tidy
from textgauge.llm.tokens import str_texts

#: The bound of the fit: labelled rows.
MAX_FIT = 20_000
MIN_SUPPORT = 3
#: z of the log odds ratio of a feature and of a voter, at least; log odds ratio of a voter, at least.
MIN_Z = 2.5
VOTER_Z = 3.0
MIN_ODDS = 3.5
RIDGE = 0.3
_MEMO = 400_000

_WORD = re.compile(r"[^\W\d_]+")
#: Insults of everyday language in four languages, as a voter beside those found in the data.
INSULTS = frozenset(
    # English
    "idiot idiots idiotic moron morons moronic imbecile stupid stupidity dumb dumbass fool fools foolish loser losers pathetic worthless disgusting trash garbage scum clown clowns filthy filth "
    "vermin parasite parasites pig pigs coward cowards freak freaks creep creeps jerk jerks bastard bastards scumbag lowlife ugly retard retarded lunatic psycho "
    # Spanish
    "idiota idiotas estúpido estúpida estúpidos imbécil imbéciles basura tonto tonta tontos payaso payasos asqueroso asquerosa escoria inútil cobarde cerdo cerdos maldito maldita "
    # German
    "dummkopf dummköpfe trottel abschaum idioten vollidiot blödmann arschloch dreckig versager widerlich schwachkopf feigling schwein müll erbärmlich wertlos "
    # French
    "idiote idiots idiotes crétin crétins crétine imbécile imbéciles ordure ordures abruti abrutis débile minable dégoûtant dégoûtante salaud lâche clown nul nulle pourriture".split()
)
_SECOND = frozenset("you your you're du dein tu ton toi tú usted vous ihr".split())


def features(word: str) -> tuple[str, ...]:
    """A word's features: itself, its stems."""
    n = len(word)
    return (word,) if n < 4 else (word, "^" + word[:4]) if n < 5 else (word, "^" + word[:4], "^" + word[:5])


def counted(words: list[str], known=None) -> set[str]:
    """The features of a text: its words and stems, and those it has at least 2 or 4 times. With ``known``, a
    memo from words to the features that matter, only those."""
    n: Counter = Counter()
    for w, c in Counter(words).items():
        for f in features(w) if known is None else known(w):
            n[f] += c
    return {g for f, c in n.items() for g in ((f,) if c < 2 else (f, f + "#2") if c < 4 else (f, f + "#2", f + "#4"))}


def patterns(text: str, words: list[str]) -> tuple[bool, bool, bool]:
    hits = [i for i, w in enumerate(words) if w in INSULTS]
    near = any(words[j] in _SECOND for i in hits for j in range(max(0, i - 3), min(len(words), i + 4)))
    return bool(hits), near, bool(hits) and sum(1 for c in text if c.isupper()) > 0.5 * max(1, len(text))


def _support(batches):
    """How many toxic and other training texts have each feature."""
    import pyarrow as pa

    toxic, other = Counter(), Counter()
    for batch in batches:
        for text, label in zip(str_texts(batch.column(0)), batch.column(1).to_pylist()):
            own = counted(_WORD.findall(text.lower()))
            (toxic if label else other).update(own)
    names = list(set(toxic) | set(other))
    for i in range(0, len(names), 50_000):
        some = names[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([toxic[x] for x in some], pa.int64()), pa.array([other[x] for x in some], pa.int64())], ["feature", "a", "b"])


def _rows(index: dict[str, int]):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out, marks = [], []
            for text in str_texts(batch.column(0)):
                words = _WORD.findall(text.lower())
                out.append(sorted({i for f in counted(words) if (i := index.get(f)) is not None}))
                marks.append(list(patterns(text, words)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.bool_())), batch.column(1)], ["found", "patterns", "toxic"])

    return run


def label_model(toxic: np.ndarray, other: np.ndarray, steps: int = 100) -> tuple[np.ndarray, dict]:
    """Posteriors of the toxic class, and what was estimated, from votes (rows x voters, true where a voter speaks)
    for the toxic and for the other class, by expectation maximisation.

    First posteriors are the share of toxic votes in a row. A voter's rate in a class is the share of the class's rows in which it speaks.
    Given the class, a residual correlation of two voters over 0.4 lowers the weight of both: a voter weighs
    1 / (1 + the sum of such correlations)."""
    toxic = toxic[:, toxic.any(axis=0)]  # a voter that never speaks tells nothing
    v = np.column_stack([toxic, other]).astype(np.float32)
    together = (v.T @ v).astype(float)
    p = np.clip(toxic.sum(axis=1) / np.maximum(1, toxic.sum(axis=1) + other.sum(axis=1)), 0.02, 0.98)
    for _ in range(steps):
        rate1, rate0 = (p @ v + 0.5) / (p.sum() + 1), ((1 - p) @ v + 0.5) / ((1 - p).sum() + 1)
        balance = np.clip(p.mean(), 1e-3, 0.5)
        # the residuals v - p rate1 - (1 - p) rate0, multiplied out
        both, rates = np.column_stack([p, 1 - p]), np.stack([rate1, rate0])
        cross = (v.T @ both) @ rates
        correlation = (together - cross - cross.T + rates.T @ (both.T @ both) @ rates) / len(v)
        spread = np.sqrt(np.maximum(np.diag(correlation), 0) + 1e-9)
        correlation = correlation / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0)
        weight = 1 / (1 + np.where(correlation > 0.4, correlation, 0).sum(axis=1))
        logit = np.log(balance / (1 - balance)) + v @ (weight * np.log(rate1 / rate0))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        moved, p = np.abs(new - p).max(), new
        if moved < 1e-6:
            break
    return p, {"balance": balance, "rate1": rate1, "rate0": rate0, "weight": weight}


def ridge_logistic(rows: list[list[int]], target: np.ndarray, size: int, ridge: float = RIDGE, steps: int = 1500) -> tuple[float, np.ndarray]:
    """Intercept and weights on binary features for soft targets, by accelerated gradient steps."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([i for r in rows for i in r], np.int64)
    n = max(1, len(rows))
    support = np.bincount(column, minlength=size).astype(float)
    scale = 1 / np.sqrt(support + ridge + 1)  # columns are scaled by their support
    w, b = np.zeros(size), 0.0
    w_ahead, b_ahead, t = w.copy(), b, 1.0
    width = np.bincount(owner, weights=scale[column] ** 2, minlength=n).max(initial=0.0)
    rate = 1 / (0.25 * max(width * 8, 1.0) + ridge * (scale**2).max(initial=0))
    for _ in range(steps):
        z = b_ahead + np.bincount(owner, weights=(w_ahead * scale)[column], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        gw = scale * np.bincount(column, weights=error[owner], minlength=size) + ridge * scale**2 * w_ahead
        w_new, b_new = w_ahead - rate * gw, b_ahead - 4 * error.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_ahead, b_ahead = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b) * 0
        moved = max(np.abs((w_new - w) * scale).max(initial=0.0), abs(b_new - b))
        w, b, t = w_new, b_new, t_new
        if moved < 1e-5:
            break
    return float(b), w * scale


def calibration(z: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of the labels over the scores z, by Newton's method with a slight pull to (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        gradient = np.array([((q - labels) * z).sum() + a - 1, (q - labels).sum() + b])
        h = q * (1 - q)
        move = np.linalg.solve(np.array([[(h * z * z).sum() + 1, (h * z).sum()], [(h * z).sum(), h.sum() + 1]]), gradient)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-9:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[float, dict[str, float]]:
    """Intercept and weights of features, from the labelled rows outside the held-out fold."""
    usable = labels.filter("doc_id is not null and toxic is not null").filter(fold("doc_id") != 0)
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_FIT)
    chosen = saved(chosen, "toxicity-labels")
    rows = saved(docs.join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") == 1).alias("toxic")), "toxicity-rows")  # MAX_FIT rows at most
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = size.get(True, 0), size.get(False, 0)
    if not n1 or not n0:
        share = n1 / max(1, n1 + n0)
        return (-30.0 if not share else 30.0), {}
    counts = rows.mapInArrow(tidy("toxicity", _support), "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = counts.filter(F.col("a") + F.col("b") >= MIN_SUPPORT)
    odds = F.log((F.col("a") + 0.5) / (n1 - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n0 - F.col("b") + 0.5))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    top = counts.withColumn("odds", odds).withColumn("z", z).filter((F.col("a") > 0) & (F.col("z") > MIN_Z)).orderBy(F.col("z").desc(), "feature").collect()
    names = [r["feature"] for r in top]
    voters = [i for i, r in enumerate(top) if r["z"] > VOTER_Z and r["odds"] > MIN_ODDS and r["a"] >= MIN_SUPPORT]
    data = rows.mapInArrow(tidy("toxicity", _rows({f: i for i, f in enumerate(names)})), "found array<int>, patterns array<boolean>, toxic boolean").collect()
    data.sort(key=lambda r: (r["found"], r["patterns"], r["toxic"]))  # the fit doesn't depend on the order of rows
    found = [r["found"] for r in data]
    votes = np.zeros((len(data), len(voters) + 3), bool)
    place = {i: k for k, i in enumerate(voters)}
    for row, r in enumerate(data):
        for i in r["found"]:
            if i in place:
                votes[row, place[i]] = True
        votes[row, len(voters) :] = r["patterns"]
    spoken = votes.sum(axis=1)
    posterior, _ = label_model(votes, np.column_stack([spoken == 0, spoken <= 1]))
    intercept, weights = ridge_logistic(found, posterior, len(names))
    z = np.array([intercept + weights[r].sum() for r in found])
    slope, shift = calibration(z, np.array([r["toxic"] for r in data], float))
    return slope * intercept + shift, {f: slope * float(w) for f, w in zip(names, weights)}


def _score(intercept: float, weights: dict[str, float]):
    def run(batches):
        import pyarrow as pa

        memo: dict[str, tuple] = {}
        base = {f.partition("#")[0] for f in weights}

        def known(w: str) -> tuple:
            own = memo.get(w)
            if own is None:
                if len(memo) > _MEMO:
                    memo.clear()
                own = memo[w] = tuple(f for f in features(w) if f in base)
            return own

        for batch in batches:
            scores = []
            for text in str_texts(batch.column(1)):
                found = counted(_WORD.findall(text.lower()), known)
                z = intercept + sum(weights[f] for f in sorted(found) if f in weights)
                scores.append(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    intercept, weights = fit(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"))
    scored = docs.mapInArrow(tidy("toxicity", _score(intercept, weights)), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
