"""Documents with everything that real tables hold: nulls, blanks, copies, long texts, odd characters, extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, label string, n int, block int, h double, trusted boolean"

WORDS = "the of and river stone lamp walk over under seven green light house paper window table garden cloud song night".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def messy_rows(seed=5, n=60):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(3, 120)) for _ in range(n)]
    for i in range(0, n, 7):
        texts[i] = texts[(i + 1) % n]  # exact copies
    for i in range(3, n, 9):
        words = texts[i - 1].split()
        words[len(words) // 2 : len(words) // 2 + 1] = ["changed"]
        texts[i] = " ".join(words)  # near copies
    texts += ["", None, "   \n\t ", "one", "Two", "two", "a\x0bb\x0cc \x1d d", "é½ 日本語 😀 Ω", "   nbsp wide", "x" * 5000, "a b " * 4000, "tab\tend \n\n  two\r\nlines  ", "W̊ ABC İstanbul", "▁mark ▁▁ it", "zero\x00byte \x00"]
    langs = ["en", "fr", None, "EN", "x1"]
    rows = [(i, t, langs[i % 5], f"s{i % 3}", None if t is None else len(t), -i, "l", 1, 2, 0.5, False) for i, t in enumerate(texts)]
    rows.append((None, "a row without an id that is otherwise fine", None, None, None, None, None, None, None, None, None))
    rows.append(rows[4])  # a repeated row
    return rows


def messy(spark, parts=3):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    """Rows as sorted tuples, nulls first."""
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))
