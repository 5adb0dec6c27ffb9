"""Expressions as SQL text for Spark, and for DuckDB, which checks them.

A metric is written once as a function of a dialect; Spark evaluates it inside Catalyst without any
Python, and the same definition in the other dialect is its oracle.
"""

from __future__ import annotations

#: A character that belongs to a word. Boundaries are spelled out, since engines disagree on \\b.
WORD = r"\p{L}\p{N}_"


class Dialect:
    name = ""

    def lit(self, text: str) -> str:
        raise NotImplementedError

    def number(self, x) -> str:
        raise NotImplementedError

    def words(self, s: str) -> str:
        """White-space separated words."""
        return self.filter(self.split(s, r"[\s\p{Z}\x0B\x1C-\x1F\x85]+"), "w", "w <> ''")

    def has(self, s: str, pattern: str) -> str:
        raise NotImplementedError

    def has_word(self, s: str, pattern: str) -> str:
        """Whether ``pattern`` matches between word boundaries."""
        return self.has(s, rf"(^|[^{WORD}])(?:{pattern})([^{WORD}]|$)")

    def count_words(self, doubled: str, phrases) -> str:
        """Whole-phrase matches, over a text whose separators were doubled, so that neighbours both count."""
        alternatives = "|".join(_double(p) for p in phrases)
        return self.count(doubled, rf"(?:^|[^{WORD}])(?:{alternatives})(?:[^{WORD}]|$)")

    def doubled(self, s: str) -> str:
        return self.replace(s, rf"([^{WORD}])", 1, 1)

    def sum_of(self, conditions) -> str:
        return "(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conditions) + ")"

    def clamp(self, x: str) -> str:
        return f"greatest({self.number(0)}, least({self.number(1)}, {x}))"

    def gauss(self, x: str, mean: float, std: float) -> str:
        z = f"(({x} - {self.number(mean)}) / {self.number(std)})"
        return f"exp({self.number(-0.5)} * {z} * {z})"


def _double(phrase: str) -> str:
    """A phrase whose separators are doubled, as a pattern."""
    out = ""
    for c in phrase:
        out += c if c.isalnum() or c == "_" else f"{c}{c}"
    return out


class Spark(Dialect):
    name = "spark"

    def lit(self, text):
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def number(self, x):
        return f"{float(x)!r}D"

    def count(self, s, pattern):
        return f"regexp_count({s}, {self.lit(pattern)})"

    def has(self, s, pattern):
        return f"({s} RLIKE {self.lit(pattern)})"

    def all_matches(self, s, pattern):
        return f"regexp_extract_all({s}, {self.lit(pattern)}, 0)"

    def group(self, s, pattern, i):
        return f"regexp_extract({s}, {self.lit(pattern)}, {i})"

    def replace(self, s, pattern, *groups, text=""):
        to = "".join(f"${g}" for g in groups) + text
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(to)})"

    def split(self, s, pattern):
        return f"split({s}, {self.lit(pattern)})"

    def size(self, a):
        return f"size({a})"

    def filter(self, a, v, e):
        return f"filter({a}, {v} -> {e})"

    def transform(self, a, v, e):
        return f"transform({a}, {v} -> {e})"

    def upto(self, n):
        """0 to n - 1; empty for n < 1."""
        return f"filter(sequence(0, greatest({n}, 1) - 1), q -> q < {n})"

    def at(self, a, i):
        return f"get({a}, CAST({i} AS INT))"

    def part(self, a, start, n):
        return f"slice({a}, CAST({start} AS INT) + 1, CAST({n} AS INT))"

    def total(self, a):
        return f"aggregate(transform({a}, y -> CAST(y AS DOUBLE)), 0D, (s, y) -> s + y)"

    def distinct(self, a):
        return f"array_distinct({a})"

    def ordered(self, a):
        return f"array_sort({a})"

    def common(self, a, b):
        return f"array_intersect({a}, {b})"

    def overlap(self, a, b):
        return f"arrays_overlap({a}, {b})"

    def contains(self, a, x):
        return f"array_contains({a}, {x})"

    def as_double(self, x):
        return f"try_cast({x} AS DOUBLE)"

    def array(self, items):
        return f"array({', '.join(items)})"

    def join(self, a, sep):
        return f"array_join({a}, {self.lit(sep)})"


class Duck(Dialect):
    name = "duck"

    def lit(self, text):
        return "'" + text.replace("'", "''") + "'"

    def number(self, x):
        return f"CAST({float(x)!r} AS DOUBLE)"

    def count(self, s, pattern):
        return f"len(regexp_extract_all({s}, {self.lit(pattern)}))"

    def has(self, s, pattern):
        return f"regexp_matches({s}, {self.lit(pattern)})"

    def all_matches(self, s, pattern):
        return f"regexp_extract_all({s}, {self.lit(pattern)})"

    def group(self, s, pattern, i):
        return f"regexp_extract({s}, {self.lit(pattern)}, {i})"

    def replace(self, s, pattern, *groups, text=""):
        to = "".join(f"\\{g}" for g in groups) + text
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(to)}, 'g')"

    def split(self, s, pattern):
        return f"string_split_regex({s}, {self.lit(pattern)})"

    def size(self, a):
        return f"len({a})"

    def filter(self, a, v, e):
        return f"list_filter({a}, lambda {v}: {e})"

    def transform(self, a, v, e):
        return f"list_transform({a}, lambda {v}: {e})"

    def upto(self, n):
        return f"range(CAST({n} AS BIGINT))"

    def at(self, a, i):
        return f"({a})[CAST({i} AS BIGINT) + 1]"

    def part(self, a, start, n):
        return f"({a})[CAST({start} AS BIGINT) + 1 : CAST({start} AS BIGINT) + CAST({n} AS BIGINT)]"

    def total(self, a):
        return f"coalesce(CAST(list_sum(list_transform({a}, lambda y: CAST(y AS DOUBLE))) AS DOUBLE), 0)"

    def distinct(self, a):
        return f"list_distinct({a})"

    def ordered(self, a):
        return f"list_sort({a})"

    def common(self, a, b):
        return f"list_intersect({a}, {b})"

    def overlap(self, a, b):
        return f"list_has_any({a}, {b})"

    def contains(self, a, x):
        return f"list_contains({a}, {x})"

    def as_double(self, x):
        return f"try_cast({x} AS DOUBLE)"

    def array(self, items):
        return f"[{', '.join(items)}]"

    def join(self, a, sep):
        return f"array_to_string({a}, {self.lit(sep)})"


SPARK, DUCK = Spark(), Duck()
