"""Secret scans with multipart credential linking (operator 7).

Base kinds, leftmost and non-overlapping for each kind over the whole text (null: empty):

* ``assign``: a keyword (password, passwd, secret, token, api_key, apikey; letters in either case), at most one
  quote, spaces, ``:`` or ``=``, spaces, at most one quote and a value of at least 6 characters;
* ``access``: ``AKIA`` and capitals or digits, at least 20 characters in all;
* ``hex``: at least 24 of ``0-9a-f``.

Linking adds weak candidates, each by itself too common to report: ``identifier`` (client, account, user and
key ids that are assigned a value), ``value`` (strings of 20 or more letters and digits of all three kinds with
high entropy, outside base spans) and ``endpoint`` (URLs, hosts with a port). A part's interval is widened to its
scope, a block of lines between blank ones, and in a text without blank lines by ``REACH`` code points; an interval
join looks for overlaps. A weak identifier is reported if a secret (assign, hex, value) overlaps it, a weak
value if an identifier (access, identifier) does, an endpoint if both do. The join sorts each scope's starts
and bisects, so its cost follows the parts, not their pairs.

Offsets are code points, ends exclusive. A null id stays null; rows repeating an id are scanned each for
itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.llm.common import tidy
from textgauge.llm.tokens import str_texts

REACH = 200
KINDS = ("assign", "access", "hex", "identifier", "value", "endpoint")

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENTIFIER = re.compile(r"""(?ai)(client_?id|account_?id|access_?key_?id|user_?name|login|user)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})""")
_VALUE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_ENDPOINT = re.compile(r"""(?a)https?://[^\s"'<>()]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}\b""")
_BLANK = re.compile(r"\n[ \t\r]*\n")

Span = tuple[int, int, int]


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base kinds."""
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def _strong(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s) and entropy(s) >= 3.5


class _Parts:
    """The intervals of one class of parts within scopes, for overlap questions."""

    def __init__(self, spans: list[Span]) -> None:
        self.start = sorted(s for s, _, _ in spans)
        self.end = sorted(e for _, _, e in spans)

    def meets(self, lo: int, hi: int) -> bool:
        """Some interval overlaps [lo, hi): those that start before hi minus those that ended by lo."""
        return bisect_left(self.start, hi) > bisect_right(self.end, lo)


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates whose complementary parts are near them in their scope."""
    covered = _Parts(base)
    values = [] if not any(c.isdigit() for c in text) else [(m.start(), 4, m.end()) for m in _VALUE.finditer(text) if _strong(m.group()) and not covered.meets(m.start(), m.end())]
    identifiers = [(m.start(), 3, m.end()) for m in _IDENTIFIER.finditer(text) if not covered.meets(m.start(), m.end())] if ":" in text or "=" in text else []
    endpoints = [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)] if ":" in text else []
    if not (values or identifiers or endpoints):
        return []
    breaks = [m.start() for m in _BLANK.finditer(text)]
    secrets = _Parts([x for x in base if x[1] != 1] + values)
    ids = _Parts([x for x in base if x[1] == 1] + identifiers)

    def near(parts: _Parts, x: Span) -> bool:
        i = bisect_right(breaks, x[0])
        low = breaks[i - 1] if i else 0
        high = breaks[i] if i < len(breaks) else len(text)
        return parts.meets(low, high) if breaks else parts.meets(max(low, x[0] - REACH), min(high, x[2] + REACH))

    return (
        [x for x in identifiers if near(secrets, x)]
        + [x for x in values if near(ids, x)]
        + [x for x in endpoints if near(secrets, x) and near(ids, x)]
    )


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches):
    import pyarrow as pa

    for batch in batches:
        rows = []
        for text in str_texts(batch.column(1)):
            base = base_spans(text)
            weak = linked_spans(text, base)
            n = Counter(k for _, k, _ in base)
            rows.append((n[0], n[1], n[2], hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + weak)), len(weak)))
        a, b, c, d, e, f = zip(*rows) if rows else ((),) * 6
        long = pa.int64()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(a, long), pa.array(b, long), pa.array(c, long), pa.array(d, pa.string()), pa.array(e, pa.string()), pa.array(f, long)],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
        )


def _redact(i: int):
    """Replaces the texts of column ``i``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for value, null in zip(str_texts(batch.column(i)), batch.column(i).is_null().to_pylist()):
                base = base_spans(value)
                out, at = [], 0
                for start, kind, end in sorted(base + linked_spans(value, base)):
                    if end > at:
                        out += [value[at : max(start, at)], f"[{KINDS[kind].upper()}]" if start >= at else ""]
                        at = end
                texts.append(None if null else "".join([*out, value[at:]]))
            arrays = [pa.array(texts, pa.string()) if k == i else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked: one row per document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(tidy("secrets", _scan), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every span that ``scan_secrets`` reports replaced by its kind in brackets; overlapping
    spans become one mark. Null texts stay null, and all other columns as they are."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may hold anything
    out = plain.mapInArrow(tidy("secrets", _redact(docs.columns.index("text"))), plain.schema)
    return out.toDF(*docs.columns)
