"""DuckDB statements for what Spark computes outside SQL: term vectors and PageRank as joins over all pairs.

They share no code with ``operators.sentences``: that one works from running sums within a row.
"""

from __future__ import annotations

from textgauge.functions import lexicons as lex
from textgauge.functions.dialect import DUCK


def _sentences(source: str) -> str:
    return f"SELECT id, ns, u.i - 1 AS s, sents[u.i] AS sent, sent_content[u.i] AS content FROM {source}, (SELECT unnest(range(1, 100001)) AS i) u WHERE ns > 1 AND u.i <= ns"


def vectors_sql(source: str) -> str:
    """id, coherence, topic_focus of ``source`` (id, sents, sent_content, ns) from TF-IDF vectors of each text's sentences."""
    stop = ", ".join(map(DUCK.lit, lex.STOP_WORDS))
    terms = DUCK.filter(DUCK.all_matches("lower(sent)", r"[\p{L}\p{N}_]{2,}"), "w", f"w NOT IN ({stop})")
    words = f"SELECT id, ns, s, unnest(ws) AS term FROM (SELECT id, ns, s, {terms} AS ws FROM ({_sentences(source)}))"
    return f"""
WITH tf AS (SELECT id, ns, s, term, CAST(count(*) AS DOUBLE) AS tf FROM ({words}) GROUP BY id, ns, s, term),
idf AS (SELECT *, tf * (ln((1 + ns) / CAST(1 + count(*) OVER (PARTITION BY id, term) AS DOUBLE)) + 1) AS raw FROM tf),
unit AS (SELECT id, ns, s, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id, s)) AS w FROM idf),
near AS (SELECT *, lead(s) OVER (PARTITION BY id, term ORDER BY s) AS s2, lead(w) OVER (PARTITION BY id, term ORDER BY s) AS w2, sum(w) OVER (PARTITION BY id, term) / ns AS m FROM unit),
terms AS (SELECT id, max(ns) AS ns, sum(CASE WHEN s2 = s + 1 THEN w * w2 ELSE 0 END) AS consecutive, sum(w * m) AS along, sum(m * m / seen) AS centre FROM (SELECT *, count(*) OVER (PARTITION BY id, term) AS seen FROM near) GROUP BY id)
SELECT id, greatest(0, least(1, 1.5 * consecutive / (ns - 1))) AS coherence, greatest(0, least(1, 1 - 2 * (1 - along / sqrt(centre) / ns))) AS topic_focus FROM terms"""


def rank_sql(source: str) -> str:
    """id, rank_cv of ``source`` (id, sents, sent_content, ns): PageRank by recursion, a text's rows until its ranks move
    by less than a millionth a sentence, or 100 steps."""
    return f"""
WITH RECURSIVE s AS ({_sentences(source)}),
words AS (SELECT id, s, unnest(content) AS term FROM s),
apart AS (SELECT a.id, a.s AS i, b.s AS j, CAST(count(*) AS DOUBLE) AS weight FROM words a JOIN words b ON a.id = b.id AND a.term = b.term AND b.s > a.s + 1 GROUP BY ALL),
edges AS (SELECT * FROM apart UNION ALL SELECT id, s, s + 1, CAST(1 AS DOUBLE) FROM s WHERE s + 1 < ns),
given AS (SELECT id, i, sum(weight) AS total FROM edges GROUP BY ALL),
links AS (SELECT e.id, e.i, e.j, e.weight / g.total AS share, FALSE AS hanging FROM edges e JOIN given g ON e.id = g.id AND e.i = g.i
  UNION ALL SELECT s.id, s.s, s.s, CAST(0 AS DOUBLE), g.total IS NULL FROM s LEFT JOIN given g ON s.id = g.id AND s.s = g.i),
ranks AS (SELECT id, 0 AS k, s AS i, ns, CAST(1 AS DOUBLE) / ns AS r, FALSE AS done FROM s
  UNION ALL
  SELECT id, k, i, ns, r, sum(abs(r - was)) OVER (PARTITION BY id) < ns * 1e-6 OR k >= 100 AS done FROM (
    SELECT id, k + 1 AS k, j AS i, ns, was, CAST(0.85 AS DOUBLE) * (flow + sum(loose) OVER (PARTITION BY id) / ns) + CAST(0.15 AS DOUBLE) / ns AS r FROM (
      SELECT l.id, k, j, ns, sum(r * share) AS flow, max(CASE WHEN l.i = j THEN r END) AS was, sum(CASE WHEN hanging THEN r ELSE 0 END) AS loose
      FROM ranks JOIN links l ON ranks.id = l.id AND ranks.i = l.i WHERE NOT done GROUP BY l.id, k, j, ns)))
SELECT id, stddev_pop(r) / avg(r) AS rank_cv FROM ranks WHERE done GROUP BY id"""


def all_metrics_sql(rows: str) -> str:
    """``rows`` (the metrics of the row alone, with ns, sents and sent_content) with the three that compare sentences."""
    return f"""WITH rows AS ({rows}), found AS ({vectors_sql('rows')}), ranked AS ({rank_sql('rows')})
SELECT rows.*, CASE WHEN ns <= 1 THEN CAST(0.5 AS DOUBLE) ELSE coalesce(coherence, CAST(0.3 AS DOUBLE)) END AS coherence,
CASE WHEN ns <= 1 THEN CAST(0.5 AS DOUBLE) ELSE coalesce(topic_focus, CAST(0.5 AS DOUBLE)) END AS topic_focus,
CASE WHEN ns <= 1 THEN CAST(0.4 AS DOUBLE) ELSE exp(-0.5 * ((rank_cv - 0.4) / 0.3) * ((rank_cv - 0.4) / 0.3)) END AS centrality
FROM rows LEFT JOIN found ON rows.id = found.id LEFT JOIN ranked ON rows.id = ranked.id"""
