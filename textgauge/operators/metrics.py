"""The metrics of a text as expressions over its row: no shuffle, no Python.

``stages(d)`` lists columns in the order in which they build on each other, from ``text`` to one score in
[0, 1] for each metric. Metrics that need a linguistic resource read a provider column (``PROVIDERS``); where it is
null, the documented neutral value or a lexical stand-in counts. Expressions starting with ``@`` count the row's words and compare
its sentences (``operators.sentences``); the DuckDB side of those is written on its own, over arrays, all pairs and as joins. In Spark a
phrase or pattern is looked for only where the text holds a word that any match must hold (``lexicons.anchors``).
"""

from __future__ import annotations

import re

from textgauge.functions import lexicons as lex
from textgauge.functions.dialect import WORD, Dialect

#: Optional columns by text, from taggers or dictionaries of the caller's choice, with their types.
PROVIDERS = {
    "p_typos": "bigint",
    "p_grammar_errors": "bigint",
    "p_entities": "bigint",
    "p_tech_terms": "bigint",
    "p_role_entities": "bigint",
    "p_english_ratio": "double",
    "p_rarity": "double",
    "p_diversity": "double",
    "p_tone_variance": "double",
    "p_tone_mixed": "boolean",
    "p_subjectivity": "double",
    "p_depth": "double",
    "p_clauses": "double",
    "p_reference_similarity": "double",
}

RULES = ["length", "grammar", "readability", "specificity", "structure", "task_signal", "constraints", "contradiction", "reference_similarity", "persona_signal", "few_shot_quality", "hedging", "safety", "output_schema", "compound_task_count", "imperative_strength"]
SEMANTIC = ["coherence", "semantic_density", "topic_focus", "lexical_sophistication", "sentence_flow", "reference_resolution", "tone_consistency", "objectivity", "syntactic_complexity", "discourse_markers"]
INFORMATION = ["shannon_entropy", "redundancy", "information_density", "vocabulary_richness", "ngram_repetition", "burstiness", "sentence_repetition"]
GRAPH = ["completeness", "has_context", "has_task", "has_constraint", "connectivity", "information_flow", "complexity", "centrality"]
PILLARS = {"rule_based": RULES, "semantic_structural": SEMANTIC, "info_theoretic": INFORMATION, "graph_analysis": GRAPH}
METRICS = [m for names in PILLARS.values() for m in names]


#: White space, and quotes, within patterns.
_SPACE = r"[ \t\n\x0B\f\r]"
_QUOTES = r"'\x22"


def _unicode(pattern: str) -> str:
    """``\\w`` and the closing ``\\b`` of a pattern by their Unicode classes."""
    return pattern.replace("[\\w", f"[{WORD}").replace("\\w", f"[{WORD}]").replace("\\b", f"(?:[^{WORD}]|$)")


def _plain(p: str) -> bool:
    return all(c.isalpha() or c in " '" for c in p)


def _anchored(d: Dialect, p: str, test: str) -> str:
    """A test for a phrase or pattern, after a look at the words that the text holds of the lists."""
    words = lex.anchors(p)
    if d.name == "duck" or not words or not lex.VOCABULARY.issuperset(words):
        return test
    return f"(({' OR '.join(d.contains('known', d.lit(w)) for w in words)}) AND {test})"


def present(d: Dialect, p: str, text: str = "low") -> str:
    """Whether a phrase or pattern occurs between word boundaries."""
    words = lex.anchors(p)
    if p.isalpha() and d.name == "duck":
        return d.contains("wl", d.lit(p))
    if lex.VOCABULARY.issuperset(words) and (p.isalpha() or p.endswith("(?:ly)?") and words) and d.name == "spark":
        return "(" + " OR ".join(d.contains("known", d.lit(w)) for w in words) + ")"
    has = d.has_word(text, _unicode(p))
    return _anchored(d, p, f"(contains({text}, {d.lit(p)}) AND {has})" if _plain(p) else has)


def hits(d: Dialect, phrases: list[str]) -> str:
    """Occurrences of all phrases: single words by their tokens, others by patterns where the text has them."""
    single = [p for p in phrases if p.isalpha()]
    out = [d.size(d.filter(_listed(d), "w", f"w IN ({', '.join(map(d.lit, single))})"))] if single else []
    counts = {p: d.count("low", f"(?<![{WORD}]){p}(?![{WORD}])") if d.name == "spark" else d.count_words("dbl", [p]) for p in phrases if not p.isalpha()}
    out += [f"CASE WHEN {_anchored(d, p, f'contains(low, {d.lit(p)})')} THEN {count} ELSE 0 END" for p, count in counts.items()]
    return "(" + " + ".join(out) + ")"


def _listed(d: Dialect) -> str:
    """The text's words, in Spark those that some list holds."""
    return "known" if d.name == "spark" else "wl"


def entropy(d: Dialect, tokens: str, v: str = "i") -> str:
    """Shannon entropy (bits) of a token array: log2(N) - sum(c log2 c) / N over run lengths of the sorted array."""
    n = f"CAST({d.size(tokens)} AS DOUBLE)"
    return f"CASE WHEN {d.size(tokens)} = 0 THEN {d.number(0)} ELSE log2({n}) - {d.total(d.transform(runs(d, tokens, v), 'c', f'c * log2(CAST(c AS DOUBLE))'))} / {n} END"


def runs(d: Dialect, tokens: str, v: str = "i") -> str:
    """Counts of the distinct values of an array: differences of the places where a run of equals ends."""
    if d.name == "spark":
        ends = f"transform(array(array_sort({tokens})), a -> filter(transform(a, ({v}, k) -> CASE WHEN k + 1 = size(a) OR {v} <> get(a, k + 1) THEN k + 1 END), e -> e IS NOT NULL))[0]"
        return f"transform(array({ends}), b -> transform(b, (e, k) -> CASE WHEN k = 0 THEN e ELSE e - get(b, k - 1) END))[0]"
    return f"map_values(list_histogram({tokens}))"


def _bands(x: str, bands: list[tuple[str, float]], other: float, d: Dialect) -> str:
    return "CASE " + " ".join(f"WHEN {x} {test} THEN {d.number(v)}" for test, v in bands) + f" ELSE {d.number(other)} END"


def stages(d: Dialect) -> list[dict[str, str]]:
    n, clamp = d.number, d.clamp
    token = r"[\p{L}\p{N}_]+|[^ \t\n\x0B\f\r\p{L}\p{N}_]"
    sentence_cut = d.replace("t", r"([.!?])[ \t\n\x0B\f\r]+", 1, text="\n")
    words_low = d.all_matches("low", rf"[{WORD}]+")

    one: dict[str, str] = {"t": "coalesce(text, '')"}
    spark = d.name == "spark"
    listed = _listed(d)
    # tokens set apart by spaces, or cut out
    tokens = {"marked": f"CAST({d.replace('t', r'([^ \t\n\x0B\f\r\p{L}\p{N}_])', text=' $1 ')} AS BINARY)"} if spark else {"words": d.words("t"), "tokens": d.all_matches("t", token)}
    two = {"low": "lower(t)", **tokens, "sents": d.filter(d.transform(d.split(sentence_cut, "\n"), "x", "trim(x)"), "x", "x <> ''")}
    blank = "[ \t\n\x0B\f\r]+"
    prose = d.replace(d.replace(d.replace("t", r"(?s)```.*?```", text=" "), r"`[^`]*`", text=" "), r"(?m)^(?:    |\t).*$", text=" ")
    if spark:  # a single space stays as it is
        prose = f"CASE WHEN contains(t, '`') OR contains(t, '    ') OR contains(t, '\t') THEN {prose} ELSE t END"
        blank = "[\t\n\x0B\f\r][ \t\n\x0B\f\r]*| [ \t\n\x0B\f\r]+"
    three = {
        "dbl": d.doubled("low"),
        "wl": words_low,
        "wc": f"CAST({d.size('words')} AS BIGINT)",
        "n_tokens": f"CAST({d.size('tokens')} AS BIGINT)",
        "n_distinct": f"CAST({d.size(d.distinct('tokens'))} AS BIGINT)",
        "ns": f"CAST({d.size('sents')} AS BIGINT)",
        "prose": f"trim({d.replace(prose, blank, text=' ')})",
        "sent_low": d.transform("sents", "x", "lower(x)"),
        # the first word of letters alone
        "openers": d.transform("sents", "x", d.group("x", rf"(?:^|[^{WORD}])(\p{{L}}+)(?:[^{WORD}]|$)", 1)),
        "sent_wc": d.transform("sents", "x", f"CAST({d.size(d.words('x'))} AS DOUBLE)"),
        # words longer than 2, then without the marks around them
        "sent_sets": d.transform("sents", "x", d.distinct(d.transform(d.filter(d.words("lower(x)"), "w", "length(w) > 2"), "w", d.replace("w", r"^[.,!?;:]+|[.,!?;:]+$", text="")))),
        "sent_terms": d.transform("sents", "x", d.filter(d.all_matches("lower(x)", r"[\p{L}\p{N}_]{2,}"), "w", f"w NOT IN ({', '.join(map(d.lit, lex.STOP_WORDS))})")),
        "sent_content": d.transform("sents", "x", d.distinct(d.filter(d.all_matches("lower(x)", r"[\p{L}]{3,}"), "w", f"w NOT IN ({', '.join(map(d.lit, lex.STOP_WORDS))})"))),
    }
    if spark:
        lines = d.join("sent_low", "\n")
        cut = {"lines": lines, "spaced": d.replace(lines, rf"[^{WORD} \t\n\x0B\f\r]+", text=" ")}
        compared = {"tw": "@word_counts(t)", "pr": "@prose_counts(prose)", "tk": "@token_counts(marked)", "vocabulary": "@vocabulary(spaced)", "may": "@sentence_kinds(spaced)", "graph": "@sentence_graph(spaced)", "alike": "@sentence_twins(lines)", "sw": "@sentence_lengths(lines)", "vectors": "@term_vectors(spaced)"}
        counted = {"wc": "tw.n_words", "known": "vocabulary.known", "n_content": "vocabulary.content", "n_tokens": "tk.n_tokens", "n_distinct": "tk.n_distinct"}
        for c in ("dbl", "wl", "wc", "n_tokens", "n_distinct", "sent_wc", "sent_sets", "sent_terms", "sent_content"):
            del three[c]
    else:
        cut, compared, counted = {}, {}, {}
    kinds = [
        ("EXAMPLE", lex.EXAMPLE_MARKERS),
        ("CONSTRAINT", lex.CONSTRAINT_MARKERS),
        ("TASK", lex.TASK_MARKERS),
        ("CONTEXT", lex.CONTEXT_MARKERS),
    ]

    def kind(x: str) -> str:
        whens = []
        for name, markers in kinds:
            test = d.has_word(x, "|".join(markers))
            if name == "TASK":
                test = f"({test} OR {d.has(x, rf'(^|[^{WORD}])(?:{'|'.join(lex.TASK_QUESTIONS)})([^{WORD}].*)?\?')})"
            whens.append(f"WHEN {test} THEN '{name}'")
        return f"CASE {' '.join(whens)} ELSE 'OTHER' END"

    pwords = d.words("prose")
    space, vowels = r"\s\p{Z}\x0B\x1C-\x1F\x85", lex.VOWELS
    if spark:  # words with three groups of vowels in one pass over the text
        complex_words = d.count("lower(prose)", rf"(?<![^{space}])(?:[^{space}{vowels}]*+[{vowels}]++){{3}}[^{space}]*+")
        coded, mean_swc, swc_var = "tw.n_code", "sw.mean", "sw.var"
        tokens_h = f"CASE WHEN n_tokens = 0 THEN {n(0)} ELSE log2(CAST(n_tokens AS DOUBLE)) - tk.spread / CAST(n_tokens AS DOUBLE) END"
        content, grams, gram_runs, repeated = {}, {}, {}, "tk.repeated"
        n_parts, part_var, filled, repeats, edges = "tk.parts", "tk.part_var", "alike.filled", "alike.pairs", "graph.shared"
        each_kind = f"transform(sent_low, (x, i) -> CASE WHEN get(may, i) = 0 THEN 'OTHER' ELSE {kind('x')} END)"
    else:
        complex_words = d.size(d.filter(pwords, "w", d.count("lower(w)", f"[{vowels}]+") + " >= 3"))
        mean_swc, swc_var = f"{d.total('sent_wc')} / ns", _variance(d, "sent_wc")
        coded = d.size(d.filter("words", "w", d.has("w", lex.CODE)))
        tokens_h, each_kind = entropy(d, "tokens"), d.transform("sent_low", "x", kind("x"))
        content = {"n_content": f"CAST({d.size(d.distinct(d.filter('wl', 'w', f'length(w) > 2 AND w NOT IN ({', '.join(map(d.lit, lex.STOP_WORDS))})')))} AS BIGINT)"}
        grams = {
            "chunk": "greatest(n_tokens // 5, 3)",
            "grams": f"CASE WHEN n_tokens < 4 THEN [CAST(NULL AS VARCHAR)] ELSE list_concat({d.transform(d.upto('n_tokens - 1'), 'i', f'concat({d.at('tokens', 'i')}, chr(1), {d.at('tokens', 'i + 1')})')}, {d.transform(d.upto('n_tokens - 2'), 'i', f'concat({d.at('tokens', 'i')}, chr(1), {d.at('tokens', 'i + 1')}, chr(1), {d.at('tokens', 'i + 2')})')}) END",
        }
        gram_runs = {
            "gram_runs": f"CASE WHEN n_tokens < 4 THEN NULL ELSE {runs(d, 'grams', 'g')} END",
            "chunk_h": d.transform(d.filter(d.upto("CASE WHEN n_tokens < 10 THEN 0 ELSE CAST(ceil(n_tokens / CAST(chunk AS DOUBLE)) AS BIGINT) END"), "i", "n_tokens - i * chunk >= 3"), "i", entropy(d, d.part("tokens", "i * chunk", "chunk"), "z")),
        }
        repeated = f"CASE WHEN n_tokens < 4 THEN NULL ELSE CAST({d.size(d.filter('gram_runs', 'c', 'c > 1'))} AS DOUBLE) END"
        n_parts, part_var, filled = d.size("chunk_h"), _variance(d, "chunk_h"), d.size(d.filter("sent_sets", "x", f"{d.size('x')} > 0"))
        edges = d.size(d.filter(_pairs(d, "ns", 2), "p", d.overlap(d.at("sent_content", "p.a"), d.at("sent_content", "p.b"))))
        repeats = d.size(d.filter(_pairs(d, "ns", 1), "p", f"{d.size(d.common(d.at('sent_sets', 'p.a'), d.at('sent_sets', 'p.b')))} > {n(.7)} * least({d.size(d.at('sent_sets', 'p.a'))}, {d.size(d.at('sent_sets', 'p.b'))})"))
    prosaic = {
        "prose_wc": f"CAST({d.size(pwords)} AS BIGINT)",
        "prose_chars": f"CAST(length({d.replace('prose', rf'[^\p{{L}}\p{{N}}]{'+' if spark else ''}', text='')}) AS DOUBLE)",
        "prose_sents": f"greatest(CAST({d.size(d.filter(d.split('prose', '[.!?]+'), 'x', chr(39).join(['trim(x) <> ', '', ''])))} AS DOUBLE), 1)",
        "syllables": f"CAST({d.count('lower(prose)', f'[{vowels}]+')} AS DOUBLE)",
        "complex_words": f"CAST({complex_words} AS DOUBLE)",
    }
    if spark:  # counted with the words where Python and Java are of one mind about the characters
        prosaic = {k: f"CASE WHEN pr.{k} IS NOT NULL THEN pr.{k} ELSE {e} END" for k, e in prosaic.items()}
    four = {
        "kinds": each_kind,
        **prosaic,
        "h": tokens_h,
        **grams,
        "short_factor": f"CASE WHEN wc >= 30 THEN {n(1)} WHEN wc <= 10 THEN {n(.3)} ELSE {n(.3)} + {n(.7)} * (wc - 10) / 20 END",
        "mean_swc": f"CASE WHEN ns = 0 THEN {n(0)} ELSE {mean_swc} END",
    }

    def short(x: str) -> str:
        return f"CASE WHEN n_tokens < 30 THEN least({x}, {n(.3)}) ELSE {x} END"

    label = rf"(?im)^({lex.LABELS})[ \t\n\x0B\f\r]*:"
    layout = {
        "k_bullets": r"(?m)^[ \t\n\x0B\f\r]*[-*\x{2022}][ \t\n\x0B\f\r]",
        "k_numbers": r"(?m)^[ \t\n\x0B\f\r]*\p{Nd}+[.)][ \t\n\x0B\f\r]",
        "k_headers": r"(?m)^#{1,6}[ \t\n\x0B\f\r]",
        "k_fences": "```",
        "k_rules": r"(?m)^-{3,}$",
        "k_labels": label,
    }
    fields = rf"(?m)^[ \t]*[-*][ \t]*`?[{WORD}]+`?[ \t]*[:(][ \t]*(?:string|int|integer|number|float|bool|boolean|array|list|object|date)"
    fenced = d.group("t", r"(?s)```(?:json)?[ \t\n\x0B\f\r]*(\{.*?\})[ \t\n\x0B\f\r]*```", 1)
    substance = d.size(d.filter(d.all_matches("t", rf"(?im)^(?:{lex.LABELS})[ \t]*:[^\n]*"), "x", f"{d.size(d.filter(d.all_matches(d.replace('lower(x)', '^[^:]*:', text=''), rf'[{WORD}]+'), 'w', f'length(w) > 2 AND w NOT IN ({', '.join(map(d.lit, lex.HOLLOW_WORDS))})'))} >= 3"))
    first = {w: d.group("low", rf"(\p{{Nd}}+)[ \t\n\x0B\f\r]*{w}s?", 1) for w in ("word", "sentence", "page")}
    numbers = d.count("dbl", rf"(?:^|[^{WORD}])\p{{Nd}}+(?:\.\.\p{{Nd}}+)?(?:px|ms|mb|gb|kb)?(?:[^{WORD}]|$)")
    asks = f"({d.has('low', rf'(^|[^{WORD}])(?:{lex.QUESTION})([^{WORD}].*)?\?')} OR {d.has('t', r'(?m)\?$')})"
    signalled = d.has_word("low", "|".join(_unicode(p) for p in lex.CONSTRAINT_SIGNALS))
    if spark:
        first = {w: f"CASE WHEN contains(low, '{w}') THEN {e} ELSE '' END" for w, e in first.items()}
        numbers = d.count("low", rf"(?<![{WORD}])\p{{Nd}}+(?:\.\p{{Nd}}+)?(?:px|ms|mb|gb|kb)?(?![{WORD}])")
        asks = f"(contains(t, '?') AND {asks})"
        signalled = " OR ".join(present(d, p) for p in sorted(lex.CONSTRAINT_SIGNALS, key=lambda p: not p.isalpha()))
    five = {
        **{k: f"CAST({d.count('t', p if d.name == 'duck' else p.replace('x{2022}', 'u2022'))} AS BIGINT)" for k, p in layout.items()},
        "paragraphs": f"CAST({d.size(d.filter(d.split('t', '\n\n'), 'x', chr(39).join(['trim(x) <> ', '', ''])))} AS BIGINT)",
        "solid": f"CAST({substance} AS BIGINT)",
        "fence": fenced,
        # a number stands between boundaries: not "3rd", "100k"; doubled separators leave one for the next number
        "n_numbers": f"CAST({numbers} AS BIGINT)",
        "n_quoted": f"CAST({d.count('t', r'"[^"]{2,}"')} + {d.count('t', r"'[^']{2,}'")} AS BIGINT)",
        "n_code": f"CAST({coded} AS BIGINT)",
        "n_verbs": f"CAST({d.size(d.common(d.array(list(map(d.lit, lex.IMPERATIVES))), listed))} AS BIGINT)",
        "n_deliverables": f"CAST({d.size(d.common(d.array(list(map(d.lit, lex.DELIVERABLES))), listed))} AS BIGINT)",
        "asks": asks,
        **{f"c_{k}": d.sum_of([present(d, p) for p in v]) for k, v in lex.CONSTRAINTS.items()},
        "signalled": f"({signalled})",
        **{f"lim_{w}": f"{d.as_double(x)}" for w, x in first.items()},
        "one_sentence": _anchored(d, "@one_sentence", d.has_word("low", f"(?:one|single){_SPACE}+sentence")),
        **{f"tone_{i}": "(" + " AND ".join("(" + " OR ".join(present(d, p) for p in side) + ")" for side in pair) + ")" for i, pair in enumerate(lex.TONE_PAIRS)},
        "no_examples": _anchored(d, "@no_examples", d.has_word("low", f"(?:do not|don'?t|avoid|never){_SPACE}+include{_SPACE}+examples?")),
        "examples": _anchored(d, "@examples", d.has_word("low", f"(?:include|provide|give|show){_SPACE}+examples?")),
        "n_persona": "(" + " + ".join(f"CASE WHEN {_anchored(d, p, f'contains(low, {d.lit(_prefix(p))})')} THEN {d.count('low', f'(?:^|[^{WORD}])(?:{_unicode(p)})')} ELSE 0 END" for p in lex.PERSONA) + ")",
        "n_injections": "(" + " + ".join(f"CASE WHEN {_anchored(d, p, f'contains(low, {d.lit(_prefix(p))})')} THEN {d.count(d.doubled('low') if spark else 'dbl', f'(?:^|[^{WORD}])(?:{_over_doubled(p)})')} ELSE 0 END" for p in lex.INJECTIONS) + ")",
        "n_io": f"CAST({d.count('t', r'(?im)^[ \t\n\x0B\f\r]*(?:input|in|q|question|user)[ \t\n\x0B\f\r]*:[ \t\n\x0B\f\r]*.+\n+[ \t\n\x0B\f\r]*(?:output|out|a|answer|assistant|response)[ \t\n\x0B\f\r]*:[ \t\n\x0B\f\r]*.+')} AS BIGINT)",
        "n_examples": f"CAST({d.count('t', r'(?im)^[ \t\n\x0B\f\r]*example[ \t\n\x0B\f\r]*\p{Nd}*[ \t\n\x0B\f\r]*:[ \t\n\x0B\f\r]*.+')} AS BIGINT)",
        # mappings on a line: up to 40 plain characters, an arrow, up to 80 plain characters or brackets
        "n_arrows": f"CAST({d.size(d.filter(d.transform(d.filter(d.split('t', '\n'), 'x', "contains(x, '->')"), 'x', d.replace('x', f'^{_SPACE}+|{_SPACE}+$')), 'x', d.has('x', rf'^[{WORD} \t\x0B\f\r{_QUOTES}.,]{{1,40}}{_SPACE}*->{_SPACE}*[{WORD} \t\x0B\f\r{_QUOTES}.,\[\]{{}}]{{1,80}}$')))} AS BIGINT)",
        "n_hedges": f"CAST({hits(d, lex.HEDGES)} AS BIGINT)",
        "n_task_verbs": f"CAST({d.size(d.common(d.array(list(map(d.lit, lex.TASK_VERBS))), listed))} AS BIGINT)",
        "n_imperatives": f"CAST({d.size(d.filter('openers', 'w', f'lower(w) IN ({', '.join(map(d.lit, lex.TASK_VERBS))})'))} AS BIGINT)",
        "n_soft": f"CAST({d.size(d.filter(listed, 'w', f'w IN ({', '.join(map(d.lit, lex.SOFTENERS))})'))} AS BIGINT)",
        "n_caps": f"CAST({d.size(d.filter('openers', 'w', f'length(w) > 2 AND upper(w) = w AND lower(w) IN ({', '.join(map(d.lit, lex.TASK_VERBS))})'))} AS BIGINT)",
        **{f"m_{k}": f"CAST({hits(d, v)} AS BIGINT)" for k, v in lex.DISCOURSE.items()},
        "n_pronouns": f"CAST({d.size(d.filter(listed, 'w', f'w IN ({', '.join(map(d.lit, lex.PRONOUNS))})'))} AS BIGINT)",
        **content,
        **gram_runs,
        "filled": f"CAST({filled} AS DOUBLE)",
        "repeats": f"CAST({repeats} AS DOUBLE)",
        "edges": f"CAST(greatest(ns - 1, 0) + {edges} AS BIGINT)",
        **{f"mean_{k.lower()}": _mean_place(d, k) for k in ("CONTEXT", "TASK", "CONSTRAINT")},
        "english": f"coalesce(p_english_ratio, {n(1)})",
        "typos": "coalesce(p_typos, 0)",
    }
    wps, cpw = "(prose_wc / prose_sents)", "(prose_chars / prose_wc)"
    ari = f"({n(4.71)} * {cpw} + {n(.5)} * {wps} - {n(21.43)})"
    cli = f"({n(5.88)} * {cpw} - {n(29.6)} * prose_sents / prose_wc - {n(15.8)})"
    fk = f"({n(.39)} * {wps} + {n(11.8)} * syllables / prose_wc - {n(15.59)})"
    fog = f"({n(.4)} * ({wps} + 100 * complex_words / prose_wc))"
    smog = f"({n(1.043)} * sqrt(complex_words * 30 / prose_sents) + {n(3.1291)})"
    easy = f"(((prose_wc - complex_words) + 3 * complex_words) / prose_sents)"
    linsear = f"(CASE WHEN {easy} > 20 THEN {easy} / 2 ELSE {easy} / 2 - 1 END)"
    grades = d.filter(d.array([f"CAST({x} AS DOUBLE)" for x in (fk, cli, ari, fog, smog, linsear)]), "g", "g >= 0 AND g <= 30")
    six = {
        "grades": f"CASE WHEN prose_wc < 3 THEN NULL ELSE {grades} END",
        "pairs": "filled * (filled - 1) / 2",
        "variety": d.sum_of([f"{k} > 0" for k in layout] + ["paragraphs > 1"]),
        "layout_total": " + ".join(layout) + " + paragraphs",
        "n_json": _json_keys(d),
        "s_types": d.has("t", r"(?m)^[ \t]*(?:export )?(?:type|interface)[ \t]+[A-Za-z_]+[ \t]*(?:=|\{)"),
        "s_yaml": d.has("t", r"(?m)^[ \t]*[A-Za-z_]+:[ \t]*(?:string|int|integer|number|float|bool|boolean|list|array|object|date)[ \t]*$"),
        "s_code": d.has("t", r"(?s)```.*?(?:def |class |function |interface )[A-Za-z_]+.*?```"),
        "s_fields": f"{d.count('t', fields)} >= 3",
        "conflicts": d.sum_of(["lim_word IS NOT NULL AND lim_sentence > 0 AND (lim_word / lim_sentence > 80 OR lim_word / lim_sentence < 3)", "lim_page IS NOT NULL AND one_sentence", "tone_0", "tone_1", "tone_2", "no_examples AND examples"]),
        "shots": "CASE WHEN n_arrows >= 2 THEN greatest(n_io + greatest(n_examples - 1, 0), n_arrows) ELSE n_io + greatest(n_examples - 1, 0) END",
        "marker_kinds": d.sum_of([f"m_{k} > 0" for k in lex.DISCOURSE]),
        "marker_total": "(" + " + ".join(f"m_{k}" for k in lex.DISCOURSE) + ")",
        "repeated_grams": repeated,
        "chunk_var": part_var,
        "swc_var": swc_var,
        "schema_json": f"CASE WHEN fence = '' THEN 0 ELSE 1 END",
    }
    schema = [("n_json >= 2", .85), ("n_json IS NULL AND fence <> '' AND " + d.has_word("lower(fence)", "string|number|int|integer|float|boolean|bool|array|object|date"), .7), ("s_types", .85), ("s_yaml", .8), ("s_code", .7), ("s_fields", .75)]
    best = "greatest(" + ", ".join(f"CASE WHEN {t} THEN {n(v)} ELSE {n(0)} END" for t, v in schema) + ")"
    count = d.sum_of([f"coalesce({t}, FALSE)" for t, _ in schema])
    flow_types = d.sum_of(["mean_context IS NOT NULL", "mean_task IS NOT NULL", "mean_constraint IS NOT NULL"])
    checks = d.sum_of(["mean_context IS NOT NULL AND mean_task IS NOT NULL", "mean_task IS NOT NULL AND mean_constraint IS NOT NULL"])
    passed = d.sum_of(["coalesce(mean_context < mean_task, FALSE)", "coalesce(mean_task < mean_constraint, FALSE)"])
    dv = "(marker_total / CAST(ns AS DOUBLE))"
    fallback = f"(n_distinct / CAST(n_tokens AS DOUBLE) + n_distinct / sqrt(CAST(n_tokens AS DOUBLE)) / 15 + ln(CAST(n_distinct AS DOUBLE)) / ln(CAST(n_tokens AS DOUBLE))) / 3"
    raw_specific = f"({clamp(f'(coalesce(p_entities, 0) + n_numbers + coalesce(p_tech_terms, 0) + n_quoted + n_code) / CAST(greatest(ns, 1) AS DOUBLE) / 8')})"
    specific = f"greatest({raw_specific} - least({n(.5)}, {n(.2)} * typos), {n(0)})"
    density = "(n_content / CAST(greatest(n_tokens, 1) AS DOUBLE))"
    scores = {
        "length": f"CASE WHEN wc = 0 THEN {n(0)} ELSE {d.gauss('wc', 150, 200)} * CASE WHEN wc < 10 THEN {n(.3)} WHEN wc > 2000 THEN {n(.5)} ELSE {n(1)} END END",
        "grammar": f"CASE WHEN trim(t) = '' THEN {n(0)} WHEN prose = '' THEN {n(.5)} ELSE greatest({n(0)}, 1 - {n(.3)} * (coalesce(p_grammar_errors, 0) + typos) / greatest(ns, 1)) END",
        "readability": f"CASE WHEN prose_wc < 3 THEN {n(.1)} WHEN {d.size('grades')} = 0 THEN {n(.3)} ELSE {d.gauss(f'({d.total('grades')} / {d.size('grades')})', 10, 4)} END",
        "specificity": f"CASE WHEN english < {n(.5)} THEN {specific} * english ELSE {specific} END",
        "structure": f"CASE WHEN variety = 0 THEN {n(.2)} ELSE ({n(.6)} * least({n(1)}, variety / {n(4)}) + {n(.4)} * least({n(1)}, ({'layout_total'}) / {n(10)})) * CASE WHEN k_labels - solid > 0 AND k_labels - solid >= solid THEN {n(.5)} ELSE {n(1)} END END",
        "task_signal": clamp(f"(least(n_verbs, 3) + CASE WHEN asks THEN 1 ELSE 0 END + least(n_deliverables, 2)) / {n(5)}"),
        "constraints": clamp(f"{n(.15)} * {d.sum_of([f'c_{k} > 0' for k in lex.CONSTRAINTS])} + {n(.05)} * ({' + '.join(f'c_{k}' for k in lex.CONSTRAINTS)})"),
        "contradiction": f"CASE WHEN NOT signalled THEN {n(.5)} ELSE greatest({n(0)}, 1 - {n(.35)} * conflicts) END",
        "reference_similarity": f"CASE WHEN p_reference_similarity IS NULL THEN {n(.5)} ELSE {clamp(f'(p_reference_similarity - {n(.4)}) / {n(.5)}')} END",
        "persona_signal": f"CASE WHEN n_persona = 0 THEN {n(.5)} ELSE least({n(1)}, least({n(.6)} + {n(.15)} * n_persona, {n(.9)}) + CASE WHEN coalesce(p_role_entities, 0) > 5 THEN {n(.1)} ELSE {n(0)} END) END",
        "few_shot_quality": _bands("shots", [("<= 0", .5), ("= 1", .55), ("= 2", .75), ("<= 5", .9)], .95, d),
        "hedging": f"CASE WHEN n_hedges = 0 THEN {n(.95)} ELSE {clamp(f'1 - {n(30)} * n_hedges / greatest(wc, 1)')} END",
        "safety": f"CASE WHEN n_injections = 0 THEN {n(1)} ELSE greatest({n(0)}, 1 - {n(.3)} * n_injections) END",
        "output_schema": f"CASE WHEN {count} = 0 THEN {n(.5)} ELSE least({n(1)}, {best} + {n(.05)} * ({count} - 1)) END",
        "compound_task_count": _bands("n_task_verbs", [("= 0", .5), ("= 1", .65), ("<= 3", .85), ("<= 6", .95)], .6, d),
        "imperative_strength": f"CASE WHEN n_imperatives = 0 THEN {n(.4)} ELSE {clamp(f'{n(.7)} + CASE WHEN n_imperatives >= 2 THEN {n(.1)} ELSE 0 END + CASE WHEN n_soft = 0 THEN {n(.1)} WHEN n_soft > n_imperatives THEN {n(-.15)} ELSE 0 END + CASE WHEN n_caps > 0 AND n_caps < n_imperatives THEN {n(.05)} ELSE 0 END')} END",
        "semantic_density": f"CASE WHEN n_tokens = 0 THEN {n(0)} WHEN short_factor < 1 THEN {n(.5)} + ({clamp(f'{n(2.5)} * {density}')} - {n(.5)}) * short_factor ELSE {clamp(f'{n(2.5)} * {density}')} END",
        "lexical_sophistication": f"CASE WHEN english < {n(.5)} THEN {clamp(f'{n(.3)} * english')} WHEN p_rarity IS NULL THEN {n(.3)} ELSE CASE WHEN typos > 0 THEN greatest({n(.1)}, {n(.3)} + {n(.7)} * p_rarity - {n(.1)} * typos) ELSE {n(.3)} + {n(.7)} * p_rarity END END",
        "sentence_flow": f"CASE WHEN ns <= 1 THEN {n(.5)} WHEN mean_swc = 0 THEN {n(.3)} ELSE {d.gauss('(sqrt(swc_var) / mean_swc)', .45, .3)} END",
        "reference_resolution": f"CASE WHEN n_pronouns = 0 THEN CASE WHEN wc < 10 THEN {n(.5)} ELSE {n(.85)} END WHEN n_content > 0 THEN {n(1)} ELSE {n(0)} END",
        "tone_consistency": f"CASE WHEN ns <= 1 OR p_tone_variance IS NULL THEN {n(.5)} WHEN p_tone_mixed THEN least({n(.5)}, {clamp(f'1 - 3 * p_tone_variance')}) ELSE {clamp('1 - 3 * p_tone_variance')} END",
        "objectivity": f"CASE WHEN wc < 5 OR p_subjectivity IS NULL THEN {n(.5)} ELSE 1 - {n(.7)} * p_subjectivity END",
        "syntactic_complexity": f"CASE WHEN ns = 0 OR p_depth IS NULL THEN {n(.5)} ELSE {n(.6)} * {d.gauss('p_depth', 5.5, 2.5)} + {n(.4)} * {d.gauss('coalesce(p_clauses, 1)', 2, 1.5)} END",
        "discourse_markers": f"CASE WHEN ns < 2 THEN {n(.5)} WHEN marker_total = 0 THEN {n(.45)} ELSE {clamp(f'{clamp(f'{n(.5)} + {n(1.2)} * {dv}')} + {n(.05)} * (marker_kinds - 1)')} END",
        "shannon_entropy": f"CASE WHEN n_tokens < 2 THEN {n(0)} ELSE {short(clamp('h / CASE WHEN n_distinct = 1 THEN 1 ELSE log2(CAST(n_distinct AS DOUBLE)) END'))} END",
        "redundancy": f"CASE WHEN n_tokens = 0 THEN {n(0)} ELSE {short(f'(n_distinct / CAST(n_tokens AS DOUBLE)) * CASE WHEN 1 - n_distinct / CAST(n_tokens AS DOUBLE) > {n(.6)} THEN {n(.5)} ELSE {n(1)} END')} END",
        "information_density": f"CASE WHEN n_tokens < 2 THEN {n(0)} ELSE {short(clamp('10 * h / n_tokens'))} END",
        "vocabulary_richness": f"CASE WHEN n_tokens < 2 THEN {n(0)} ELSE {short(f'CASE WHEN p_diversity IS NULL THEN {clamp(fallback)} ELSE {clamp(f'(n_distinct / CAST(n_tokens AS DOUBLE) + 3 * p_diversity) / 4')} END')} END",
        "ngram_repetition": f"CASE WHEN n_tokens < 4 THEN {n(.3)} ELSE {short(clamp(f'1 - 3 * repeated_grams / (2 * n_tokens - 3)'))} END",
        "burstiness": f"CASE WHEN n_tokens < 10 OR {n_parts} < 2 THEN {n(.3)} ELSE {short(clamp('1 - 2 * chunk_var'))} END",
        "sentence_repetition": f"CASE WHEN ns < 2 OR pairs = 0 THEN {n(.5)} ELSE {clamp('1 - 2 * repeats / pairs')} END",
        "completeness": clamp(f"{n(.33)} * {flow_types} + CASE WHEN {d.contains('kinds', d.lit('EXAMPLE'))} THEN {n(.1)} ELSE {n(0)} END"),
        "has_context": f"CASE WHEN mean_context IS NULL THEN {n(0)} ELSE {n(1)} END",
        "has_task": f"CASE WHEN mean_task IS NULL THEN {n(0)} ELSE {n(1)} END",
        "has_constraint": f"CASE WHEN mean_constraint IS NULL THEN {n(0)} ELSE {n(1)} END",
        "connectivity": f"CASE WHEN ns <= 1 THEN {n(.5)} ELSE {clamp('2 * (edges / (CAST(ns AS DOUBLE) * (ns - 1)))')} END",
        "information_flow": f"CASE WHEN {flow_types} < 2 THEN {n(.5)} ELSE {passed} / CAST(greatest({checks}, 1) AS DOUBLE) END",
        "complexity": f"CASE WHEN ns = 0 THEN {n(0)} WHEN ns = 1 THEN {n(.3)} ELSE {d.gauss('(edges / CAST(ns AS DOUBLE))', 2.25, 1.5)} END",
    }
    if d.name == "spark":
        scores |= {
            "coherence": f"CASE WHEN ns <= 1 THEN {n(.5)} ELSE coalesce(vectors.coherence, {n(.3)}) END",
            "topic_focus": f"CASE WHEN ns <= 1 THEN {n(.5)} ELSE coalesce(vectors.topic_focus, {n(.5)}) END",
            "centrality": f"CASE WHEN ns <= 1 THEN {n(.4)} ELSE {d.gauss('graph.rank_cv', .4, .3)} END",
        }
    later = [four, five, six, {k: f"CAST({v} AS DOUBLE)" for k, v in scores.items()}]
    if spark:  # fields become columns once: the optimizer loses some of those that generators take out of a struct
        field = re.compile(rf"\b({'|'.join(compared)})\.(\w+)")
        counted |= {f"{a}_{b}": f"{a}.{b}" for columns in later for e in columns.values() for a, b in field.findall(e)}
        later = [{c: field.sub(r"\1_\2", e) for c, e in columns.items()} for columns in later]
    return [one, two, three, cut, compared, counted, *later]


def _over_doubled(pattern: str) -> str:
    """An injection pattern over a text whose separators are doubled, so that a match leaves the next one its boundary."""
    out = pattern.removesuffix(r"\s*").replace(r"\b.*\b", rf"[^{WORD}\n].*[^{WORD}\n]").replace(r"\s", _SPACE)
    return out.replace(r"\b", f"(?:[^{WORD}]|$)").replace(f"{_SPACE}*:", f"{_SPACE}*::").replace(" ", "  ").replace(_SPACE.replace(" ", "  "), _SPACE)


def _prefix(pattern: str) -> str:
    """The letters a pattern starts with, which a text must hold for any match."""
    if pattern.startswith("(?:override"):
        return " "
    out = ""
    for i, c in enumerate(pattern):
        if not (c.isalpha() or c == " ") or pattern[i + 1 : i + 2] in ("?", "*"):
            break
        out += c
    return out


def _pairs(d: Dialect, n: str, gap: int) -> str:
    """Pairs (a, b) of places with b >= a + gap."""
    if d.name == "spark":
        return f"flatten(transform({d.upto(n)}, a -> transform({d.upto(f'{n} - a - {gap}')}, k -> named_struct('a', a, 'b', a + k + {gap}))))"
    return f"flatten(list_transform({d.upto(n)}, lambda a: list_transform({d.upto(f'greatest({n} - a - {gap}, 0)')}, lambda k: {{'a': a, 'b': a + k + {gap}}})))"


def _variance(d: Dialect, a: str) -> str:
    """Population variance of an array; null if it is empty."""
    mean = f"({d.total(a)} / {d.size(a)})"
    if d.name == "duck":
        return f"list_var_pop({a})"
    return f"CASE WHEN size({a}) = 0 THEN NULL ELSE transform(array({mean}), m -> {d.total(d.transform(a, 'v', '(v - m) * (v - m)'))} / size({a}))[0] END"


def _mean_place(d: Dialect, kind: str) -> str:
    places = d.filter(d.upto("ns"), "i", f"{d.at('kinds', 'i')} = '{kind}'")
    return f"CASE WHEN {d.contains('kinds', d.lit(kind))} THEN {d.total(places)} / {d.size(places)} END"


def _json_keys(d: Dialect) -> str:
    """Keys of the fenced object; null if it isn't JSON. Bare type names are quoted first."""
    types = r":[ \t\n]*(string|number|integer|int|float|boolean|bool|array|object|date)([ \t\n]*[,}])"
    if d.name == "spark":
        fixed = f"regexp_replace(fence, {d.lit(types)}, {d.lit(': \"$1\"$2')})"
        return f"CASE WHEN fence = '' THEN NULL ELSE size(json_object_keys({fixed})) END"
    fixed = f"regexp_replace(fence, {d.lit(types)}, {d.lit(': \"\\1\"\\2')}, 'g')"
    return f"CASE WHEN fence <> '' AND json_valid({fixed}) THEN len(json_keys({fixed})) END"
