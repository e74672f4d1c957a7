"""SQL twins of the column functions, used to write the oracle queries.

The oracle engine (DuckDB) differs from Spark in regex flags, lambda
syntax and whitespace classes; these helpers pin one definition.
"""

from __future__ import annotations

from quarry.functions.text import (LEMMA_MIN_RESULT, LEMMA_MIN_WORD, LEMMA_RULES,
                                   MIN_TOKEN_LEN, STOP_WORDS, WHITESPACE)

WS = WHITESPACE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_ws(e: str) -> str:
    return f"trim({e}, {q(WS)})"


def trim_lower(e: str) -> str:
    return f"lower({strip_ws(e)})"


def clean_text(e: str) -> str:
    kept = f"regexp_replace({trim_lower(e)}, {q('[^a-z' + WS + ']')}, ' ', 'g')"
    return strip_ws(f"regexp_replace({kept}, {q('[' + WS + ']+')}, ' ', 'g')")


def normalize_tokens(e: str) -> str:
    s = f"regexp_replace({trim_lower(e)}, {q('[^a-z_' + WS + ']')}, ' ', 'g')"
    s = strip_ws(f"replace({s}, '_', ' ')")
    return f"list_filter(string_split_regex({s}, {q('[' + WS + ']+')}), lambda x: x <> '')"


def stop_list() -> str:
    return "[" + ", ".join(q(w) for w in sorted(set(STOP_WORDS))) + "]"


def stopword_filter(e: str) -> str:
    return (f"list_filter({e}, lambda x: length(x) >= {MIN_TOKEN_LEN} "
            f"AND NOT list_contains({stop_list()}, x))")


def lemmatize_word(x: str) -> str:
    parts = [f"WHEN length({x}) <= {LEMMA_MIN_WORD} THEN {x}"]
    for suf, rep in LEMMA_RULES:
        keep = f"(length({x}) - {len(suf)})"
        parts.append(f"WHEN ends_with({x}, {q(suf)}) AND {keep} + {len(rep)} >= {LEMMA_MIN_RESULT} "
                     f"THEN left({x}, {keep}::BIGINT) || {q(rep)}")
    return "CASE " + " ".join(parts) + f" ELSE {x} END"


def suffix_lemmatize(e: str) -> str:
    return f"list_transform({e}, lambda w: {lemmatize_word('w')})"


def preprocess_tokens(e: str) -> str:
    return suffix_lemmatize(stopword_filter(normalize_tokens(e)))


def round_half_up(e: str, digits: int) -> str:
    p = float(10 ** digits)
    return f"(floor(({e}) * {p} + 0.5) / {p})"


def values(rows, cols) -> str:
    """Inline VALUES table: ``(VALUES (...), ...) AS t(cols)``."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return q(v)
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"
