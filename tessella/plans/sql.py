"""Pieces of DuckDB SQL shared by the oracles: the same patterns as the Column expressions."""

from __future__ import annotations

from tessella.functions.text import AFTER_LINES, CLEANING, SPACE, STOPWORDS, WORD


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STOP_LIST = ", ".join(map(quoted, STOPWORDS))


def fold(x: str) -> str:
    """By DuckDB's own table of accents, not the engine's."""
    return f"replace(strip_accents(lower({x})), 'ß', 'ss')"


def term_rows(source: str, keys: str, text: str) -> str:
    """A query of (keys, term), a row for each token occurrence."""
    return f"""
    SELECT {keys}, term FROM (
      SELECT {keys}, unnest(CASE WHEN contains(w, '-') THEN list_concat([replace(w, '-', '')], string_split(w, '-')) ELSE [w] END) AS term
      FROM (SELECT {keys}, regexp_replace(regexp_replace(r, '[''’]s$', ''), '[''’]', '', 'g') AS w
        FROM (SELECT {keys}, unnest(regexp_extract_all({fold(f"COALESCE({text}, '')")}, {quoted(WORD)})) AS r FROM {source}) AS x1) AS x2) AS x3
    WHERE length(term) >= 2 AND term NOT IN ({STOP_LIST})"""


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, {quoted(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def estimate_tokens(x: str) -> str:
    words = f"len(string_split_regex({trimmed(x)}, {quoted(SPACE + '+')}))"
    return f"CASE WHEN COALESCE({x}, '') = '' THEN 0 ELSE GREATEST(FLOOR(length({x}) / 4.0 + 0.5), FLOOR({words} * 1.25 + 0.5)) END::INTEGER"


def norm_line(x: str) -> str:
    return f"regexp_replace(regexp_replace({trimmed(x)}, '[0-9]+', '#', 'g'), {quoted(SPACE + '+')}, ' ', 'g')"


def replace_all(x: str, patterns) -> str:
    for pattern, to in patterns:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(to.replace('$1', chr(92) + '1'))}, 'g')"
    return x


def clean_page(x: str, keep_lines: str | None = None) -> str:
    """keep_lines: SQL that turns {x} (text after the first patterns) into the text without boilerplate."""
    x = replace_all(x, CLEANING)
    return trimmed(replace_all(keep_lines.replace("{x}", x) if keep_lines else x, AFTER_LINES))
