"""SQL that finds what a rule of the catalogues finds in a table of texts."""

from __future__ import annotations

import re

from scanframe import tables
from scanframe.functions.source import VALIDATED
from scanframe.plans.views import quoted


def matches(rule: tuple[str, ...], texts: str = "texts", keep: str = "file") -> str:
    """``keep, line, type, severity, category, description, match, seq`` of one rule on ``texts``, which has
    the columns of ``keep`` and ``content``.

    SQL's patterns have no look-ahead, so what the one rule with such must not match is masked.
    """
    name, pattern, severity, category, description = rule
    content = "content"
    if private := re.fullmatch(r"http://\(\?!(.*)\)", pattern):
        content, pattern = f"regexp_replace(content, '(?i)http://({private[1]})', 'xxxx://\\1', 'g')", "http://"
    p = quoted(f"(?i){pattern}")
    v = "lower(trim(trim(q), '''\"'))"
    placeholder = (
        f"({v} IN ({', '.join(map(quoted, tables.PLACEHOLDERS))}) OR length({v}) < 6 OR regexp_matches({v}, '^[$%<{{\\[]|[}}>\\]]$') OR regexp_matches({v}, '^[x*.·_-]*$') "
        f"OR contains(q, '{{{{') OR contains(q, '{{%') OR (contains({v}, '%') AND length(replace(replace({v}, '%s', ''), '%d', '')) < 3))"
    )
    checked = f" WHERE q = '' OR NOT {placeholder}" if name in VALIDATED else ""
    quotes = "regexp_extract(m, '''[^''\\n]{2,}''|\"[^\"\\n]{2,}\"|`[^`\\n]{2,}`', 0)"
    return f"""SELECT {keep}, line::INTEGER AS line, {quoted(name)} AS type, {quoted(severity)} AS severity, {quoted(category)} AS category, {quoted(description)} AS description, m AS match, k AS seq FROM (
  SELECT {keep}, k, m, 1 + length(t) - length(replace(t, chr(10), '')) AS line, CASE WHEN {quotes} = '' THEN '' ELSE {quotes}[2:-2] END AS q FROM (
    SELECT {keep}, k, ms[k] AS m, array_to_string(ms[1:k - 1], '') || array_to_string(ps[1:k], '') AS t FROM (
      SELECT {keep}, ms, ps, unnest(range(1, len(ms) + 1)) AS k FROM (
        SELECT {keep}, regexp_extract_all(c, {p}) AS ms, string_split_regex(c, {p}) AS ps FROM (SELECT {keep}, {content} AS c FROM {texts}) WHERE regexp_matches(c, {p})))))""" + checked


def found(rules, texts: str = "texts", keep: str = "file") -> str:
    """The matches of several rules."""
    return "\n  UNION ALL ".join(matches(r, texts, keep) for r in rules)
