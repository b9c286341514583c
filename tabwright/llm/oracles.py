"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations


def quality_sql(rules) -> str:
    """op9: measures by list functions and windows, and the hosts' shrunk rates."""
    low, high = rules.mean_word_chars
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT row_id, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
grams AS (
  SELECT row_id, unnest(range(1, len(w) - 3)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram
  FROM words WHERE len(w) >= 5),
twice AS (SELECT row_id, p FROM (SELECT *, count(*) OVER (PARTITION BY row_id, gram) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT row_id, sum(least(5, coalesce(p - before, 5))) AS n FROM
  (SELECT *, lag(p) OVER (PARTITION BY row_id ORDER BY p) AS before FROM twice) GROUP BY row_id),
measured AS (
  SELECT row_id, doc_id, host, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered USING (row_id)),
flagged AS (
  SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS hard,
    n_symbols > {rules.max_symbols_per_word} * n_words OR 100 * n_dup_lines > {rules.max_dup_line_percent} * n_lines
    OR word_chars < {low} * n_words OR word_chars > {high} * n_words AS soft
  FROM measured),
hosts AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (WHERE hard OR soft)::DOUBLE AS f FROM flagged GROUP BY host),
moments AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts),
prior AS (SELECT m, v, CASE WHEN v > 1e-12 THEN greatest(0, m * (1 - m) / v - 1) ELSE 0 END AS weight FROM moments),
shrunk AS (SELECT host, n, m, v, weight, CASE WHEN n - 1 + weight > 0 THEN (greatest(f - 1, 0) + m * weight) / (n - 1 + weight) ELSE m END AS rate FROM hosts, prior),
rates AS (
  SELECT host, v > 1e-12 AND (rate >= 1 OR rate > 0 AND (rate - m) / sqrt(rate * (1 - rate) / (n + weight)) > {rules.host_deviations}) AS condemned FROM shrunk)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, hard AS base_failed, NOT hard AND NOT (soft AND condemned) AS kept
FROM flagged JOIN rates ON flagged.host IS NOT DISTINCT FROM rates.host"""


def url_filter_sql(events) -> str:
    """op7: intervals by a window, keys by unnesting, and the longest entry that holds."""
    rows = ", ".join(f"('{e}', '{a}', DATE '{d}')" for e, a, d in events)
    return rf"""
WITH events(entry, action, since) AS (VALUES {rows}),
intervals AS (
  SELECT * FROM (SELECT lower(entry) AS entry, action, since AS valid_from, lead(since) OVER (PARTITION BY lower(entry) ORDER BY since) AS valid_to FROM events)
  WHERE action IN ('block', 'allow')),
captures AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS DATE) AS fetched_at,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS segment FROM pages),
labels AS (SELECT *, string_split(host, '.') AS l FROM captures),
keys AS (
  SELECT page_id, fetched_at, unnest(list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], '.'))) AS entry FROM labels WHERE host <> ''
  UNION ALL SELECT page_id, fetched_at, host || '/' || segment FROM labels WHERE host <> '' AND segment <> ''),
held AS (
  SELECT page_id, entry, action, valid_from, row_number() OVER (PARTITION BY page_id ORDER BY length(entry) DESC, entry DESC) AS place,
    count(*) OVER (PARTITION BY page_id) AS n_active
  FROM keys JOIN intervals USING (entry) WHERE valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to))
SELECT page_id, url, host, fetched_at, coalesce(n_active, 0) AS n_active, entry, action, valid_from, coalesce(action = 'block', false) AS blocked
FROM captures LEFT JOIN (SELECT * FROM held WHERE place = 1) USING (page_id)"""


def _template_pattern(template: str) -> str:
    """A template's markup as a regular expression over words with a space after each."""
    from tabwright.llm.licenses import MARKUP, words_of

    out, at = [], 0
    for mark in [*MARKUP.finditer(template), None]:
        out += [f"{w.decode()} " for w in words_of(template[at : mark.start() if mark else len(template)])]
        if mark is None:
            break
        at = mark.end()
        if mark[1] == "var":
            given = dict(x.split("=") for x in (mark[2] or "").strip(";").split(";") if "=" in x)
            out.append(f"(?:[^ ]+ ){{{given.get('min', 0)},{given.get('max', 20)}}}")
        else:
            out.append("(?:" if mark[1] == "beginOptional" else ")?")
    return " " + "".join(out)


def license_sql(templates, phrases) -> str:
    """op3: phrases by slices of the words, templates by regular expressions."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    places = ", ".join(
        f"list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {p.split()!r})" for p, _ in phrases
    )
    base = ", ".join(f"CASE WHEN len(found[{i}]) > 0 THEN '{label}' END" for i, (_, label) in enumerate(phrases, 1))
    own = ", ".join(f"CASE WHEN regexp_matches(joined, '{_template_pattern(t)}') THEN '{label}' END" for label, t in templates)
    known = "list_filter({}, lambda x: x IS NOT NULL)"
    return rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined, [{places}] AS found FROM texts),
marked AS (
  SELECT doc_id, w, list_sort(flatten(found)) AS starts, {known.format(f"[{base}]")} AS base, {known.format(f"[{own}]")} AS own FROM places)
SELECT doc_id, len(w)::BIGINT AS n_words, len(starts)::BIGINT AS n_base, (starts[1] - 1)::BIGINT AS first_word, (starts[-1] - 1)::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, own))), ',') AS labels,
  CASE WHEN len(own) > 0 THEN 1.0::DOUBLE WHEN len(base) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM marked"""
