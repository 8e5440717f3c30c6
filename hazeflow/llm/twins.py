"""DuckDB twins of the registered queries that SQL can express."""

from __future__ import annotations

from hazeflow.llm import divergence as D
from hazeflow.llm import url_reputation as U

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _fits(rule: U.Rule) -> str:
    return f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')"


def _longest(value) -> str:
    ordered = sorted(U.RULES, key=lambda r: (-len(r.name), r.name))
    return "CASE " + " ".join(f"WHEN {_fits(r)} THEN {value(r)}" for r in ordered) + " END"


def _shrunk(name: str, level: str, parent: str, key: str) -> str:
    """CTEs: the level with its prior, the level's strength, and the level with its posterior."""
    return f"""
{name}_prior AS (SELECT l.*, p.rate AS prior FROM {level} l JOIN {parent} p ON l.{key} = p.{key}),
{name}_sums AS (
  SELECT coalesce(sum(n * (good / n - prior) * (good / n - prior)), 0) AS deviation, coalesce(sum(prior * (1 - prior)), 0) AS plain,
         coalesce(sum((n - 1) * (prior * (1 - prior))), 0) AS extra
  FROM {name}_prior WHERE n > 0),
{name}_worth AS (
  SELECT CASE WHEN extra > 0 AND deviation > plain
              THEN least(greatest(1 / ((deviation - plain) / extra) - 1, {U.MIN_PRIOR}), {U.MAX_PRIOR}) ELSE {U.MAX_PRIOR} END AS worth
  FROM {name}_sums),
{name}_post AS (
  SELECT *, good + worth * prior AS a, n - good + worth * (1 - prior) AS b, (good + worth * prior) / (n + worth) AS rate
  FROM {name}_prior, {name}_worth)"""


URL_REPUTATION = f"""
WITH seen AS (
  SELECT page_id, coalesce({_LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, regexp_extract(host, '([^.]*\\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix,
         count(quality) AS n, count(*) FILTER (WHERE quality = 1) AS good
  FROM seen LEFT JOIN known ON TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})', 1), '') AS BIGINT) = doc_id
  GROUP BY host),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(good)::BIGINT AS good FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, 1 AS whole, sum(n)::BIGINT AS n, sum(good)::BIGINT AS good FROM domains GROUP BY suffix),
overall AS (SELECT 1 AS whole, CASE WHEN sum(n) > 0 THEN sum(good) / sum(n) ELSE 0.5 END AS rate FROM hosts),
{_shrunk("s", "suffixes", "overall", "whole")},
{_shrunk("d", "domains", "s_post", "suffix")},
{_shrunk("h", "hosts", "d_post", "domain")}
SELECT page_id, seen.host, path, {_longest(lambda r: f"'{r.name}'").replace("host", "seen.host")} AS rule,
       coalesce({_longest(lambda r: "'allow'" if r.allow else "'block'").replace("host", "seen.host")},
                CASE WHEN a / (a + b) + {U.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < {U.MIN_GOOD_RATE} THEN 'block' ELSE 'allow' END) AS verdict
FROM seen LEFT JOIN h_post ON seen.host = h_post.host
"""

_CHARS = "len(replace(replace({}, '\\', '\\\\'), '<|', '<\\|'))"

REPLY_TREES = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(24 + {_CHARS.format("role")} + {_CHARS.format("text")})::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""


def _part(x: str, y: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"


def _term(p: str, q: str) -> str:
    return f"{_part(p, q)} + {_part(q, p)}"


_CLASS_NAMES = [*D.NOT_IN_CLASS, "beyond", "other"]
_OUTSIDE = ",\n         ".join(f"len(regexp_replace(text, '{out.replace(chr(39), chr(39) * 2)}', '', 'g')) AS {name}" for name, out in D.NOT_IN_CLASS.items())
_NAMED = " + ".join(D.NOT_IN_CLASS)

DIVERGENCE = f"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
docs AS (
  SELECT *, [w FOR w IN string_split_regex(text, '{D.SPACE}') IF w <> ''] AS words, strlen(text) AS bytes,
         {_OUTSIDE}
  FROM texts),
tokens AS (SELECT doc_id, lang, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times
  FROM (SELECT doc_id, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY i))
  WHERE c IS NOT NULL),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM windows, (VALUES (0), (1), (2)) steps(k) WHERE times > 1 GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{D.NOT_SPACE}') GROUP BY doc_id),
counts AS (SELECT lang, w, count(*) AS n FROM tokens GROUP BY lang, w),
totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
common AS (
  SELECT lang, w, n / total AS q FROM counts JOIN totals USING (lang)
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= {D.COMMON_WORDS}),
other_words AS (SELECT lang, 1 - sum(q) AS q FROM common GROUP BY lang),
own AS (SELECT doc_id, w, count(*) AS n FROM tokens GROUP BY doc_id, w),
spoken AS (
  SELECT doc_id, lang, sum({_term("p", "q")}) AS terms, greatest(1 - sum(p), 0) AS p
  FROM (SELECT d.doc_id, d.lang, c.q, coalesce(o.n, 0) / len(d.words) AS p
        FROM docs d JOIN common c ON d.lang = c.lang LEFT JOIN own o ON o.doc_id = d.doc_id AND o.w = c.w
        WHERE len(d.words) >= {D.MIN_WORDS})
  GROUP BY doc_id, lang),
word_distances AS (
  SELECT doc_id, sqrt(greatest((terms + {_term("s.p", "r.q")}) / 2, 0)) AS word_distance FROM spoken s JOIN other_words r USING (lang)),
shares AS (
  SELECT doc_id, lang, {", ".join(f"{c} / bytes AS {c}" for c in D.NOT_IN_CLASS)},
         (bytes - len(text)) / bytes AS beyond, (len(text) - ({_NAMED})) / bytes AS other
  FROM docs WHERE len(text) >= {D.MIN_CHARS}),
typical AS (SELECT lang, {", ".join(f"avg({c}) AS {c}" for c in _CLASS_NAMES)} FROM shares GROUP BY lang),
class_distances AS (
  SELECT doc_id, sqrt(greatest(({" + ".join(_term(f"s.{c}", f"t.{c}") for c in _CLASS_NAMES)}) / 2, 0)) AS class_distance
  FROM shares s JOIN typical t USING (lang)),
base AS (
  SELECT doc_id, len(words) AS n_words, len(text) - space AS word_chars, symbol AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
failed AS (SELECT *, n_words < {D.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT failed.*, NOT base_failed AND coalesce(class_distance, 0) <= {D.MAX_CLASS_DISTANCE}
       AND coalesce(word_distance, 0) <= {D.MAX_WORD_DISTANCE} AS kept
FROM failed LEFT JOIN class_distances USING (doc_id) LEFT JOIN word_distances USING (doc_id)
"""


def _merkle(levels: int = 8, root_levels: int = 4) -> str:
    """Trees of up to 8 ** levels rows a language and 8 ** root_levels languages."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def part(value):
        return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"

    heads = " || ".join(part(f"{c}::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars"))
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda d, z: xor(d >> 1, (d & 1) * 3988292384::UBIGINT))"
    numbers = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {numbers}), lambda c, b: {bits}), 4294967295::UBIGINT)"
    steps = [
        f"""t0 AS (SELECT doc_id, lang, sha256({heads} || {part("text")}) AS leaf,
            CASE WHEN {crc} % 3 = 0 THEN sha256({heads} || {part(f"translate(text, '{upper}', '{lower}')")}) END AS tampered FROM documents)""",
        "t1 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM t0)",
        "l0 AS (SELECT lang, i, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM t1)",
    ]

    def climb(name: str, count: int) -> None:
        for k in range(count):
            run = "PARTITION BY lang, i // 8 ORDER BY i ROWS BETWEEN"
            steps.append(f"""{name}s{k} AS (SELECT *,
                coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{k})""")
            steps.append(f"""{name}{k + 1} AS (SELECT lang, i // 8 AS i,
                CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d,
                ((any_value(n) + 7) // 8)::BIGINT AS n FROM {name}{k} GROUP BY lang, i // 8)""")

    climb("l", levels)
    steps.append(f"r0 AS (SELECT '' AS lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, d, count(*) OVER () AS n, lang AS name FROM l{levels})")
    climb("r", root_levels)
    steps.append("f0 AS (SELECT doc_id, lang, i, leaf, coalesce(tampered, leaf) AS f, '' AS proof FROM t1)")
    at = 0
    for name, count in (("l", levels), ("r", root_levels)):
        if name == "r":
            steps.append(
                f"""f{at + 1} AS (SELECT f{at}.* REPLACE (r0.i AS i, '' AS lang), r0.d AS subroot
                FROM f{at} JOIN r0 ON f{at}.lang IS NOT DISTINCT FROM r0.name)"""
            )
            at += 1
        for k in range(count):
            steps.append(f"""f{at + 1} AS (SELECT a.* REPLACE (a.i // 8 AS i, CASE WHEN s.n > 1 THEN sha256(before || f || after) ELSE f END AS f,
                proof || before || after AS proof) FROM f{at} AS a JOIN {name}s{k} AS s ON a.lang IS NOT DISTINCT FROM s.lang AND a.i = s.i)""")
            at += 1
    return (
        "WITH " + ",\n".join(steps) + f"""
        SELECT doc_id, leaf, subroot, (SELECT d FROM r{root_levels}) AS root, sha256(proof) AS proof_sha256, f AS folded_root,
            f = (SELECT d FROM r{root_levels}) AS verified FROM f{at}"""
    )


MERKLE = _merkle()
