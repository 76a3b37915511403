"""SQL that gives the same rows, for the queries that SQL can express."""

from __future__ import annotations

from tallyweave.llm.licenses import CLAUSE_END, HINT, HOLDER, HOLDER_PLAIN, RULES, SENTENCE_END, SENTENCES, rule_pattern

#: A to Z in lower case only, and the words of texts and items.
_ITEM_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATION = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce({_ITEM_WORDS}, []) AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM v),
p AS (
  SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT p.r, p.s, p.n, v.item FROM p JOIN v USING (n, t)),
h AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS at FROM m) GROUP BY r),
f AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN f ON f.r = d.r
"""

_WARC = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h
  FROM pages),
g AS (SELECT h, n, min(page_id) AS first FROM p GROUP BY h, n),
b AS (
  SELECT p.page_id, p.n, g.first, array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
      (CAST('0x' || substr(p.h, 1 + 5 * CAST(k // 4 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31
      AS INTEGER), 1)), '') AS d
  FROM p JOIN g USING (h, n))
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM b
"""


def _escaped(x: str) -> str:
    doubled = rf"replace(coalesce({x}, ''), '\', '\\')"
    for first, rest in (("<", "(/?s>)"), (r"\[", r"(/?INST\])"), ("<", "(</?SYS>>)")):
        doubled = rf"regexp_replace({doubled}, '({first}){rest}', '\1\\\2', 'g')"
    return doubled


_CHAT = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]', CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]'
  FROM range(2) t(k)),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '') AS learned,
    sum(length('<s>[INST]' || {_escaped("role")} || '[/INST]' || {_escaped("text")} || '</s>')) AS chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
  sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""

_QUALITY = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS x FROM documents),
w AS (
  SELECT doc_id, r, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM t),
s AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
n AS (
  SELECT r, count(*) AS n FROM (
    SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS at
    FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM s) WHERE c > 1)
  GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words,
    len(l) AS n_lines, length(regexp_replace(x, '[^\p{Lu}]', '', 'g')) AS n_upper,
    length(regexp_replace(x, '[^\p{L}]', '', 'g')) AS n_letters, length(regexp_replace(x, '[^!]', '', 'g')) AS n_bangs
  FROM w LEFT JOIN n USING (r)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_upper > 40 * n_letters THEN 64 ELSE 0 END + CASE WHEN 100 * n_bangs > 25 * n_words THEN 128 ELSE 0 END
    AS failed_rules
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules = 0 AS kept,
  CAST(failed_rules AS INTEGER) AS failed_rules
FROM f
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _licenses() -> str:
    known = ", ".join(f"({_quoted(s)}, {_quoted(i)})" for s, i in SENTENCES.items())
    line, names = "line0", []
    steps = []
    for k, (name, sequence) in enumerate(RULES):
        pattern = _quoted(rule_pattern(sequence))
        steps.append(
            f"s{k + 1} AS (SELECT *, regexp_matches(line{k}, {pattern}) AS hit{k}, "
            f"regexp_replace(line{k}, {pattern}, ' # ', 'g') AS line{k + 1} FROM s{k})"
        )
        names.append(f"CASE WHEN hit{k} THEN {_quoted(name)} END")
    last = len(RULES)
    return rf"""
WITH known(s, id) AS (VALUES {known}),
t AS (SELECT doc_id, row_number() OVER () AS r, lower(text) AS x FROM documents),
y AS (
  SELECT r, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, {_quoted(SENTENCE_END)}, chr(12), 'g'),
    {_quoted(CLAUSE_END)}, chr(10), 'g'), '[^a-z0-9\n\f]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), {_quoted(HOLDER)}, '{HOLDER_PLAIN}', 'g'), chr(12)) AS b
  FROM t WHERE x IS NOT NULL),
b AS (SELECT r, unnest(b) AS b, generate_subscripts(b, 1) AS k FROM y),
w AS (SELECT b.*, trim(translate(b, chr(10), ' ')) AS s, trim(translate(b, chr(10), ' ')) IN (SELECT s FROM known) AS whole FROM b),
u AS (
  SELECT r, k, 0 AS j, s FROM w WHERE whole UNION ALL
  SELECT r, k, j, trim(s) AS s FROM (
    SELECT r, k, generate_subscripts(string_split(b, chr(10)), 1) AS j, unnest(string_split(b, chr(10))) AS s FROM w WHERE NOT whole)),
g AS (
  SELECT r, list(id ORDER BY k, j) FILTER (WHERE id IS NOT NULL) AS ids,
    count(*) FILTER (WHERE id IS NULL AND contains(u.s, '{HINT}')) AS odd
  FROM u LEFT JOIN known USING (s) GROUP BY r),
s0 AS (
  SELECT doc_id, coalesce(ids, []) AS ids, coalesce(odd, 0) AS odd,
    CASE WHEN len(coalesce(ids, [])) > 0 THEN ' ' || array_to_string(ids, '  ') || ' ' ELSE '' END AS {line}
  FROM t LEFT JOIN g USING (r)),
{", ".join(steps)}
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_filter([{", ".join(names)}], lambda x, i: x IS NOT NULL AND NOT list_contains(([{", ".join(names)}])[1 : i - 1], x)), ',') AS licenses,
  CAST(odd + len(regexp_extract_all(line{last}, '[A-Za-z0-9]+')) AS BIGINT) AS n_unknown
FROM s{last}
"""


def _levels(name: str, leaves: str, rounds: int) -> str:
    """Nodes n and folded leaves f of each level above ``leaves`` (s, i, n, d, f, ...)."""
    steps = [f"{name}n0 AS MATERIALIZED (SELECT s, i, n, d FROM {leaves})", f"{name}f0 AS (SELECT *, '' AS proof FROM {leaves})"]
    left, right = "array_to_string(g.g[1 : f.i % 3], '')", "array_to_string(g.g[f.i % 3 + 2 :], '')"
    for k in range(rounds):
        steps.append(
            f"{name}n{k + 1} AS MATERIALIZED (SELECT s, i // 3 AS i, (n + 2) // 3 AS n, list(d ORDER BY i) AS g, "
            f"CASE WHEN n = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}n{k} GROUP BY s, i // 3, n)"
        )
        steps.append(
            f"{name}f{k + 1} AS (SELECT f.* REPLACE (f.i // 3 AS i, g.n AS n, f.proof || {left} || {right} AS proof, "
            f"CASE WHEN f.n = 1 THEN f.f ELSE sha256({left} || f.f || {right}) END AS f) "
            f"FROM {name}f{k} f JOIN {name}n{k + 1} g ON g.s IS NOT DISTINCT FROM f.s AND g.i = f.i // 3)"
        )
    return ",\n".join(steps)


def _merkle(rounds: int = 14, top_rounds: int = 6) -> str:
    """Enough levels for 3**14 rows of a source and 3**6 sources."""

    def framed(x: str) -> str:
        return f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"

    ahead = " || ".join(map(framed, ("doc_id", "source", "lang", "n_chars")))
    return rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
row_digests AS (
  SELECT doc_id, source AS s, sha256({ahead} || {framed("text")}) AS d,
    sha256({ahead} || {framed("replace(text, chr(10), '')")}) AS c,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)) AS inverted_crc
  FROM documents, crc),
leaf AS MATERIALIZED (
  SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, d) - 1 AS i,
    count(*) OVER (PARTITION BY s) AS n, d, CASE WHEN inverted_crc % 2 = 1 THEN c ELSE d END AS f
  FROM row_digests),
{_levels("a", "leaf", rounds)},
subs AS MATERIALIZED (
  SELECT 0 AS s, s AS source, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, count(*) OVER () AS n, d, d AS f FROM an{rounds}),
{_levels("b", "subs", top_rounds)},
-- Folding goes on from each leaf's own subroot.
joined AS MATERIALIZED (
  SELECT l.doc_id, l.d AS leaf, l.proof AS below, l.f, 0 AS s, u.source, u.i, u.n, u.d FROM af{rounds} l
  JOIN subs u ON u.source IS NOT DISTINCT FROM l.s),
{_levels("c", "joined", 0)},
{_folds("c", "b", top_rounds)},
root AS (SELECT d AS root FROM bn{top_rounds})
SELECT doc_id, leaf, x.d AS subroot, root, sha256(below || proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM cf{top_rounds} x, root
"""


def _folds(name: str, nodes: str, rounds: int) -> str:
    """Folded rows f of each level above ``name``f0, with the nodes of another name."""
    left, right = "array_to_string(g.g[1 : f.i % 3], '')", "array_to_string(g.g[f.i % 3 + 2 :], '')"
    return ",\n".join(
        f"{name}f{k + 1} AS (SELECT f.* REPLACE (f.i // 3 AS i, g.n AS n, f.proof || {left} || {right} AS proof, "
        f"CASE WHEN f.n = 1 THEN f.f ELSE sha256({left} || f.f || {right}) END AS f) "
        f"FROM {name}f{k} f JOIN {nodes}n{k + 1} g ON g.s IS NOT DISTINCT FROM f.s AND g.i = f.i // 3)"
        for k in range(rounds)
    )


def _product_codes(rounds: int = 6) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"d{k} AS (SELECT r, part, e, sum((v.x - b.x) * (v.x - b.x)) AS d FROM v JOIN b{k} b USING (part, pos) GROUP BY r, part, e), "
            f"a{k} AS MATERIALIZED (SELECT r, part, e, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, e) = 1)"
        )
        if k < rounds:
            steps.append(
                f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, b.pos, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN ("
                f"SELECT part, e, pos, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x "
                f"FROM v JOIN a{k} USING (r, part) GROUP BY part, e, pos) m USING (part, e, pos))"
            )
    steps_text = ",\n".join(steps)
    return f"""
WITH usable AS (
  SELECT vec_id, embedding, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 8 = 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (
  SELECT r, len(embedding) // 8 AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM usable
  WHERE len(embedding) = (SELECT len(embedding) FROM usable WHERE r = 1)),
v AS MATERIALIZED (SELECT r, k // w AS part, k % w AS pos, CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT) AS x FROM c),
b0 AS MATERIALIZED (
  SELECT part, dense_rank() OVER (ORDER BY r) - 1 AS e, pos, x FROM v
  WHERE r IN (SELECT DISTINCT r FROM v ORDER BY r LIMIT 16)),
{steps_text},
book AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, pos)) AS h FROM b{rounds}),
o AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM o JOIN usable USING (r), book
"""


ORACLE = {
    "op2_warc": _WARC,
    "op5_decontamination": _DECONTAMINATION,
    "op6_chat": _CHAT,
    "op7_licenses": _licenses(),
    "op10_quality": _QUALITY,
    "op12_merkle": _merkle(),
    "op13_product_codes": _product_codes(),
}
