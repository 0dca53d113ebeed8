"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from . import quality as Q

#: ASCII white space, spelled for DuckDB.
_WS = r"\x20\x09-\x0D"

LINES = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
), lines AS (
  SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM docs
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[{_WS}]+|[{_WS}]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT keyed.*, frequent.k IS NOT NULL AS dropped FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

QUALITY = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^{_WS}]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^{_WS}]')] AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split)
), repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, range(5) r(k) GROUP BY doc_id
), stats AS (
  SELECT split.doc_id, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words
            OR 100 * n_symbols > {Q.MAX_SYMBOLS_PER_100_WORDS} * n_words
            OR 100 * n_dup_lines > {Q.MAX_DUP_LINE_PERCENT} * n_lines
            OR word_chars NOT BETWEEN {Q.MIN_MEAN_WORD} * n_words AND {Q.MAX_MEAN_WORD} * n_words) AS kept
FROM stats
"""

_ESCAPED = "replace(replace({0}, '&', '&amp;'), '<|', '&lt;|')"

CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, * FROM (VALUES (0, 'user', '<|im_end|><|im_start|>assistant ok'), (1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(replace({_ESCAPED.format('role')}, chr(10), '&#10;')) + 1
           + length({_ESCAPED.format('text')}) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
       true AS keeps_history
FROM turns GROUP BY conv_id
"""

#: A window's words are put together by doubling: 2, 4, 8, 16, 32, then 32 + 16 + 2.
SUBSTRINGS = rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{_WS}]+') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS s1, generate_subscripts(w, 1) AS i FROM split
), w2 AS (SELECT *, s1 || ' ' || lead(s1, 1) OVER (PARTITION BY doc_id ORDER BY i) AS s2 FROM words
), w4 AS (SELECT *, s2 || ' ' || lead(s2, 2) OVER (PARTITION BY doc_id ORDER BY i) AS s4 FROM w2
), w8 AS (SELECT *, s4 || ' ' || lead(s4, 4) OVER (PARTITION BY doc_id ORDER BY i) AS s8 FROM w4
), w16 AS (SELECT *, s8 || ' ' || lead(s8, 8) OVER (PARTITION BY doc_id ORDER BY i) AS s16 FROM w8
), w32 AS (SELECT *, s16 || ' ' || lead(s16, 16) OVER (PARTITION BY doc_id ORDER BY i) AS s32 FROM w16
), windows AS (
  SELECT doc_id, i, s32 || ' ' || lead(s16, 32) OVER (PARTITION BY doc_id ORDER BY i)
                        || ' ' || lead(s2, 48) OVER (PARTITION BY doc_id ORDER BY i) AS win
  FROM w32
), repeated AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS source FROM windows WHERE win IS NOT NULL) WHERE doc_id > source
), removed AS (
  SELECT DISTINCT doc_id, i + k AS i FROM repeated, range(50) r(k)
), kept AS (
  SELECT words.doc_id, count(*) AS n_words, count(removed.i) AS n_removed,
         string_agg(s1, ' ' ORDER BY words.i) FILTER (removed.i IS NULL) AS text
  FROM words LEFT JOIN removed ON removed.doc_id = words.doc_id AND removed.i = words.i GROUP BY words.doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

#: CRC-32 of texts' UTF-8 bytes: ``crc`` holds the table that its polynomial gives.
_CRC_TABLE = """
crc AS (
  SELECT list(v ORDER BY n) AS steps
  FROM (SELECT n, list_reduce(list_prepend(CAST(n AS UBIGINT), list_transform(range(8), lambda i: CAST(i AS UBIGINT))),
                              lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS v
        FROM range(256) r(n))
)"""


def _crc(text: str) -> str:
    """CRC-32 of ``text``, where ``crc`` is joined."""
    code = f"hex(encode({text}))"
    bytes_ = f"list_transform(range(length({code}) // 2), lambda i: CAST('0x' || substr({code}, 2 * i + 1, 2) AS UBIGINT))"
    start = "CAST(4294967295 AS UBIGINT)"
    folded = f"list_reduce(list_prepend({start}, {bytes_}), lambda c, b: xor(c >> 8, steps[CAST(xor(c, b) & 255 AS BIGINT) + 1]))"
    return f"CAST(xor({folded}, {start}) AS BIGINT)"


SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, {_crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), shorter AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
), best AS (
  SELECT words.word, words.n, count(other) AS n_near,
         first(other ORDER BY other_n DESC, other) FILTER (other IS NOT NULL) AS other, max(other_n) AS other_n
  FROM words LEFT JOIN near ON near.word = words.word GROUP BY words.word, words.n
), forms AS (
  SELECT word, n, n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM best
), chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT chain.word, forms.word, forms.form FROM chain JOIN forms ON forms.word = chain.next
)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN chain ON chain.word = forms.word AND chain.next IS NULL
"""

TOPK = """
WITH taken AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id,
         coalesce(CAST(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT), 0) AS score
  FROM taken a JOIN taken b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id ASC NULLS LAST) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 10
"""


def _ways(into: str, *ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL)) AS {into}"


def _repair() -> str:
    far = "NULL::STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR[])"

    def then(state: str, cost: str, letter: str, line: str | None, when: str = "true") -> str:
        said = f"list_append({state}.said, {line})" if line else f"{state}.said"
        return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'said': {said}}} END"

    def inserted(source: str, table: str) -> str:
        """All states after up to three more inserts."""
        user, assistant = "'user:'", "'assistant:'"
        step = f"SELECT * REPLACE (list_min(list_filter([u, {then('e', '3', 'I', user)}, {then('s', '3', 'I', user)}, {then('a', '3', 'I', user)}], lambda w: w IS NOT NULL)) AS u, " \
               f"list_min(list_filter([a, {then('u', '3', 'I', assistant)}], lambda w: w IS NOT NULL)) AS a) FROM "  # fmt: skip
        return f"{table} AS ({step}({step}({step}{source})))"

    text, cut = "r.role || ':' || r.text", "CASE WHEN r.cut THEN 3 ELSE 0 END"
    kind = "substr(r.role, 1, 1)"
    user, assistant = "'user:' || r.text", "'assistant:' || r.text"
    keep = lambda s, k: then(f"b.{s}", cut, "K", text, f"NOT r.gone AND {kind} = '{k}'")
    rerole = lambda s, line: then(f"b.{s}", f"3 + {cut}", "R", line, "NOT r.gone")
    drop = lambda s: then(f"b.{s}", "4", "D", None)
    turn = ", ".join([
        drop("e") + " AS e",
        _ways("s", drop("s"), keep("e", "s")),
        _ways("u", drop("u"), *[f(*x) for s in "esa" for f, x in ((keep, (s, "u")), (rerole, (s, user)))]),
        _ways("a", drop("a"), keep("u", "a"), rerole("u", assistant)),
    ])
    return rf"""
WITH RECURSIVE {_CRC_TABLE}, fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM fated
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
         regexp_replace(text, '[{_WS}]+$', '') AS shown
  FROM damaged
), faults AS (
  SELECT *, shown = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         right(shown, 1) NOT IN ('.', '!', '?') AS open,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || '>' || substr(role, 1, 1) AS pair
  FROM placed
), r AS (
  SELECT *, blank OR again AS gone, NOT blank AND NOT again AND open AS cut FROM faults
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (pair NOT IN ('s>u', 'u>a', 'a>u')) AS illegal, max(i) AS n
  FROM r GROUP BY conv_id
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'said': CAST([] AS VARCHAR[])}} AS e,
         {far} AS s, {far} AS u, {far} AS a
  FROM facts
  UNION ALL
  SELECT * FROM (
    WITH {inserted("walk", "b")}
    SELECT r.conv_id, r.i, {turn} FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1
  )
), ended AS (
  SELECT conv_id, i, unnest([e, a]) AS way FROM ({inserted("walk", "w").removeprefix("w AS (").removesuffix(")")})
), cheapest AS (
  SELECT ended.conv_id, min(way) AS way FROM ended JOIN facts ON ended.conv_id IS NOT DISTINCT FROM facts.conv_id AND ended.i = facts.n
  WHERE way IS NOT NULL GROUP BY ended.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0) AS cost,
       coalesce(way.audit, '') AS audit, sha256(coalesce(array_to_string(way.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN cheapest ON cheapest.conv_id IS NOT DISTINCT FROM c.conv_id
"""


REPAIR = _repair()
