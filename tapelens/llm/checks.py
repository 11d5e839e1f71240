"""DuckDB SQL for the results of the registered corpus queries."""

from __future__ import annotations

from tapelens.llm import quality_rules

_BITS = " + ".join(
    f"CASE WHEN {rule.fails} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(quality_rules.RULES))
_MASK = {name: quality_rules.mask_of(rules) for name, rules in quality_rules.POLICIES.items()}

_QUALITY = rf"""
WITH body AS (
    SELECT doc_id, coalesce(text, '') AS body,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
windows AS (
    SELECT doc_id, unnest(range(1, len(words) - 3)) AS p, words FROM body WHERE len(words) >= 5),
named AS (SELECT doc_id, p, array_to_string(words[p:p + 4], ' ') AS w FROM windows),
twice AS (SELECT doc_id, p FROM named QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (
    SELECT doc_id, count(DISTINCT p + k) AS n
    FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
measured AS (
    SELECT b.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(c.n, 0) AS n_repeat_words
    FROM body b LEFT JOIN covered c ON b.doc_id = c.doc_id),
ledger AS (SELECT *, {_BITS} AS failure_bits FROM measured)
"""

QUALITY_RULES = _QUALITY + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failure_bits & {_MASK['base']}) <> 0 AS base_failed,
       (failure_bits & {_MASK[quality_rules.CURRENT]}) = 0 AS kept, failure_bits, n_lines
FROM ledger
"""

QUALITY_ABLATIONS = _QUALITY + ", cases(policy, rule, mask, bit) AS (VALUES " + ", ".join(
    f"('{policy}', '{rule}', {_MASK[policy]}, {quality_rules.mask_of((rule,))})"
    for policy, rules in quality_rules.POLICIES.items() for rule in rules) + """)
SELECT policy, rule, count(*) AS n_docs,
       count(*) FILTER (WHERE (failure_bits & mask) = 0) AS n_kept,
       count(*) FILTER (WHERE (failure_bits & mask & bit) <> 0) AS n_failing,
       count(*) FILTER (WHERE (failure_bits & mask) = bit) AS n_only_reason
FROM ledger, cases GROUP BY policy, rule
"""

MINMAX_DEDUP = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached(v, c) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT e.b, r.c FROM reached r JOIN both_ways e ON e.a = r.v AND r.c < e.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.c) AS component_id,
       d.doc_id = min(r.c) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reached r ON r.v = d.doc_id
GROUP BY d.doc_id, s.n
"""

SIZE_AWARE_JOIN = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM words WHERE len(w) > 0),
members AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM places),
sized AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id) AS n FROM members),
met AS (
    SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS k
    FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM met WHERE 100 * k >= 80 * (x + y - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reached(v, c) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT e.b, r.c FROM reached r JOIN edge e ON e.a = r.v AND r.c < e.b)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN sized s USING (doc_id) JOIN reached r ON r.v = d.doc_id
GROUP BY d.doc_id
"""

DECONTAMINATION = r"""
WITH item AS (
    SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
doc AS (
    SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
item_place AS (SELECT item_id, w, len(w) AS n, unnest(range(1, len(w) - 3)) AS p FROM item WHERE len(w) >= 5),
item_shingle AS (
    SELECT item_id, n, array_to_string(w[p:p + 4], ' ') AS s, count(*) AS c FROM item_place GROUP BY ALL),
doc_place AS (SELECT doc_id, w, len(w) AS of, unnest(range(1, len(w) - 3)) AS p FROM doc WHERE len(w) >= 5),
doc_shingle AS (SELECT doc_id, of, p, array_to_string(w[p:p + 4], ' ') AS s FROM doc_place),
start AS (
    SELECT DISTINCT doc_id, of, n,
           unnest(range(greatest(1, p - n + 5), least(p, greatest(1, of - n + 1)) + 1)) AS start
    FROM doc_shingle JOIN (SELECT DISTINCT n, s FROM item_shingle) USING (s)),
in_window AS (
    SELECT w.doc_id, w.n, w.of, w.start, d.s, count(*) AS c
    FROM start w JOIN doc_shingle d ON d.doc_id = w.doc_id AND d.p BETWEEN w.start AND w.start + w.n - 5
    GROUP BY ALL),
scored AS (
    SELECT doc_id, item_id, x.n, start, sum(least(x.c, i.c))::DOUBLE AS k,
           least(x.n, any_value(of)) + x.n - 8 AS either
    FROM in_window x JOIN item_shingle i ON i.n = x.n AND i.s = x.s
    GROUP BY doc_id, item_id, x.n, start)
SELECT doc_id, item_id, start AS start_word, n AS n_words, k / (either - k) AS similarity
FROM scored WHERE k / (either - k) >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY k / (either - k) DESC, start) = 1
"""

PERSPECTIVES = r"""
WITH said AS (
    SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> 'system'),
lines AS (
    SELECT s.conv_id, p.speaker, s.turn // 64 AS block, s.turn, s.role, s.text,
           CASE WHEN s.role = p.speaker THEN '<|assistant|>' || chr(10)
                WHEN s.role = 'system' THEN '<|system|>' || chr(10)
                ELSE '<|user|>name=' || coalesce(s.role, 'unknown') || chr(10) END AS head,
           s.text || '<|end|>' || chr(10) AS body, coalesce(s.role = p.speaker, false) AS own
    FROM said s JOIN speakers p USING (conv_id)),
placed AS (
    SELECT *, sum(length(head) + length(body)) OVER (
        PARTITION BY conv_id, speaker, block ORDER BY turn, role NULLS FIRST, text
        ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
    FROM lines)
SELECT conv_id, speaker, block, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY turn, role NULLS FIRST, text) AS text,
       coalesce(string_agg((stop - length(body))::VARCHAR || ':' || stop::VARCHAR, ','
                ORDER BY turn, role NULLS FIRST, text) FILTER (WHERE own), '') AS mask,
       coalesce(sum(length(body)) FILTER (WHERE own), 0)::BIGINT AS n_trained
FROM placed GROUP BY conv_id, speaker, block
"""

_BYTE = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bytes_ = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: {_BYTE}), 4294967295)"


PREFIX_TRIE = rf"""
WITH said AS (
    SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
        ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
planned AS (SELECT *, {_crc32('conv_id::VARCHAR')} % 6 AS h FROM said),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.t[1:c.h], c.t[1:0]), c.t[c.h + 1:]) AS t
    FROM planned c LEFT JOIN said b ON b.conv_id = c.conv_id - c.conv_id % 100),
prefix AS (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS depth FROM rebuilt),
node AS (
    SELECT t[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(length(any_value(t[depth].text)), 0) AS len,
           coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(t) = depth), '') AS ends
    FROM prefix GROUP BY 1, 2),
counted AS (
    SELECT n.*, (SELECT count(*) FROM node c WHERE c.depth = n.depth + 1 AND c.p[1:n.depth] = n.p) AS n_children,
           (SELECT min(u.conv_id) FROM node u WHERE u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]) AS parent_conv_id
    FROM node n)
SELECT u.conv_id, u.depth, any_value(u.parent_conv_id) AS parent_conv_id, any_value(u.n_convs) AS n_convs,
       any_value(u.n_children) AS n_children, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves,
       sum((v.n_convs - 1) * v.len)::BIGINT AS saved_tokens, sha256(any_value(u.ends)) AS ends_sha256
FROM counted u JOIN counted v ON v.depth >= u.depth AND v.p[1:u.depth] = u.p
GROUP BY u.p, u.conv_id, u.depth
"""

# One string per place of the grammar: the least cost in six digits, then the letters.
_NONE = "'999999'"


def _more(place: str, cost: str, letter: str) -> str:
    return (f"CASE WHEN {place}[1:6] >= '900000' THEN {_NONE} ELSE "
            f"lpad(({place}[1:6]::INT + {cost})::VARCHAR, 6, '0') || {place}[7:] || '{letter}' END")


def _inserted(places: str) -> str:
    """Insertions one after the other, twice round, from the place before each."""
    once = lambda s: (f"list_transform([{s}], lambda x: [x[1], x[2], least(x[3], {_more('x[1]', '2', 'I')}, "  # noqa: E731
                      f"{_more('x[2]', '2', 'I')}, {_more('x[4]', '2', 'I')}), "
                      f"least(x[4], {_more('x[3]', '2', 'I')})])[1]")
    return once(once(places))


_CUT = "(CASE WHEN c[1][2] = 't' THEN 1 ELSE 0 END)"
_STAYS = "c[1][2] NOT IN ('b', 'd')"


def _onward(letter: str, places: tuple[str, ...]) -> str:
    from_ = [_more(p, _CUT, "K") for p in places]
    renamed = [_more(p, f"(2 + {_CUT})", "R") for p in places]
    kept = f"CASE WHEN {_STAYS} AND c[1][1] = '{letter}' THEN least({', '.join(from_)}, {_NONE}) ELSE {_NONE} END"
    if letter == "s":
        return kept
    return f"{kept}, CASE WHEN {_STAYS} THEN least({', '.join(renamed)}, {_NONE}) ELSE {_NONE} END"


_TURN = ("[" + ", ".join(f"least({_more(f's[{i}]', '3', 'D')}{', ' + onward if onward else ''})" for i, onward in (
    (1, ""), (2, _onward("s", ("s[1]",))), (3, _onward("u", ("s[1]", "s[2]", "s[4]"))), (4, _onward("a", ("s[3]",))))) + "]")

STRUCTURE_REPAIR = rf"""
WITH fate AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate
    FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM fate, (VALUES (1), (2)) AS c(copy) WHERE fate <> 0 AND (copy = 1 OR fate = 3)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
           rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended FROM damaged),
faulty AS (
    SELECT *, CASE WHEN ended = '' THEN 'b'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
        WHEN ended[-1] IN ('.', '!', '?') THEN '.' ELSE 't' END AS fault,
        role[1] || coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos DESC), '') AS pair,
        lead(1) OVER (PARTITION BY conv_id ORDER BY pos) AS more
    FROM placed),
folded AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
           count(*) FILTER (WHERE fault = 't') AS truncated,
           count(*) FILTER (WHERE more = 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal,
           list_reduce(list_prepend({_inserted("['000000', " + ", ".join([_NONE] * 3) + "]")},
               list([role[1] || fault] ORDER BY pos)), lambda s, c: {_inserted(_TURN)}) AS least_
    FROM faulty GROUP BY conv_id),
parsed AS (SELECT *, least(least_[1], least_[4]) AS best FROM folded),
letters AS (SELECT conv_id, unnest(string_split(best[7:], '')) AS letter, unnest(range(1, length(best) - 5)) AS nth FROM parsed),
placed_letters AS (
    SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS pos, count(*) FILTER (WHERE letter <> 'D') OVER w AS place
    FROM letters WHERE letter <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY nth)),
sized AS (SELECT *, count(*) FILTER (WHERE letter <> 'D') OVER (PARTITION BY conv_id) % 2 AS odd FROM placed_letters),
lines AS (
    SELECT l.conv_id, l.nth, CASE WHEN letter = 'K' THEN f.role WHEN (place - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END
           || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END AS line
    FROM sized l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.pos = l.pos
    WHERE letter <> 'D'),
joined AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY nth) AS body FROM lines GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best[1:6]::BIGINT, 0) AS cost, coalesce(best[7:], '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN parsed p ON p.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM i.conv_id
"""
