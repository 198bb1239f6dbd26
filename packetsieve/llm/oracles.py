"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), runs AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) AS phrase
  FROM runs, (SELECT unnest([1, 2, 3]) AS k)
), counted AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL
), words AS (
  SELECT lang, sum(a) AS n FROM counted WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT * FROM counted WHERE k >= 2 AND a >= 10
), cuts AS (
  SELECT *, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS ws FROM candidates
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, f.a AS l, b.a AS r,
         (1000000::HUGEINT * c.a * c.a) // (f.a::HUGEINT * b.a) AS score
  FROM cuts c
  JOIN counted f ON f.lang = c.lang AND f.phrase = array_to_string(c.ws[1:c.cut], ' ')
  JOIN counted b ON b.lang = c.lang AND b.phrase = array_to_string(c.ws[c.cut + 1:c.k], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    FROM candidates longer WHERE longer.lang = s.lang AND longer.k > s.k AND 100 * longer.a >= 50 * s.a
    AND contains(' ' || longer.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN words USING (lang) QUALIFY rank <= 2000
"""

#: Levels of a tree in the SQL below: enough for 8^8 leaves.
LEVELS = 8


def _tree(name: str) -> str:
    """Steps from ``{name}_0`` (``key``, ``pos``, ``d``, ``total``) to the siblings of each level and the tops."""
    steps = []
    for j in range(LEVELS):
        steps.append(
            f"{name}_runs_{j} AS (SELECT key, pos // 8 AS up, list(d ORDER BY pos) AS ds, max(total) AS total "
            f"FROM {name}_{j} WHERE total > 1 GROUP BY ALL)"
        )
        steps.append(
            f"{name}_beside_{j} AS (SELECT n.key, n.pos, array_to_string(ds[1:n.pos % 8], '') AS lft, "
            f"array_to_string(ds[n.pos % 8 + 2:8], '') AS rgt FROM {name}_{j} n JOIN {name}_runs_{j} r ON r.key = n.key AND r.up = n.pos // 8)"
        )
        steps.append(
            f"{name}_{j + 1} AS (SELECT key, up AS pos, sha256(array_to_string(ds, '')) AS d, (total + 7) // 8 AS total FROM {name}_runs_{j})"
        )
    tops = " UNION ALL ".join(f"SELECT key, d FROM {name}_{j} WHERE total = 1" for j in range(LEVELS + 1))
    return ", ".join([*steps, f"{name}_top AS ({tops})"])


def _folded(name: str, source: str, out: str) -> str:
    """Steps that fold ``node`` and add to ``proof`` along the levels from ``pos``, in ``{out}``."""
    steps, last = [], source
    for j in range(LEVELS):
        step = out if j == LEVELS - 1 else f"{out}_{j}"
        steps.append(
            f"{step} AS (SELECT f.* REPLACE (CASE WHEN b.key IS NULL THEN f.node ELSE sha256(b.lft || f.node || b.rgt) END AS node, "
            f"f.proof || coalesce(b.lft || b.rgt, '') AS proof) "
            f"FROM {last} f LEFT JOIN {name}_beside_{j} b ON b.key = f.key AND b.pos = f.pos // {8**j})"
        )
        last = step
    return ", ".join(steps)


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


CRC32 = """xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
    lambda crc, byte: list_reduce([xor(crc, byte)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0],
      lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)), 4294967295::UBIGINT)"""

MERKLE = f"""
WITH leaves AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE ':' || lang END AS key, {_leaf('text')} AS leaf,
         CASE WHEN ({CRC32}) % 3 = 0 THEN {_leaf(LOWERED)} ELSE {_leaf('text')} END AS node
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS total FROM leaves
), t_0 AS (SELECT key, pos, leaf AS d, total FROM placed),
{_tree('t')},
named AS (SELECT key AS name, d AS subroot, row_number() OVER (ORDER BY key) - 1 AS top_pos, count(*) OVER () AS langs FROM t_top),
u_0 AS (SELECT '' AS key, top_pos AS pos, subroot AS d, langs AS total FROM named),
{_tree('u')},
low_start AS (SELECT doc_id, key, leaf, node, pos, '' AS proof FROM placed),
{_folded('t', 'low_start', 'low')},
high_start AS (SELECT doc_id, leaf, node, proof, '' AS key, top_pos AS pos, subroot FROM low JOIN named ON name = key),
{_folded('u', 'high_start', 'high')}
SELECT doc_id, leaf, subroot, u_top.d AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = u_top.d AS verified
FROM high JOIN u_top ON u_top.key = high.key
"""

CONTROL = r"(\\*)(\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE\]|\[SEP\])"


def _escaped(column: str) -> str:
    return rf"length(regexp_replace({column}, '{CONTROL}', '\1\\\2', 'g'))"


CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
         sum({_escaped('text')} + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 22 + {_escaped('role')} END)::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM joined
"""
