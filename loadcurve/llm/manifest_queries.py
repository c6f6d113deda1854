"""Query of the manifest operator, and the SQL that must give the same rows."""

from __future__ import annotations

from loadcurve.llm import manifest
from loadcurve.llm.registry import query, table

#: Levels that the SQL writes out: 8 ** 8 leaves a group, 8 ** 3 groups.
_LEVELS, _TOP = 8, 3


def _tree(name: str, levels: int) -> str:
    """CTEs {name}0, {name}1, ...: the nodes (g, pos, h) of each level with m, their number in group g, and the digests left and right of each."""
    out = []
    for k in range(levels):
        if k:
            out.append(f"""{name}{k} AS (
              SELECT g, pos // 8 AS pos, CASE WHEN m > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h, (m + 7) // 8 AS m
              FROM {name}{k - 1} GROUP BY g, pos // 8, m)""")
        out.append(f"""{name}{k}s AS (
          SELECT a.g, a.pos, a.m, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
                 coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
          FROM {name}{k} AS a JOIN {name}{k} AS b ON a.g = b.g AND a.pos // 8 = b.pos // 8 GROUP BY a.g, a.pos, a.m)""")
    return ",\n".join(out)


def _climb(name: str, levels: int, before: str, place: str) -> str:
    """CTEs that carry a row's digest x and its proof up through the levels of tree `name`."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k}p AS (
          SELECT p.* REPLACE (p.proof || s.l || s.r AS proof, CASE WHEN s.m > 1 THEN sha256(s.l || p.x || s.r) ELSE p.x END AS x,
                              p.copied + CAST(s.m > 1 AND {str(name == "n" and k < 3)} AND p.touched AS INT) AS copied)
          FROM {before} AS p JOIN {name}{k}s AS s ON s.g = p.{"g" if name == "n" else "one"} AND s.pos = p.{place} // {8**k})""")
        before = f"{name}{k}p"
    return ",\n".join(out)


def _field(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BITS = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BITS}), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"

SQL = f"""
WITH leaves AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, coalesce({_CRC} % 3 = 0, false) AS touched,
         sha256({" || ".join(_field(c) for c in manifest.FIELDS)}) AS h,
         sha256({" || ".join(_field(_LOWER if c == "text" else c) for c in manifest.FIELDS)}) AS low
  FROM documents),
docs AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS m FROM leaves),
n0 AS (SELECT g, pos, h, m FROM docs),
{_tree("n", _LEVELS)},
subroots AS (SELECT g AS member, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS m FROM n{_LEVELS - 1} WHERE pos = 0),
t0 AS (SELECT 1 AS g, pos, h, m FROM subroots),
{_tree("t", _TOP)},
whole AS (SELECT h AS root FROM t{_TOP - 1} WHERE pos = 0),
start AS (
  SELECT d.doc_id, d.h AS leaf, d.g, d.pos, 1 AS one, s.pos AS up, s.h AS subroot, whole.root, d.touched, CAST(d.touched AS INT) AS copied,
         '' AS proof, CASE WHEN d.touched THEN d.low ELSE d.h END AS x
  FROM docs AS d JOIN subroots AS s ON s.member = d.g CROSS JOIN whole),
{_climb("n", _LEVELS, "start", "pos")},
{_climb("t", _TOP, f"n{_LEVELS - 1}p", "up")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, x AS folded_root, x = root AS verified, copied FROM t{_TOP - 1}p
"""


@query("op12_merkle_manifest", SQL)
def _(spark, sf_dir):
    return manifest.audit_versions(table(spark, sf_dir, "documents"), manifest.lower_case_of_thirds())
