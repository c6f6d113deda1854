"""Query of the collocation operator, and the SQL that must give the same rows."""

from __future__ import annotations

from loadcurve.llm import collocations
from loadcurve.llm.registry import query, table


@query(
    "op11_phrase_collocations",
    """
    WITH pieces AS (
      SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
      FROM (SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents)),
    starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
    grams AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, j FROM starts, range(1, 6) AS lengths(j) WHERE i + j - 1 <= len(w)),
    f AS (SELECT lang, phrase, j, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
    totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
    kept AS (
      SELECT c.* FROM f AS c
      WHERE c.j >= 2 AND NOT EXISTS (
        SELECT 1 FROM f AS o WHERE o.lang = c.lang AND o.j > c.j AND 100 * o.f >= 100 * c.f AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
    cuts AS (
      SELECT kept.*, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:j], ' ') AS rest
      FROM kept, range(1, 5) AS places(k) WHERE k < j),
    scored AS (
      SELECT cuts.lang, cuts.phrase, cuts.f AS a, k, x.f AS l, y.f AS r, n,
             (1000::HUGEINT * cuts.f::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
      FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = cuts.head JOIN f AS y ON y.lang = cuts.lang AND y.phrase = cuts.rest
      JOIN totals ON totals.lang = cuts.lang),
    lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE place = 1)
    SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
           CAST(score AS BIGINT) AS score, CAST(k AS BIGINT) AS cut
    FROM ranked WHERE rank <= 2000
    """,
)
def _(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
