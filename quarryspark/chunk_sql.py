"""The splitter's rule as SQL, to check chunks against."""

from __future__ import annotations

#: White space in the Unicode sense.
_SPACES = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288)
SPACES = " || ".join(f"chr({c})" for c in _SPACES)


def chunks_sql(source: str, separators: tuple[str, ...], size: int = 1500, overlap: int = 200) -> str:
    """CTEs that end in ``chunks`` (id, n, char_start, text): the splitter's rule over ``source`` (a query of id, text).

    A level per separator splits what is too long and has it; what is left is cut. Then a window of neighbouring pieces moves along each
    text: where the next piece doesn't fit, the window is a chunk, and its trailing pieces of up to ``overlap`` stay.
    """
    out = [f"src AS MATERIALIZED ({source})", "s0 AS (SELECT id, 0::BIGINT AS a, text AS t FROM src WHERE text IS NOT NULL)"]
    k = 0
    for sep in separators:
        if not sep:
            continue
        q = " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in sep)
        out.append(f"""p{k} AS (SELECT id, a, i, CASE WHEN i = 1 THEN x ELSE {q} || x END AS x FROM (
  SELECT id, a, unnest(string_split(t, {q})) AS x, generate_subscripts(string_split(t, {q}), 1) AS i FROM s{k} WHERE length(t) > {size} AND contains(t, {q})))""")
        out.append(f"""s{k + 1} AS (SELECT id, a, t FROM s{k} WHERE length(t) <= {size} OR NOT contains(t, {q})
  UNION ALL SELECT id, a, t FROM (SELECT id, (a + sum(length(x)) OVER (PARTITION BY id, a ORDER BY i) - length(x))::BIGINT AS a, x AS t FROM p{k}) WHERE t <> '')""")
        k += 1
    out.append(f"cut AS (SELECT id, a + j * {size} AS a, least(a + length(t), a + (j + 1) * {size}) AS b FROM s{k}, generate_series(0, (length(t) - 1) // {size}) g(j))")
    out.append("e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY a) AS n FROM cut)")
    out.append("l AS MATERIALIZED (SELECT id, list(a ORDER BY n) AS starts, list(b ORDER BY n) AS ends FROM e GROUP BY id)")
    out.append(f"""w AS (SELECT id, n, 1::BIGINT AS f, NULL::BIGINT AS out FROM e WHERE n = 1
  UNION ALL SELECT id, n, CASE WHEN full_ THEN f + len([x for x in starts[f:n - 1] if x < greatest(ends[n - 1] - {overlap}, b - {size})]) ELSE f END, CASE WHEN full_ THEN f END
  FROM (SELECT e.*, w.f, l.starts, l.ends, e.b - l.starts[w.f] > {size} AS full_ FROM w JOIN e ON e.id = w.id AND e.n = w.n + 1 JOIN l ON l.id = e.id))""")
    out.append("r AS (SELECT id, out AS f, n - 1 AS g FROM w WHERE out IS NOT NULL UNION ALL SELECT w.id, f, n FROM w JOIN l ON l.id = w.id AND w.n = len(l.ends))")
    out.append("c AS (SELECT r.id, r.g, starts[f] AS a, substring(text, (starts[f] + 1)::BIGINT, (ends[g] - starts[f])::BIGINT) AS raw FROM r JOIN l USING (id) JOIN src USING (id))")
    out.append(f"chunks AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY g, a) - 1 AS n, (a + length(raw) - length(ltrim(raw, {SPACES})))::INTEGER AS char_start, trim(raw, {SPACES}) AS text FROM c WHERE trim(raw, {SPACES}) <> '')")
    return "WITH RECURSIVE " + ",\n".join(out)
