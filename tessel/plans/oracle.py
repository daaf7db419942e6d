"""DuckDB SQL for the solver's queries, written from the recurrences."""

TRADE = """trade AS (SELECT s_nationkey AS i, c_nationkey AS j, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS q
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
EDGES = f"{TRADE}, edges AS (SELECT i, j, 1 + q % 97 AS v FROM trade WHERE i <> j)"


def closed(edges: str) -> str:
    """Shortest paths by five squarings, enough for 32 steps."""
    steps = [f"d0 AS (SELECT * FROM ({edges}) UNION ALL SELECT n_nationkey, n_nationkey, 0 FROM nation)"]
    steps += [f"d{k + 1} AS (SELECT a.i, b.j, min(a.v + b.v) AS v FROM d{k} a JOIN d{k} b ON a.j = b.i GROUP BY a.i, b.j)" for k in range(5)]
    return f"WITH {EDGES}, {', '.join(steps)} SELECT i, j, v FROM d5"


FW = closed("SELECT i, j, v FROM edges")
REGION = closed("SELECT i, j, v FROM edges JOIN nation a ON i = a.n_nationkey JOIN nation b ON j = b.n_nationkey WHERE a.n_regionkey = b.n_regionkey")
MINPLUS = f"WITH {EDGES} SELECT a.i, b.j, min(a.v + b.v) AS v FROM edges a JOIN edges b ON a.j = b.i GROUP BY a.i, b.j"

MATRIX = f"""{TRADE}, counts AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j, coalesce(trade.n, 0) AS n
  FROM nation a CROSS JOIN nation b LEFT JOIN trade ON trade.i = a.n_nationkey AND trade.j = b.n_nationkey),
matrix AS (SELECT i, j, (n + CASE WHEN i = j THEN 1 + sum(n) OVER (PARTITION BY i) ELSE 0 END)::DOUBLE AS v FROM counts)"""
GRAM = """long AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS i, round(unnest(embedding)::DOUBLE * 1000)::BIGINT AS x FROM embeddings),
matrix AS (SELECT a.i, b.i AS j, (sum(a.x * b.x)::BIGINT / 1e6 + CASE WHEN a.i = b.i THEN 100 ELSE 0 END)::DOUBLE AS v FROM long a JOIN long b USING (vec_id) GROUP BY a.i, b.i)"""
#: The whole table after each pivot; multipliers are read from the table before it.
ELIMINATION = """m(k, i, j, v) AS (SELECT 0, i, j, v FROM matrix UNION ALL
  SELECT x.k + 1, x.i, x.j, CASE WHEN x.i > x.k AND x.j >= x.k THEN x.v - u.v * q.v / w.v ELSE x.v END
  FROM m x JOIN m u ON u.i = x.i AND u.j = x.k JOIN m q ON q.i = x.k AND q.j = x.j JOIN m w ON w.i = x.k AND w.j = x.k
  WHERE x.k < (SELECT max(i) FROM matrix)),
reduced AS (SELECT i, j, v FROM m WHERE k = (SELECT max(i) FROM matrix))"""


def eliminated(matrix: str, select: str) -> str:
    return f"WITH RECURSIVE {matrix}, {ELIMINATION} {select}"


UPPER = eliminated(MATRIX, "SELECT i, j, CASE WHEN i > j THEN 0.0::DOUBLE ELSE round(v, 6) + 0.0::DOUBLE END AS v FROM reduced")
#: Column j of the table before pivot j, over its diagonal.
LOWER = eliminated(MATRIX, "SELECT x.i, x.j, CASE WHEN x.i < x.j THEN 0.0::DOUBLE ELSE round(x.v / w.v, 6) + 0.0::DOUBLE END AS v FROM m x JOIN m w ON w.k = x.k AND w.i = x.j AND w.j = x.j WHERE x.k = x.j")
DET = "SELECT (1 - 2 * (sum((v < 0)::INT) % 2))::INT AS sign, round(sum(log10(abs(v))), 6) + 0.0::DOUBLE AS log10_abs FROM reduced WHERE i = j"
SOLVE = f"""WITH RECURSIVE {MATRIX}, n AS (SELECT count(*)::INT AS n FROM nation),
m(k, i, j, v) AS (SELECT 0, i, j, v FROM (SELECT i, j, v FROM matrix UNION ALL SELECT n_nationkey, n.n, (n_nationkey + 1)::DOUBLE FROM nation, n) UNION ALL
  SELECT x.k + 1, x.i, x.j, CASE WHEN x.i = x.k THEN x.v / w.v ELSE x.v - u.v * q.v / w.v END
  FROM m x JOIN m u ON u.i = x.i AND u.j = x.k JOIN m q ON q.i = x.k AND q.j = x.j JOIN m w ON w.i = x.k AND w.j = x.k WHERE x.k < (SELECT n FROM n))
SELECT i, round(v, 6) + 0.0::DOUBLE AS x FROM m, n WHERE k = n.n AND j = n.n"""
LITERAL = f"WITH {MATRIX} SELECT i, j, CASE WHEN i <= j THEN v ELSE 0.0::DOUBLE END AS v FROM matrix"

CHAIN = """chain AS (SELECT pos, (2 * sum((x > 0)::INT) >= count(*))::INT AS h FROM (SELECT unnest(range(len(embedding)))::INT AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY pos),
size AS (SELECT count(*)::INT AS n FROM chain)"""
CONTACT = """hits AS MATERIALIZED (SELECT a.pos AS j, t.pos AS t FROM chain a JOIN chain t ON true JOIN chain q ON q.pos = 2 * a.pos - t.pos - 1
  WHERE t.h = 1 AND q.h = 1 AND t.pos - a.pos >= 2 AND 2 * a.pos - t.pos >= 0),
contact AS MATERIALIZED (SELECT a.pos AS j, b.pos AS k, count(hits.t) AS c FROM size JOIN chain a ON a.pos >= 1 AND a.pos < size.n - 1 JOIN chain b ON b.pos - a.pos >= 2
  LEFT JOIN hits ON hits.j = a.pos AND hits.t <= b.pos GROUP BY a.pos, b.pos)"""


def folding(weight: str, join: str = "") -> str:
    """The table after each column from the last; column k is final when it is read."""
    return f"""s(k, i, j, v) AS (SELECT size.n - 1, a.pos, b.pos, 0::BIGINT FROM chain a JOIN chain b ON a.pos <= b.pos, size UNION ALL
  SELECT x.k - 1, x.i, x.j, CASE WHEN u.v IS NOT NULL AND x.j >= x.i + 1 AND x.j <= least(x.k - 2, size.n - 3) AND x.i <= size.n - 4 THEN greatest(x.v, u.v + {weight}) ELSE x.v END
  FROM s x CROSS JOIN size LEFT JOIN s u ON u.i = x.j + 1 AND u.j = x.k {join} WHERE x.k >= 3),
folded AS (SELECT i, j, v FROM s WHERE k = 2)"""


STUB = f"WITH RECURSIVE {CHAIN}, {folding('x.j + 1 + least(x.k, 2 * x.j - x.i + 1)')}"
REAL = f"WITH RECURSIVE {CHAIN}, {CONTACT}, {folding('coalesce(f.c, 0)', 'LEFT JOIN contact f ON f.j = x.j + 1 AND f.k = least(x.k, 2 * x.j - x.i + 1)')}"

ALIGN = """WITH RECURSIVE one AS (SELECT c_nationkey + 1 AS pos, c_mktsegment AS name, count(*) AS n FROM customer GROUP BY ALL),
two AS (SELECT c_nationkey + 1 AS pos, c_mktsegment AS name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
x AS (SELECT pos, left(arg_min(name, (-n, name)), 1) AS ch FROM one GROUP BY pos),
y AS (SELECT pos, left(arg_min(name, (-n, name)), 1) AS ch FROM two GROUP BY pos),
places AS (SELECT i, j, x.ch AS a, y.ch AS b FROM (SELECT unnest(range(0, (SELECT count(*) + 1 FROM x)))::INT AS i) CROSS JOIN (SELECT unnest(range(0, (SELECT count(*) + 1 FROM y)))::INT AS j)
  LEFT JOIN x ON x.pos = i LEFT JOIN y ON y.pos = j),
g(d, i, j, v) AS (SELECT 0, 0, 0, 0::BIGINT UNION ALL
  (SELECT d + 1, i, j, v FROM g WHERE d < (SELECT max(i + j) FROM places) UNION ALL
   SELECT t.d, t.i, t.j, t.v FROM (
     SELECT p.i + p.j AS d, p.i, p.j, min(CASE WHEN s.i = p.i THEN s.v + s.j + p.j WHEN s.j = p.j THEN s.v + s.i + p.i ELSE s.v + (p.a <> p.b)::INT END) AS v
     FROM places p JOIN g s ON s.d + 1 = p.i + p.j AND ((s.i = p.i AND s.j < p.j) OR (s.j = p.j AND s.i < p.i) OR (s.i = p.i - 1 AND s.j = p.j - 1)) GROUP BY p.i, p.j) t)),
aligned AS (SELECT i, j, v FROM g WHERE d = (SELECT max(i + j) FROM places))"""

BLOCKS = "blocks AS (SELECT a.range::INT AS bi, b.range::INT AS bj FROM range({r}) a CROSS JOIN range({r}) b)"
MD = f"WITH {BLOCKS.format(r=7)}, n AS (SELECT *, abs(bi - bj) AS d FROM blocks) SELECT bi, bj, (least(bi, bj) + d * (15 - d) // 2)::INT AS number, ((least(bi, bj) + d * (15 - d) // 2) % 64)::INT AS part FROM n"
CUS = f"WITH {BLOCKS.format(r=7)} SELECT bi, bj, (bi // 2 * 3 + bj // 2)::INT AS number, (bi // 2 * 3 + bj // 2)::INT AS part FROM blocks"
SQUARE = "WITH s AS (SELECT (range // 9)::INT AS b, count(*) AS n FROM range(50) GROUP BY 1) SELECT x.b AS bi, y.b AS bj, x.n * y.n AS cells FROM s x CROSS JOIN s y"
VALUES = """WITH c AS (SELECT a.range::INT AS i, b.range::INT AS j, (a.range * 7919 + b.range * 104729 + 30 * 1299709 + 12345) % 2147483647 AS x FROM range(40) a CROSS JOIN range(40) b),
m AS (SELECT i, j, x * 48271 % 2147483647 * 69621 % 2147483647 AS x FROM c)
SELECT 'graph' AS kind, i, j, 1 + (x % 9001) / 1000 AS v FROM m WHERE i <> j
UNION ALL SELECT 'matrix', i, j, 1 + (x % 9901) / 100 + CASE WHEN i = j THEN 4040.0::DOUBLE ELSE 0.0::DOUBLE END FROM m UNION ALL SELECT 'folding', i, j, 0.0::DOUBLE FROM m WHERE i <= j"""
SEQUENCES = """WITH c AS (SELECT range::INT AS pos, seed, (range * 7919 + seed * 1299709 + 12345) % 2147483647 AS x FROM range(1, 61) CROSS JOIN (SELECT unnest([30, 31]) AS seed))
SELECT pos, seed, substring('ABCD', ((x * 48271 % 2147483647 * 69621 % 2147483647) % 4)::INT + 1, 1) AS ch FROM c"""
PRINTED = f"""WITH {EDGES}, top AS (SELECT max(j) AS m FROM edges), a AS (SELECT DISTINCT i FROM edges),
places AS (SELECT i, unnest(range(m + 1))::INT AS j FROM a, top)
SELECT i, string_agg(coalesce(v::VARCHAR, '-'), ' ' ORDER BY j) AS line FROM places LEFT JOIN edges USING (i, j) GROUP BY i"""
STAGES = f"""WITH {BLOCKS.format(r=6)}, k AS (SELECT range::INT AS k FROM range(6)),
roles AS (SELECT 'fw' AS problem, k, CASE WHEN bi = k AND bj = k THEN 'A' WHEN bi = k THEN 'B' WHEN bj = k THEN 'C' ELSE 'D' END AS role FROM blocks, k
UNION ALL SELECT 'ge', k, CASE WHEN bi < k OR bj < k THEN 'DONE' WHEN bi = k AND bj = k THEN 'A' WHEN bi = k THEN 'B' WHEN bj = k THEN 'C' ELSE 'D' END FROM blocks, k
UNION ALL SELECT 'paf', k, CASE WHEN bj > k THEN 'DONE' WHEN bj < k THEN 'D' WHEN bi = k THEN 'A' ELSE 'B' END FROM blocks, k WHERE bi <= bj)
SELECT problem, k, role, count(*) AS blocks FROM roles GROUP BY ALL"""
FANOUT = """SELECT 'fw' AS problem, range::INT AS k, 10::BIGINT AS pivot_uses, 50::BIGINT AS cross_uses FROM range(6)
UNION ALL SELECT 'ge', range::INT, 2 * (5 - range), 2 * (5 - range) * (5 - range) FROM range(6) UNION ALL SELECT 'paf', range::INT, range, range * (range + 1) FROM range(6)"""

SQL = {
    **dict.fromkeys(("fw_apsp_auto", "fw_apsp_cells", "fw_apsp_shuffle", "fw_apsp_broadcast", "fw_apsp_tiled", "fw_apsp_md", "fw_apsp_cus", "sink_roundtrip"), FW),
    "fw_apsp_double": closed("SELECT i, j, v / 7 AS v FROM edges").replace("SELECT i, j, v FROM d5", "SELECT i, j, round(v, 6) + 0.0::DOUBLE AS v FROM d5"),
    "fw_minplus_step": MINPLUS,
    "fw_region_closure": REGION,
    **dict.fromkeys(("ge_upper_cells", "ge_upper_shuffle", "ge_upper_broadcast", "ge_upper_tiled"), UPPER),
    "ge_lower": LOWER,
    "ge_det": eliminated(MATRIX, DET),
    "ge_gram_det": eliminated(GRAM, DET),
    "ge_solve": SOLVE,
    "ge_literal_triu": LITERAL,
    **dict.fromkeys(("paf_stub_cells", "paf_stub_shuffle", "paf_stub_broadcast", "paf_stub_tiled"), f"{STUB} SELECT i, j, v FROM folded"),
    **dict.fromkeys(("paf_contact_cells", "paf_contact_shuffle", "paf_contact_broadcast", "paf_contact_tiled"), f"{REAL} SELECT i, j, v FROM folded"),
    "paf_contact_matrix": f"WITH {CHAIN}, {CONTACT} SELECT j, k, c FROM contact",
    "paf_score": f"{REAL} SELECT max(v) AS score FROM folded WHERE i = 0",
    "gap_align": f"{ALIGN} SELECT i, j, v FROM aligned",
    "gap_cost": f"{ALIGN} SELECT arg_max(v, (i, j)) AS cost FROM aligned",
    "part_ph": f"WITH {BLOCKS.format(r=7)} SELECT bi, bj, 2::BIGINT AS n, 1::BIGINT AS parts, true AS inside FROM blocks",
    "part_md": MD,
    "part_cus": CUS,
    "src_square": SQUARE,
    "src_upper": f"{SQUARE} WHERE x.b <= y.b",
    "src_values": VALUES,
    "src_sequences": SEQUENCES,
    "sink_matrix": PRINTED,
    "stage_census": STAGES,
    "fanout_census": FANOUT,
}
