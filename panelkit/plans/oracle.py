"""DuckDB SQL for the stand-in panel, used as the independent oracle.

The SQL deliberately takes a different route than the Spark plan (a direct
three-way join, ``count(DISTINCT ...)``, decimal sums) so that agreement is
a real check rather than the same code twice.
"""

PANEL_SQL = """
panel AS (
  SELECT entity_id, yr, n, n_orders,
         ieg4 / 10000.0 AS ieg, ida4 / 10000.0 AS ida, iaa4 / 10000.0 AS iaa, ips4 / 10000.0 AS ips,
         ipv4 / 10000.0 AS ipv, ian4 / 10000.0 AS ian, ipp4 / 10000.0 AS ipp,
         ((2 * (ieg4 + ida4 + iaa4 + ips4 + ipv4 + ian4) + 6) // 12) / 10000.0 AS inde
  FROM (
    SELECT entity_id, yr, n, n_orders,
           CAST(least(10, 2 * n_orders) * 10000 AS BIGINT) AS ieg4,
           (2 * q4 + 5 * n) // (10 * n) AS ida4,
           (2 * 100 * d4 + n) // (2 * n) AS iaa4,
           (2 * 125 * t4 + n) // (2 * n) AS ips4,
           (2 * 100000 * n_r + n) // (2 * n) AS ipv4,
           (2 * 100000 * n_f + n) // (2 * n) AS ian4,
           CASE WHEN yr <> 2001 THEN (2 * 2000 * s_size + n) // (2 * n) END AS ipp4
    FROM (
      SELECT o.o_custkey AS entity_id, CAST(year(o.o_orderdate) AS INTEGER) AS yr,
             CAST(count(*) AS BIGINT) AS n,
             CAST(count(DISTINCT o.o_orderkey) AS BIGINT) AS n_orders,
             CAST(sum(CAST(l.l_quantity AS DECIMAL(18,4))) * 10000 AS BIGINT) AS q4,
             CAST(sum(CAST(l.l_discount AS DECIMAL(18,4))) * 10000 AS BIGINT) AS d4,
             CAST(sum(CAST(l.l_tax AS DECIMAL(18,4))) * 10000 AS BIGINT) AS t4,
             CAST(sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_r,
             CAST(sum(CASE WHEN l.l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_f,
             CAST(sum(p.p_size) AS BIGINT) AS s_size
      FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
                    JOIN part p ON l.l_partkey = p.p_partkey
      GROUP BY 1, 2) a) b
)"""

PANEL_X_SQL = PANEL_SQL + """,
panel_x AS (
  SELECT p.*, c.c_mktsegment AS segment, nt.n_name AS institution,
         CASE WHEN p.inde IS NULL THEN 'Sem classificação' WHEN p.inde < 4.2 THEN 'Quartzo'
              WHEN p.inde < 5.0 THEN 'Ágata' WHEN p.inde < 5.8 THEN 'Ametista'
              ELSE 'Topázio' END AS tier,
         CASE WHEN p.entity_id % 2 = 0 THEN 'Menina' ELSE 'Menino' END AS gender,
         CASE WHEN p.ipv = 0 THEN NULL WHEN p.ipv >= 5 THEN 'Sim' ELSE 'Não' END AS pv,
         p.entity_id % 7 - 3 AS lag,
         p.yr - min(p.yr) OVER (PARTITION BY p.entity_id) AS tenure,
         nullif(p.ipv, 0.0) AS ipv_n,
         CAST(p.entity_id % 8 AS INTEGER) AS phase,
         CAST(p.entity_id % 8 AS VARCHAR) || 'H' AS phase_code,
         CASE WHEN p.inde IS NULL THEN NULL WHEN p.inde < 4.2 THEN 1 WHEN p.inde < 5.0 THEN 2
              WHEN p.inde < 5.8 THEN 3 ELSE 4 END AS tier_ord
  FROM panel p LEFT JOIN customer c ON c.c_custkey = p.entity_id
               LEFT JOIN nation nt ON nt.n_nationkey = c.c_nationkey
)"""


def with_panel(body: str, enriched: bool = True) -> str:
    """Prefix a query body with the panel CTEs; a body that opens with its
    own ``WITH`` has its CTEs appended to the panel ones."""
    b = body.lstrip()
    if b[:5].upper() == "WITH ":
        b = ",\n" + b[5:]
    else:
        b = "\n" + b
    return "WITH " + (PANEL_X_SQL if enriched else PANEL_SQL) + b
