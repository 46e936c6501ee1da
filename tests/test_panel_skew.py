"""The panel plan on a skewed fixture (one customer owns a third of all
orders) equals a brute-force computation of the fixture formulas."""
import datetime as dt
import os
import random
import tempfile

import pandas as pd


def _fixture():
    rnd = random.Random(3)
    d = tempfile.mkdtemp(prefix="panelkit-skew-")
    parts = pd.DataFrame({"p_partkey": list(range(1, 41)), "p_name": "x", "p_brand": "b", "p_type": "t",
                          "p_size": [rnd.randint(1, 50) for _ in range(40)], "p_retailprice": 1.0})
    orders, lines = [], []
    for ok in range(1, 301):
        cust = 0 if ok % 3 == 0 else rnd.randint(1, 30)
        date = dt.datetime(1995 + rnd.randint(0, 6), rnd.randint(1, 12), 1)
        orders.append((ok, cust, "O", 1.0, date, "1"))
        for ln in range(rnd.randint(1, 7)):
            lines.append((ok, rnd.randint(1, 40), 1, ln, float(rnd.randint(1, 50)), 1.0, rnd.randint(0, 10) / 100,
                          rnd.randint(0, 8) / 100, rnd.choice("RNA"), rnd.choice("FO"), date))
    pd.DataFrame(orders, columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                  "o_orderpriority"]).to_parquet(os.path.join(d, "orders.parquet"), coerce_timestamps="us")
    li = pd.DataFrame(lines, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                      "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                                      "l_shipdate"])
    li.to_parquet(os.path.join(d, "lineitem.parquet"), coerce_timestamps="us")
    parts.to_parquet(os.path.join(d, "part.parquet"))
    return d, pd.DataFrame(orders, columns=["ok", "cust", "s", "p", "date", "pr"]), li, parts


def _half_up(num, den):
    return (2 * num + den) // (2 * den)


def test_panel_on_skewed_fixture_matches_brute_force(spark):
    from panelkit.plans.panel import build_panel
    d, o, li, parts = _fixture()
    size = dict(zip(parts.p_partkey, parts.p_size))
    exp = {}
    j = li.merge(o, left_on="l_orderkey", right_on="ok")
    for (cust, yr), g in j.groupby([j.cust, j.date.dt.year]):
        n = len(g)
        q4 = int(sum(round(x * 10000) for x in g.l_quantity))
        d4 = int(sum(round(x * 10000) for x in g.l_discount))
        t4 = int(sum(round(x * 10000) for x in g.l_tax))
        nr, nf = int((g.l_returnflag == "R").sum()), int((g.l_linestatus == "F").sum())
        s = int(sum(size[p] for p in g.l_partkey))
        parts4 = [min(10, 2 * g.l_orderkey.nunique()) * 10000, _half_up(q4, 5 * n), _half_up(100 * d4, n),
                  _half_up(125 * t4, n), _half_up(100000 * nr, n), _half_up(100000 * nf, n)]
        ipp = None if yr == 2001 else _half_up(2000 * s, n) / 10000
        exp[(cust, yr)] = tuple(v / 10000 for v in parts4) + (ipp, ((2 * sum(parts4) + 6) // 12) / 10000, n)
    got = {(r["entity_id"], r["yr"]): (r["ieg"], r["ida"], r["iaa"], r["ips"], r["ipv"], r["ian"], r["ipp"],
                                      r["inde"], r["n"]) for r in build_panel(spark, d).collect()}
    assert got == exp
    hot = [k for k in got if k[0] == 0]
    assert sum(got[k][-1] for k in hot) > len(li) / 4  # the hot customer really is hot
