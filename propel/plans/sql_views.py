"""The business views as DuckDB SQL, for the oracle side of every check.

``with_views(sql)`` prefixes a query with exactly the CTEs it references
(plus their dependencies), so each oracle string runs on the base tables the
driver registers.
"""

from __future__ import annotations

import re

VIEW_SQL: dict[str, str] = {
    "ratings": """SELECT o_custkey AS user_id, l_partkey AS movie_id, 1 + CAST(l_quantity AS INT) % 5 AS rating,
  CAST(l_shipdate AS TIMESTAMP) AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "movies": """SELECT p_partkey AS movie_id, CASE WHEN p_size = 50 THEN NULL ELSE 1970 + p_size END AS year,
  p_name AS title FROM part""",
    "transactions": """SELECT o_custkey AS customer_id, o_orderdate AS transaction_date, o_totalprice AS amount
  FROM orders""",
    "services": """SELECT o_custkey AS customer_id, l_shipdate AS last_service_date FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N'""",
    "claims": """SELECT o_custkey AS customer_id, l_shipdate AS last_claim_date FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""",
    "lost_quotations": """SELECT o_custkey AS customer_id, o_orderdate AS lost_date, o_orderstatus AS competitor,
  o_totalprice AS competitor_price FROM orders WHERE o_orderstatus = 'P'""",
    "products": """SELECT DISTINCT o_custkey AS customer_id, p_type AS product FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE l_returnflag = 'A'""",
    "customers": """SELECT c_custkey AS customer_id, c_name AS name, r_name AS region, 18 + c_custkey % 57 AS age,
  c_acctbal AS income, a.acquisition_date, p.products_owned_str, c_custkey % 7 = 0 AS renewal_in_30_days
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS acquisition_date FROM orders GROUP BY o_custkey) a
    ON c_custkey = a.o_custkey
  LEFT JOIN (SELECT customer_id, string_agg(product, ',' ORDER BY product) AS products_owned_str
    FROM products GROUP BY customer_id) p ON c_custkey = p.customer_id""",
    "predictions": """SELECT event_id AS id, user_id AS customer_id,
  (event_id * 7919 % 10007) / 10007.0E0 AS propensity_score,
  CASE WHEN event_id % 3 = 0 THEN 'v1' ELSE 'v2' END AS model_version, ts AS created_at
  FROM events WHERE event_type IN ('view', 'click')""",
    "feedback": """SELECT event_id AS id, user_id AS customer_id,
  concat('AGT-', CAST((user_id + event_id) % (SELECT count(*) FROM supplier) AS VARCHAR)) AS agent_id, event_type AS action_taken,
  CASE event_type WHEN 'purchase' THEN 'converted' WHEN 'error' THEN 'not_converted' ELSE 'pending' END AS outcome,
  ts AS created_at FROM events WHERE event_type <> 'view'""",
    "agents": """SELECT concat('AGT-', CAST(s_suppkey AS VARCHAR)) AS agent_id, s_name AS name, n_name AS region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "assignments": """SELECT concat('AGT-', CAST(c_custkey % (SELECT count(*) FROM supplier) AS VARCHAR)) AS agent_id, c_custkey AS customer_id
  FROM customer""",
    "request_log": """SELECT event_id, ts, user_id AS client, event_type AS endpoint,
  CASE WHEN event_type = 'error' THEN 500 WHEN value > 150 THEN 404 ELSE 200 END AS status,
  value / 100.0E0 AS duration_seconds, event_id % 4 = 0 AS cache_hit FROM events""",
    "scored": """SELECT d.doc_id AS id, l.quality AS label, least(d.n_chars / 2000.0E0, 1.0E0) AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
}

_DEPS = {"customers": ["products"]}


def _referenced(sql: str, extra: dict[str, str]) -> list[str]:
    names = list(VIEW_SQL) + list(extra)
    found = [n for n in names if re.search(rf"\b{n}\b", sql)]
    out: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in out:
            out.append(n)
    for n in found:
        add(n)
    return out


def with_views(sql: str, **extra: str) -> str:
    """Prefix ``sql`` (which may itself start with WITH) with the view CTEs it uses.

    ``extra`` adds named CTEs (e.g. a shared sub-result) placed after the views.
    """
    body = sql.strip()
    names = _referenced(body + " ".join(extra.values()), extra)
    ctes = [f"{n} AS ({VIEW_SQL[n]})" for n in names if n in VIEW_SQL]
    ctes += [f"{k} AS ({v})" for k, v in extra.items()]
    if not ctes:
        return body
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body
