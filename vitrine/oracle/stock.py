"""Orders against stock as SQL: a recursive walk over the orders in serving order, with the stock of all products as
one list by product id. Each step costs as much as that list, so this suits small data only."""

from __future__ import annotations

SERVED = """
served AS (
  SELECT r.id AS order_id, row_number() OVER (ORDER BY r.created_at ASC NULLS LAST, r.id) AS n, l.lines
  FROM order_request r LEFT JOIN (
    SELECT order_id, list({'p': product_id, 'q': qty,
        'known': product_id > 0 AND product_id <= (SELECT max(id) FROM product)} ORDER BY pos) AS lines
    FROM placed_line GROUP BY order_id) l ON l.order_id = r.id)"""

# Every line is tested alone against the stock before the order; then all lines are taken off.
PLACED = SERVED + """,
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS STRUCT(p BIGINT, q BIGINT, known BOOLEAN)) AS bad, false AS ok,
    (SELECT list(CAST(stock AS BIGINT) ORDER BY id) FROM product) AS stock, CAST(NULL AS BIGINT) AS available
  UNION ALL
  SELECT t.n, t.bad, t.ok,
    CASE WHEN t.ok THEN list_reduce(
      list_transform(t.lines, lambda l: {'p': l.p, 'q': l.q, 's': CAST([] AS BIGINT[])}),
      lambda a, l: {'p': l.p, 'q': l.q, 's': a.s[:l.p - 1] || [a.s[l.p] - l.q] || a.s[l.p + 1:]},
      {'p': CAST(0 AS BIGINT), 'q': CAST(0 AS BIGINT), 's': t.stock}).s ELSE t.stock END,
    CASE WHEN t.bad.known THEN t.stock[t.bad.p] END
  FROM (
    SELECT s.n, s.lines, w.stock, b.bad, len(s.lines) > 0 AND b.bad IS NULL AS ok
    FROM walk w JOIN served s ON s.n = w.n + 1,
    LATERAL (SELECT list_filter(s.lines, lambda l: NOT l.known OR l.q > w.stock[l.p])[1] AS bad) b) t)"""

ADMISSION = """
SELECT s.order_id, s.n - 1 AS rank, coalesce(w.ok, false) AS accepted,
  CASE WHEN w.ok THEN NULL WHEN w.bad IS NULL THEN 'no items' WHEN w.bad.known THEN 'stock' ELSE 'unknown product' END
    AS reason,
  CASE WHEN w.ok THEN NULL ELSE w.bad.p END AS product_id, w.available
FROM walk w JOIN served s ON s.n = w.n"""

PLACE = """
SELECT (SELECT max(id) FROM shop_orders) + o.k AS id, l.pos, l.product_id, l.qty, p.name,
  CAST(CASE WHEN coalesce(p.endprice, 0) <> 0 THEN p.endprice ELSE p.price END AS DOUBLE) AS price,
  i.primary_image AS image, o.stock[l.product_id] AS remaining_stock
FROM (SELECT s.order_id, w.stock, row_number() OVER (ORDER BY s.n) AS k
      FROM walk w JOIN served s ON s.n = w.n WHERE w.ok) o
JOIN placed_line l ON l.order_id = o.order_id JOIN product p ON p.id = l.product_id
LEFT JOIN first_image i ON i.product_id = l.product_id"""

# Line by line: each asks for its increase over the order's last old line of the product; one failure undoes all.
AMENDED = """
last_line AS (
  SELECT order_id, product_id, amended_qty FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id, product_id ORDER BY pos DESC) AS rn FROM placed_line) t
  WHERE rn = 1),
served AS (
  SELECT r.id AS order_id, row_number() OVER (ORDER BY r.created_at ASC NULLS LAST, r.id) AS n, l.lines
  FROM order_request r LEFT JOIN (
    SELECT a.order_id, list({'p': a.product_id, 'd': a.qty - coalesce(o.amended_qty, 0), 'fail': false,
        's': CAST([] AS BIGINT[])} ORDER BY a.pos) AS lines
    FROM amended a JOIN product p ON p.id = a.product_id
    LEFT JOIN last_line o ON o.order_id = a.order_id AND o.product_id = a.product_id
    GROUP BY a.order_id) l ON l.order_id = r.id),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, false AS fail, CAST(NULL AS BIGINT) AS p, CAST(NULL AS BIGINT) AS available,
    (SELECT list(CAST(stock AS BIGINT) ORDER BY id) FROM product) AS stock
  UNION ALL
  SELECT t.n, coalesce(t.after.fail, false), CASE WHEN t.after.fail THEN t.after.p END,
    CASE WHEN t.after.fail THEN t.after.s[t.after.p] END,
    CASE WHEN t.after.fail OR t.after IS NULL THEN t.stock ELSE t.after.s END
  FROM (
    SELECT s.n, w.stock, list_reduce(s.lines,
      lambda a, l: CASE WHEN a.fail THEN a WHEN l.d > a.s[l.p] THEN {'p': l.p, 'd': l.d, 'fail': true, 's': a.s}
        ELSE {'p': l.p, 'd': l.d, 'fail': false, 's': a.s[:l.p - 1] || [a.s[l.p] - l.d] || a.s[l.p + 1:]} END,
      {'p': CAST(0 AS BIGINT), 'd': CAST(0 AS BIGINT), 'fail': false, 's': w.stock}) AS after
    FROM walk w JOIN served s ON s.n = w.n + 1) t)"""

AMEND = """
SELECT s.order_id, s.n - 1 AS rank, NOT w.fail AS accepted, CASE WHEN w.fail THEN 'stock' END AS reason,
  w.p AS product_id, w.available
FROM walk w JOIN served s ON s.n = w.n"""


# The tables after a batch: orders, lines, stock and refusals as rows of one shape.
_COLUMNS = {
    "part": "VARCHAR", "id": "BIGINT", "user_id": "BIGINT", "status": "VARCHAR", "created_at": "VARCHAR",
    "active": "BOOLEAN", "delivery_cost": "DOUBLE", "voucher_code": "VARCHAR", "voucher_id": "BIGINT", "pos": "BIGINT",
    "product_id": "BIGINT", "line_id": "BIGINT", "quantity": "BIGINT", "qty": "BIGINT", "selected_option": "VARCHAR",
    "stock": "INTEGER", "reason": "VARCHAR", "available": "BIGINT",
}


def _part(source: str, **given: str) -> str:
    shown = [f"CAST({given.get(c, 'NULL')} AS {kind}) AS {c}" for c, kind in _COLUMNS.items()]
    return f"SELECT {', '.join(shown)}\n{source}"


_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_ORDER = {c: f"o.{c}" for c in ("id", "user_id", "status", "active", "delivery_cost", "voucher_code")}
_ORDER |= {"part": "'order'", "created_at": _TIME.format("o.created_at")}
_LINE = {c: f"l.{c}" for c in ("pos", "product_id", "quantity", "qty", "selected_option")}
_LINE |= {"part": "'line'", "id": "l.order_id", "line_id": "l.id"}
_REST = [
    _part("FROM (SELECT arg_max(stock, n) AS stock FROM verdict) v, product p",
          part="'product'", id="p.id", stock="v.stock[p.id]"),
    _part("FROM verdict v WHERE NOT v.accepted", part="'refused'", id="v.order_id",
          **{c: f"v.{c}" for c in ("reason", "product_id", "available")}),
]

PLACED_STATE = PLACED + f""",
verdict AS MATERIALIZED (
  SELECT a.*, w.n, w.stock, sum(CASE WHEN a.accepted THEN 1 ELSE 0 END) OVER (ORDER BY w.n) AS k
  FROM ({ADMISSION}) a JOIN walk w ON w.n = a.rank + 1)"""
PLACE_AFTER = "\nUNION ALL\n".join([
    _part("FROM shop_orders o", **_ORDER),
    _part("FROM order_request r JOIN verdict v ON v.order_id = r.id WHERE v.accepted",
          part="'order'", id="(SELECT max(id) FROM shop_orders) + v.k", user_id="r.user_id",
          status="CASE WHEN r.status IS NULL OR r.status = '' THEN 'Created' ELSE r.status END",
          created_at=_TIME.format("coalesce(r.created_at, TIMESTAMP '1998-01-01 00:00:00')"),
          active="coalesce(r.active, true)", delivery_cost="coalesce(r.delivery_cost, 0)",
          voucher_id="CASE WHEN r.voucher_id <> 0 THEN r.voucher_id END"),
    _part("FROM line l", **_LINE),
    _part("FROM line l JOIN verdict v ON v.order_id = l.order_id WHERE v.accepted",
          **_LINE | {"id": "(SELECT max(id) FROM shop_orders) + v.k"}),
    *_REST,
])

AMENDED_STATE = AMENDED + f""",
verdict AS MATERIALIZED (
  SELECT a.*, w.n, w.stock FROM ({AMEND}) a JOIN walk w ON w.n = a.rank + 1)"""
AMEND_AFTER = "\nUNION ALL\n".join([
    _part("FROM shop_orders o JOIN verdict v ON v.order_id = o.id WHERE NOT v.accepted", **_ORDER),
    _part("FROM shop_orders o JOIN verdict v ON v.order_id = o.id JOIN order_request r ON r.id = o.id WHERE v.accepted",
          **_ORDER | {c: f"r.{c}" for c in ("user_id", "status", "active", "delivery_cost", "voucher_id")}),
    _part("FROM line l JOIN verdict v ON v.order_id = l.order_id WHERE NOT v.accepted", **_LINE),
    _part("FROM amended l JOIN verdict v ON v.order_id = l.order_id WHERE v.accepted",
          part="'line'", id="l.order_id", pos="l.pos", product_id="l.product_id", qty="l.qty"),
    *_REST,
])
