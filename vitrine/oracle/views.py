"""The shop tables and shared intermediate results as DuckDB views, inlined into each oracle query."""

from __future__ import annotations

import re

from ..sources.fixtures import COMMON, RATING_SUBMISSION, tables_of

VIEWS: dict[str, str] = {
    name: body.format(**{t: t for t in tables_of(body)}).strip() for name, body in COMMON.items()
}
VIEWS["rating_submission"] = (
    RATING_SUBMISSION.format(events="events").replace("get_json_object", "json_extract").strip()
)
VIEWS["rating"] = """
SELECT seq + 1 AS id, user_id, product_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY ts DESC, seq DESC) AS rn
  FROM rating_submission) t WHERE rn = 1"""
VIEWS["order_items"] = """
SELECT l_orderkey + 1 AS order_id, CAST(pos AS BIGINT) AS pos, l_partkey + 1 AS product_id,
  CASE WHEN pos % 3 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS qty,
  CASE WHEN pos % 3 = 1 THEN concat('{"product_id":', CAST(l_partkey + 1 AS VARCHAR), ',"quantity":', CAST(CAST(l_quantity AS INT) AS VARCHAR), '}')
       WHEN pos % 3 = 2 THEN concat('{"id":', CAST(l_partkey + 1 AS VARCHAR), ',"qty":', CAST(CAST(l_quantity AS INT) AS VARCHAR), ',"selectedOption":"L"}')
       ELSE concat('{"product_id":', CAST(l_partkey + 1 AS VARCHAR), '}') END AS item_json
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem) t"""
# The lines as the stored JSON text gives them.
VIEWS["line"] = """
SELECT order_id, CAST(n AS BIGINT) AS pos, CAST(j ->> '$.product_id' AS BIGINT) AS product_id,
  CAST(j ->> '$.id' AS BIGINT) AS id, CAST(j ->> '$.quantity' AS BIGINT) AS quantity, CAST(j ->> '$.qty' AS BIGINT) AS qty,
  j ->> '$.selectedOption' AS selected_option, CAST(j AS VARCHAR) AS raw
FROM (SELECT order_id, unnest(json_extract(items, '$[*]')) AS j,
        unnest(range(1, CAST(json_array_length(items) AS BIGINT) + 1)) AS n
      FROM (SELECT order_id, concat('[', string_agg(item_json, ',' ORDER BY pos), ']') AS items
            FROM order_items GROUP BY order_id) d) e"""
VIEWS["placed_line"] = """
SELECT order_id, pos, CASE WHEN coalesce(product_id, 0) <> 0 THEN product_id ELSE nullif(id, 0) END AS product_id,
  CAST(CASE WHEN coalesce(quantity, 0) <> 0 THEN quantity WHEN coalesce(qty, 0) <> 0 THEN qty ELSE 1 END AS BIGINT) AS qty,
  CAST(CASE WHEN coalesce(qty, 0) <> 0 THEN qty WHEN coalesce(quantity, 0) <> 0 THEN quantity ELSE 0 END AS BIGINT) AS amended_qty,
  quantity, qty AS raw_qty, selected_option
FROM line"""
VIEWS["amended"] = """
SELECT order_id, pos, CASE WHEN pos % 4 = 0 THEN product_id + 1 ELSE product_id END AS product_id,
  greatest(coalesce(qty, 2) + 3 * pos - 5, 0) AS qty
FROM order_items"""
VIEWS["first_image"] = """
SELECT product_id, link AS primary_image FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY priority ASC NULLS LAST, id ASC) AS rn FROM images) t
WHERE rn = 1"""
VIEWS["strict_image"] = """
SELECT product_id, link AS primary_image FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY id ASC) AS rn FROM images WHERE priority = 1) t
WHERE rn = 1"""
VIEWS["rated"] = """
SELECT product_id, round(avg(value), 1) AS avg_rating, count(*) AS rating_count FROM rating GROUP BY product_id"""
VIEWS["card"] = """
SELECT p.id, p.name, p.description, CAST(p.price AS DOUBLE) AS price, CAST(p.endprice AS DOUBLE) AS endprice,
  i.primary_image, coalesce(r.avg_rating, 0) AS avg_rating, coalesce(r.rating_count, 0) AS rating_count
FROM product p LEFT JOIN first_image i ON i.product_id = p.id
LEFT JOIN (SELECT product_id, round(avg(value), 2) AS avg_rating, count(*) AS rating_count FROM rating
           GROUP BY product_id) r ON r.product_id = p.id"""
VIEWS["card_json"] = """
SELECT c.id, concat('{"id":', CAST(c.id AS VARCHAR), ',"name":', to_json(c.name), ',"description":', to_json(c.description),
  ',"price":', coalesce(CAST(p.price AS VARCHAR), 'null'), ',"endprice":', coalesce(CAST(p.endprice AS VARCHAR), 'null'),
  ',"primary_image":', coalesce(CAST(to_json(c.primary_image) AS VARCHAR), 'null'),
  ',"avg_rating":', CAST(CAST(c.avg_rating AS DOUBLE) AS VARCHAR), ',"rating_count":', CAST(c.rating_count AS VARCHAR), '}') AS body
FROM card c JOIN product p ON p.id = c.id"""
VIEWS["placed_image"] = """
SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY priority ASC NULLS LAST, id ASC) AS pos,
  id, link, priority FROM images"""
VIEWS["related"] = """
SELECT id AS product_id, CAST(n AS BIGINT) AS pos, CAST(e AS BIGINT) AS related_id
FROM (SELECT id, unnest(json_extract(related, '$[*]')) AS e,
        unnest(range(1, CAST(json_array_length(related) AS BIGINT) + 1)) AS n
      FROM product WHERE related IS NOT NULL) t"""
VIEWS["owned_order"] = """
SELECT o.id, o.user_id, o.status, strftime(o.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, o.active,
  CAST(o.delivery_cost AS DOUBLE) AS delivery_cost, o.voucher_code, u.name AS user_name, u.email AS user_email,
  u.user_name AS username, u.phone AS user_phone, u.avatar
FROM shop_orders o LEFT JOIN users u ON u.id = o.user_id"""
VIEWS["wrapped"] = """
SELECT id, type, priority, CASE WHEN map IS NULL THEN '[null]' WHEN map LIKE '[%' THEN map ELSE concat('[', map, ']') END AS doc
FROM banner"""
VIEWS["element"] = """
SELECT w.id AS banner_id, w.type, w.priority, CAST(e.n AS BIGINT) AS elem_pos, CAST(e.j AS VARCHAR) AS elem, e.j,
  CASE json_type(e.j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string'
    WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number'
    WHEN 'DOUBLE' THEN 'number' END AS kind
FROM wrapped w LEFT JOIN (
  SELECT id, unnest(json_extract(doc, '$[*]')) AS j,
    unnest(range(1, CAST(json_array_length(doc) AS BIGINT) + 1)) AS n FROM wrapped) e ON e.id = w.id"""
VIEWS["product_entry"] = """
SELECT banner_id, elem_pos, type, CAST(n AS BIGINT) AS sub_pos,
  CASE WHEN json_type(p) = 'OBJECT' THEN NULL ELSE CAST(CAST(p AS VARCHAR) AS BIGINT) END AS number,
  CASE WHEN json_type(p) = 'OBJECT' THEN CAST(p ->> '$.id' AS BIGINT) END AS oid
FROM (SELECT banner_id, elem_pos, type, unnest(json_extract(j, '$.productIds[*]')) AS p,
        unnest(range(1, CAST(json_array_length(j, '$.productIds') AS BIGINT) + 1)) AS n
      FROM element WHERE kind = 'object' AND json_type(j, '$.productIds') = 'ARRAY') t"""
VIEWS["category_entry"] = """
SELECT t.banner_id, t.elem_pos, CAST(t.n AS BIGINT) AS sub_pos, CAST(c.id AS BIGINT) AS category_id,
  c.name AS category_name, c.image AS category_image
FROM (SELECT banner_id, elem_pos, CAST(unnest(json_extract(j, '$.categoryIds[*]')) AS BIGINT) AS cid,
        unnest(range(1, CAST(json_array_length(j, '$.categoryIds') AS BIGINT) + 1)) AS n
      FROM element WHERE type = 'Category' AND kind = 'object' AND json_type(j, '$.categoryIds') = 'ARRAY') t
LEFT JOIN category c ON c.id = t.cid"""
VIEWS["held_rating"] = """
SELECT seq + 1 AS id, user_id, product_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY ts DESC, seq DESC) AS rn
  FROM rating_submission WHERE ts < TIMESTAMP '2024-01-15 00:00:00') t WHERE rn = 1"""
VIEWS["valid_status"] = """
SELECT * FROM status_request
WHERE status IN ('Created', 'Accepted', 'Preparing', 'Shipping', 'Delivered', 'Canceled')"""
VIEWS["last_status"] = """
SELECT order_id, seq, status FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, seq DESC) AS rn FROM valid_status) t WHERE rn = 1"""


def _names(text: str) -> list[str]:
    # Words of other tables' columns may look like view names, so only FROM and JOIN targets count.
    found = re.findall(r"(?:\bFROM|\bJOIN)\s+(\w+)", text)
    return [n for n in dict.fromkeys(found) if n in VIEWS]


def with_views(body: str, own: str = "", recursive: bool = False) -> str:
    """`body` preceded by the views it reads; `own` is further CTE text placed after them."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _names(text):
            if name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(own + body)
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in ordered]
    if own:
        ctes.append(own.strip())
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + "\n" if ctes else "") + body.strip()
