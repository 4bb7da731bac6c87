"""DuckDB SQL with the same result as each registered query, over the driver's tables."""

from __future__ import annotations

from . import stock
from .views import with_views

ORACLES: dict[str, str] = {}


def oracle(name: str, body: str, own: str = "", recursive: bool = False) -> None:
    ORACLES[name] = with_views(body, own, recursive)


PRODUCT = """p.id, p.name, p.category_id, p.description, p.active, CAST(p.price AS DOUBLE) AS price,
  CAST(p.endprice AS DOUBLE) AS endprice, p.stock, p.related"""
USER = "id, name, user_name, phone, email, avatar, active"
AS_OF = "TIMESTAMP '1998-01-01 00:00:00'"

# Scans, sources, sinks
oracle("table_scan", f"""
SELECT 'product' AS part, p.id, p.name, p.category_id::BIGINT AS category_id, p.description, p.active,
  CAST(p.price AS DOUBLE) AS price, CAST(p.endprice AS DOUBLE) AS endprice, p.stock::BIGINT AS stock, p.related FROM product p
UNION ALL BY NAME
SELECT 'category' AS part, id::BIGINT AS id, name, priority::BIGINT AS priority, active, image FROM category
UNION ALL BY NAME SELECT 'images' AS part, id, product_id, link, priority FROM images
UNION ALL BY NAME SELECT 'rating' AS part, id, user_id, product_id, value::BIGINT AS value FROM rating
UNION ALL BY NAME
SELECT 'voucher' AS part, id, code, type, value::BIGINT AS value, min_value::BIGINT AS min_value, max_value::BIGINT AS max_value,
  active, strftime(expire_date, '%Y-%m-%d %H:%M:%S') AS expire_date FROM voucher
UNION ALL BY NAME SELECT 'users' AS part, {USER} FROM users""")
oracle("users_public", f"SELECT {USER} FROM users")
oracle("sink_rows", f"SELECT {USER} FROM users")
oracle("items_decode", "SELECT order_id, pos, product_id, id, quantity, qty, selected_option, raw FROM line")
oracle("map_decode", "SELECT banner_id, elem_pos, kind, elem FROM element")
oracle("related_decode", "SELECT product_id, pos, related_id FROM related")
oracle("json_encode", """
SELECT 'order' AS part, id, CAST(to_json({'id': id, 'user_id': user_id, 'status': status, 'active': active,
  'voucher_code': voucher_code}) AS VARCHAR) AS body FROM shop_orders
UNION ALL
SELECT 'items', order_id, CAST(to_json(list({'product_id': product_id, 'quantity': quantity, 'selectedOption': selected_option}
  ORDER BY pos)) AS VARCHAR) FROM line GROUP BY order_id
UNION ALL
SELECT 'related', id, CAST(to_json(CAST(CAST(related AS JSON) AS BIGINT[])) AS VARCHAR) FROM product
UNION ALL
SELECT 'map', id, map FROM banner""")

# Filters and predicates
oracle("lookup_by_key", f"SELECT {PRODUCT} FROM product p WHERE p.id IN (SELECT l_orderkey + 1 FROM lineitem)")
oracle("lookup_missing", """
SELECT DISTINCT l_orderkey + 1 AS id FROM lineitem WHERE l_orderkey + 1 NOT IN (SELECT id FROM product)""")
oracle("admin_active", f"SELECT {USER} FROM users WHERE active")
oracle("catalog_filter", f"SELECT {PRODUCT} FROM product p WHERE p.active AND p.name ILIKE '%r%g%'")
oracle("user_rating", """
SELECT b.user_id, b.product_id, r.id AS rating_id, r.value
FROM (SELECT DISTINCT o_custkey + 1 AS user_id, l_partkey + 1 AS product_id
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) b
LEFT JOIN rating r ON r.user_id = b.user_id AND r.product_id = b.product_id""")
oracle("product_images", "SELECT product_id, pos, id, link, priority FROM placed_image")
oracle("product_links", """
SELECT p.id AS product_id, i.pos, i.link FROM product p LEFT JOIN placed_image i ON i.product_id = p.id""")
oracle("voucher_by_code", f"""
SELECT code, id, type, value, min_value, max_value, active, strftime(expire_date, '%Y-%m-%d %H:%M:%S') AS expire_date
FROM voucher WHERE active AND expire_date > {AS_OF} AND code IN (SELECT voucher_code FROM shop_orders)""")
oracle("voucher_valid_for_orders", f"""
SELECT o.id, o.voucher_code, v.id AS voucher_id, CASE WHEN v.id IS NULL THEN 'unknown'
  WHEN v.active IS NOT TRUE THEN 'inactive' WHEN v.expire_date > {AS_OF} THEN 'valid' ELSE 'expired' END AS voucher_state
FROM shop_orders o LEFT JOIN voucher v ON v.code = o.voucher_code""")
oracle("order_normalise", f"""
SELECT id, user_id, CASE WHEN status IS NULL OR status = '' THEN 'Created' ELSE status END AS status,
  strftime(coalesce(created_at, {AS_OF}), '%Y-%m-%d %H:%M:%S') AS created_at, coalesce(active, true) AS active,
  CAST(coalesce(delivery_cost, 0) AS DOUBLE) AS delivery_cost,
  CASE WHEN voucher_id <> 0 THEN voucher_id END AS voucher_id
FROM order_request""")
oracle("item_normalise", """
SELECT order_id, pos, product_id, qty AS placed_qty, amended_qty FROM placed_line""")
oracle("effective_price", """
SELECT id, CAST(CASE WHEN coalesce(endprice, 0) <> 0 THEN endprice ELSE coalesce(price, 0) END AS DOUBLE)
  AS effective_price FROM product""")
oracle("validate_status", """
SELECT seq, order_id, status, CASE WHEN status NOT IN ('Created', 'Accepted', 'Preparing', 'Shipping', 'Delivered', 'Canceled')
  THEN 'status_unknown'
  END AS reject_reason FROM status_request""")
oracle("validate_voucher", """
SELECT id, code, type, CASE WHEN type IS NULL OR type NOT IN ('num', 'per') THEN 'type must be num or per' END AS create_reason,
  CASE WHEN type NOT IN ('num', 'per') THEN 'type must be num or per' END AS update_reason FROM voucher_request""")
oracle("validate_items", """
SELECT id, CASE WHEN id NOT IN (SELECT l_orderkey + 1 FROM lineitem) THEN 'items_missing' END AS reject_reason
FROM shop_orders""")
oracle("validate_image", """
SELECT seq, product_id, link, CASE WHEN link IS NULL THEN 'link is required' END AS reject_reason FROM image_request""")
oracle(
    "validate_unique",
    """
SELECT r.seq, r.name, r.username, r.email,
  CASE WHEN NOT w.ok THEN 'username or email already exists' END AS reject_reason
FROM account_request r JOIN walk w ON w.seq = r.seq""",
    own="""
walk AS (
  SELECT CAST(-1 AS BIGINT) AS seq, true AS ok, (SELECT list(username) FROM account) AS names,
    (SELECT list(email) FROM account) AS mails
  UNION ALL
  SELECT r.seq, NOT list_contains(w.names, r.username) AND NOT list_contains(w.mails, r.email),
    CASE WHEN list_contains(w.names, r.username) OR list_contains(w.mails, r.email) THEN w.names
      ELSE list_append(w.names, r.username) END,
    CASE WHEN list_contains(w.names, r.username) OR list_contains(w.mails, r.email) THEN w.mails
      ELSE list_append(w.mails, r.email) END
  FROM walk w JOIN account_request r ON r.seq = w.seq + 1)""",
    recursive=True,
)
oracle("order_user_columns", """
SELECT id AS user_id, name AS user_name, email AS user_email, user_name AS username, phone AS user_phone FROM users""")

# Joins
oracle("orders_with_user", "SELECT * EXCLUDE (avatar) FROM owned_order")
oracle("orders_of_user", "SELECT * FROM owned_order WHERE user_id IN (SELECT id FROM users WHERE active)")
oracle("primary_image", """
SELECT p.id, i.primary_image FROM product p LEFT JOIN first_image i ON i.product_id = p.id""")
oracle("strict_primary_image", """
SELECT p.id, i.primary_image FROM product p LEFT JOIN strict_image i ON i.product_id = p.id""")
oracle("product_rating", """
SELECT p.id, r.avg_rating, coalesce(r.rating_count, 0) AS rating_count
FROM product p LEFT JOIN rated r ON r.product_id = p.id""")
oracle("product_rating_banner", "SELECT id, avg_rating, rating_count FROM card")
oracle("any_array_semi", "SELECT id, name FROM product WHERE id IN (SELECT related_id FROM related)")
oracle("unnest_join", """
SELECT r.product_id, r.pos, r.related_id, p.name FROM related r JOIN product p ON p.id = r.related_id""")
oracle("unnest_left_category", """
SELECT banner_id, elem_pos, sub_pos, category_id, category_name AS name, category_image AS image FROM category_entry""")
MERGED = """SELECT l.order_id, l.pos, l.product_id AS id, p.name, CAST(p.price AS DOUBLE) AS price, p.stock,
  CAST(NULL AS VARCHAR) AS primary_image, l.quantity, l.raw_qty AS qty, l.selected_option
FROM placed_line l LEFT JOIN product p ON p.id = l.product_id"""
oracle("items_merge_product", MERGED)
DETAIL = """SELECT l.order_id, l.pos, l.product_id, l.qty, p.id IS NOT NULL AS known, p.name,
  CAST(CASE WHEN coalesce(p.endprice, 0) <> 0 THEN p.endprice ELSE p.price END AS DOUBLE) AS price,
  i.primary_image AS image, p.stock AS remaining_stock
FROM placed_line l LEFT JOIN product p ON p.id = l.product_id LEFT JOIN first_image i ON i.product_id = p.id"""
oracle("order_item_detail", DETAIL)

# Aggregations
oracle("table_count", """
SELECT 'product' AS table_name, count(*) AS n FROM product
UNION ALL SELECT 'shop_orders', count(*) FROM shop_orders
UNION ALL SELECT 'users', count(*) FROM users""")
oracle("rating_summary", """
SELECT product_id, round(avg(value), 1) AS avg_rating, count(DISTINCT user_id) AS rating_count
FROM rating_submission GROUP BY product_id""")
oracle("images_agg", """
SELECT p.id, coalesce(n.n, 0) AS n_images, i.pos AS image_pos, i.id AS image_id, i.link AS image_link,
  i.priority AS image_priority
FROM product p LEFT JOIN placed_image i ON i.product_id = p.id
LEFT JOIN (SELECT product_id, count(*) AS n FROM images GROUP BY product_id) n ON n.product_id = p.id""")
oracle("max_priority", "SELECT product_id, max(priority) AS max_priority FROM images GROUP BY product_id")
oracle("distinct_item_products", "SELECT DISTINCT order_id, product_id FROM placed_line WHERE product_id IS NOT NULL")
oracle("items_qty_last", """
SELECT order_id, product_id, amended_qty AS qty FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id, product_id ORDER BY pos DESC) AS rn FROM placed_line) t
WHERE rn = 1""")

# First and last rows of groups
oracle("items_dedupe", f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id, id, coalesce(selected_option, '') ORDER BY pos) AS rn
  FROM ({MERGED}) m) t WHERE rn = 1""")
ADDED = """
SELECT a.seq, a.product_id, a.link, CASE WHEN s.has_primary THEN s.top + a.k WHEN a.k = 1 THEN 1
  ELSE greatest(coalesce(s.top, 1), 1) + a.k - 1 END AS priority
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seq) AS k FROM image_request {where}) a
LEFT JOIN (SELECT product_id, max(priority) AS top, bool_or(priority = 1) AS has_primary FROM images GROUP BY product_id) s
  ON s.product_id = a.product_id"""
oracle("image_next_priority", ADDED.format(where=""))
oracle("rating_latest", """
SELECT user_id, product_id, seq, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY ts DESC, seq DESC) AS rn
  FROM rating_submission) t WHERE rn = 1""")
oracle("status_latest", "SELECT order_id, seq, status FROM last_status")

# Sorts and pages
HEAD = """o.id, o.user_id, o.status, strftime(o.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, o.active,
  CAST(o.delivery_cost AS DOUBLE) AS delivery_cost, o.voucher_code"""


def paged(page: int, limit: int, table: str) -> str:
    return f"""CAST({page} AS BIGINT) AS page, CAST({limit} AS BIGINT) AS "limit", (SELECT count(*) FROM {table}) AS total,
  (SELECT CAST(ceil(count(*) / {limit}.0) AS BIGINT) FROM {table}) AS total_pages"""


oracle("paginate", f"""
SELECT {HEAD}, {paged(3, 25, 'shop_orders')} FROM shop_orders o ORDER BY o.id DESC LIMIT 25 OFFSET 50""")
oracle("page_index", """
SELECT id, (rn - 1) // 10 + 1 AS page, (rn - 1) % 10 + 1 AS place
FROM (SELECT id, row_number() OVER (ORDER BY id DESC) AS rn FROM shop_orders) t""")
oracle("sort_products_desc", "SELECT id, name FROM product ORDER BY id DESC")
oracle("sort_banners", "SELECT id, priority, type FROM banner ORDER BY priority ASC NULLS LAST, id")

# Whole views
RATED = """r.avg_rating, coalesce(r.rating_count, 0) AS rating_count"""
oracle("catalog_with_primary_image", f"""
SELECT {PRODUCT}, i.primary_image, {RATED}
FROM product p LEFT JOIN first_image i ON i.product_id = p.id LEFT JOIN rated r ON r.product_id = p.id
ORDER BY p.id DESC""")
FULL = f"""
SELECT {PRODUCT}, {RATED}, i.pos AS image_pos, i.id AS image_id, i.link AS image_link, i.priority AS image_priority
FROM product p LEFT JOIN rated r ON r.product_id = p.id LEFT JOIN placed_image i ON i.product_id = p.id
WHERE p.active"""
oracle("catalog_full", FULL)
oracle("product_detail", FULL + " AND p.id IN (SELECT l_orderkey + 1 FROM lineitem)")
oracle("catalog_admin", f"""
SELECT {PRODUCT}, i.primary_image FROM product p LEFT JOIN strict_image i ON i.product_id = p.id ORDER BY p.id""")
oracle("catalog_admin_page", f"""
SELECT {PRODUCT}, {paged(2, 20, 'product')}, i.primary_image
FROM product p LEFT JOIN strict_image i ON i.product_id = p.id ORDER BY p.id LIMIT 20 OFFSET 20""")
oracle("related_products", f"""
SELECT s.product_id AS source_id, {PRODUCT}, i.primary_image, {RATED}
FROM (SELECT DISTINCT product_id, related_id FROM related) s JOIN product p ON p.id = s.related_id
LEFT JOIN first_image i ON i.product_id = p.id LEFT JOIN rated r ON r.product_id = p.id""")
oracle("orders_page", f"""
SELECT o.* EXCLUDE (avatar), {paged(1, 10, 'shop_orders')} FROM owned_order o ORDER BY o.id DESC LIMIT 10""")
oracle("order_products", f"""
SELECT o.id AS order_id, p.id AS product_id, {PRODUCT.replace('p.id, ', '', 1)}, o.user_id, u.name AS user_name
FROM shop_orders o LEFT JOIN users u ON u.id = o.user_id
LEFT JOIN (SELECT DISTINCT l.order_id, l.product_id FROM placed_line l JOIN product q ON q.id = l.product_id) d
  ON d.order_id = o.id
LEFT JOIN product p ON p.id = d.product_id""")
oracle("order_details", f"""
SELECT d.*, CASE WHEN o.status IS NULL OR o.status = '' THEN 'Created' ELSE o.status END AS status,
  CAST(coalesce(o.delivery_cost, 0) AS DOUBLE) AS delivery_cost
FROM ({DETAIL}) d JOIN order_request o ON o.id = d.order_id""")

# Banners: one SELECT per kind of row of each listing
_NO_CATEGORY = """CAST(NULL AS BIGINT) AS category_id, CAST(NULL AS VARCHAR) AS category_name,
  CAST(NULL AS VARCHAR) AS category_image"""
_CARD = "c.id AS product_id, c.name, c.description, c.price, c.endprice, c.primary_image, c.avg_rating, c.rating_count"
_NO_CARD = """CAST(NULL AS BIGINT) AS product_id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS description,
  CAST(NULL AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS endprice, CAST(NULL AS VARCHAR) AS primary_image,
  CAST(NULL AS DOUBLE) AS avg_rating, CAST(NULL AS BIGINT) AS rating_count"""
_HEAD = "e.banner_id, e.type, e.priority, coalesce(e.elem_pos, 1) AS slot, e.kind"
_NONE = "CAST(NULL AS VARCHAR)"


def _as_is(where: str) -> str:
    return f"""SELECT {_HEAD}, 'element' AS form, {_NONE} AS end_date, e.elem, CAST(NULL AS BIGINT) AS elem_pos,
  CAST(NULL AS BIGINT) AS sub_pos, {_NO_CARD}, {_NO_CATEGORY} FROM element e WHERE {where}"""


_LIST_NUMBER = f"""SELECT {_HEAD}, 'product' AS form, {_NONE} AS end_date, {_NONE} AS elem,
  CASE WHEN c.id IS NOT NULL THEN e.elem_pos END AS elem_pos,
  CASE WHEN c.id IS NOT NULL THEN CAST(1 AS BIGINT) END AS sub_pos, {_CARD}, {_NO_CATEGORY}
FROM element e LEFT JOIN card c ON c.id = CASE WHEN e.kind = 'number' THEN CAST(e.elem AS BIGINT) END
WHERE e.type = 'List' AND e.kind = 'number'"""
_CATEGORY_NUMBER = f"""SELECT {_HEAD}, 'category' AS form, {_NONE} AS end_date, {_NONE} AS elem,
  CASE WHEN k.id IS NOT NULL THEN e.elem_pos END AS elem_pos,
  CASE WHEN k.id IS NOT NULL THEN CAST(1 AS BIGINT) END AS sub_pos, {_NO_CARD},
  CAST(k.id AS BIGINT) AS category_id, k.name AS category_name, k.image AS category_image
FROM element e LEFT JOIN category k ON k.id = CASE WHEN e.kind = 'number' THEN CAST(e.elem AS BIGINT) END
WHERE e.type = 'Category' AND e.kind = 'number'"""
_CATEGORY_LISTS = f"""SELECT b.id AS banner_id, b.type, b.priority, CAST(0 AS BIGINT) AS slot, {_NONE} AS kind,
  'categories' AS form, {_NONE} AS end_date, {_NONE} AS elem, x.elem_pos, x.sub_pos, {_NO_CARD},
  x.category_id, x.category_name, x.category_image
FROM banner b LEFT JOIN category_entry x ON x.banner_id = b.id WHERE b.type = 'Category'"""


def _objects(where: str, end_date: str, ref: str) -> str:
    return f"""SELECT {_HEAD}, 'products' AS form, {end_date} AS end_date, {_NONE} AS elem, x.elem_pos, x.sub_pos,
  x.product_id, x.name, x.description, x.price, x.endprice, x.primary_image, x.avg_rating, x.rating_count, {_NO_CATEGORY}
FROM element e LEFT JOIN (
  SELECT y.banner_id, y.elem_pos, y.sub_pos, {_CARD} FROM product_entry y JOIN card c ON c.id = {ref}) x
  ON x.banner_id = e.banner_id AND x.elem_pos = e.elem_pos
WHERE {where}"""


_DATED = "CASE WHEN e.kind = 'object' THEN e.j ->> '$.endDate' END"
_TIMER_OBJECT = "e.type = 'Timer' AND e.kind = 'object'"
_LIST_OBJECT = "e.type = 'List' AND e.kind = 'object'"
_MEMBERS = f"""SELECT {_HEAD}, 'products' AS form, {_DATED} AS end_date, {_NONE} AS elem, x.elem_pos, x.sub_pos,
  x.product_id, x.name, x.description, x.price, x.endprice, x.primary_image, x.avg_rating, x.rating_count, {_NO_CATEGORY}
FROM element e LEFT JOIN (
  SELECT y.banner_id, y.elem_pos, c.id AS sub_pos, {_CARD}
  FROM (SELECT DISTINCT banner_id, elem_pos, number FROM product_entry) y JOIN card c ON c.id = y.number) x
  ON x.banner_id = e.banner_id AND x.elem_pos = e.elem_pos
WHERE e.type = 'Timer' AND e.kind IS NOT NULL"""
_TIMER_EMPTY = _as_is("e.type = 'Timer' AND e.kind IS NULL").replace("'element' AS form", "'none' AS form")


def union(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


oracle("banners_admin", union(
    _CATEGORY_LISTS, _LIST_NUMBER, _objects(_TIMER_OBJECT, _DATED, "y.number"),
    _as_is("""e.type <> 'Category' AND NOT (e.type = 'List' AND coalesce(e.kind, '') = 'number')
  AND NOT (e.type = 'Timer' AND coalesce(e.kind, '') = 'object')"""),
))
oracle("banners_admin_products", union(
    _MEMBERS, _TIMER_EMPTY, _LIST_NUMBER, _CATEGORY_NUMBER,
    _as_is("e.type <> 'Timer' AND NOT (e.type IN ('List', 'Category') AND coalesce(e.kind, '') = 'number')"),
))
oracle("banners_client", union(
    _LIST_NUMBER, _CATEGORY_NUMBER,
    _as_is("NOT (e.type IN ('List', 'Category') AND coalesce(e.kind, '') = 'number')"),
))
oracle("banners_client_products", union(
    _CATEGORY_LISTS, _objects(_TIMER_OBJECT, _DATED, "y.number"),
    _objects(_LIST_OBJECT, _NONE, "coalesce(y.oid, y.number)"),
    _as_is("e.type <> 'Category' AND NOT (e.type IN ('List', 'Timer') AND coalesce(e.kind, '') = 'object')"),
))
oracle("banner_client_by_id", "SELECT * FROM (" + union(
    _CATEGORY_LISTS, _objects(f"({_TIMER_OBJECT}) OR ({_LIST_OBJECT})", _NONE, "coalesce(y.oid, y.number)"),
    _as_is("e.type <> 'Category' AND NOT (e.type IN ('List', 'Timer') AND coalesce(e.kind, '') = 'object')"),
) + ") t WHERE banner_id IN (SELECT id FROM users)")

# The documents of the first listing
oracle("banner_regroup", """
SELECT b.id AS banner_id, b.type, b.priority, CASE WHEN b.type = 'Category' THEN c.map ELSE e.map END AS map
FROM banner b
LEFT JOIN (
  SELECT banner_id, concat('[', string_agg(concat('{"id":', coalesce(CAST(category_id AS VARCHAR), 'null'),
    ',"name":', coalesce(CAST(to_json(category_name) AS VARCHAR), 'null'),
    ',"image":', coalesce(CAST(to_json(category_image) AS VARCHAR), 'null'), '}'), ',' ORDER BY elem_pos, sub_pos), ']') AS map
  FROM category_entry GROUP BY banner_id) c ON c.banner_id = b.id
LEFT JOIN (
  SELECT x.banner_id, concat('[', string_agg(CASE
      WHEN x.type = 'List' AND x.kind = 'number' THEN CASE WHEN k.id IS NULL THEN 'null' ELSE concat('[', k.body, ']') END
      WHEN x.type = 'Timer' AND x.kind = 'object' THEN concat('{"endDate":',
        coalesce(CAST(to_json(x.j ->> '$.endDate') AS VARCHAR), 'null'), ',"products":', coalesce(t.products, 'null'), '}')
      ELSE coalesce(x.elem, 'null') END, ',' ORDER BY x.elem_pos), ']') AS map
  FROM element x
  LEFT JOIN card_json k ON k.id = CASE WHEN x.kind = 'number' THEN CAST(x.elem AS BIGINT) END
  LEFT JOIN (
    SELECT y.banner_id, y.elem_pos, concat('[', string_agg(d.body, ',' ORDER BY y.sub_pos), ']') AS products
    FROM product_entry y JOIN card_json d ON d.id = y.number GROUP BY y.banner_id, y.elem_pos) t
    ON t.banner_id = x.banner_id AND t.elem_pos = x.elem_pos
  GROUP BY x.banner_id) e ON e.banner_id = b.id""")

# Change batches
oracle("apply_insert", """
SELECT id, user_id, product_id, value FROM rating
UNION ALL
SELECT (SELECT max(id) FROM rating) + row_number() OVER (ORDER BY ts, seq), user_id, product_id, value
FROM rating_submission""")
oracle("apply_update", """
SELECT p.id, p.name, CAST(CASE WHEN u.id IS NULL THEN p.price ELSE u.price END AS DOUBLE) AS price,
  CAST(CASE WHEN u.id IS NULL THEN p.endprice END AS DOUBLE) AS endprice,
  CASE WHEN u.id IS NULL THEN p.stock ELSE u.stock END AS stock, 'kept' AS outcome
FROM product p LEFT JOIN product_update u ON u.id = p.id
UNION ALL
SELECT id, NULL, NULL, NULL, NULL, 'unknown' FROM product_update WHERE id NOT IN (SELECT id FROM product)""")
oracle("apply_delete", """
SELECT id, 'kept' AS outcome, NULL AS user_name, NULL AS username FROM shop_orders
WHERE id NOT IN (SELECT event_id * 2 FROM events)
UNION ALL
SELECT id, 'deleted', user_name, username FROM owned_order WHERE id IN (SELECT event_id * 2 FROM events)
UNION ALL
SELECT DISTINCT event_id * 2, 'unknown', NULL, NULL FROM events WHERE event_id * 2 NOT IN (SELECT id FROM shop_orders)""")
oracle("delete_product_cascade", """
SELECT 'product' AS table_name, id FROM product WHERE active
UNION ALL SELECT 'images', id FROM images WHERE product_id NOT IN (SELECT id FROM product WHERE NOT active)
UNION ALL SELECT 'rating', id FROM rating WHERE product_id NOT IN (SELECT id FROM product WHERE NOT active)""")
oracle("rating_upsert", """
SELECT t.user_id, t.product_id, t.value, CASE WHEN h.id IS NULL THEN 'added' ELSE 'updated' END AS outcome,
  s.avg_rating, s.rating_count
FROM (SELECT user_id, product_id, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY ts DESC, seq DESC) AS rn
        FROM rating_submission WHERE ts >= TIMESTAMP '2024-01-15 00:00:00') l WHERE rn = 1) t
LEFT JOIN held_rating h ON h.user_id = t.user_id AND h.product_id = t.product_id
JOIN (SELECT product_id, round(avg(value), 1) AS avg_rating, count(DISTINCT user_id) AS rating_count
      FROM rating GROUP BY product_id) s ON s.product_id = t.product_id""")
oracle("order_status_update", """
SELECT o.id, l.status, o.user_name, 'updated' AS outcome, CAST(NULL AS BIGINT) AS seq
FROM owned_order o JOIN last_status l ON l.order_id = o.id
UNION ALL
SELECT order_id, status, NULL, 'order_unknown', seq FROM valid_status WHERE order_id NOT IN (SELECT id FROM shop_orders)
UNION ALL
SELECT order_id, status, NULL,
  'status_unknown', seq
FROM status_request WHERE status NOT IN ('Created', 'Accepted', 'Preparing', 'Shipping', 'Delivered', 'Canceled')""")
STEP = """(SELECT c.seq, c.image_id, c.priority, i.product_id,
  row_number() OVER (PARTITION BY i.product_id ORDER BY c.seq, c.image_id, c.priority) AS step
FROM image_choice c JOIN images i ON i.id = c.image_id)"""
oracle("set_primary_image", f"""
SELECT i.id, i.product_id, i.link, CAST(CASE WHEN o.own IS NOT NULL THEN 1 + t.steps - o.own
  ELSE i.priority + coalesce(t.steps, 0) END AS BIGINT) AS priority
FROM images i
LEFT JOIN (SELECT product_id, count(*) AS steps FROM {STEP} s GROUP BY product_id) t ON t.product_id = i.product_id
LEFT JOIN (SELECT image_id, max(step) AS own FROM {STEP} s GROUP BY image_id) o ON o.image_id = i.id""")
oracle("set_secondary_priority", f"""
SELECT i.id, i.product_id, i.link, CASE WHEN t.todo IS NULL THEN i.priority ELSE list_reduce(
  list_transform(t.todo, lambda s: {{'image': s.image_id, 'now': s.priority}}),
  lambda a, s: {{'image': a.image, 'now': CASE WHEN s.image = a.image THEN s.now WHEN a.now >= s.now THEN a.now + 1
    ELSE a.now END}},
  {{'image': i.id, 'now': i.priority}}).now END AS priority
FROM images i LEFT JOIN (
  SELECT product_id, list({{'image_id': image_id, 'priority': priority}} ORDER BY step) AS todo FROM {STEP} s
  GROUP BY product_id) t ON t.product_id = i.product_id""")
oracle("update_image_priority", """
SELECT i.id, i.product_id, i.link, CASE WHEN c.image_id IS NULL THEN i.priority ELSE c.priority END AS priority
FROM images i LEFT JOIN (SELECT image_id, arg_max(priority, (seq, priority)) AS priority FROM image_choice GROUP BY image_id) c
  ON c.image_id = i.id""")
oracle("add_product_images", f"""
SELECT id, product_id, link, priority FROM images
UNION ALL
SELECT (SELECT max(id) FROM images) + row_number() OVER (ORDER BY seq), product_id, link, priority
FROM ({ADDED.format(where="WHERE link IS NOT NULL")}) a""")

# Orders against stock
oracle("order_admission", stock.ADMISSION, stock.PLACED, recursive=True)
oracle("order_place", stock.PLACE, stock.PLACED, recursive=True)
oracle("order_amend", stock.AMEND, stock.AMENDED, recursive=True)
oracle("order_place_after", stock.PLACE_AFTER, stock.PLACED_STATE, recursive=True)
oracle("order_amend_after", stock.AMEND_AFTER, stock.AMENDED_STATE, recursive=True)

# Streams: the end state
oracle("stream_rating_upsert", """
SELECT coalesce(h.id, (SELECT max(id) FROM held_rating) + n.k) AS id, r.user_id, r.product_id, r.value
FROM rating r LEFT JOIN held_rating h ON h.user_id = r.user_id AND h.product_id = r.product_id
LEFT JOIN (
  SELECT f.user_id, f.product_id, row_number() OVER (ORDER BY f.ts, f.seq) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY ts, seq) AS rn FROM rating_submission) f
  LEFT JOIN held_rating g ON g.user_id = f.user_id AND g.product_id = f.product_id
  WHERE f.rn = 1 AND g.id IS NULL) n ON n.user_id = r.user_id AND n.product_id = r.product_id""")
oracle("stream_order_status", """
SELECT o.id, coalesce(l.status, o.status) AS status, 'current' AS outcome, CAST(NULL AS BIGINT) AS seq
FROM shop_orders o LEFT JOIN last_status l ON l.order_id = o.id
UNION ALL
SELECT order_id, status, 'refused', seq FROM valid_status WHERE order_id NOT IN (SELECT id FROM shop_orders)
UNION ALL
SELECT order_id, status, 'refused', seq FROM status_request
WHERE status NOT IN ('Created', 'Accepted', 'Preparing', 'Shipping', 'Delivered', 'Canceled')""")
