"""One expectation per cell of the banner matrix: what each listing makes of each shape of map."""

import json

import pytest

from vitrine.operators import banners

from .conftest import rows

SHAPES = {
    1: ("List", "[1,2,2,99]"), 2: ("List", "2"), 3: ("List", '[{"productIds":[2,{"id":1},2]}]'),
    4: ("List", '{"productIds":[]}'), 5: ("Timer", '[{"endDate":"2030-01-01","productIds":[2,1,1,99]}]'),
    6: ("Timer", '{"endDate":"2030-02-01"}'), 7: ("Timer", "[1]"), 8: ("Category", "[1,2,99]"),
    9: ("Category", '[{"categoryIds":[1,99]},{"categoryIds":[2]}]'), 10: ("Category", '[{"categoryIds":1}]'),
    11: ("Slider", '["a",{"x":null},true]'), 12: ("Single", "[]"), 13: ("List", None), 14: ("Timer", "[]"),
    15: ("Timer", None), 16: ("Timer", '[{"endDate":"d","productIds":[{"id":2},1]}]'), 17: ("Category", None),
    18: ("Category", "[]"), 19: ("Timer", '[{"productIds":[true,"2",1.5,1]}]'),
}
P1, P2, C1, C2, C0 = "p1", "p2", "c1", "c2", "c?"
ASIS = {k: json.loads(m) if m else None for k, (_, m) in SHAPES.items()}


def timer(end, *products):
    return {"endDate": end, "products": list(products) or None}


NUMBERS = {1: [[P1], [P2], [P2], None], 2: [[P2]]}
LISTED = {8: None, 9: [C1, C0, C2], 10: None, 17: None, 18: None}
SINGLE = {8: [C1, C2, None]}
TIMED = {5: [timer("2030-01-01", P2, P1, P1)], 6: [timer("2030-02-01")], 16: [timer("d", P1)],
         19: [timer(None, P2, P1)]}
OBJECTS = {3: [{"products": [P2, P1, P2]}], 4: [{"products": None}]}
EXPECTED = {
    "ADMIN": NUMBERS | LISTED | TIMED,
    "ADMIN_PRODUCTS": NUMBERS | SINGLE | {
        5: [timer("2030-01-01", P1, P2)], 6: [timer("2030-02-01")], 7: [timer(None)], 14: None, 15: [timer(None)],
        16: [timer("d", P1)], 19: [timer(None, P1, P2)],
    },
    "CLIENT": NUMBERS | SINGLE,
    "CLIENT_PRODUCTS": OBJECTS | LISTED | TIMED,
    "CLIENT_BY_ID": OBJECTS | LISTED | {
        5: [{"products": [P2, P1, P1]}], 6: [{"products": None}], 16: [{"products": [P2, P1]}],
        19: [{"products": [P2, P1]}],
    },
}


def short(value):
    """Products and categories of a document as p1, c1; an unknown category as c?."""
    if isinstance(value, list):
        return [short(v) for v in value]
    if isinstance(value, dict):
        if "avg_rating" in value:
            return f"p{value['id']}"
        if "image" in value:
            return f"c{value['id']}" if value["id"] else C0
        return {k: short(v) for k, v in value.items()}
    return value


@pytest.fixture(scope="module")
def shop(spark):
    table = spark.createDataFrame(
        [(i, t, m, None if i % 2 else i) for i, (t, m) in SHAPES.items()],
        "id bigint, type string, map string, priority int",
    )
    products = spark.createDataFrame(
        [(1, "one", "d1", 5, 4), (2, "two", "d2", 6, None)],
        "id bigint, name string, description string, price int, endprice int",
    )
    images = spark.createDataFrame([(1, 1, "link", 2)], "id bigint, product_id bigint, link string, priority bigint")
    ratings = spark.createDataFrame([(1, 1, 2, 4), (2, 2, 2, 5), (3, 3, 2, 5)], "id bigint, user_id bigint, product_id bigint, value int")
    categories = spark.createDataFrame([(1, "c1", "i1"), (2, "c2", "i2")], "id int, name string, image string")
    return table, products, images, ratings, categories


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_matrix(shop, name):
    listing = getattr(banners, name)
    flat = banners.resolve_banners(*shop, listing)
    got = {r.banner_id: r.map for r in banners.nest_banners(flat, listing).collect()}
    got = {k: short(json.loads(m)) if m else None for k, m in got.items()}
    kept = {k: v if isinstance(v, list) and v else [v] if v != [] else [None] for k, v in ASIS.items()}
    assert got == kept | EXPECTED[name]


def test_product_fields(shop):
    flat = banners.resolve_banners(*shop, banners.ADMIN)
    documents = {r.banner_id: json.loads(r.map) for r in banners.nest_banners(flat, banners.ADMIN).where("banner_id = 1").collect()}
    one, two = documents[1][0][0], documents[1][1][0]
    assert one == {"id": 1, "name": "one", "description": "d1", "price": 5, "endprice": 4, "primary_image": "link",
                   "avg_rating": 0.0, "rating_count": 0}
    assert (two["avg_rating"], two["rating_count"], two["primary_image"], two["endprice"]) == (4.67, 3, None, None)


def test_order_and_broken_maps(spark, shop):
    table = shop[0]
    assert [r.id for r in banners.sort_banners(table).collect()] == [*range(2, 19, 2), *range(1, 20, 2)]
    broken = spark.createDataFrame([(1, "List", "{oops", 1), (2, "List", "[1]", 1)], table.schema)
    assert rows(banners.quarantined_banners(broken), "banner_id") == [(1,)]
