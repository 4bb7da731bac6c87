"""Rows by key, filters over whole tables, and validation of incoming rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import fresh_path, materialise
from .ranking import WINDOW_ROWS, largest_group, with_group

# The order states and the voucher types that are accepted.
ORDER_STATUSES = ["Created", "Accepted", "Preparing", "Shipping", "Delivered", "Canceled"]
VOUCHER_TYPES = ["num", "per"]


def rows_for_keys(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among `keys`; repeats in `keys` collapse and unknown keys vanish.

    The keys are made distinct before the join, so an often repeated key crosses the network once per task at most.
    """
    return table.join(keys.select(key).distinct(), key, "left_semi")


def missing_keys(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Keys that have no row."""
    return keys.select(key).distinct().join(table, key, "left_anti")


def public_users(users: DataFrame) -> DataFrame:
    return users.drop("password", "password_hash")


def active_accounts(accounts: DataFrame, flag: str = "status") -> DataFrame:
    return accounts.where(F.col(flag))


def catalog_filter(
    products: DataFrame, category_id: int | None = None, search: str | None = None, active_only: bool = True
) -> DataFrame:
    """Products by the given conditions only; % and _ in the search text act as wildcards."""
    if active_only:
        products = products.where(F.col("active"))
    if category_id is not None:
        products = products.where(F.col("category_id") == category_id)
    if search:
        products = products.where(F.col("name").ilike(f"%{search}%"))
    return products


def latest(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last change per key. Works as a map-side combined aggregate, so a busy key does not gather in one task."""
    rest = [c for c in changes.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return changes.groupBy(*keys).agg(last).select(*keys, "_last.*")


# Vouchers


def valid_vouchers(vouchers: DataFrame, as_of: Column) -> DataFrame:
    """Active vouchers that expire strictly after `as_of`; without a date they are not valid."""
    return vouchers.where(F.col("active") & (F.col("expire_date") > as_of))


def voucher_by_code(vouchers: DataFrame, codes: DataFrame, as_of: Column) -> DataFrame:
    return rows_for_keys(valid_vouchers(vouchers, as_of), codes, "code")


def voucher_state_of_orders(orders: DataFrame, vouchers: DataFrame, as_of: Column) -> DataFrame:
    """Every order once, with the state of its voucher code: valid, inactive, expired or unknown.

    Of several vouchers with one code a valid one counts first, then the one with the lowest id.
    """
    valid = F.coalesce(F.col("active") & (F.col("expire_date") > as_of), F.lit(False))
    one = F.min_by(F.struct("id", "active", "expire_date"), F.struct(~valid, F.col("id"))).alias("v")
    known = vouchers.groupBy(F.col("code").alias("voucher_code")).agg(one).select(
        "voucher_code", F.col("v.id").alias("voucher_id"), F.col("v.active").alias("_active"), "v.expire_date"
    )
    state = (
        F.when(F.col("voucher_id").isNull(), "unknown")
        .when(~F.coalesce("_active", F.lit(False)), "inactive")
        .when(F.col("expire_date") > as_of, "valid")
        .otherwise("expired")
    )
    return orders.drop("voucher_id").join(known, "voucher_code", "left").select(
        *[c for c in orders.columns if c != "voucher_id"], "voucher_id", state.alias("voucher_state")
    )


# Validation: every function adds `reject_reason`, null for rows that pass.


def _checked(rows: DataFrame, passes: Column, reason: Column) -> DataFrame:
    return rows.withColumn("reject_reason", F.when(~F.coalesce(passes, F.lit(False)), reason))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject_reason").isNotNull())


def validate_status(changes: DataFrame) -> DataFrame:
    return _checked(changes, F.col("status").isin(ORDER_STATUSES), F.lit("status_unknown"))


def validate_voucher(vouchers: DataFrame, update: bool = False) -> DataFrame:
    """The type must be given and known; on update it is checked only where given."""
    given = F.coalesce(F.col("type"), F.lit("")) != ""
    known = F.col("type").isin(VOUCHER_TYPES)
    return _checked(vouchers, ~given | known if update else known, F.lit("type must be num or per"))


def validate_items(orders: DataFrame, lines: DataFrame, order_id: str = "id") -> DataFrame:
    """Orders need at least one decoded line."""
    filled = lines.select(F.col("order_id").alias(order_id)).distinct().withColumn("_filled", F.lit(True))
    return _checked(orders.join(filled, order_id, "left"), F.col("_filled"), F.lit("items_missing")).drop("_filled")


def validate_image(images: DataFrame) -> DataFrame:
    return _checked(images, F.coalesce(F.col("link"), F.lit("")) != "", F.lit("link is required"))


def _root_and_parity(links: DataFrame, seq: str) -> DataFrame:
    """`seq`, `root`, `odd`: where the chain of `links` (seq, before) ends and whether it is an odd number of steps long.

    Pointer doubling: after k rounds every pointer spans 2^k links, so a chain of n requests takes log2(n) rounds.
    """
    state = materialise(links.select(seq, F.col("before").alias("root"), F.lit(True).alias("odd")), "chains")
    while True:
        ahead = state.select(F.col(seq).alias("_at"), F.col("root").alias("_next"), F.col("odd").alias("_odd"))
        joined = state.join(ahead, state["root"] == ahead["_at"], "left")
        longer = F.col("_at").isNotNull()
        state = materialise(joined.select(
            seq, F.when(longer, F.col("_next")).otherwise(F.col("root")).alias("root"),
            F.when(longer, F.col("odd") != F.col("_odd")).otherwise(F.col("odd")).alias("odd"), longer.alias("_moved"),
        ), "chains")
        moved = not state.where("_moved").isEmpty()
        state = state.drop("_moved")
        if not moved:
            return state


def validate_unique(
    requests: DataFrame, accounts: DataFrame, fields: Sequence[str], seq: str = "seq", window_rows: int | None = None
) -> DataFrame:
    """Accept requests in `seq` order while every field is still free; a refused request claims nothing.

    Each round settles, over all groups of equal values at once, requests that come first in the groups of all their fields
    and refuses those that share a value with an accepted one. Then it follows chains: a request with one earlier open rival
    in all its groups is accepted exactly if that rival is not, so along such links every second request is accepted.
    Links are followed by pointer doubling, and whole chains and trees of them settle in one round, however long. The
    earliest open request always settles, so the rounds end. Null never clashes.
    """
    spark = requests.sparkSession
    taken, clash = F.lit(False), requests.select(seq, *fields)
    for f in fields:
        held = accounts.select(f).where(F.col(f).isNotNull()).distinct().withColumn(f"_held_{f}", F.lit(True))
        clash = clash.join(held, f, "left")
        taken = taken | F.coalesce(f"_held_{f}", F.lit(False))
    # Every null is a group of its own.
    keys = {f: F.struct(f, F.when(F.col(f).isNull(), F.col(seq)).alias("own")) for f in fields}
    start = clash.select(
        seq, *[key.alias(f) for f, key in keys.items()], F.when(taken, "out").otherwise("open").alias("state")
    )
    state = materialise(start, "unique")
    schema, paths = state.schema, [fresh_path(spark, "unique")]
    state.where("state = 'out'").write.parquet(paths[0])
    state = state.where("state = 'open'")
    sizes = {f: largest_group(state, [f]) for f in fields}  # groups only get smaller
    limit = WINDOW_ROWS if window_rows is None else window_rows
    while not state.isEmpty():
        state = materialise(_with_rivals(state, fields, seq, {f for f in fields if sizes[f] <= limit}), "unique")
        links = state.where("_rivals = 1").select(seq, F.col("_rival").alias("before"))
        chains = _root_and_parity(links, seq).select(F.col(seq).alias("_of"), F.col("root").alias("_root"), "odd")
        firsts = state.where("_rivals = 0").select(F.col(seq).alias("_first"))
        # A root without rivals is in; the parity of the way there tells about the rest. Other roots wait.
        known = chains.join(firsts, chains["_root"] == firsts["_first"], "left_semi")
        placed = state.join(known, state[seq] == known["_of"], "left")
        accepted = (F.col("_rivals") == 0) | F.coalesce(~F.col("odd"), F.lit(False))
        refused = F.coalesce(F.col("odd"), F.lit(False))
        state = materialise(
            placed.select(seq, *fields, F.when(accepted, "in").when(refused, "out").otherwise("open").alias("state")), "unique")
        lost = F.lit(False)
        for f in fields:
            state = with_group(state, [f], {f"_lost_{f}": F.bool_or(F.col("state") == "in")}, window_rows, sizes[f])
            lost = lost | F.col(f"_lost_{f}")
        now = F.when((F.col("state") == "open") & lost, "out").otherwise(F.col("state"))
        paths.append(fresh_path(spark, "unique"))
        state.select(seq, *fields, now.alias("state")).write.parquet(paths[-1])
        state = spark.read.schema(schema).parquet(paths[-1]).where("state = 'open'")
    refused = spark.read.schema(schema).parquet(*paths).where("state = 'out'").select(seq, F.lit(True).alias("_refused"))
    reason = F.lit(" or ".join(fields) + " already exists")
    return _checked(requests.join(refused, seq, "left"), F.col("_refused").isNull(), reason).drop("_refused")


def _with_rivals(state: DataFrame, fields: Sequence[str], seq: str, windowed: set[str]) -> DataFrame:
    """`state` with the number of earlier open requests that share a value (2 stands for more) and, where it is one, which.

    A group's two earliest requests tell everything: the first has no rival in it, the second one, all others several.
    Groups of the fields in `windowed` fit a window; those of others are aggregated and joined back.
    """
    for f in fields:
        if f in windowed:
            group = Window.partitionBy(f).orderBy(seq)
            state = state.withColumns({
                f"_a_{f}": F.first(seq).over(group), f"_b_{f}": F.nth_value(seq, 2).over(group),
            })
            continue
        first = state.groupBy(f).agg(F.min(seq).alias("_a")).select(F.col(f).alias("_f"), "_a")
        later = state.select(f, seq).join(first, F.col(f) == F.col("_f")).where(F.col(seq) > F.col("_a"))
        second = later.groupBy("_f").agg(F.min(seq).alias("_b"))
        both = first.join(second, "_f", "left").select("_f", F.col("_a").alias(f"_a_{f}"), F.col("_b").alias(f"_b_{f}"))
        state = state.join(both, state[f] == both["_f"]).drop("_f")
    none = F.array().cast(f"array<{dict(state.dtypes)[seq]}>")
    rivals = F.array_distinct(F.concat(*[
        F.when(F.col(seq) == F.col(f"_a_{f}"), none).when(F.col(seq) == F.col(f"_b_{f}"), F.array(f"_a_{f}"))
        .otherwise(F.array(f"_a_{f}", f"_b_{f}"))
        for f in fields
    ]))
    return state.withColumn("_all", rivals).select(
        seq, *fields, F.least(F.size("_all"), F.lit(2)).alias("_rivals"),
        F.when(F.size("_all") == 1, F.get("_all", F.lit(0))).alias("_rival"))
