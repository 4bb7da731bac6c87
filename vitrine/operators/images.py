"""Image priorities: where new images go and what moving one does to the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .lookups import latest, missing_keys
from .ranking import WINDOW_ROWS, fresh_ids, largest_group, ranked, sums_before

LEVELS_PER_TABLE = 4  # levels of composed moves between two written tables


def next_priorities(images: DataFrame, additions: DataFrame, window_rows: int | None = None) -> DataFrame:
    """`additions` (seq, product_id, …) with the priority each gets when they arrive one after another.

    A product without a primary image gets one first; every other addition goes behind the largest priority.
    """
    state = images.groupBy("product_id").agg(
        F.max("priority").alias("_max"), F.bool_or(F.col("priority") == 1).alias("_primary")
    )
    k = F.col("_k")
    placed = ranked(additions, ["product_id"], [F.col("seq").asc()], "_k", window_rows)
    behind = F.greatest(F.col("_max"), F.lit(1)) + k - 1
    priority = F.when(F.coalesce("_primary", F.lit(False)), F.col("_max") + k).when(k == 1, 1).otherwise(behind)
    return placed.join(state, "product_id", "left").select(*additions.columns, priority.cast("bigint").alias("priority"))


def add_images(images: DataFrame, additions: DataFrame) -> DataFrame:
    """The images table after the additions, with new ids in `seq` order."""
    added = fresh_ids(next_priorities(images, additions), images, [F.col("seq").asc()])
    return images.unionByName(added.select(*images.columns))


def _choices_of(images: DataFrame, choices: DataFrame) -> DataFrame:
    """The choices of known images with their product; written, as it is counted, ranked and totalled."""
    owners = images.select(F.col("id").alias("image_id"), "product_id")
    return materialise(choices.join(owners, "image_id"), "choices")


def set_primary(images: DataFrame, choices: DataFrame, window_rows: int | None = None) -> DataFrame:
    """Images after the choices (seq, image_id) one after another: the chosen gets 1, the product's others move up.

    Every step after its own last choice moves an image by one, so the end state needs counts only. Ties in `seq` go by
    image.
    """
    made = _choices_of(images, choices)
    steps = ranked(made, ["product_id"], [F.col("seq").asc(), F.col("image_id").asc()], "_step", window_rows)
    totals = made.groupBy("product_id").agg(F.count("*").alias("_steps"))
    own = steps.groupBy(F.col("image_id").alias("id")).agg(F.max("_step").alias("_own"))
    moved = F.when(F.col("_own").isNotNull(), 1 + F.col("_steps") - F.col("_own")).otherwise(
        F.col("priority") + F.coalesce("_steps", F.lit(0))
    )
    joined = images.join(totals, "product_id", "left").join(own, "id", "left")
    return joined.withColumn("priority", moved.cast("bigint")).select(*images.columns)


def _up_to(df: DataFrame, keys: list[str], order: list[Column], flag: Column, name: str, large: int | None) -> DataFrame:
    """How many flagged rows there are up to each row, itself included, in its group by `order` (a total order).

    `large` is None where every product fits a window; else it limits the rows of a window and larger groups are summed in
    blocks.
    """
    if large is None:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(flag.cast("bigint")).over(window))
    placed = ranked(df, keys, order, "_rank", large)
    summed = sums_before(placed, keys, "_rank", {"_before": flag.cast("bigint")}, large)
    return summed.withColumn(name, F.col("_before") + flag.cast("bigint")).drop("_rank", "_before")


def set_secondary(images: DataFrame, choices: DataFrame, window_rows: int | None = None) -> DataFrame:
    """Images after the choices (seq, image_id, priority): the chosen gets its value, others at or above it move up.

    A move sends every other image x of the product to x + 1 if x >= its value. Moves in a row are again of this kind: x plus
    the number of thresholds up to x, with as many thresholds as moves. Two neighbouring runs of moves with thresholds u and v
    become one with the thresholds u and v - |{i : u_i + i <= v}| (u_i the i-th smallest). So runs of 1, 2, 4, … moves are
    composed level by level, and at each level every image takes the one run that brings it from its last own move to the
    end; no image ever meets the list of moves. A level is two running counts over moves and images of the products that
    have moves; there are as many levels as bits in the largest number of moves of a product.

    Ties in `seq` go by image, then value. A null value takes its image out (null) and moves no other; null priorities stay;
    images without a product, and unknown images, are not moved.
    """
    made = _choices_of(images, choices).where("product_id IS NOT NULL").select(
        "product_id", "seq", "image_id", F.col("priority").cast("bigint").alias("to"))
    steps = ranked(made, ["product_id"], [F.col("seq").asc(), F.col("image_id").asc(), F.col("to").asc()], "_step", window_rows)
    steps = materialise(steps.select("product_id", "image_id", "to", "_step"), "steps")
    most = steps.agg(F.max("_step").alias("n")).first()["n"] or 0
    if not most:
        return images
    own = steps.groupBy(F.col("image_id").alias("id")).agg(
        F.max("_step").alias("_own"), F.max_by(F.struct("to"), "_step").alias("_last"))
    moved_products = steps.select(F.col("product_id")).distinct()
    untouched = images.join(moved_products, "product_id", "left_anti")
    touched = images.join(moved_products, "product_id", "left_semi").join(own, "id", "left").select(
        "product_id", F.struct(*images.columns).alias("_image"), F.lit(1).alias("_kind"),
        F.coalesce("_own", F.lit(0)).alias("_next"),  # the first move that it has not met
        F.when(F.col("_last").isNotNull(), F.col("_last.to")).otherwise(F.col("priority").cast("bigint")).alias("_x"),
    )
    shape = dict(touched.dtypes)["_image"]
    thresholds = steps.select(
        "product_id", F.lit(None).cast(shape).alias("_image"), F.lit(0).alias("_kind"),
        (F.col("_step") - 1).alias("_next"), F.col("to").alias("_x"),
    )
    rows = thresholds.where("_x IS NOT NULL").unionByName(touched)
    large = largest_group(rows, ["product_id"])
    limit = WINDOW_ROWS if window_rows is None else window_rows
    large = None if large <= limit else limit
    if large is None:
        rows = rows.repartition("product_id")  # serves the windows of all levels
    move, image = F.col("_kind") == 0, (F.col("_kind") == 1) & F.col("_x").isNotNull()
    tie = [F.col("_kind"), F.col("_next"), F.col("_image.id")]
    levels = (most - 1).bit_length()
    for level in range(levels):
        run = F.shiftright("_next", level)
        right = run.bitwiseAND(F.lit(1)) == 1
        # Images that wait at this level stand apart.
        rows = rows.withColumn("_run", F.when(move | (image & right), run).otherwise(-1)).withColumn(
            "_both", F.shiftright("_run", 1))
        rows = _up_to(rows, ["product_id", "_run"], [F.col("_x"), *tie], move, "_upto", large)
        place = F.when(move & ~right, F.col("_x") + F.col("_upto")).otherwise(F.col("_x"))
        rows = rows.withColumn("_place", place)
        left = move & ~right
        rows = _up_to(
            rows, ["product_id", "_both"], [F.col("_place"), F.when(left, 0).otherwise(1), *tie], left, "_left", large)
        x = (
            F.when(move & right, F.col("_x") - F.col("_left")).when(image & right, F.col("_x") + F.col("_upto"))
            .otherwise(F.col("_x"))
        )
        at = F.when(image & right, F.shiftleft(run + 1, level)).otherwise(F.col("_next"))
        rows = rows.select("product_id", "_image", "_kind", at.alias("_next"), x.alias("_x"))
        if level % LEVELS_PER_TABLE == LEVELS_PER_TABLE - 1 and level + 1 < levels:
            rows = materialise(rows, "levels")
            rows = rows if large else rows.repartition("product_id")
    # Images that no move has reached yet take all of them at once.
    rows = _up_to(rows, ["product_id"], [F.col("_x"), *tie], move, "_upto", large)
    final = F.when(F.col("_next") == 0, F.col("_x") + F.col("_upto")).otherwise(F.col("_x"))
    done = rows.where("_kind = 1").withColumn("_final", final).select(
        *[F.col("_final").cast(images.schema[c].dataType).alias(c) if c == "priority" else F.col(f"_image.{c}") for c in images.columns])
    return untouched.select(*images.columns).unionByName(done)


def set_priority(images: DataFrame, choices: DataFrame) -> DataFrame:
    """Images with the last priority given by id, the larger at a tie; unknown ids change nothing."""
    given = choices.select(F.col("image_id").alias("id"), "seq", F.col("priority").alias("_to"))
    last = latest(given, ["id"], ["seq", "_to"])
    hit = F.col("seq").isNotNull()
    return images.join(last, "id", "left").withColumn(
        "priority", F.when(hit, F.col("_to")).otherwise(F.col("priority"))
    ).select(*images.columns)


def unknown_images(images: DataFrame, choices: DataFrame) -> DataFrame:
    return missing_keys(images, choices.withColumnRenamed("image_id", "id"))
