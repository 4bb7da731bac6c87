"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations.

Each source has a word target: its share by weight, never above `most` times its size; what is cut off goes to the
others by weight. A source is taken in whole passes plus a part: its documents stand in a hashed order, and the part is
everything before a cut in that order. The cut is found by radix selection: word totals of 2^12 cells, then of the cells
of the cell that holds the cut, and so on, so no running sum goes over a whole source.

The hashed order is divided into blocks. A tree splits the exact block counts of all sources over the output shards: at
each node the left half's counts are drawn without replacement, source by source, each draw given what earlier sources
took (a multivariate hypergeometric sample), until a node is one shard. Shards then own disjoint runs of each source's
permuted blocks, and rows are shuffled locally by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import positions
from ..storage import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 1 << 17
SHARD_WORDS = 1 << 24
DIGIT, DIGITS = 12, 5
_BITS = DIGIT * DIGITS


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ordered(sources: DataFrame) -> DataFrame:
    """Sources with their place by code point (UTF-8 bytes sort alike), null last."""
    return positions(sources, [F.col("source").asc_nulls_last()], "place")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """`source`, `place`, `size` and `target` of every source; only scalars come to the driver, one round per resharing."""
    table = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = materialise(_ordered(sizes).withColumn("weight", table.cast("double")), "sources")
    total = weighed.agg(F.sum("size")).first()[0] or 0
    limit = F.col("size") * F.lit(float(most))
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) > limit
        left = weighed.agg(
            F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
        ).first()
        if not left[1]:
            break
        higher = max(level, (share * total - left[0]) / left[1])
        if higher == level:
            break
        level = higher
    target = F.when(F.col("weight") * F.lit(level) > limit, limit).otherwise(F.col("weight") * F.lit(level))
    return weighed.select("source", "place", "size", target.alias("target"))


def _strata(parts: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows of `sources` split by stratum: each takes the share of its source's target that it has of its size."""
    whole = sources.select(
        F.col("source").alias("name"), F.col("place").alias("whole"), F.col("size").alias("of"), F.col("target").alias("wanted"))
    share = F.when(F.col("of") > 0, F.col("wanted") * F.col("size") / F.col("of")).otherwise(F.lit(0.0))
    split = parts.join(whole, parts["source"].eqNullSafe(whole["name"])).select(
        "source", "stratum", "whole", "size", share.alias("target"))
    return positions(split, [F.col("whole").asc(), F.col("stratum").asc_nulls_last()], "place").drop("whole")


def _cuts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """`place`, `passes`, `cut` (a hash) and `rest` and `at_cut`: words wanted and present exactly at the cut."""
    passes = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")
    left = F.round(F.col("target") - passes * F.col("size")).cast("long")
    cuts = sources.select("place", passes.alias("passes"), F.lit(0).cast("long").alias("cut"), left.alias("rest"),
                          F.col("size").alias("at_cut"))
    for digit in range(DIGITS):
        shift = _BITS - DIGIT * (digit + 1)
        inside = rows.join(cuts, "place").where(
            F.shiftright("order", shift + DIGIT) == F.shiftright("cut", shift + DIGIT)
        )
        cells = inside.groupBy("place", F.shiftright("order", shift).alias("cell")).agg(F.sum("words").alias("words"))
        run = Window.partitionBy("place").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        placed = cells.join(cuts, "place").withColumn("upto", F.sum("words").over(run))
        # The first cell that reaches the wanted words; all cells, if they hold just as many, end in the last one.
        chosen = placed.where((F.col("upto") >= F.col("rest")) & (F.col("words") > 0)).groupBy("place").agg(
            F.min_by(F.struct("cell", "words", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest")), "cell")
            .alias("c")
        )
        cuts = materialise(
            cuts.join(chosen, "place", "left").select(
                "place", "passes", F.coalesce(F.shiftleft("c.cell", shift), "cut").alias("cut"),
                F.coalesce("c.rest", "rest").alias("rest"), F.coalesce("c.words", "at_cut").alias("at_cut"),
            ), "cuts",
        )
    return cuts


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """`place`, `pass`, `shard`, `n`: the counts of `quotas` (`place`, `pass`, `n`) split over 2^levels shards."""
    state = quotas.select(F.lit(0).cast("long").alias("node"), "place", "pass", "n")
    for level in range(levels):
        node = state.groupBy("node").agg(
            F.array_sort(F.collect_list(F.struct("place", "pass", "n"))).alias("items"), F.sum("n").alias("total")
        )
        start = F.struct(
            F.col("total").alias("left"), F.floor(F.col("total") / 2).cast("long").alias("wanted"),
            F.array().cast("array<bigint>").alias("out"),
        )

        def draw(state: Column, item: Column) -> Column:
            # Block by block: each is taken with the chance that is left, which is a hypergeometric draw.
            blocks = F.when(item["n"] > 0, F.sequence(F.lit(1).cast("long"), item["n"])).otherwise(
                F.array().cast("array<bigint>"))
            taken = F.aggregate(
                blocks, F.lit(0).cast("long"),
                lambda got, k: got + F.when(
                    _uniform(F.lit(seed), F.lit(level), F.col("node"), item["place"], item["pass"], k)
                    * (state["left"] - k + 1) < state["wanted"] - got, F.lit(1).cast("long"),
                ).otherwise(F.lit(0).cast("long")),
            )
            moved = F.transform(F.array(taken), lambda t: F.struct(
                (state["left"] - item["n"]).alias("left"), (state["wanted"] - t).alias("wanted"),
                F.concat(state["out"], F.array(t)).alias("out"),
            ))
            return F.element_at(moved, 1)

        drawn = node.select("node", "items", F.aggregate("items", start, draw)["out"].alias("lefts"))
        split = drawn.select("node", F.explode(F.arrays_zip("items", "lefts")).alias("z")).select(
            "node", "z.items.place", "z.items.pass", F.col("z.items.n").alias("n"), F.col("z.lefts").alias("l"))
        state = materialise(
            split.select((F.col("node") * 2).alias("node"), "place", "pass", F.col("l").alias("n")).unionAll(
                split.select((F.col("node") * 2 + 1).alias("node"), "place", "pass", F.expr("n - l").alias("n"))
            ).where("n > 0"), "tree",
        )
    return state.withColumnRenamed("node", "shard")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 7, by_text: bool = False, carry: bool = False,
    strata: str | None = None,
) -> DataFrame:
    """One row per document: `doc_id`, `source`, `text`, `size`, `source_size`, `target`, `taken` and `copies`, an array
    of (pass, shard, key, words): where each copy goes, its place in the shard by `key`, and how many words it gives.

    `size` counts words between ASCII blanks. Sources stand by code point, null last, and weigh `weights` in turn; they
    share `share` times all words, none more than `most` times its own. Copies of a document are whole, but for the
    documents at a source's cut. Rows with one `doc_id` share a place in the order, with `by_text` only if their texts are
    equal, too; with `carry` a column `row` follows, a struct of all columns of `docs`; with `strata`, a column, each of its
    values is taken at its source's rate, has a cut of its own, and `source_size` and `target` are its own; null texts have no
    words; repeated rows each count; a source without words has target 0; no rows give no rows. Nothing is random: reruns agree.
    """
    named = ["doc_id", "text"] if by_text else ["doc_id"]
    order = F.shiftrightunsigned(F.xxhash64(*named, F.lit(seed)), 64 - _BITS)
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    stratum = [F.col(strata).cast("string").alias("stratum")] if strata else []
    group = ["source", "stratum"] if strata else ["source"]
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *stratum,
        F.col("text").cast("string").alias("text"), *row,
    ).withColumn("words", n_words(F.col("text"))).withColumn("order", order)
    base = materialise(counted.select("doc_id", *group, "words", "order"), "words")
    sources = materialise(
        targets(base.groupBy("source").agg(F.sum("words").alias("size")), weights, share, most), "targets")
    if strata:
        sources = materialise(_strata(base.groupBy(*group).agg(F.sum("words").alias("size")), sources), "strata")
    names = sources.select(
        F.col("source").alias("name"), *[F.col("stratum").alias("part_of") for _ in stratum], "place",
        F.col("size").alias("source_size"), "target")

    def of_group(rows: DataFrame, named: DataFrame) -> Column:
        same = rows["source"].eqNullSafe(named["name"])
        return same & rows["stratum"].eqNullSafe(named["part_of"]) if strata else same

    rows = base.join(names, of_group(base, names)).select("place", "words", "order")
    cuts = _cuts(rows, sources)

    # Blocks are cells of the hashed order; a source has a power of two of them.
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("source_size"), F.lit(1)) / F.lit(block_words)))).cast("int")
    plans = materialise(
        names.join(cuts, "place").withColumn("bits", bits).withColumn("shift", F.lit(_BITS) - F.col("bits")), "plans")
    cut_block = F.expr("shiftright(cut, shift)") + 1
    quotas = plans.select("place", F.explode(F.expr("sequence(0L, passes)")).alias("pass"), "passes", "bits",
                          cut_block.alias("cut_blocks"), "rest").select(
        "place", "pass",
        F.when(F.col("pass") < F.col("passes"), F.expr("shiftleft(1L, bits)"))
        .when(F.col("rest") > 0, F.col("cut_blocks")).otherwise(0).alias("n"),
    ).where("n > 0")
    total = sources.agg(F.sum("target")).first()[0] or 0
    levels = max(0, int(total // shard_words)).bit_length()
    shards = _tree(quotas, levels, seed)
    upto = Window.partitionBy("place", "pass").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    owned = shards.withColumn("upto", F.sum("n").over(upto)).select(
        "place", "pass", "shard", F.explode(F.expr("sequence(upto - n, upto - 1)")).alias("block"))
    owners = materialise(
        owned.groupBy("place", "block").agg(F.map_from_entries(F.collect_list(F.struct("pass", "shard"))).alias("owner")),
        "owners",
    )

    part = (
        F.when((F.col("order") < F.col("cut")) & (F.col("rest") > 0), F.col("words"))
        .when((F.col("order") == F.col("cut")) & (F.col("at_cut") > 0),
              F.floor(F.col("words") * F.col("rest") / F.col("at_cut")).cast("long"))
        .otherwise(F.lit(0).cast("long"))
    )
    placed = counted.join(plans, of_group(counted, plans)).withColumn(
        "block", F.expr("shiftright(order, shift)")).withColumn("part", part)
    joined = placed.join(owners, ["place", "block"], "left")
    passes = F.filter(F.expr("sequence(0L, passes)"), lambda p: (p < F.col("passes")) | (F.col("part") > 0))
    copies = F.transform(passes, lambda p: F.struct(
        p.alias("pass"), F.element_at("owner", p).alias("shard"), F.xxhash64(*named, p, F.lit(seed + 1)).alias("key"),
        F.when(p < F.col("passes"), F.col("words")).otherwise(F.col("part")).alias("words"),
    ))
    return joined.select(
        "doc_id", "source", "text", F.col("words").alias("size"), "source_size", "target",
        (F.col("passes") * F.col("words") + F.col("part")).alias("taken"), copies.alias("copies"), *(["row"] if carry else []),
    )
