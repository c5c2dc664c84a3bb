"""Mixing sources to target weights by pivotal rounding of copy numbers.

Each source gets a share of words, and each of its documents the same expected
number of copies.  The fractions are rounded in pairs: words move at random from
one document to the other until one of the two has a whole number of copies, so a
source's words stay what they were.  Groups of documents are rounded in one fold
each, what is left of a group goes to the next level of a tree, up to one
document per source, which is rounded to the nearest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.joins import spread_join
from ..sources.scratch import written

#: Documents that one fold rounds, on average.
FAN_IN = 256
#: A word is a run of anything but the six separators.
WORD = "[^\\x20\\x09-\\x0D]+"


def text_size(text: Column) -> Column:
    """Number of words, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, *, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to one row per source (columns source, source_size).

    Sources in the order of their code points, NULL last, weigh ``weights``,
    repeating, and share ``share`` times all words; a target stops at ``most`` times
    its source, and what is above is shared again by weight among the others.  That
    is filling by level: sources are capped in the order of cap per weight for as
    long as the level, if all before are capped, is above theirs.  The windows see
    one row per source, not documents.
    """
    if share > most:
        raise ValueError("the sources cannot hold that share")
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weight).withColumn("_cap", most * F.col("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = ((share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / F.sum("_weight").over(after))
    ranked = ranked.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("_weight") <= F.col("_cap"))
    final = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("_open"), F.least(final * F.col("_weight"), F.col("_cap"))).otherwise(F.col("_cap"))
    return ranked.select("source", "source_size", target.alias("target"))


#: One step of the fold.  The hand holds the document that is still open: its words are
#: ``mass`` of ``size``.  Moving words to the new document takes a, moving them from it takes b
#: until one of both is whole; each is as likely as the other is long, so expectations stay.
_STEP = """
    (acc, x) -> if(acc.hand is null, named_struct('hand', x, 'out', acc.out),
      element_at(transform(array(named_struct(
          'a', least(acc.hand.mass, x.size - x.mass), 'b', least(x.mass, acc.hand.size - acc.hand.mass))), m ->
        if(((xxhash64(x.doc_id, x.size, acc.hand.doc_id, {seed}) & 9007199254740991L) / 9007199254740992D) * (m.a + m.b) < m.b,
          if(acc.hand.mass <= x.size - x.mass,
             named_struct('hand', {x_all}, 'out', array_append(acc.out, {hand_none})),
             named_struct('hand', {hand_less}, 'out', array_append(acc.out, {x_one}))),
          if(x.mass <= acc.hand.size - acc.hand.mass,
             named_struct('hand', {hand_all}, 'out', array_append(acc.out, {x_none})),
             named_struct('hand', {x_less}, 'out', array_append(acc.out, {hand_one}))))), 1))
"""
_FIELDS = ("size", "doc_id", "rows", "whole", "mass")
_ITEM = "struct<size:bigint,doc_id:bigint,rows:bigint,whole:bigint,mass:double>"


def _item(of: str, mass: str) -> str:
    values = {name: f"{of}.{name}" for name in _FIELDS} | {"mass": mass}
    return "named_struct(" + ", ".join(f"'{name}', {values[name]}" for name in _FIELDS) + ")"


def _fold(seed: int) -> str:
    """SQL of the fold over ``items``, the larger documents first; its result has ``hand`` and ``out``."""
    step = _STEP.format(
        seed=seed, x_all=_item("x", "x.mass + acc.hand.mass"), hand_none=_item("acc.hand", "0D"),
        hand_less=_item("acc.hand", "acc.hand.mass - m.a"), x_one=_item("x", "cast(x.size as double)"),
        hand_all=_item("acc.hand", "acc.hand.mass + x.mass"), x_none=_item("x", "0D"),
        x_less=_item("x", "x.mass - m.b"), hand_one=_item("acc.hand", "cast(acc.hand.size as double)"))
    return (f"aggregate(sort_array(items, false), named_struct('hand', cast(null as {_ITEM}), "
            f"'out', cast(array() as array<{_ITEM}>)), {step})")


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11,
                fan_in: int = FAN_IN) -> DataFrame:
    """Columns doc_id, source, size, source_size, target and taken (words the mix takes, copies counted) of every row.

    ``taken`` is a whole number of copies times the size, at most ``most`` copies
    rounded up.  A source's words differ from its target by less than one document.
    Draws are hashes of ids and ``seed``: reruns agree, however rows are dealt out.

    Rows of one id, source and size are one class from the first aggregation on and
    share its copies evenly; NULL ids are such classes too.  Empty and NULL texts
    take nothing, a source of only such texts has target 0.  Groups of about
    ``fan_in`` documents are chosen by hash within their source, so one source may
    hold nearly all rows; each level of the tree is a table in the shared folder.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                        text_size(F.col(text)).alias("size"))
    classes = written(plain.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-classes")
    sources = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("_n"))
    targets = source_targets(sources, weights=weights, share=share, most=most).join(
        sources.select(F.col("source").alias("_s"), "_n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    targets = written(targets, "mix-targets")

    def keyed(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_known", F.col("source").isNotNull()).withColumn("_key", F.coalesce("source", F.lit("")))

    rated = spread_join(keyed(classes), keyed(targets).drop("source"), ["_known", "_key"], "inner", ["doc_id", "size"])
    copies = F.col("rows") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = rated.withColumn("_copies", F.when(F.col("size") > 0, copies).otherwise(0.0)).withColumn("whole", F.floor("_copies"))
    rated = rated.withColumn("mass", (F.col("_copies") - F.col("whole")) * F.col("size"))
    carried = ["source", "source_size", "target"]
    rated = rated.select(*carried, F.greatest(F.lit(1), F.ceil(F.col("_n") / fan_in)).cast("long").alias("_groups"),
                         F.struct(*_FIELDS).alias("item"))
    rated = written(rated, "mix-items")
    decided = [rated.where("item.mass = 0").select(*carried, "item")]
    open_items, level = rated.where("item.mass > 0"), 0
    widest = rated.agg(F.max("_groups")).first()[0] or 0
    while widest:
        bucket = F.pmod(F.xxhash64("item.doc_id", "item.size", F.lit(seed + level)), F.col("_groups"))
        folded = (open_items.withColumn("_bucket", bucket).groupBy(*carried, "_groups", "_bucket")
                  .agg(F.collect_list("item").alias("items")).withColumn("done", F.expr(_fold(seed + 1000 * level))))
        folded = written(folded.select(*carried, "_groups", "done"), "mix-level")
        decided.append(folded.select(*carried, F.explode("done.out").alias("item")))
        fewer = F.greatest(F.lit(1), F.ceil(F.col("_groups") / fan_in)).cast("long")
        open_items = folded.select(*carried, fewer.alias("_groups"), F.col("done.hand").alias("item"))
        level, widest = level + 1, -(-widest // fan_in) if widest > 1 else 0
    decided.append(open_items.select(*carried, "item"))
    union = decided[0]
    for part in decided[1:]:
        union = union.unionByName(part)
    picked = F.col("item.whole") + F.when(2 * F.col("item.mass") >= F.col("item.size"), 1).otherwise(0)
    picked = F.when(F.col("item.size") > 0, picked).otherwise(0)
    # The rows of a class share its copies: the first ones of them have one more.
    spread = union.withColumn("_picked", picked.cast("long")).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("item.rows"))))
    each = F.floor(F.col("_picked") / F.col("item.rows")) + F.when(F.col("_row") <= F.pmod("_picked", F.col("item.rows")), 1).otherwise(0)
    return spread.select(F.col("item.doc_id").alias("doc_id"), "source", F.col("item.size").alias("size"), "source_size",
                         "target", (each * F.col("item.size")).cast("long").alias("taken"))
