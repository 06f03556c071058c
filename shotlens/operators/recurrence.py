"""A tie-break that remembers the stream's last choice, for streams of any length over many tasks.

What a run of rows does to the last choice is a function of it that needs little room: an outcome for a few ids (those that
stand in open ties), and one for all others, which is either a fixed id or "as before". Such functions compose, so blocks of
a stream are summed up apart from each other, a prefix over the sums gives the choice with which each block begins, and a
second pass makes the choices.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from shotlens.operators.places import in_blocks
from shotlens.session import materialise, ship

#: Rows of a block, and blocks whose effects are composed in one task.
BLOCK, FAN = 4096, 512
EFFECT = "struct<otherwise:string,ids:array<string>,gives:array<string>>"


class Effect:
    """From the last choice to the next last choice. `otherwise` None: as before; `given`: ids with another outcome."""

    def __init__(self, otherwise: str | None = None, given: dict[str, str] | None = None):
        self.otherwise, self.given = otherwise, given or {}

    def __call__(self, last: str) -> str:
        return self.given.get(last, last if self.otherwise is None else self.otherwise)

    def then(self, after: Effect) -> Effect:
        """First this, then `after`."""
        if self.otherwise is None:
            given = {k: after(k) for k in after.given} | {k: after(v) for k, v in self.given.items()}
            out = after.otherwise
        else:
            given, out = {k: after(v) for k, v in self.given.items()}, after(self.otherwise)
        return Effect(out, {k: v for k, v in given.items() if v != (k if out is None else out)})


def _rank(x) -> tuple:
    """The order of Spark: nulls first, NaN last."""
    return (0, 0) if x is None else (2, 0) if x != x else (1, x)


def winner(ties: Sequence[dict], last: str) -> int:
    """The place of the tie with the strictly largest (k1, k2, is the last choice, k4, k5), or -1."""
    if not ties:
        return -1
    keys = [(_rank(t["k1"]), _rank(t["k2"]), bool(last) and t["id"] == last, _rank(t["k4"]), _rank(t["k5"])) for t in ties]
    top = max(range(len(keys)), key=keys.__getitem__)
    return top if keys.count(keys[top]) == 1 else -1


def effect_of(fixed: bool, fixed_id: str | None, ties: Sequence[dict]) -> Effect:
    """What one row does: a fixed choice decides; else the ties, for each last choice that is among them and for others."""
    if fixed:
        return Effect(fixed_id or "")
    if not ties:
        return Effect()
    other = winner(ties, "")
    out = None if other < 0 else ties[other]["id"] or ""
    given = {}
    for own in {t["id"] for t in ties if t["id"]}:
        k = winner(ties, own)
        given[own] = own if k < 0 else ties[k]["id"] or ""
    return Effect(out, {k: v for k, v in given.items() if v != (k if out is None else out)})


def _effects(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, block and the block's effect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for rows in _each(b, "rows"):
                whole = Effect()
                for r in rows:
                    whole = whole.then(effect_of(r["fixed"], r["id"], r["ties"] or ()))
                found.append(_coded(whole))
            yield _with(b, ("rows",), effect=pa.array(found, _EFFECT))

    return _mapped(blocks.select(*keys, "block", "rows"), run, ("rows",), f"effect {EFFECT}")


_EFFECT = pa.struct([("otherwise", pa.string()), ("ids", pa.list_(pa.string())), ("gives", pa.list_(pa.string()))])


def _coded(e: Effect) -> dict:
    return {"otherwise": e.otherwise, "ids": list(e.given), "gives": list(e.given.values())}


def _decoded(x: dict) -> Effect:
    return Effect(x["otherwise"], dict(zip(x["ids"], x["gives"], strict=True)))


def _each(b: pa.RecordBatch, name: str) -> Iterator:
    """A column's values one at a time: a batch may have thousands of blocks, and as Python objects rows take many times
    their bytes."""
    for x in b.column(b.schema.get_field_index(name)):
        yield x.as_py()


def _with(b: pa.RecordBatch, without: Sequence[str], **more: pa.Array) -> pa.RecordBatch:
    kept = [n for n in b.schema.names if n not in without]
    return pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in kept), *more.values()], names=[*kept, *more])


def _mapped(df: DataFrame, run, without: Sequence[str], more: str) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without)
    return df.mapInArrow(run, f"{kinds}, {more}")


def _begins(effects: DataFrame, keys: Sequence[str], blocks: int) -> DataFrame:
    """keys, block and `last`, the choice with which each block begins: FAN blocks are composed at a time, their own
    beginnings are found in the same way, and each block's beginning follows from its group's."""
    effects = materialise(effects.sparkSession, effects, "effects")
    grouped = effects.withColumn("grp", F.floor(F.col("block") / FAN).cast("long")).groupBy(*keys, "grp").agg(F.sort_array(F.collect_list(F.struct("block", "effect"))).alias("parts"))
    if blocks <= FAN:
        begun = grouped.withColumn("last", F.lit(""))
    else:

        def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = []
                for parts in _each(b, "parts"):
                    whole = Effect()
                    for p in parts:
                        whole = whole.then(_decoded(p["effect"]))
                    found.append(_coded(whole))
                yield _with(b, ("parts",), effect=pa.array(found, _EFFECT))

        grouped = materialise(effects.sparkSession, grouped, "effects-in-groups")
        above = _begins(_mapped(grouped, compose, ("parts",), f"effect {EFFECT}").withColumnRenamed("grp", "block"), keys, -(-blocks // FAN))
        begun = _joined(grouped, above.withColumnRenamed("block", "grp"), [*keys, "grp"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lasts, numbers = [], []
            for parts, last in zip(_each(b, "parts"), _each(b, "last"), strict=True):
                mine = []
                for p in parts:
                    mine.append(last)
                    last = _decoded(p["effect"])(last)
                lasts.append(mine)
                numbers.append([p["block"] for p in parts])
            yield _with(b, ("parts", "last", "grp"), numbers=pa.array(numbers, pa.list_(pa.int64())), lasts=pa.array(lasts, pa.list_(pa.string())))

    out = _mapped(begun, walk, ("parts", "last", "grp"), "numbers array<long>, lasts array<string>")
    return out.select(*keys, F.explode(F.arrays_zip(F.col("numbers").alias("block"), F.col("lasts").alias("last"))).alias("x")).select(*keys, "x.block", "x.last")


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """An inner join in which nulls meet."""
    right = right.withColumnsRenamed({c: f"__{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(right, same).drop(*(f"__{c}" for c in on))


def carry_choice(df: DataFrame, keys: Sequence[str], order: Sequence[str], fixed: str, ties: str, block: int = BLOCK) -> DataFrame:
    """Each row's choice, with the last one of its stream as part of a tie's key.

    A row has `fixed`, a struct<id,...> or null, and `ties`, an array of struct<k1, k2, k4, k5, id, row> to choose from
    where fixed is null. The key of a tie is (k1, k2, id is the last choice, k4, k5); the largest wins if it is strictly
    larger than the second. Out: the keys, the order columns, chosen (struct or null) and by_tie.

    `order` must be total in a stream. A task holds one block of at most `block` rows; streams of one block need no prefix."""
    spark = df.sparkSession
    ship(spark)
    keys, order = list(keys), list(order)
    rows = df.select(*keys, *order, F.col(fixed).alias("__fixed"), F.coalesce(F.col(ties), F.array().cast(df.schema[ties].dataType)).alias("__ties"))
    if any(isinstance(f.dataType, MapType) for f in rows.schema):
        raise ValueError("choices are structs without maps")
    slim = F.transform("items", lambda x: F.struct(x["__fixed"].isNotNull().alias("fixed"), x["__fixed"]["id"].cast("string").alias("id"), F.transform(x["__ties"], lambda t: F.struct(t["k1"].alias("k1"), t["k2"].alias("k2"), t["k4"].alias("k4"), t["k5"].alias("k5"), t["id"].cast("string").alias("id"))).alias("ties")))
    blocks = materialise(spark, in_blocks(spark, rows, keys, order, block, "choices"), "choices").withColumn("rows", slim)
    most = blocks.agg(F.max("block")).head()[0] or 0
    if most:
        blocks = _joined(blocks, _begins(_effects(blocks, keys), keys, most + 1), [*keys, "block"])
    else:
        blocks = blocks.withColumn("last", F.lit(""))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            picks = []
            for rows_, last in zip(_each(b, "rows"), _each(b, "last"), strict=True):
                mine = []
                for r in rows_:
                    k = -1 if r["fixed"] else winner(r["ties"], last)
                    last = (r["id"] or "") if r["fixed"] else last if k < 0 else r["ties"][k]["id"] or ""
                    mine.append(k)
                picks.append(mine)
            yield _with(b, ("rows", "last"), picks=pa.array(picks, pa.list_(pa.int32())))

    done = _mapped(blocks.select(*keys, "items", "rows", "last"), choose, ("rows", "last"), "picks array<int>")
    each = done.select(*keys, F.explode(F.arrays_zip("items", "picks")).alias("x")).select(*keys, "x.items.*", F.col("x.picks").alias("__pick"))
    by_tie = F.col("__pick") >= 0
    chosen = F.when(by_tie, F.get("__ties", F.col("__pick"))["row"]).otherwise(F.col("__fixed"))
    return each.select(*keys, *order, chosen.alias("chosen"), by_tie.alias("by_tie"))
