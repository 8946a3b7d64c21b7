"""Sharding by balanced label propagation, with DataFrame operations only.

Documents with equal texts are linked. Each document begins in a shard drawn from its row, then
rounds of Spark joins move linked documents towards the shard in which most of their neighbours are,
under capacity quotas: a shard takes no more rows than its quota leaves free. Documents of one group
in one shard are alike, so the state of a round is a table of (group, shard, rows) cells - 40 cells at
most for the largest group - and never holds links or one row per copy. When no cell moves any more,
linked documents stay where propagation put them and unlinked ones fill the quotas, which makes the
law exact: the row counts of any two shards differ by at most one, and a group is cut only if it
does not fit.

Law: `rows`. Size of a row: UTF-8 bytes of its text (null: none) plus 16.

Defined results: null texts are one group, as are empty texts; repeated rows are linked copies; rows
with a null doc_id are placed like others; an empty table gives no row; fewer rows than shards leave
some shards empty; other columns are ignored. `slot` numbers the rows of a shard without gaps from 0.

Nothing is collected but the row counts of the shards. Numbering within a shard or group goes through
cells of (key, salt), so neither a hot group nor a shard is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import dropped, ranked, stored

SHARDS = 40
ROUNDS = 12
#: Cells that number the rows of one shard or group, and requests of one round.
SALTS = 64


def _draw(*columns: str):
    return F.xxhash64(*columns)


def quotas(n: int, shards: int) -> list[int]:
    """Rows that each shard must hold: equal, or one more for the first ones."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def _loads(cells: DataFrame, shards: int) -> list[int]:
    found = dict(cells.groupBy("shard").agg(F.sum("n")).collect())
    return [int(found.get(s, 0)) for s in range(shards)]


def _array(values: list[int]):
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def propagate(cells: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Move rows of (group, shard, n) cells towards each group's fullest shards while quotas last. Rows only go to
    a cell as large as theirs or larger, and some request is always granted, so the rounds end."""
    shards = len(quota)
    for _ in range(rounds):
        load = _loads(cells, shards)
        free = _array([max(0, q - x) for q, x in zip(quota, load)])
        # A group gathers in its fullest shards, as many as have the room for all of it. What lies in others asks
        # for that room, fullest shard first, at once: a large group does not take a round for each shard.
        room = F.element_at(free, F.col("shard") + 1)
        groups = cells.groupBy("g").agg(F.array_sort(F.collect_list(F.struct(
            (-F.col("n")).alias("less"), F.xxhash64("g", "shard").alias("tie"), "shard", "n", room.alias("room")))).alias("c"))
        reach = "aggregate(slice(c, 1, {}), 0L, (s, x) -> s + x.n{})"
        kept = f"size(filter(sequence(1, size(c)), i -> {reach.format('i', ' + x.room')} < {reach.format('size(c)', '')})) + 1"
        parted = groups.withColumn("kept", F.expr(kept)).select(
            "g", F.expr("slice(c, 1, kept)").alias("stay"), F.expr("slice(c, kept + 1, size(c))").alias("leave")).where("size(leave) > 0")
        span = "transform({0}, (x, i) -> struct(x.shard, x.n, aggregate(slice({0}, 1, i), 0L, (s, y) -> s + y.{1}) as a, x.{1} as w))"
        asking = parted.select("g", F.explode(F.expr(span.format("leave", "n"))).alias("f"), F.expr(span.format("stay", "room")).alias("to")).select(
            "g", "f", F.explode("to").alias("t"))
        requests = asking.select(
            "g", F.col("f.shard").alias("shard"), F.expr("least(f.a + f.w, t.a + t.w) - greatest(f.a, t.a)").alias("n"),
            F.col("t.shard").alias("to"), F.col("t.n").alias("pull"),
            F.pmod(F.xxhash64("g", F.lit(7)), F.lit(SALTS)).cast("int").alias("salt")).where("n > 0")
        asked = requests.groupBy("to", "salt").agg(F.sum("n").alias("sum"))
        upto = Window.partitionBy("to").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        shift = asked.select("to", "salt", F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("shift"))
        own = Window.partitionBy("to", "salt").orderBy(F.desc("pull"), "g", "shard").rowsBetween(
            Window.unboundedPreceding, -1)
        queued = requests.withColumn("ahead", F.coalesce(F.sum("n").over(own), F.lit(0))).join(shift, ["to", "salt"])
        left = F.element_at(free, F.col("to") + 1) - F.col("shift") - F.col("ahead")
        accepted = queued.select("g", "shard", "to", F.least("n", F.greatest(left, F.lit(0))).alias("m")).where("m > 0")
        moved = stored(accepted, "moves")
        if moved.isEmpty():
            break
        changes = moved.select("g", F.col("shard"), (-F.col("m")).alias("n")).unionByName(
            moved.select("g", F.col("to").alias("shard"), F.col("m").alias("n")))
        after = stored(cells.unionByName(changes).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"),
                       "cells")
        dropped(cells)
        dropped(moved)
        cells = after
    return cells


def balanced_shards(documents: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    text = F.col("text").cast("binary")
    slim = stored(documents.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("g"),
        F.monotonically_increasing_id().alias("rid")), "shard-rows")
    n = slim.count()
    quota = quotas(n, shards)
    first = F.pmod(_draw("rid"), F.lit(shards)).cast("int")

    drawn = slim.groupBy("g", first.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    linked = drawn.groupBy("g").agg(F.sum("n").alias("all")).where("`all` > 1").select("g")
    cells = stored(drawn.join(linked, "g").select("g", "shard", "n"), "cells")
    cells = propagate(_fitted(cells, quota), quota, rounds)

    # Which rows of a group go to which of its shards: the rows are numbered, and each cell takes an
    # interval of the numbers. The intervals ride with the (group, salt) shifts of the numbering.
    upto = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    intervals = cells.withColumn("a", F.coalesce(F.sum("n").over(upto), F.lit(0))).groupBy("g").agg(
        F.array_sort(F.collect_list(F.struct("a", "shard"))).alias("cells"))
    salted = slim.withColumn("salt", F.pmod(_draw("rid"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("g", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("g").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).join(intervals, "g").select(
        "g", "salt", "shift", "cells")
    numbered = salted.withColumn("own", F.row_number().over(Window.partitionBy("g", "salt").orderBy("rid")) - 1).join(
        shift, ["g", "salt"], "left")
    nth = F.col("own") + F.col("shift")
    placed = stored(numbered.select(
        "doc_id", "size", "text_crc32", "rid",
        F.element_at(F.filter("cells", lambda c: c["a"] <= nth), -1)["shard"].alias("held")), "shard-held")

    # Unlinked rows fill what the quotas leave.
    load = _loads(cells, shards)
    ends, total = [], 0
    for q, x in zip(quota, load):
        total += q - x
        ends.append(total)
    loose = ranked(placed.where("held is null"), [], [F.col("rid")], "nth", _draw("rid"), 1024)
    fill = F.size(F.filter(_array(ends), lambda e: e <= F.col("nth")))
    every = placed.where("held is not null").select("doc_id", "size", "text_crc32", "rid", F.col("held").alias("shard"))
    every = every.unionByName(loose.select("doc_id", "size", "text_crc32", "rid", fill.cast("int").alias("shard")))
    slots = ranked(every, ["shard"], [F.col("rid")], "slot", _draw("rid"), SALTS)
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def _fitted(cells: DataFrame, quota: list[int]) -> DataFrame:
    """Cells of which no shard holds more than its quota: the draw is even, yet a few linked rows may
    be too many where nearly all rows are linked. The excess of a shard goes to shards with room."""
    shards = len(quota)
    load = _loads(cells, shards)
    over = [max(0, x - q) for q, x in zip(quota, load)]
    if not any(over):
        return cells
    # Rows of each over-full shard are numbered by running sums; those in the last `over` leave.
    salt = F.pmod(F.xxhash64("g", F.lit(3)), F.lit(SALTS)).cast("int")
    dealt = cells.withColumn("salt", salt)
    sums = dealt.groupBy("shard", "salt").agg(F.sum("n").alias("sum"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("shard", "salt", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("shard", "salt").orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = dealt.withColumn("run", F.sum("n").over(within)).join(shift, ["shard", "salt"])
    leave = F.least("n", F.greatest(
        F.element_at(_array(over), F.col("shard") + 1) - (F.col("shift") + F.col("run") - F.col("n")), F.lit(0)))
    split = stored(run.select("g", "shard", "n", leave.alias("out"),
                              (F.col("shift") + F.col("run") - F.col("n")).alias("at")), "cells")
    room, spans, total = [max(0, q - x) for q, x in zip(quota, load)], [], 0
    for s, r in enumerate(room):
        if r:
            spans.append((total, total + r, s))
            total += r
    skipped = [sum(over[:s]) for s in range(shards)]
    begin = F.element_at(_array(skipped), F.col("shard") + 1) + F.col("at")
    leaving = split.where("out > 0").select("g", begin.alias("a"), (begin + F.col("out")).alias("b"))
    targets = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"),
                                 F.lit(s).alias("shard")) for a, b, s in spans])
    moved = leaving.withColumn("t", F.explode(targets)).select(
        "g", F.col("t.shard").alias("shard"),
        (F.least("b", F.col("t.b")) - F.greatest("a", F.col("t.a"))).alias("n")).where("n > 0")
    stay = split.select("g", "shard", (F.col("n") - F.col("out")).alias("n")).where("n > 0")
    out = stored(stay.unionByName(moved).groupBy("g", "shard").agg(F.sum("n").alias("n")), "cells")
    dropped(cells)
    dropped(split)
    return out


def op4_query(spark, sf_dir):
    from strataloom.llm.common import read_table

    return balanced_shards(read_table(spark, sf_dir, "documents"))
