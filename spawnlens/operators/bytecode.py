"""Set-based code analysis: instructions, blocks, edges, reachability and creations as rows, by windows within a code.

Rows per code are many, so these are for reports over distinct codes; verdicts at scale come from the kernel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evm

KEY = "bytecode_hash"
#: Characters of codes that are dealt to a task, some 40 MB of instruction rows; row numbers that are broadcast at most (8 bytes each).
AT_ONCE, MOST = 1 << 19, 1 << 22


def _by(*more: str):
    return Window.partitionBy(KEY, *more).orderBy("i")


def _to_here():
    return _by().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _blocks():
    return Window.partitionBy(KEY).orderBy("blk")


def distinct_codes(contracts: DataFrame, code_col: str = "code") -> DataFrame:
    """Each code once, with its hash; analysis cost is by distinct code."""
    return contracts.where(F.col(code_col).isNotNull()).select(F.col(code_col).alias("code")).distinct().withColumn(KEY, evm.bytecode_hash(F.col("code")))


def codes_once(contracts: DataFrame, by: list[str], keep: Callable[[DataFrame], DataFrame], code_col: str = "code", most: int = MOST) -> DataFrame:
    """distinct_codes, stored. Of the contracts of one code that with the least hash of the columns `by` stands for all: these are found by digests, and only their codes are
    shuffled, instead of those of each task. Contracts that share such a hash only send some codes more. With over `most` codes all are shuffled.

    keep: writes rows and reads them again.
    """
    row, own = F.xxhash64(*by), contracts.where(F.col(code_col).isNotNull())
    first = keep(own.select(F.unhex(F.sha2(code_col, 256)).alias("_k"), row.alias("_row")).groupBy("_k").agg(F.min("_row").alias("_row")).select("_row"))
    if first.count() <= most:
        own = own.join(F.broadcast(first), row == F.col("_row"), "left_semi")
    return keep(distinct_codes(own, code_col))


def dealt(codes: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """Codes by key in as many tasks as their characters ask for, so that what a task sorts does not grow with their number; one code is in one task. Instructions of these
    stay where they are, no window over a key shuffles them. codes are read twice, so they should be stored."""
    size = codes.agg(F.sum(F.length("code"))).first()[0] or 0
    return codes.repartition(max(1, -(-size // at_once)), KEY)


def instruction_rows(codes: DataFrame) -> DataFrame:
    """key, i, op, operand (hex), pc, n (instructions of the code)."""
    rows = codes.select(KEY, F.posexplode(evm.instructions(F.col("code"))).alias("i", "t"))
    width = F.floor(F.length("t") / 2).cast("int")
    return rows.select(KEY, "i", F.substring("t", 1, 2).alias("op"), F.substring("t", 3, 64).alias("operand"), (F.sum(width).over(_to_here()) - width).cast("int").alias("pc"), F.count("*").over(Window.partitionBy(KEY)).alias("n"))


def with_blocks(rows: DataFrame) -> DataFrame:
    """Adds blk, the block's number, and stops, the stopping opcodes up to here in the block."""
    before = F.lag("op").over(_by())
    starts = (F.col("i") == 0) | (F.col("op") == evm.JUMPDEST) | (before.isin(evm.ENDS_BLOCK) & (F.col("pc") < F.col("n")))
    numbered = rows.withColumn("blk", (F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(_to_here()) - 1).cast("int"))
    inside = Window.partitionBy(KEY, "blk").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.withColumn("stops", F.sum(F.col("op").isin(evm.STOPS).cast("int")).over(inside))


def block_rows(rows: DataFrame) -> DataFrame:
    """key, blk, start_pc, end_pc, n_instructions, first_op, last_op, last_jump (pc of the last instruction), contains_create, contains_create2, next_pc, n_jumpdests."""
    grouped = rows.groupBy(KEY, "blk").agg(
        F.min("pc").alias("start_pc"), F.max("pc").alias("last_pc"), F.count("*").alias("n_instructions"), F.min_by("op", "i").alias("first_op"), F.max_by("op", "i").alias("last_op"),
        F.bool_or(F.col("op") == evm.CREATE).alias("contains_create"), F.bool_or(F.col("op") == evm.CREATE2).alias("contains_create2"),
    )
    whole = Window.partitionBy(KEY)
    return (
        grouped.withColumn("next_pc", F.lead("start_pc").over(_blocks()))
        .withColumn("end_pc", F.coalesce(F.col("next_pc") - 1, "last_pc"))
        .withColumn("n_jumpdests", F.sum((F.col("first_op") == evm.JUMPDEST).cast("int")).over(whole))
        .withColumnRenamed("last_pc", "last_jump")
    )


def falls(last_op: Column) -> Column:
    return ~last_op.isin(evm.BREAKS)


def jumps(last_op: Column) -> Column:
    return last_op.isin(evm.JUMP, evm.JUMPI)


def _falls_to() -> Column:
    return F.when(falls(F.col("last_op")), F.col("next_pc"))


def _n_successors() -> Column:
    to, next_is_dest = _falls_to(), F.lead("first_op").over(_blocks()) == evm.JUMPDEST
    n = F.when(jumps(F.col("last_op")), F.col("n_jumpdests") + F.when(to.isNotNull() & ~next_is_dest, 1).otherwise(0)).when(to.isNotNull(), 1).otherwise(0)
    return n.cast("bigint")


def edge_summary(blocks: DataFrame) -> DataFrame:
    """Each block's outgoing edges without the cross product of jumps and destinations: where it falls to, whether it jumps, and its successors' number."""
    return blocks.select(KEY, "start_pc", _falls_to().alias("falls_to"), jumps(F.col("last_op")).alias("jumps"), _n_successors().alias("n_successors"))


def reachability(blocks: DataFrame) -> DataFrame:
    """Adds reachable, by the closed form: islands of blocks that fall through, all entered at JUMPDESTs once the first island jumps."""
    before = _blocks().rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("island", F.coalesce(F.sum((~falls(F.col("last_op"))).cast("int")).over(before), F.lit(0)))
    jumped = placed.withColumn("any_jump", F.max((jumps(F.col("last_op")) & (F.col("island") == 0)).cast("int")).over(Window.partitionBy(KEY)))
    seed = (F.col("blk") == 0) | ((F.col("first_op") == evm.JUMPDEST) & (F.col("any_jump") == 1))
    within = Window.partitionBy(KEY, "island").orderBy("blk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return jumped.withColumn("reachable", F.max(seed.cast("int")).over(within) == 1).drop("any_jump")


def block_info(blocks: DataFrame) -> DataFrame:
    """One row a block: start_pc, end_pc, n_instructions, contains_create, contains_create2, reachable, n_successors, n_predecessors.

    Neighbours are counted, not spelt out: every jump leads to every JUMPDEST, so their lists grow with the square of a code.
    """
    whole, last = Window.partitionBy(KEY), F.col("last_op")
    before_falls, before_jumps = F.lag(falls(last)).over(_blocks()), F.lag(jumps(last)).over(_blocks())
    is_dest = F.col("first_op") == evm.JUMPDEST
    from_jumps = F.when(is_dest, F.sum(jumps(last).cast("int")).over(whole)).otherwise(0)
    from_fall = F.coalesce((before_falls & ~(is_dest & before_jumps)).cast("int"), F.lit(0))
    counted = reachability(blocks).withColumns({"n_predecessors": (from_jumps + from_fall).cast("bigint"), "n_successors": _n_successors()})
    return counted.select(KEY, "start_pc", "end_pc", "n_instructions", "contains_create", "contains_create2", "reachable", "n_predecessors", "n_successors")


def verified(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """key, pc, op of creations in reachable blocks before what stops them."""
    alive = rows.where(F.col("op").isin(evm.CREATE, evm.CREATE2) & (F.col("stops") == 0))
    return alive.join(blocks.where("reachable").select(KEY, "blk"), [KEY, "blk"]).select(KEY, "pc", "op")


def static_targets(rows: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """key, blk, jump_pc, target_pc: JUMPDESTs pushed by one of the five instructions before a jump. blocks: the rows' blocks, if they are there; each JUMPDEST starts one."""
    recent = F.collect_list(F.when(F.col("op").between("60", "7f") & (F.col("operand") != ""), F.col("operand"))).over(_by().rowsBetween(-5, -1))
    at = rows.withColumn("pushed", recent).where(jumps(F.col("op"))).select(KEY, "blk", F.col("pc").alias("jump_pc"), F.explode("pushed").alias("operand"))
    # Operands of more digits than an address can have are no targets; leading zeros are.
    short = F.regexp_replace("operand", "^0+", "")
    value = F.when(F.length(short) <= 7, F.coalesce(F.conv(F.when(short == "", "0").otherwise(short), 16, 10).cast("int"), F.lit(-1)))
    dests = rows.where(F.col("op") == evm.JUMPDEST).select(KEY, F.col("pc").alias("target_pc")) if blocks is None else blocks.where(F.col("first_op") == evm.JUMPDEST).select(KEY, F.col("start_pc").alias("target_pc"))
    return at.select(KEY, "blk", "jump_pc", value.alias("target_pc")).distinct().join(dests, [KEY, "target_pc"]).select(KEY, "blk", "jump_pc", "target_pc")


def enhanced_edges(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """key, start_pc, kind, dst_pc: fall, static (to pushed JUMPDESTs), or all (to every JUMPDEST, not spelt out)."""
    fall = blocks.where(falls(F.col("last_op")) & F.col("next_pc").isNotNull()).select(KEY, "start_pc", F.lit("fall").alias("kind"), F.col("next_pc").alias("dst_pc"))
    # Only a block's last instruction gives it edges; jumps inside blocks that late terminators do not split give none.
    ends = blocks.where(jumps(F.col("last_op"))).select(KEY, "blk", "start_pc", "last_jump")
    known = targets.select(KEY, F.col("jump_pc").alias("last_jump"), "target_pc")
    joined = ends.join(known, [KEY, "last_jump"], "left")
    return fall.unionByName(joined.select(KEY, "start_pc", F.when(F.col("target_pc").isNull(), "all").otherwise("static").alias("kind"), F.col("target_pc").alias("dst_pc")))


def creation_context(rows: DataFrame) -> DataFrame:
    """key, pc, kept: CREATEs before what stops their block, and whether no abort is near them."""
    w = Window.partitionBy(KEY, "blk").orderBy("i")
    near = F.collect_list("op").over(w.rowsBetween(-10, 4))
    size = F.count("*").over(Window.partitionBy(KEY, "blk"))
    aborts = F.coalesce(F.lead("op").over(w).isin("fd", "fe"), F.lit(False)) | F.array_contains(near, "ff") | ((size < 3) & F.array_contains(near, "fd"))
    return rows.withColumn("kept", ~aborts).where((F.col("op") == evm.CREATE) & (F.col("stops") == 0)).select(KEY, "pc", "kept")
