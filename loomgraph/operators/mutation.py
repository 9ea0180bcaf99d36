"""Graph mutations from an ordered log ``txn_id, op_seq, op, v, e, value, weight``.

Operations are FIND, INSERT, DELETE (vertex ``v``) and INSERT_EDGE, DELETE_EDGE (``v`` to ``e``).  A single operation sees all
before it.  A transaction is checked against the state before it: it doesn't see its own changes.  Deleting a
vertex takes its edges along, and inserting it again doesn't bring them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.store import settle

VERTEX_OPS, EDGE_OPS = ("INSERT", "DELETE"), ("INSERT_EDGE", "DELETE_EDGE")
OPS = ("FIND", *VERTEX_OPS, *EDGE_OPS)
LOG = "txn_id long, op_seq long, op string, v long, e long, value long, weight long"


def checked(log: DataFrame) -> DataFrame:
    """The log, with an error at the first unknown operation or missing operand."""
    whole = F.col("op").isin(*OPS) & F.col("v").isNotNull() & (~F.col("op").isin(*EDGE_OPS) | F.col("e").isNotNull())
    said = F.raise_error(F.concat(F.lit("operation not allowed: "), F.coalesce("op", F.lit("null")))).cast("string")
    return log.withColumn("op", F.when(F.coalesce(whole, F.lit(False)), F.col("op")).otherwise(said))


def both_directions(log: DataFrame) -> DataFrame:
    """Insertions of edges also in the other direction, right after."""
    turned = log.filter("op = 'INSERT_EDGE' and v <> e").withColumns({"v": F.col("e"), "e": F.col("v")})
    return log.withColumn("op_seq", F.col("op_seq") * 2).unionByName(turned.withColumn("op_seq", F.col("op_seq") * 2 + 1))


def _as_of(vertices: DataFrame, log: DataFrame) -> DataFrame:
    """The edge operations and finds with ``v_there, e_there`` (existence before the operation) and ``v_cut, e_cut`` (number of
    the last deletion before it).  One window per vertex over its own history."""
    history = vertices.select("id", F.lit(-1).cast("long").alias("at"), F.lit(True).alias("there"), F.lit(None).cast("string").alias("side"))
    history = history.union(log.filter(F.col("op").isin(*VERTEX_OPS)).select("v", "op_seq", F.col("op") == "INSERT", F.lit("own")))
    probes = log.filter(F.col("op") != "INSERT").select("v", "op_seq", F.lit(None).cast("boolean"), F.lit("v"))
    probes = probes.union(log.filter(F.col("op") == "INSERT").select("v", "op_seq", F.lit(None).cast("boolean"), F.lit("v")))
    probes = probes.union(log.filter(F.col("op").isin(*EDGE_OPS)).select("e", "op_seq", F.lit(None).cast("boolean"), F.lit("e")))
    before = Window.partitionBy("id").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    seen = history.union(probes).select(
        "*",
        F.max(F.when(F.col("there").isNotNull(), F.struct("at", "there"))).over(before).alias("last"),
        F.max(F.when(~F.col("there"), F.col("at"))).over(before).alias("cut"),
    )
    seen = seen.filter(F.col("side").isin("v", "e")).select("side", "at", F.coalesce("last.there", F.lit(False)).alias("is"), F.coalesce("cut", F.lit(-1).cast("long")).alias("cut"))
    wide = seen.groupBy(F.col("at").alias("op_seq")).agg(
        F.max(F.when(F.col("side") == "v", F.col("is"))).alias("v_there"), F.max(F.when(F.col("side") == "e", F.col("is"))).alias("e_there"),
        F.max(F.when(F.col("side") == "v", F.col("cut"))).alias("v_cut"), F.max(F.when(F.col("side") == "e", F.col("cut"))).alias("e_cut"),
    )
    return log.join(wide, "op_seq")


def op_results(vertices: DataFrame, edges: DataFrame, log: DataFrame) -> DataFrame:
    """``txn_id, op_seq, op, v, e, status, message`` of each operation on its own, in the order of ``op_seq`` (unique)."""
    seen = _as_of(vertices, checked(log))
    pair = seen.filter(F.col("op").isin(*EDGE_OPS))
    effective = F.col("v_there") & F.col("e_there")
    known = edges.select(F.col("src").alias("v"), F.col("dst").alias("e"), F.lit(-1).cast("long").alias("op_seq"), F.lit(True).alias("made"))
    history = known.unionByName(pair.filter(effective).select("v", "e", "op_seq", (F.col("op") == "INSERT_EDGE").alias("made")))
    w = Window.partitionBy("v", "e").orderBy("op_seq").rangeBetween(Window.unboundedPreceding, -1)
    probe = pair.select("v", "e", "op_seq", F.lit(None).cast("boolean").alias("made"), F.lit(1).alias("probe"))
    had = history.withColumn("probe", F.lit(None).cast("int")).unionByName(probe).select("op_seq", "probe", F.max(F.when(F.col("made").isNotNull(), F.struct("op_seq", "made"))).over(w).alias("last")).filter("probe = 1").select("op_seq", "last")
    all_ = seen.join(had, "op_seq", "left")
    edge_there = F.coalesce(F.col("last.made") & (F.col("last.op_seq") >= F.greatest("v_cut", "e_cut")), F.lit(False))
    op, there = F.col("op"), F.coalesce("v_there", F.lit(False))
    ends = there & F.coalesce("e_there", F.lit(False))
    status = (
        F.when(op == "FIND", F.when(there, "Found").otherwise("Fail"))
        .when(op == "INSERT", F.when(there, "Success").otherwise("Inserted"))
        .when(op == "DELETE", F.when(there, "Deleted").otherwise("Fail"))
        .when(op == "INSERT_EDGE", F.when(ends & ~edge_there, "Inserted").otherwise("Fail"))
        .otherwise(F.when(ends & edge_there, "Deleted").otherwise("Fail"))
    )
    message = F.when(op.isin("FIND", "DELETE") & ~there, "vertex not found").when(op.isin(*EDGE_OPS) & ~ends, "vertex not found").when((op == "INSERT_EDGE") & edge_there, "edge exists").when((op == "DELETE_EDGE") & ~edge_there, "edge not found")
    return all_.select("txn_id", "op_seq", "op", "v", "e", status.alias("status"), message.alias("message"))


def _final_vertices(vertices: DataFrame, log: DataFrame) -> DataFrame:
    history = vertices.select("id", F.lit(-1).cast("long").alias("at"), F.lit(True).alias("there")).union(log.filter(F.col("op").isin(*VERTEX_OPS)).select("v", "op_seq", F.col("op") == "INSERT"))
    return history.groupBy("id").agg(F.max_by("there", "at").alias("there")).filter("there").select("id")


def _final_edges(edges: DataFrame, log: DataFrame, effective: DataFrame) -> DataFrame:
    made = edges.select("src", "dst", "weight", F.lit(-1).cast("long").alias("at"), F.lit(True).alias("made"))
    made = made.union(effective.select("v", "e", "weight", "op_seq", F.col("op") == "INSERT_EDGE"))
    last = made.groupBy("src", "dst").agg(F.max(F.struct("at", "made", "weight")).alias("l")).filter("l.made").select("src", "dst", F.col("l.weight").alias("weight"), F.col("l.at").alias("at"))
    cuts = log.filter("op = 'DELETE'").groupBy(F.col("v").alias("id")).agg(F.max("op_seq").alias("cut"))
    for end in ("src", "dst"):
        last = last.join(cuts.select(F.col("id").alias(end), F.col("cut").alias(f"{end}_cut")), end, "left")
    alive = (F.coalesce("src_cut", F.lit(-2)) < F.col("at")) & (F.coalesce("dst_cut", F.lit(-2)) < F.col("at"))
    return last.filter(alive).select("src", "dst", "weight")


def apply_ops(vertices: DataFrame, edges: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges after every operation on its own, in the order of ``op_seq``; no loop, only windows.

    An edge operation counts if both ends exist when it comes; the last one of a pair decides."""
    log = checked(log)
    seen = _as_of(vertices, log.filter(F.col("op") != "FIND"))
    effective = seen.filter(F.col("op").isin(*EDGE_OPS) & F.col("v_there") & F.col("e_there"))
    return _final_vertices(vertices, log), _final_edges(edges, log, effective)


def apply_txn(vertices: DataFrame, edges: DataFrame, ops: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One transaction: vertices and edges after it, and one row ``committed, failed`` (failed operations).

    It aborts if a find misses; if ``strict``, if any operation fails.  All are judged by the state before it."""
    ops = checked(ops)
    ids = vertices.select("id")
    there = ops.join(ids.select(F.col("id").alias("v"), F.lit(True).alias("v_there")), "v", "left").join(ids.select(F.col("id").alias("e"), F.lit(True).alias("e_there")), "e", "left")
    there = there.join(edges.select(F.col("src").alias("v"), F.col("dst").alias("e"), F.lit(True).alias("edge")), ["v", "e"], "left")
    v, e, edge = (F.coalesce(c, F.lit(False)) for c in ("v_there", "e_there", "edge"))
    op = F.col("op")
    fails = F.when(op.isin("FIND", "DELETE"), ~v).when(op == "INSERT_EDGE", ~(v & e) | edge).when(op == "DELETE_EDGE", ~edge).otherwise(False)
    there = settle(there.select("txn_id", "op_seq", "op", "v", "e", "weight", (v & e).alias("ends"), fails.alias("fails")))
    said = there.agg(F.coalesce(F.max(F.col("fails") & (F.lit(True) if strict else F.col("op") == "FIND")), F.lit(False)).alias("abort"), F.coalesce(F.sum(F.col("fails").cast("long")), F.lit(0)).alias("failed"))
    said = settle(said.select((~F.col("abort")).alias("committed"), "failed"))
    if not said.first().committed:
        return vertices, edges, said
    effective = there.filter(F.col("op").isin(*EDGE_OPS) & F.col("ends") & ((F.col("op") == "DELETE_EDGE") | ~F.col("fails")))
    return settle(_final_vertices(vertices, there)), settle(_final_edges(edges, there, effective)), said


def _vertices_before(vertices: DataFrame, log: DataFrame) -> DataFrame:
    """``id, txn_id``, one row for each vertex that a transaction names, with ``is`` (existence before it), ``cut`` (number of its
    last deletion in it) and ``cut_txn`` (the last transaction before it with one).  Only ``live`` operations count."""
    mine = F.col("live") & F.col("op").isin(*VERTEX_OPS)
    named = log.select(F.col("v").alias("id"), "txn_id", F.when(mine, F.struct("op_seq", (F.col("op") == "INSERT").alias("there"))).alias("last"), F.when(mine & (F.col("op") == "DELETE"), F.col("op_seq")).alias("cut"))
    ends = log.filter(F.col("op").isin(*EDGE_OPS)).select(F.col("e").alias("id"), "txn_id", F.lit(None).alias("last"), F.lit(None).alias("cut"))
    first = vertices.select("id", F.lit(None).alias("txn_id"), F.struct(F.lit(-1).cast("long").alias("op_seq"), F.lit(True).alias("there")).alias("last"), F.lit(None).alias("cut"))
    states = named.union(ends).union(first).groupBy("id", "txn_id").agg(F.max("last").alias("last"), F.max("cut").alias("cut"))
    w = Window.partitionBy("id").orderBy(F.asc_nulls_first("txn_id")).rowsBetween(Window.unboundedPreceding, -1)
    there = F.coalesce(F.last("last.there", ignorenulls=True).over(w), F.lit(False))
    cut_txn = F.last(F.when(F.col("cut").isNotNull(), F.col("txn_id")), ignorenulls=True).over(w)
    return states.select("id", "txn_id", there.alias("is"), "cut", cut_txn.alias("cut_txn")).filter("txn_id is not null")


def _pairs_before(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``v, e, txn_id``, one row for each pair that a transaction names (none: as given), with ``before, after`` (existence of
    the edge before and after it) and its ``weight`` after it.

    A transaction maps absent and present to a state each: it sets, keeps or turns.  So the state is the last one set,
    turned as often as asked since."""
    insert = F.col("op") == "INSERT_EDGE"
    first = edges.groupBy(F.col("src").alias("v"), F.col("dst").alias("e")).agg(F.max("weight").alias("weight"))
    first = first.select("v", "e", F.lit(None).cast("long").alias("txn_id"), "weight", F.lit(None).cast("long").alias("cut_txn"), F.lit(True).alias("if_absent"), F.lit(True).alias("if_there"))
    did = pairs.groupBy("v", "e", "txn_id").agg(
        F.max(F.struct("op_seq", insert.alias("made"), "weight")).alias("last"), F.max(~insert).alias("deletes"), F.first("ends").alias("ends"),
        F.first("live").alias("live"), F.first("cut").alias("cut"), F.first("cut_txn").alias("cut_txn"),
    )
    counts = F.col("live") & F.col("ends")
    if_absent = counts & F.col("last.made") & (F.col("cut").isNull() | (F.col("cut") < F.col("last.op_seq")))
    if_there = ~(counts & F.col("deletes")) & F.col("cut").isNull()
    steps = first.unionByName(did.select("v", "e", "txn_id", "last.weight", "cut_txn", if_absent.alias("if_absent"), if_there.alias("if_there")))
    w = Window.partitionBy("v", "e").orderBy(F.asc_nulls_first("txn_id"))
    until = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a vertex deleted since the pair was last named takes the edge along
    lost = F.col("cut_txn").isNotNull() & (F.lag("txn_id").over(w).isNull() | (F.col("cut_txn") > F.lag("txn_id").over(w)))
    steps = steps.withColumn("lost", lost).withColumn("if_was", F.when(F.col("lost"), F.col("if_absent")).otherwise(F.col("if_there")))
    steps = steps.withColumn("turns", F.sum((F.col("if_absent") & ~F.col("if_was")).cast("long")).over(until))
    steps = steps.withColumn("set", F.last(F.when(F.col("if_absent") == F.col("if_was"), F.struct(F.col("if_absent").alias("to"), "turns")), ignorenulls=True).over(until))
    odd = (F.col("turns") - F.coalesce("set.turns", F.lit(0))) % 2 == 1
    steps = steps.withColumn("after", F.coalesce("set.to", F.lit(False)) != odd)
    steps = steps.withColumn("before", ~F.col("lost") & F.coalesce(F.lag("after").over(w), F.lit(False)))
    made = F.last(F.when(~F.col("before") & F.col("after"), F.struct("weight")), ignorenulls=True).over(until)
    return steps.select("v", "e", "txn_id", "before", "after", made["weight"].alias("weight"))


def _judged(vertices: DataFrame, edges: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with ``fails`` of each operation, and the pairs as of :func:`_pairs_before`, if just ``live`` operations count."""
    seen = _vertices_before(vertices, log)
    for end in ("v", "e"):
        log = log.join(seen.select(F.col("id").alias(end), "txn_id", F.col("is").alias(f"{end}_is"), F.col("cut").alias(f"{end}_cut"), F.col("cut_txn").alias(f"{end}_txn")), [end, "txn_id"], "left")
    ends = F.col("v_is") & F.coalesce("e_is", F.lit(False))
    log = log.select("txn_id", "op_seq", "op", "v", "e", "weight", "live", "v_is", ends.alias("ends"), F.greatest("v_cut", "e_cut").alias("cut"), F.greatest("v_txn", "e_txn").alias("cut_txn"))
    pairs = _pairs_before(edges, log.filter(F.col("op").isin(*EDGE_OPS)))
    log = log.join(pairs.select("v", "e", "txn_id", F.col("before").alias("edge")), ["v", "e", "txn_id"], "left")
    op, edge = F.col("op"), F.coalesce("edge", F.lit(False))
    fails = F.when(op.isin("FIND", "DELETE"), ~F.col("v_is")).when(op == "INSERT_EDGE", ~F.col("ends") | edge).when(op == "DELETE_EDGE", ~edge).otherwise(False)
    return log.select("txn_id", "op", fails.alias("fails")), pairs


def apply_txns(vertices: DataFrame, edges: DataFrame, log: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transactions in the order of ``txn_id``: vertices and edges after the last, and ``txn_id, txn_status, failed``.

    Each depends on the state that the one before leaves, but windows find the states before all of them at once if
    it is known which ones abort.  At first none is taken to; each round judges all by the aborts of the round before, until
    they stay the same.  As a judgement depends on earlier transactions only, round k is right up to the k-th transaction
    at least, so there is one answer; rounds follow the longest chain of aborts that depend on each other."""
    log = settle(checked(log).filter("txn_id is not null"))
    vertices, edges = settle(vertices.select("id")), settle(edges.select("src", "dst", F.col("weight").cast("long").alias("weight")))
    aborted = log.select("txn_id").limit(0)
    while True:
        live = log.join(aborted.withColumn("out", F.lit(True)), "txn_id", "left").withColumn("live", F.col("out").isNull())
        judged, pairs = _judged(vertices, edges, live)
        said = judged.groupBy("txn_id").agg(F.max(F.col("fails") & (F.lit(True) if strict else F.col("op") == "FIND")).alias("abort"), F.sum(F.col("fails").cast("long")).alias("failed"))
        said = settle(said)
        found = said.filter("abort").select("txn_id")
        if found.exceptAll(aborted).isEmpty() and aborted.exceptAll(found).isEmpty():
            break
        aborted = found
    done = live.filter("live")
    history = vertices.select("id", F.lit(None).cast("long").alias("txn_id"), F.lit(None).cast("long").alias("op_seq"), F.lit(True).alias("there"))
    history = history.union(done.filter(F.col("op").isin(*VERTEX_OPS)).select("v", "txn_id", "op_seq", F.col("op") == "INSERT"))
    left = history.groupBy("id").agg(F.max(F.struct("txn_id", "op_seq", "there")).alias("last")).filter("last.there").select("id")
    pair = pairs.groupBy(F.col("v").alias("src"), F.col("e").alias("dst")).agg(F.max(F.struct("txn_id", "after", "weight")).alias("last")).filter("last.after")
    cuts = done.filter("op = 'DELETE'").groupBy(F.col("v").alias("id")).agg(F.max("txn_id").alias("cut"))
    for end in ("src", "dst"):
        pair = pair.join(cuts.select(F.col("id").alias(end), F.col("cut").alias(f"{end}_cut")), end, "left")
        pair = pair.filter(F.col(f"{end}_cut").isNull() | F.coalesce(F.col(f"{end}_cut") <= F.col("last.txn_id"), F.lit(False)))
    status = F.when(F.col("abort"), "Aborted").otherwise("Committed")
    return settle(left), settle(pair.select("src", "dst", F.col("last.weight").alias("weight"))), said.select("txn_id", status.alias("txn_status"), "failed")


def seq_of(*order: Column) -> Column:
    """Operation numbers of a log that has only an order; one sort of the whole log."""
    return F.row_number().over(Window.orderBy(*order)).cast("long")
