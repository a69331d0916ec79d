"""Folds of ordered events: token streams, context under a budget, bounded memory, revisions of reviewed records."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def token_stream(steps: DataFrame, stream: str, step: str, token: str, end: int) -> DataFrame:
    """(stream, tokens, last_step, complete): the tokens of a stream in order of their steps.

    The end token is left out, and a step that comes again with the same token (as final events do) counts once; a step
    with two tokens makes the stream incomplete, as does a gap between steps or a missing end.  The last step is that of
    the last kept token.
    """
    once = steps.groupBy(stream, step).agg(F.min(token).alias("t"), F.max(token).alias("u"))
    rows = once.groupBy(stream).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), "t", "u"))).alias("x"))
    kept = F.filter("x", lambda y: y["t"] != end)
    whole = (F.size("x") == F.element_at("x", -1)["s"] - F.element_at("x", 1)["s"] + 1) & F.forall("x", lambda y: y["t"] == y["u"]) & (F.element_at("x", -1)["t"] == end)
    return rows.select(stream, F.transform(kept, lambda y: y["t"]).alias("tokens"), F.when(F.size(kept) > 0, F.element_at(kept, -1)["s"]).alias("last_step"), whole.alias("complete"))


def aligned(folded: DataFrame, finals: DataFrame, stream: str, tokens: str) -> DataFrame:
    """Adds ``aligned``: the final event of a stream tells the same tokens; false where there is none."""
    said = finals.select(stream, F.col(tokens).alias("__f"))
    return folded.join(said, stream, "left").withColumn("aligned", F.coalesce(F.col("__f") == F.col("tokens"), F.lit(False))).drop("__f")


def accounts(calls: DataFrame, task: str, order: str, tokens: str) -> DataFrame:
    """Adds ``n_calls`` and ``n_tokens``, the sums of a task up to each call; tokens that aren't told make the sum unknown
    from there on."""
    until = Window.partitionBy(task).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.count(tokens).over(until) == F.count("*").over(until)
    return calls.withColumn("n_calls", F.count("*").over(until)).withColumn("n_tokens", F.when(known, F.sum(tokens).over(until)))


def shed(items: DataFrame, context: str, rank: str, order: str, cost: str, budget: int, required: int = 0) -> DataFrame:
    """Adds ``kept`` and ``over_budget``: items go in order of falling rank, the last of a rank first, until the rest
    fits.  Items of the ``required`` rank never go, so that a context may stay over its budget."""
    going = Window.partitionBy(context).orderBy(F.desc(rank), F.desc(order))
    gone = F.coalesce(F.sum(F.when(F.col(rank) != required, F.col(cost)).otherwise(0)).over(going.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy(context)
    kept = (F.col(rank) == required) | (F.sum(cost).over(whole) - gone <= budget)
    marked = items.withColumn("kept", kept)
    return marked.withColumn("over_budget", F.sum(F.when(F.col("kept"), F.col(cost)).otherwise(0)).over(whole) > budget)


def within_length(records: DataFrame, topic: list[str], order: list[Column], text: str, most: int) -> DataFrame:
    """The first records of a topic whose texts together have at most ``most`` characters; none after the first that
    doesn't fit."""
    upto = Window.partitionBy(*topic).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("__l", F.sum(F.length(text)).over(upto)).filter(F.col("__l") <= most).drop("__l")


def revisions(edits: DataFrame, record: str, order: str, base: str, approve: str) -> DataFrame:
    """(record, order, accepted, revision, approved) of every edit, by optimistic concurrency.

    An edit is accepted if it is based on the record's revision at that time, and makes the next one; any accepted edit
    takes an approval back unless it is one itself.  The edits of a record are few, and are folded in one row.
    """
    listed = edits.groupBy(record).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(base).cast("int").alias("b"), F.coalesce(F.col(approve), F.lit(False)).alias("a")))).alias("e"))
    start = F.struct(F.lit(0).alias("r"), F.lit(False).alias("a"), F.array().cast(f"array<struct<o:{edits.schema[order].dataType.simpleString()},accepted:boolean,revision:int,approved:boolean>>").alias("log"))

    def step(s: Column, e: Column) -> Column:
        ok = F.coalesce(e["b"] == s["r"], F.lit(False))
        r, a = F.when(ok, s["r"] + 1).otherwise(s["r"]), F.when(ok, e["a"]).otherwise(s["a"])
        return F.struct(r.alias("r"), a.alias("a"), F.array_append(s["log"], F.struct(e["o"].alias("o"), ok.alias("accepted"), r.alias("revision"), a.alias("approved"))).alias("log"))

    folded = listed.select(record, F.explode(F.aggregate("e", start, step)["log"]).alias("x"))
    return folded.select(record, F.col("x.o").alias(order), "x.accepted", "x.revision", "x.approved")


def evaluation_status(approved: Column, complete: Column, tables: Column) -> Column:
    """What an evaluation may do with a reviewed record."""
    return F.when(tables == 0, "not_applicable").when(~F.coalesce(complete, F.lit(False)), "incomplete").when(F.coalesce(approved, F.lit(False)), "ready").otherwise("awaiting_approval")


SNAPSHOT = {"task": "string", "stage": "string", "n_calls": "bigint", "n_tokens": "bigint", "outcome": "string"}
STAGES = ("received", "searching", "calculating", "answered", "failed")


def snapshot_errors(snapshots: DataFrame) -> DataFrame:
    """(task, problem) of snapshots that no state can have: unknown stages, ends without an outcome, negative counts."""
    ended = F.col("stage").isin("answered", "failed")
    problems = F.array_compact(F.array(
        F.when(F.col("task").isNull(), "no task"), F.when(~F.coalesce(F.col("stage").isin(*STAGES), F.lit(False)), "unknown stage"), F.when(ended & F.col("outcome").isNull(), "no outcome"),
        F.when(~ended & F.col("outcome").isNotNull(), "outcome before the end"), F.when((F.col("n_calls") < 0) | (F.col("n_tokens") < 0), "negative count")))
    return snapshots.select("task", F.explode(problems).alias("problem"))


#: What an agent may do next at each stage.
MOVES = {"received": ("search", "answer", "fail"), "searching": ("search", "calculate", "answer", "fail"), "calculating": ("calculate", "answer", "fail"), "answered": (), "failed": ()}
AFTER = {"search": "searching", "calculate": "calculating", "answer": "answered", "fail": "failed"}


def agent_states(actions: DataFrame, task: str, order: str, action: str, most_calls: int) -> DataFrame:
    """(task, order, stage, n_calls, valid) after every action of a task, from ``received`` on.

    Calls are searches and calculations; one beyond ``most_calls``, or an action that the stage doesn't allow, is not
    valid and fails the task.  The actions of a task are bounded by its calls, and are folded in one row.
    """
    listed = actions.groupBy(task).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(action).alias("a")))).alias("x"))
    start = F.struct(F.lit("received").alias("s"), F.lit(0).alias("n"), F.array().cast(f"array<struct<o:{actions.schema[order].dataType.simpleString()},stage:string,n_calls:int,valid:boolean>>").alias("log"))

    def step(s: Column, e: Column) -> Column:
        allowed = F.coalesce(*[F.when(s["s"] == stage, e["a"].isin(*moves) if moves else F.lit(False)) for stage, moves in MOVES.items()], F.lit(False))
        call = F.coalesce(e["a"].isin("search", "calculate"), F.lit(False))
        ok = F.coalesce(allowed, F.lit(False)) & (~call | (s["n"] < most_calls))
        after = F.when(~ok, "failed").otherwise(F.coalesce(*[F.when(e["a"] == a, to) for a, to in AFTER.items()]))
        n = s["n"] + F.when(ok & call, 1).otherwise(0)
        return F.struct(after.alias("s"), n.alias("n"), F.array_append(s["log"], F.struct(e["o"].alias("o"), after.alias("stage"), n.alias("n_calls"), ok.alias("valid"))).alias("log"))

    folded = listed.select(task, F.explode(F.aggregate("x", start, step)["log"]).alias("y"))
    return folded.select(task, F.col("y.o").alias(order), "y.stage", "y.n_calls", "y.valid")
