"""Session state: slots that carry forward, last turns, shared budgets; over batches by windows, over streams by state."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def carry_forward(turns: DataFrame, session: str, order: str, slots: list[str], commits: str | None = None) -> DataFrame:
    """Adds ``state_<slot>``: the last value given so far; turns that don't commit read the state but don't change it."""
    until = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = turns
    for s in slots:
        given = F.col(s) if commits is None else F.when(F.col(commits), F.col(s))
        out = out.withColumn(f"state_{s}", F.coalesce(F.col(s), F.last(given, ignorenulls=True).over(until)))
    return out


def last_turns(turns: DataFrame, session: str, order: str, text: str, n: int = 2) -> DataFrame:
    """Adds ``last_turns``: the texts of the n turns before, oldest first."""
    before = Window.partitionBy(session).orderBy(order).rowsBetween(-n, -1)
    return turns.withColumn("last_turns", F.collect_list(text).over(before))


def within_budget(calls: DataFrame, session: str, order: str, cost: str, budget: float) -> DataFrame:
    """Adds ``spent`` and ``allowed``: a call is allowed while the sum up to it stays within the budget; the first that
    doesn't fit stops the session, and refused calls spend nothing.  Costs aren't negative."""
    until = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    asked = calls.withColumn("__sum", F.sum(cost).over(until))
    spent = F.max(F.when(F.col("__sum") <= budget, F.col("__sum"))).over(until)
    return asked.withColumn("spent", F.coalesce(spent, F.lit(0))).withColumn("allowed", F.col("__sum") <= budget).drop("__sum")


def alternation(turns: DataFrame, session: str, order: str, role: str, first: str, second: str) -> DataFrame:
    """(session, n, valid): after system turns, roles alternate from ``first``, and orders are unique."""
    known = turns.filter(F.col(role) != "system")
    step = Window.partitionBy(session).orderBy(order)
    odd = F.row_number().over(step) % 2 == 1
    marked = known.withColumn("__ok", F.col(role) == F.when(odd, first).otherwise(second))
    return marked.groupBy(session).agg(F.count("*").alias("n"), (F.min("__ok") & (F.countDistinct(order) == F.count("*"))).alias("valid"))


def topic_memory(records: DataFrame, topic: list[str], seen: str, task: str, limit: int = 20) -> DataFrame:
    """At most ``limit`` records of a topic, the newest; a task inserts once, however often it is repeated."""
    once = records.dropDuplicates([*topic, task])
    newest = Window.partitionBy(*topic).orderBy(F.desc(seen), F.asc(task))
    return once.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= limit).drop("__r")


def stream_slots(turns: DataFrame, session: str, slots: list[str]) -> DataFrame:
    """carry_forward over a stream of (session, seq, slots...): state is one row of slots for each session."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    out = ", ".join([f"{session} long, seq long", *(f"state_{s} string" for s in slots)])

    def step(key, batches, state):
        held = list(state.get) if state.exists else [None] * len(slots)
        pdf = pd.concat(list(batches)).sort_values("seq")
        rows = []
        for _, turn in pdf.iterrows():
            held = [turn[s] if isinstance(turn[s], str) else h for s, h in zip(slots, held)]
            rows.append((key[0], int(turn["seq"]), *held))
        state.update(tuple(held))
        yield pd.DataFrame(rows, columns=[session, "seq", *(f"state_{s}" for s in slots)])

    state_schema = ", ".join(f"{s} string" for s in slots)
    return turns.groupBy(session).applyInPandasWithState(step, out, state_schema, "append", GroupStateTimeout.NoTimeout)
