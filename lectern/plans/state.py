"""Folds of events: contexts that shed items, bounded memory, token streams and revisions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import state
from .registry import query, table


@query("""WITH x AS (SELECT event_id, user_id, event_id % 4 AS r, ceil(value)::BIGINT AS cost FROM events),
g AS (SELECT *, sum(cost) OVER (PARTITION BY user_id) AS total, coalesce(sum(CASE WHEN r <> 0 THEN cost ELSE 0 END) OVER (PARTITION BY user_id ORDER BY r DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM x),
k AS (SELECT *, r = 0 OR total - gone <= 150 AS kept FROM g) SELECT event_id, kept, sum(CASE WHEN kept THEN cost ELSE 0 END) OVER (PARTITION BY user_id) > 150 AS over_budget FROM k""")
def context_shedding(spark, d):
    items = table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 4).alias("rank"), F.ceil("value").alias("cost"))
    return state.shed(items, "user_id", "rank", "event_id", "cost", 150).select("event_id", "kept", "over_budget")


@query("SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS n FROM conversations) WHERE n <= 600")
def memory_projection(spark, d):
    """The latest turns of a conversation that fit into 600 characters."""
    return state.within_length(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], "text", 600).select("conv_id", "turn")


@query("SELECT event_id, row_number() OVER w AS n_calls, CASE WHEN count(*) FILTER (event_type = 'click') OVER w = 0 THEN sum(ceil(value)::BIGINT) OVER w END::BIGINT AS n_tokens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def task_accounts(spark, d):
    calls = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") != "click", F.ceil("value")).alias("tokens"))
    return state.accounts(calls, "user_id", "event_id", "tokens").select("event_id", "n_calls", "n_tokens")


@query("SELECT l_orderkey, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS tokens, max(l_linenumber)::INT AS last_step, max(l_linenumber) - min(l_linenumber) + 1 = count(DISTINCT l_linenumber) AS complete FROM lineitem GROUP BY l_orderkey")
def token_streams(spark, d):
    """Lines as steps, some of which repeat, and an end after the last."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("step"), F.col("l_linenumber").alias("token"))
    ends = lines.groupBy("l_orderkey").agg((F.max("step") + 1).alias("step"), F.lit(-1).alias("token"))
    return state.token_stream(lines.union(ends), "l_orderkey", "step", "token", -1).withColumn("tokens", F.array_join("tokens", ","))


@query()
def review_revisions(spark, d):
    """Lines as edits of their order, based on the revision of their place, some on an older one."""
    k = F.row_number().over(_by_order())
    edits = table(spark, d, "lineitem").select("l_orderkey", (k * 10 + F.col("l_linenumber")).alias("edit"), F.when(F.col("l_linenumber") % 3 == 0, k - 2).otherwise(k - 1).alias("base"), (F.col("l_returnflag") == "R").alias("approve"))
    return state.revisions(edits, "l_orderkey", "edit", "base", "approve")


@query()
def agent_runs(spark, d):
    """Events of a user as an agent's actions."""
    action = F.element_at(F.array(*map(F.lit, ["search", "calculate", "search", "answer"])), (F.col("event_id") % 4 + 1).cast("int"))
    return state.agent_states(table(spark, d, "events").select("user_id", "event_id", action.alias("action")), "user_id", "event_id", "action", 3)


def _by_order():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice")
