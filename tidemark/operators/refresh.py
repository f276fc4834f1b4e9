"""The refresh of a mailbox as one call: plan what is due, run the stages, merge, apply corrections, spread the scores and reconcile the to-dos."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import maintain, queue
from tidemark.operators.merge import merge_latest
from tidemark.sources.tables import keep

CONTEXT_STAGES = ("chunk", "embed", "extract")


def due_context_stages(messages: DataFrame, coverage: dict[str, DataFrame]) -> DataFrame:
    """(email_id, stages): the context stages that have no row for a message in their table of ids (email_id), in order."""
    rows = messages.select("email_id")
    for stage in CONTEXT_STAGES:
        done = coverage[stage].select("email_id").distinct().withColumn(f"_{stage}", F.lit(True))
        rows = rows.join(done, "email_id", "left")
    due = F.array_compact(F.array(*[F.when(F.col(f"_{s}").isNull(), s) for s in CONTEXT_STAGES]))
    return rows.select("email_id", due.alias("stages")).where(F.size("stages") > 0)


def skip_stages(plan: DataFrame, *names: str) -> DataFrame:
    """A plan without the named stages; rows with none left go."""
    left = F.array_except("stages", F.array(*[F.lit(n) for n in names]).cast("array<string>"))
    return plan.withColumn("stages", left).where(F.size("stages") > 0)


def refresh(messages: DataFrame, log: DataFrame, todos: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], owner: str, skip: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Saved tables after a refresh: plan, messages, changed (whose corrections took effect), spread and todos.

    ``stages``: of each stage of the plan the function that sets its columns for the rows it is given. Order: stages, merge, corrections, spread, to-dos.
    """
    plan = keep(skip_stages(maintain.due_stages(messages), *skip), "plan")
    rows = keep(messages, "messages")
    for name, run in stages.items():
        todo = plan.where(F.array_contains("stages", name)).select("email_id")
        done = run(rows.join(todo, "email_id", "left_semi")).select(rows.columns)
        rows = keep(merge_latest(rows, done, ["email_id"]), "messages")
    scored = queue.score_messages(queue.with_signals(rows, owner))
    fed = keep(queue.apply_feedback(scored, queue.sender_priors(log)), "fed")
    spread = keep(queue.spread_scores(fed), "spread")
    return {"plan": plan, "messages": rows, "changed": fed.where("changed"), "spread": spread, "todos": keep(maintain.sync_todos(todos, maintain.desired_todos(fed), fed), "todos")}


def refresh_subset(messages: DataFrame, ids: DataFrame, log: DataFrame, todos: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], owner: str) -> dict[str, DataFrame]:
    """``refresh`` of the messages of ``ids`` alone; only their to-dos are reconciled."""
    some = messages.join(ids.select("email_id").distinct(), "email_id", "left_semi")
    return refresh(some, log, todos, stages, owner)


def feedback_cycle(messages: DataFrame, log: DataFrame, entry: DataFrame, owner: str) -> dict[str, DataFrame]:
    """After a correction ``entry`` is recorded: the log, the rows of its senders with their corrections applied, and the spread of all scores."""
    grown = log.unionByName(entry.select(log.columns))
    return {"log": grown, **_after(messages, grown, entry, owner)}


def _after(messages: DataFrame, log: DataFrame, senders: DataFrame, owner: str) -> dict[str, DataFrame]:
    scored = queue.score_messages(queue.with_signals(messages, owner))
    fed = keep(queue.apply_feedback(scored, queue.sender_priors(log)), "fed")
    of = senders.select(T.addr_only(F.col("sender")).alias("_address")).distinct()
    affected = fed.where("changed").join(of, T.addr_only(F.col("sender")) == F.col("_address"), "left_semi")
    return {"affected": affected, "spread": queue.spread_scores(fed)}


def feedback_cleared(messages: DataFrame, log: DataFrame, senders: DataFrame, owner: str, kind: str | None = None) -> dict[str, DataFrame]:
    """After the corrections of ``senders`` (sender), of one kind where it is given, are cleared: the log without them, the cleared entries, the senders' rows that other corrections still change, and the spread of all scores.

    ``messages`` are as the stages left them: what a cleared correction had changed is back.
    """
    left, gone = queue.clear_priors(log, senders, kind)
    return {"log": left, "cleared": gone, **_after(messages, left, senders, owner)}
