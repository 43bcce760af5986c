"""Organisations, workspaces, audit log, conversations, request limits: set-oriented versions of a service's queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

#: tier, requests, seconds. Fixed values
TIERS = [("heavy", 10, 60), ("upload", 50, 86_400), ("chat", 1000, 86_400), ("analysis", 20, 3600), ("standard", 100, 60)]
#: status and its progress in per cent. Fixed values
PROGRESS = {"QUEUED": 0, "UPLOADING": 5, "PARSING": 15, "CLEANING": 30, "CHUNKING": 45, "EMBEDDING": 60, "INDEXING": 80, "ANALYZING": 90, "COMPLETED": 100}


def members(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """Members of organisations with name and address."""
    return memberships.join(users, "user_id").select("organization_id", "user_id", "name", "email", "role")


def organisations_of(memberships: DataFrame, organisations: DataFrame) -> DataFrame:
    """Organisations (organization_id, organization) of each user, with their role there."""
    return memberships.join(organisations, "organization_id").select("user_id", "organization_id", "organization", "role")


def visible_workspaces(workspaces: DataFrame, memberships: DataFrame) -> DataFrame:
    """(user_id, workspace_id) that a user owns or whose organisation they belong to: two branches, no OR in a join."""
    owned = workspaces.select(F.col("owner_id").alias("user_id"), "workspace_id")
    shared = workspaces.where("organization_id is not null").join(memberships.select("user_id", "organization_id"), "organization_id").select("user_id", "workspace_id")
    return owned.unionByName(shared).distinct()


def effective_roles(asked: DataFrame, workspaces: DataFrame, memberships: DataFrame) -> DataFrame:
    """``asked`` (user_id, workspace_id) with role: admin of an own one without organisation, else the membership's; else null."""
    asked = asked.select(F.col("user_id").alias("asker"), F.col("workspace_id").alias("asked_id"))
    own = workspaces.select(F.col("workspace_id").alias("own_id"), F.col("owner_id").alias("own_owner"), F.col("organization_id").alias("own_organization"))
    roles = memberships.select(F.col("user_id").alias("member_id"), F.col("organization_id").alias("member_of"), F.col("role").alias("member_role"))
    joined = asked.join(own, F.col("asked_id") == F.col("own_id"), "left")
    joined = joined.join(roles, (F.col("asker") == F.col("member_id")) & (F.col("own_organization") == F.col("member_of")), "left")
    role = F.when(F.col("own_organization").isNull(), F.when(F.col("own_owner") == F.col("asker"), "admin")).otherwise(F.col("member_role"))
    return joined.select(F.col("asker").alias("user_id"), F.col("asked_id").alias("workspace_id"), role.alias("role"))


#: documents of a workspace that meet its readers in one group
GROUP_DOCUMENTS = 1024


def access_scope(documents: DataFrame, workspaces: DataFrame, memberships: DataFrame) -> DataFrame:
    """Documents (document_id, workspace_id) that each user may read, with their role.

    Readers are found for workspaces with documents only. The rows are each workspace's documents times its readers: its documents
    are dealt into groups that its readers meet one by one, so a large workspace is spread over tasks.
    """
    held = documents.groupBy("workspace_id").agg(F.ceil(F.count(F.lit(1)) / GROUP_DOCUMENTS).cast("int").alias("groups"))
    own = workspaces.join(held.select("workspace_id"), "workspace_id", "left_semi")
    seen = effective_roles(visible_workspaces(own, memberships), own, memberships)
    seen = seen.join(held, "workspace_id").select("user_id", "workspace_id", "role", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    dealt = documents.select("document_id", "workspace_id").join(held, "workspace_id").select("document_id", "workspace_id", F.pmod(F.xxhash64("document_id"), "groups").cast("int").alias("group"))
    # a fixed number of partitions, since the rows that are shuffled tell nothing of those that are made
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), documents.sparkSession.sparkContext.defaultParallelism)
    return dealt.repartition(4 * parts, "workspace_id", "group").hint("shuffle_hash").join(seen, ["workspace_id", "group"]).select("user_id", "document_id", "workspace_id", "role")


def audit_report(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log (workspace_id, action, ts, ...) newest first, and counts of actions."""
    return log.orderBy(F.col("ts").desc()), log.groupBy("workspace_id", "action").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


def recent_messages(messages: DataFrame, n: int = 5, current: DataFrame | None = None) -> DataFrame:
    """The last ``n`` messages (session_id, turn, role, text) of each session, oldest first, without the ``current`` ones (session_id, turn)."""
    if current is not None:
        messages = messages.join(current.select("session_id", "turn"), ["session_id", "turn"], "left_anti")
    order = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    kept = messages.where(F.col("role").isin("user", "assistant", "system")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy("turn"))).drop("_n")


def repeated_questions(messages: DataFrame, seconds: int = 1800) -> DataFrame:
    """User messages (session_id, ts in seconds, text) with whether the same one was asked at most ``seconds`` before."""
    key = F.sha2(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), 256)
    asked = messages.where("role = 'user'").withColumn("question_hash", key)
    before = F.lag("ts").over(Window.partitionBy("session_id", "question_hash").orderBy("ts"))
    return asked.withColumn("reused", F.coalesce(F.col("ts") - before <= seconds, F.lit(False)))


def limits(tier: str) -> tuple[int, int]:
    """(requests, seconds) of a tier; those of the standard one if it is unknown."""
    known = {name: (most, seconds) for name, most, seconds in TIERS}
    return known.get(tier, known["standard"])


def rate_limit(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """``requests`` (key, ts) with admitted, remaining and reset: every earlier request in the window counts, also a rejected one."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = Window.partitionBy("key").orderBy("at").rangeBetween(-seconds * 1_000_000 + 1, -1)
    rows = requests.withColumn("at", at).withColumn("before", F.count(F.lit(1)).over(span)).withColumn("oldest", F.min("at").over(span))
    admitted = F.col("before") < limit
    reset = F.when(~admitted, F.greatest(F.lit(1), F.floor(seconds - (F.col("at") - F.col("oldest")) / 1e6).cast("int"))).otherwise(F.lit(seconds))
    return rows.withColumns({"admitted": admitted, "remaining": F.greatest(F.lit(0), limit - F.col("before") - 1).cast("int"), "reset": reset}).drop("at", "oldest")


def latest_status(changes: DataFrame) -> DataFrame:
    """Of ``changes`` (document_id, status, ts): the latest status, the progress it has reached, and the seconds since the first.

    A status without progress of its own, as FAILED, keeps that of the last one with some.
    """
    steps = F.create_map(*(F.lit(x) for kv in PROGRESS.items() for x in kv))
    known = changes.withColumn("step", F.element_at(steps, F.col("status")))
    reached = F.max_by("step", F.when(F.col("step").isNotNull(), F.col("ts"))).alias("progress")
    grouped = known.groupBy("document_id").agg(F.max_by("status", "ts").alias("status"), reached, F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return grouped.select("document_id", "status", "progress", (F.col("last_ts").cast("timestamp").cast("long") - F.col("first_ts").cast("timestamp").cast("long")).alias("seconds"))


def stage_seconds(changes: DataFrame) -> DataFrame:
    """How long each document stayed in each status."""
    after = F.lead("ts").over(Window.partitionBy("document_id").orderBy("ts"))
    return changes.select("document_id", "status", "ts", (after.cast("timestamp").cast("long") - F.col("ts").cast("timestamp").cast("long")).alias("seconds"))


def usage_totals(log: DataFrame) -> DataFrame:
    """Tokens by session and model."""
    return log.groupBy("session_id", "model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))


def quality_report(checks: DataFrame) -> DataFrame:
    """A pack's assertions (pack, passed): totals, and PASS if all passed."""
    return checks.groupBy("pack").agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.when(F.bool_and("passed"), "PASS").otherwise("FAIL").alias("status"))


def library_overview(documents: DataFrame) -> DataFrame:
    """Documents, those completed, and megabytes, by user."""
    return documents.groupBy("user_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.bround(F.sum("bytes") / 1048576.0, 2).alias("megabytes"))


def notifications(documents: DataFrame, users: DataFrame) -> DataFrame:
    """Completed documents with the address of their owner."""
    return documents.where("status = 'COMPLETED'").join(users, "user_id", "left").where("email is not null").select("document_id", "user_id", "email")


def page(frame: DataFrame, keys: list[str], skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of a table in the order of ``keys``."""
    return frame.orderBy(*keys).offset(skip).limit(limit)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
