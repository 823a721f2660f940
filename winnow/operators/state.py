"""Changes of state: each derives the next table from the present one, to be written in its place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnow.functions import text

ACTIVE_JOB = ("queued", "running")
FINAL = ("completed", "failed")


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """df with new values where a condition holds (not where it is null), and `changed`."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumn("changed", hit).withColumns({c: F.when(F.col("changed"), v).otherwise(F.col(c)) for c, v in values.items()})


def trash(media: DataFrame, ids: DataFrame, trip_id) -> DataFrame:
    """Active media of a trip that are listed become trashed."""
    listed = ids.select(F.col("id"), F.lit(True).alias("listed")).distinct()
    out = media.join(listed, "id", "left")
    return update(out, F.col("listed") & (F.col("trip_id") == trip_id) & (F.col("status") == "active"), {"status": F.lit("trashed")}).drop("listed")


def restore(media: DataFrame, where: Column) -> DataFrame:
    """Trashed media become active again."""
    return update(media, where & (F.col("status") == "trashed"), {"status": F.lit("active")})


def soft_delete(media: DataFrame, where: Column) -> DataFrame:
    return update(media, where & (F.col("status") == "trashed"), {"status": F.lit("deleted")})


def cascade(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of a child table that stay when parents (id) go."""
    return children.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def replaced_tags(tags: DataFrame, decisions: DataFrame, prefix: str = "category:") -> DataFrame:
    """Tags after decisions (media_id, category): those with the prefix give way to the new one."""
    decided = decisions.select("media_id").distinct()
    old = tags.join(decided.withColumn("decided", F.lit(True)), "media_id", "left").where(~(F.coalesce("decided", F.lit(False)) & F.col("tag_name").ilike(f"{prefix}%"))).select("media_id", "tag_name")
    return old.unionByName(decisions.select("media_id", F.concat(F.lit(prefix), F.col("category")).alias("tag_name")))


def written_decisions(media: DataFrame, decisions: DataFrame) -> DataFrame:
    """media (id, …) after decisions (id, final_status, trashed_reason, final_category, error): the error is overwritten, too."""
    d = decisions.withColumn("decided", F.lit(True))
    take = lambda new, old: F.when(F.col("decided"), F.col(new)).otherwise(F.col(old))
    return media.join(d, "id", "left").withColumns({"status": take("final_status", "status"), "category": take("final_category", "category"), "processing_error": take("error", "processing_error")}).select(*media.columns)


def can_start(trips: DataFrame, jobs: DataFrame) -> DataFrame:
    """Trips with whether a job may start: none of theirs is queued or running."""
    busy = jobs.where(F.col("status").isin(*ACTIVE_JOB)).select("trip_id").distinct().withColumn("busy", F.lit(True))
    return trips.join(busy, "trip_id", "left").withColumn("can_start", F.col("busy").isNull()).drop("busy")


def stale(created: Column, as_of: Column, hours: int) -> Column:
    return created < as_of - F.make_dt_interval(F.lit(0), F.lit(hours))


def failed_jobs(jobs: DataFrame, where: Column, message: str) -> DataFrame:
    """Jobs after a sweep: those that are active and meet the condition have failed."""
    return update(jobs, F.col("status").isin(*ACTIVE_JOB) & where, {"status": F.lit("failed"), "error_message": F.lit(message)})


def sequenced(events: DataFrame) -> DataFrame:
    """Events with seq from 1 for each job, in order of time and id."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("job_id").orderBy("created_at", "id")).cast("long"))


def latest(events: DataFrame) -> DataFrame:
    """The state of each job, folded from its events: status at the end, events, and errors."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("created_at", "id")).alias("status"), F.count("*").alias("events"), F.count_if(F.col("level") == "error").alias("errors"))


def percent(step: Column, steps: int, done: bool) -> Column:
    """Progress at the begin or end of a step, from 1."""
    return F.round(100 * (step if done else step - 1) / steps).cast("int")


def result_outcome(status: Column, result: Column) -> Column:
    """What fetching a job's result gives: conflict until it is complete, an error if it isn't JSON."""
    return F.when(~status.eqNullSafe(F.lit("completed")), "conflict").when(F.try_parse_json(result).isNull(), "parse_error").otherwise("ok")


#: Steps in a user's life: action -> (states it starts from, state or role it gives).
USER_ACTIONS = {"approve": (("pending",), "active"), "reject": (("pending",), "rejected"), "disable": (("active",), "disabled"), "enable": (("disabled",), "active")}


def user_action(users: DataFrame, action: str) -> DataFrame:
    """users after an action on all it can apply to; admins can't be disabled."""
    before, after = USER_ACTIONS[action]
    allowed = F.col("status").isin(*before)
    if action == "disable":
        allowed = allowed & (F.col("role") != "admin")
    return update(users, allowed, {"status": F.lit(after)})


def promoted(users: DataFrame, where: Column) -> DataFrame:
    """users after a promotion: active regular ones become admins."""
    return update(users, where & (F.col("status") == "active") & (F.col("role") == "regular"), {"role": F.lit("admin")})


#: Ends of upload sessions: action -> (session, media) states; only active sessions end.
SESSION_ACTIONS = {"complete": ("completed", "uploaded"), "abort": ("aborted", "cancelled"), "expire": ("expired", "expired")}


def session_action(sessions: DataFrame, action: str, where: Column) -> DataFrame:
    """Sessions after an action, with the state that their media take (null where nothing changed)."""
    session, media = SESSION_ACTIONS[action]
    out = update(sessions, where & (F.col("status") == "active"), {"status": F.lit(session)})
    return out.withColumn("media_status", F.when(F.col("changed"), media))


def first_decisions(decisions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One decision for each key: the first in order."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return decisions.withColumn("rn", rn).where("rn = 1").drop("rn")


def set_member(parents: DataFrame, chosen: DataFrame, members: DataFrame, column: str, key: str) -> DataFrame:
    """parents (id, column) after a choice (id, choice) that counts only if it is a member (key, id) of that parent."""
    sound = chosen.join(members.select(F.col(key).alias("id"), F.col("id").alias("choice")).distinct(), ["id", "choice"], "left_semi")
    return parents.join(sound, "id", "left").withColumn(column, F.coalesce("choice", column)).drop("choice")


def owned(rows: DataFrame, admin_id, column: str = "user_id") -> DataFrame:
    return rows.withColumn(column, F.coalesce(F.col(column), F.lit(admin_id)))


def trashed_reason(rows: DataFrame, where: Column) -> DataFrame:
    """Rows of the older detector: status trashed, and `duplicate` added to the reasons."""
    return update(rows, where, {"trashed_reason": text.append_reason(F.col("trashed_reason"), "duplicate"), "status": F.lit("trashed")})


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*ACTIVE_JOB))


def latest_active(jobs: DataFrame, order: str) -> DataFrame:
    """trip_id and id of each trip's active job that was created last."""
    return active(jobs).groupBy("trip_id").agg(F.max_by("id", order).alias("id"))


def inserted(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows with new ones whose key they don't have yet; what new ones lack is null."""
    return rows.unionByName(new.join(rows.select(key), key, "left_anti"), allowMissingColumns=True)


def hard_deleted(media: DataFrame, tags: DataFrame, groups: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """media, tags and groups after media (id) are deleted: their tags go, and they are no group's default image."""
    ids = gone.select("id").distinct()
    default = ids.select(F.col("id").alias("default_image_id"), F.lit(True).alias("gone"))
    left = groups.join(default, "default_image_id", "left").withColumn("default_image_id", F.when(F.col("gone").isNull(), F.col("default_image_id"))).drop("gone")
    return media.join(ids, "id", "left_anti"), tags.join(ids.withColumnRenamed("id", "media_id"), "media_id", "left_anti"), left


def expired_uploads(sessions: DataFrame, media: DataFrame, as_of: Column, hours: int) -> tuple[DataFrame, DataFrame]:
    """sessions (id, media_id, status, updated_at) and media (id, processing_status) after a sweep:
    active sessions not updated for so long expire, and their media with them."""
    out = update(sessions, (F.col("status") == "active") & stale(F.col("updated_at"), as_of, hours), {"status": F.lit("expired")})
    late = out.where("changed").select(F.col("media_id").alias("id"), F.lit(True).alias("late")).distinct()
    swept = media.join(late, "id", "left").withColumn("processing_status", F.when(F.col("late"), "expired").otherwise(F.col("processing_status"))).drop("late")
    return out, swept


def set_values(rows: DataFrame, where: Column, column: str, value: str, allowed: tuple[str, ...]) -> DataFrame:
    """rows after a column is set where a condition holds; a value that isn't allowed changes nothing."""
    return update(rows, where & F.lit(value in allowed), {column: F.lit(value)})


def appended(log: DataFrame, new: DataFrame) -> DataFrame:
    """Events (job_id, seq, …) with new ones (job_id, place, …) numbered on from each job's last."""
    last = log.groupBy("job_id").agg(F.max("seq").alias("last"))
    more = new.join(last, "job_id", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + F.col("place")).drop("last", "place")
    return log.unionByName(more)


def upserted_rows(key: list[str], kept: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """For a stored table: (old, new) -> the rows after an upsert. A new row takes the place of the old one
    of its key, but for the columns that are kept; old rows without a new one stay."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        was = old.select(*key, *[F.col(c).alias(f"_{c}") for c in kept])
        out = new.join(was, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in kept}) if kept else new
        return out.select(*old.columns).unionByName(old.join(new.select(*key), key, "left_anti"))

    return merge
