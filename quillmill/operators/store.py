"""Per-user stores as DataFrames: point reads, upserts, deletes, policies. Writers rewrite a table; one writer at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import js

SETTINGS_COLUMNS = ("company_name", "contact_email", "contact_phone", "contact_website", "brand_color", "header_text", "footer_text", "logo_path")
#: Bytes below which a rendered PDF counts as empty.
LEAST_PDF = 100


def exactly_one(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key if there is one and only one, else nothing; at most two rows are looked at."""
    found = rows.where(F.col(key) == F.lit(value)).limit(2)
    return found.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 1").drop("_n")


def owned(rows: DataFrame, user_id, column: str = "user_id") -> DataFrame:
    """The view that a user has of a table."""
    return rows.where(F.col(column) == F.lit(user_id))


def path_owner(path: Column | str) -> Column:
    """The first folder of an object's path."""
    return F.get(F.split(js.col(path), "/"), 0)


def assert_owned(rows: DataFrame, user_id, column: str = "user_id") -> DataFrame:
    """Rows to be written; a foreign one fails the job."""
    mine = F.col(column) == F.lit(user_id)
    return rows.where(F.when(mine, True).otherwise(F.raise_error(F.lit("row of another user"))))


def upsert(table: DataFrame, changes: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """table with the changes by key: ``columns`` are overwritten, even by NULL, other columns keep what they have.

    Of changes that repeat a key the one with the largest ``order`` counts. New keys are added.
    """
    if order:
        changes = changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), order).alias("c")).select("c.*")
    new = changes.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key), F.lit(True).alias("_changed"))
    both = table.withColumn("_there", F.lit(True)).join(new, key, "full_outer")

    def merged(c: str) -> Column:
        if c == key:
            return F.col(key)
        if c in columns:
            return F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(F.col("_there"), F.col(c)).otherwise(F.col(f"_new_{c}") if c in changes.columns else F.lit(None)).alias(c)

    return both.select(*map(merged, table.columns))


def insert_unique(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with new rows; a key that is in the table, or twice among the new ones, fails the job. NULL keys are no keys."""
    there = table.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_there", F.lit(1))
    times = new.where(F.col(key).isNotNull()).groupBy(key).count().join(there, key, "left").select(key, (F.col("count") + F.coalesce("_there", F.lit(0)) > 1).alias("_twice"))
    checked = new.join(times, key, "left")
    fine = F.when(F.coalesce("_twice", F.lit(False)), F.raise_error(F.concat(F.lit(f"duplicate {key} "), F.col(key).cast("string")))).otherwise(True)
    return table.unionByName(checked.where(fine).drop("_twice"))


def delete_by(table: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """table without the rows that a request names by all keys; requests that name none do nothing."""
    return table.join(requests.select(*keys), keys, "left_anti")


def put_objects(objects: DataFrame, uploads: DataFrame, order: str | None = None) -> DataFrame:
    """Objects by path, replaced where uploaded anew; of several uploads of a path that with the largest ``order`` stays.

    Without ``order`` a path that is uploaded twice fails the job, for nothing says which one came last.
    """
    columns = [c for c in uploads.columns if c != order]
    held = F.max_by(F.struct(*columns), order) if order else F.first(F.struct(*columns))
    several = F.when((F.count("*") > 1) & F.lit(order is None), F.raise_error(F.concat(F.lit("several uploads of "), F.col("path")))).otherwise(held)
    new = uploads.groupBy("path").agg(several.alias("_new")).select("_new.*")
    return objects.join(new, "path", "left_anti").unionByName(new)


def remove_objects(objects: DataFrame, paths: DataFrame) -> DataFrame:
    """Objects without those whose path is named."""
    return objects.join(paths.select("path"), "path", "left_anti")


def normalised_settings(bodies: DataFrame, now: Column) -> DataFrame:
    """(user_id, settings) as they are saved: empty texts become NULL, the colour gets its default, and the time is set."""
    value = lambda c: js.first_truthy(c, F.lit(js.TEAL)) if c == "brand_color" else js.truthy(c)
    return bodies.select("user_id", *(value(c).alias(c) for c in SETTINGS_COLUMNS), now.alias("updated_at"))


def save_settings(table: DataFrame, bodies: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    """The settings table after these bodies; of several of one user that with the largest ``order`` counts."""
    if order:
        bodies = bodies.groupBy("user_id").agg(F.max_by(F.struct(*bodies.columns), order).alias("b")).select("b.*")
    return upsert(table, normalised_settings(bodies, now), "user_id", [*SETTINGS_COLUMNS, "updated_at"])


def guarded(rows: DataFrame, *guards: tuple[Column, str, int]) -> DataFrame:
    """Adds (status, error) of the first guard (bad, message, status) whose condition holds, else 200 and NULL.

    A condition that is NULL doesn't hold.
    """
    status, error = F.lit(200), F.lit(None).cast("string")
    for bad, message, code in reversed(guards):
        failed = F.coalesce(bad, F.lit(False))
        status, error = F.when(failed, code).otherwise(status), F.when(failed, message).otherwise(error)
    return rows.select("*", status.alias("status"), error.alias("error"))


def cascade(rows: DataFrame, survivors: DataFrame, key: str) -> DataFrame:
    """Rows whose owner still exists."""
    return rows.join(survivors.select(key), key, "left_semi")


def inserted_projects(requests: DataFrame, request_key: str, now: Column) -> DataFrame:
    """New projects with the id that is given back and the time; the id follows from user and request.

    So a task that runs twice makes the same rows, and a request that is sent again can be told from a new one.
    """
    key = F.sha2(F.concat_ws("/", F.col("user_id").cast("string"), F.col(request_key).cast("string")), 256)
    named = new_projects(requests.withColumn("_id", key), ["_id"])
    return named.select(F.col("_id").alias("id"), "user_id", "name", "data", "documents", now.alias("created_at"))


def new_projects(requests: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """(user_id, name, data, documents) -> rows to be appended; name falls back on the data's, then on Untitled."""
    own = F.get_json_object("data", "$.project.name")
    return requests.select(*carried or [], "user_id", js.first_truthy("name", own, F.lit("Untitled")).alias("name"), js.first_truthy("data", F.lit("{}")).alias("data"), F.coalesce("documents", F.array()).alias("documents"))


def project_list(projects: DataFrame, roles: str = "roles", created: str = "created_at") -> DataFrame:
    """The dashboard: role counts and dates; ``place`` is the order, newest first and undated before all."""
    newest = Window.partitionBy("user_id").orderBy(F.col(created).desc_nulls_first(), "id")
    return projects.select("user_id", "id", "name", F.coalesce(F.size(roles), F.lit(0)).alias("role_count"), js.short_date(created).alias("short_date"), js.long_date(created).alias("long_date"), F.row_number().over(newest).alias("place"))


def progress(roles: DataFrame, sides: DataFrame) -> DataFrame:
    """(project_id, role_ord, done) and (project_id, role_ord) of sides that were made -> counts of each project with roles.

    ``total`` roles, ``done`` of them filled in, ``ready`` with sides, and both as they are shown. Sides of roles that
    are not there don't count, nor do repeated ones.
    """
    made = sides.select("project_id", "role_ord").distinct().withColumn("_made", F.lit(True))
    counted = roles.join(made, ["project_id", "role_ord"], "left").groupBy("project_id").agg(F.count("*").alias("total"), F.count_if("done").alias("done"), F.count_if("_made").alias("ready"))
    shown = F.concat(F.col("done").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" done"))
    download = F.when(F.col("ready") > 0, F.concat(F.lit("Download All ("), F.col("ready").cast("string"), F.lit(")")))
    return counted.select("*", shown.alias("done_label"), download.alias("download_label"))


def sides_to_make(roles: DataFrame, sides: DataFrame) -> DataFrame:
    """The roles (project_id, role_ord, ...) that have no sides yet, numbered from 1 in each project."""
    left = roles.join(sides.select("project_id", "role_ord"), ["project_id", "role_ord"], "left_anti")
    return left.withColumn("nth", F.row_number().over(Window.partitionBy("project_id").orderBy("role_ord")))


def settings_or_defaults(users: DataFrame, settings: DataFrame, defaults: dict[str, str | None]) -> DataFrame:
    """One row per user; defaults hold only for users without a row, a stored NULL stays."""
    found = users.join(settings.withColumn("_there", F.lit(True)), "user_id", "left")
    present = F.coalesce("_there", F.lit(False))
    return found.select("user_id", *(js.overlay(present, c, default).alias(c) for c, default in defaults.items()))


#: Settings and what a renderer calls them.
_BRANDING = (
    ("contact_email", "contactEmail"),
    ("contact_phone", "contactPhone"),
    ("contact_website", "contactWebsite"),
    ("header_text", "headerText"),
    ("footer_text", "footerText"),
    ("logo_path", "logoPath"),
)


def branding(users: DataFrame, settings: DataFrame, company: str, logos: DataFrame | None = None) -> DataFrame:
    """Settings as a renderer takes them: names, texts, logo, colour with its RGB and text colour; empty ones are NULL.

    ``logos`` (path, mime, content) gives logoBase64, a data URI, and logoFormat of the logos that are there.
    """
    found = users.join(settings, "user_id", "left")
    colour = js.first_truthy("brand_color", F.lit(js.TEAL))
    named = found.select("user_id", js.first_truthy("company_name", F.lit(company)).alias("companyName"), *(js.truthy(c).alias(o) for c, o in _BRANDING), colour.alias("brandColor"))
    shown = named.withColumn("brandColorRgb", js.hex_to_rgb("brandColor")).withColumn("textColor", js.contrast_text("brandColorRgb"))
    if logos is None:
        return shown
    held = logos.select(F.col("path").alias("logoPath"), js.data_uri(js.text_or_empty("mime"), "content").alias("logoBase64"), js.image_format("mime").alias("logoFormat"))
    return shown.join(held, "logoPath", "left").select(*shown.columns, "logoBase64", "logoFormat")
