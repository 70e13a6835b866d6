"""Projects, repositories, runs, files: versions, duplicates, links, settings; all as set-based rewrites.

Parquet has no MERGE: an update is a union and "the newest row of each key". Latest versions are max_by with
map-side partials, not a window over each file's whole history.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import store

FINAL = ("processed", "error", "skipped")


# --- projects and repositories --------------------------------------------------------------------


def with_counts(parents: DataFrame, key: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """parents with a count column for each child table (name -> (table, foreign key)); pre-aggregated, so joins don't fan out."""
    for name, (df, fk) in children.items():
        n = df.groupBy(F.col(fk).alias(key)).agg(F.count("*").alias(name))
        parents = parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    return parents


def create(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """old with the rows of new (id and more) whose id isn't there yet, stamped with created_at and updated_at where there are such columns."""
    fresh = new.dropDuplicates(["id"]).join(old.select("id"), "id", "left_anti")
    stamped = [now.cast(old.schema[c].dataType).alias(c) if c in ("created_at", "updated_at") else F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns]
    return old.unionByName(fresh.select(*stamped))


def update(old: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """old with the columns of changes (id and more) that aren't null; changed rows are stamped with updated_at."""
    columns = [c for c in changes.columns if c != "id" and c in old.columns]
    j = old.join(changes.select("id", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns]), "id", "left")
    value = lambda c: F.coalesce(f"__{c}", c) if c in columns else F.when(F.col("__hit"), now.cast(old.schema[c].dataType)).otherwise(F.col(c)) if c == "updated_at" else F.col(c)
    return j.select(*[value(c).alias(c) for c in old.columns])


def delete_project(gone: DataFrame, projects: DataFrame, repositories: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(projects, repositories, links) without the projects gone (id), their repositories, and links with an end in either."""
    ids = gone.select("id").distinct()
    lost = repositories.join(ids.withColumnRenamed("id", "project_id"), "project_id", "left_semi").select("id").unionByName(ids).distinct()
    left = links.join(lost.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(lost.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    kept = repositories.join(ids.withColumnRenamed("id", "project_id"), "project_id", "left_anti").select(*repositories.columns)
    return projects.join(ids, "id", "left_anti").select(*projects.columns), kept, left.select(*links.columns)


def update_context(projects: DataFrame, contexts: DataFrame, now: Column) -> DataFrame:
    """projects with the contexts (id, context) that are valid (see context_errors); an invalid one changes nothing."""
    return update(projects, contexts.where(F.size(context_errors(F.col("context"))) == 0).select("id", "context"), now)


def links_of(links: DataFrame, project: str) -> DataFrame:
    """Links with the project on either side."""
    return links.where((F.col("source_id") == project) | (F.col("target_id") == project))


def bad_links(links: DataFrame, repositories: DataFrame) -> DataFrame:
    """Links to themselves, or whose ends aren't repositories of the link's project."""
    own = repositories.select(F.col("project_id"), F.col("id"))
    lost = lambda side: links.join(own.withColumnRenamed("id", side), ["project_id", side], "left_anti")
    return links.where("source_id = target_id").unionByName(lost("source_id")).unionByName(lost("target_id")).distinct()


def detect_links(refs: DataFrame, least: int = 1) -> DataFrame:
    """(repo_a, repo_b, shared, confidence): repositories that name the same tables. refs: (repository_id, name).

    Repositories with the same names are one class, and pairs are between classes: a name in R repositories of C classes makes
    C^2 / 2 pairs at most, however many copies there are. Names of more than COMMON classes tell little by themselves and make
    no pairs (see common_names, which reports them); they are still counted for every pair that shares another name.
    """
    named, classes = name_classes(refs)
    common = store.materialize(named.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select("name"), "common-names")
    rare = named.join(F.broadcast(common), "name", "left_anti") if store.is_small(common) else named.join(common, "name", "left_anti")
    pairs = rare.select(F.col("class").alias("a"), "name").join(rare.select(F.col("class").alias("b"), "name"), "name").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    # what a pair shares of the common names: by the sets of them, which are small and one row a class
    sets = named.join(common, "name", "left_semi").groupBy("class").agg(F.collect_set("name").alias("names"))
    both = pairs.join(sets.toDF("a", "x"), "a", "left").join(sets.toDF("b", "y"), "b", "left")
    more = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.size(F.array_intersect("x", "y"))).otherwise(0)
    pairs = both.select("a", "b", (F.col("shared") + more).alias("shared"))
    members = classes.select("class", "repository_id", "n")
    # copies of one class share all their names: each with the first of them
    firsts = classes.groupBy("class").agg(F.min("repository_id").alias("repo_a"))
    copies = members.join(firsts, "class").where("repo_a < repository_id").select("repo_a", F.col("repository_id").alias("repo_b"), F.col("n").alias("shared"), F.lit(1.0).alias("confidence")).where(F.col("shared") >= least)
    of = firsts.join(classes.groupBy("class").agg(F.first("n").alias("n")), "class")
    named_pairs = pairs.where(F.col("shared") >= least).join(of.toDF("a", "ra", "na"), "a").join(of.toDF("b", "rb", "nb"), "b")
    between = named_pairs.select(F.least("ra", "rb").alias("repo_a"), F.greatest("ra", "rb").alias("repo_b"), "shared", F.round(F.col("shared") / F.least("na", "nb"), 6).alias("confidence"))
    return between.unionByName(copies)


#: A name of more classes of repositories than this makes no pairs by itself.
COMMON = 1000


def name_classes(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((class, name), (class, repository_id, n)): repositories with exactly the same names, in lower case, are one class; n names each."""
    named = store.materialize(refs.select("repository_id", F.lower("name").alias("name")).where("repository_id IS NOT NULL AND name IS NOT NULL").distinct(), "names")
    classes = store.materialize(named.groupBy("repository_id").agg(F.xxhash64(F.sum(F.xxhash64("name").cast("decimal(38,0)")).cast("string"), F.bit_xor(F.xxhash64(F.reverse("name"))), F.count("*")).alias("class"), F.count("*").alias("n")), "name-classes")
    first = classes.groupBy("class").agg(F.min("repository_id").alias("repository_id"))
    return named.join(first, "repository_id").select("class", "name"), classes


def common_names(refs: DataFrame, least: int | None = None) -> DataFrame:
    """(name, repositories, classes) of the names that are in more than `least` (COMMON) classes of repositories, as a class instead of pairs."""
    named, classes = name_classes(refs)
    sizes = classes.groupBy("class").agg(F.count("*").alias("copies"))
    g = named.join(sizes, "class").groupBy("name").agg(F.sum("copies").alias("repositories"), F.count("*").alias("classes"))
    return g.where(F.col("classes") > (COMMON if least is None else least))


#: Fields of a project's context that are lists of strings, and its formats.
CONTEXT_LISTS = ("source_entities", "target_entities", "related_projects", "domain_hints")
CONTEXT_FORMATS = ("text", "markdown")


def context_errors(c: Column) -> Column:
    """Array of what is wrong with a project's JSON context: unreadable, or fields of the wrong type or value."""
    v = F.try_parse_json(c)
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    wrong = [
        F.when(kind("description") != "STRING", F.lit("description: string expected")),
        F.when(kind("format").isNotNull() & ~F.coalesce(F.try_variant_get(v, "$.format", "string"), F.lit("")).isin(*CONTEXT_FORMATS), F.lit("format: text or markdown expected")),
        *[F.when(~kind(f).startswith("ARRAY"), F.lit(f"{f}: array expected")).when(~kind(f).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(f"{f}: strings expected")) for f in CONTEXT_LISTS],
    ]
    return F.when(v.isNull(), F.array(F.lit("unreadable"))).otherwise(F.filter(F.array(*wrong), lambda x: x.isNotNull()))


def context_block(c: Column) -> Column:
    """A project's context for a prompt, as tags; empty without a description, and without the tags that have nothing."""
    text = lambda f: F.nullif(F.get_json_object(c, f"$.{f}"), F.lit(""))
    listed = lambda f: F.nullif(F.array_join(F.from_json(F.get_json_object(c, f"$.{f}"), "array<string>"), ", "), F.lit(""))
    tag = lambda f, body: F.concat(F.lit(f"  <{f}>"), body, F.lit(f"</{f}>"))
    fields = ("source_entities", "target_entities", "domain_hints")
    block = F.concat_ws("\n", F.lit("<project_context>"), tag("description", text("description")), tag("format", text("format")), *[tag(f, listed(f)) for f in fields], F.lit("</project_context>"))
    return F.when(text("description").isNotNull(), block).otherwise("")


# --- files ----------------------------------------------------------------------------------------


def status_of(status: str = "status", processed: str = "processed_at") -> Column:
    return F.coalesce(F.col(status), F.when(F.col(processed).isNotNull(), "processed").otherwise("pending"))


def type_of(kind: str = "file_type", name: str = "filename") -> Column:
    return F.coalesce(F.col(kind), F.nullif(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), F.lit("")), F.lit("unknown"))


def file_filter(files: DataFrame, superseded: bool = False, **equal: str | None) -> DataFrame:
    """Files by any of project, repository, source and status; a None isn't asked for."""
    for c, v in equal.items():
        if v is not None:
            files = files.where((status_of() if c == "status" else F.col(c)) == v)
    return files if superseded else files.where(~F.coalesce("is_superseded", F.lit(False)))


def page_of(df: DataFrame, order: Sequence[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """A page with `total`, the number of all rows, and `has_more` on every row; no row beyond the end."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, order, limit, offset).join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.col("total") > offset + limit).orderBy(*order)  # one row


def page(df: DataFrame, order: Sequence[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def search_files(files: DataFrame, text: str) -> DataFrame:
    """Files whose name or relative path contains the text, ignoring case."""
    part = F.lit(text.lower())
    return files.where(F.contains(F.lower("filename"), part) | F.coalesce(F.contains(F.lower("relative_path"), part), F.lit(False)))


def file_stats(files: DataFrame) -> DataFrame:
    """(total, processed, failed, pending, skipped): counts by status; zero rather than null."""
    s = status_of()
    n = lambda v: F.coalesce(F.sum(F.when(s == v, 1)), F.lit(0)).cast("bigint")
    return files.agg(F.count("*").alias("total"), n("processed").alias("processed"), n("error").alias("failed"), n("pending").alias("pending"), n("skipped").alias("skipped"))


def register(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("project_id", "repository_id", "relative_path")) -> DataFrame:
    """new with registration: duplicate (same content hash in project and repository), new_version (same path,
    other content; supersedes the latest) or new_file. Null repositories are equal to each other."""
    seen = old.select("project_id", F.coalesce("repository_id", F.lit("")).alias("__r"), "file_hash").distinct().withColumn("__dup", F.lit(True))
    latest = old.withColumn("__r", F.coalesce("repository_id", F.lit(""))).groupBy("project_id", "__r", "relative_path").agg(F.max_by("id", F.struct("created_at", "id")).alias("supersedes"))
    n = new.withColumn("__r", F.coalesce("repository_id", F.lit("")))
    n = n.join(seen, ["project_id", "__r", "file_hash"], "left").join(latest, ["project_id", "__r", "relative_path"], "left")
    kind = F.when(F.col("__dup"), "duplicate").when(F.col("supersedes").isNotNull(), "new_version").otherwise("new_file")
    return n.withColumn("registration", kind).withColumn("supersedes", F.when(kind == "new_version", F.col("supersedes"))).drop("__r", "__dup")


def registration_history(files: DataFrame, group: Sequence[str], path: str, digest: str, at: Sequence[str]) -> DataFrame:
    """files with registration as if each had been registered in order `at`: by the first of its digest and of its path in the group."""
    order = F.struct(*at)
    firsts = files.groupBy(*group, digest).agg(F.min(order).alias("__d"))
    paths = files.groupBy(*group, path).agg(F.min(order).alias("__p"))
    j = files.join(firsts, [*group, digest]).join(paths, [*group, path])
    return j.withColumn("registration", F.when(F.col("__d") < order, "duplicate").when(F.col("__p") < order, "new_version").otherwise("new_file")).drop("__d", "__p")


def latest_versions(files: DataFrame, keys: Sequence[str], at: Sequence[str]) -> DataFrame:
    rest = [c for c in files.columns if c not in keys]
    return files.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("r")).select(*keys, "r.*")


def version_numbers(files: DataFrame, keys: Sequence[str], at: Sequence[str]) -> DataFrame:
    """files with version: 1 for the newest of its key."""
    return files.withColumn("version", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in at])))


def set_status(files: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """files with the status of updates (id, new_status); final ones stamp processed_at."""
    u = files.join(updates.select("id", "new_status"), "id", "left")
    stamped = F.when(F.col("new_status").isin(*FINAL), now).otherwise(F.col("processed_at"))
    return u.withColumn("processed_at", stamped).withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def outcome(supported: Column, duplicate: Column, parse_error: Column, index_status: Column) -> Column:
    """A file's outcome, in the order the stages decide it; a failed validation never fails the file."""
    return F.when(~supported, "unsupported").when(duplicate, "duplicate").when(parse_error.isNotNull(), "parse_error").when(index_status.isin("skipped", "error"), F.concat(F.lit("index_"), index_status)).otherwise("processed")


# --- runs -----------------------------------------------------------------------------------------


def next_sequence(runs: DataFrame, project: str, timestamp: str) -> DataFrame:
    return runs.where((F.col("project_id") == project) & (F.col("timestamp") == timestamp)).agg((F.coalesce(F.max("sequence"), F.lit(0)) + 1).alias("sequence"))


def run_results(files: DataFrame) -> DataFrame:
    """(run_id, status, error_message): completed, or completed_with_errors with `N files failed`."""
    failed = F.sum(F.when(F.col("status") == "error", 1).otherwise(0))
    g = files.where("run_id IS NOT NULL").groupBy("run_id").agg(failed.alias("n"))
    return g.select("run_id", F.when(F.col("n") == 0, "completed").otherwise("completed_with_errors").alias("status"), F.when(F.col("n") > 0, F.format_string("%d files failed", "n")).alias("error_message"))


# --- small tables ---------------------------------------------------------------------------------


def put(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new rows replace old ones of the same keys (chat artifacts, settings, model configurations)."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def expire(df: DataFrame, days: int, at: str = "created_at", now: Column | None = None) -> DataFrame:
    return df.where(F.col(at) >= (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {days} DAYS"))


def extensions(c: Column) -> Column:
    """A comma list of extensions in lower case with a leading dot, without repeats."""
    parts = F.filter(F.transform(F.split(F.lower(c), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.when(p.startswith("."), p).otherwise(F.concat(F.lit("."), p))))


def save_settings(settings: DataFrame, allowed: Sequence[str], most_mb: int, by: str, now: Column) -> DataFrame:
    """The one row of upload settings (id, allowed_extensions, max_file_size_mb, updated_at, updated_by), in place of the one before."""
    if not 1 <= most_mb <= 500:
        raise ValueError("the size limit is between 1 and 500 MB")
    one = settings.sparkSession.range(1).select(F.lit("default").alias("id"), extensions(F.lit(",".join(allowed))).alias("allowed_extensions"), F.lit(most_mb).alias("max_file_size_mb"), now.alias("updated_at"), F.lit(by).alias("updated_by"))
    return put(settings, one.select(*[F.col(c).cast(settings.schema[c].dataType).alias(c) for c in settings.columns]), ("id",))


def free_model(model: Column, free: Sequence[str], default: str) -> Column:
    """struct(model, downgraded): a model of the free tier as it is, none as the default, any other as the default and downgraded."""
    kept = model.isin(*free)
    none = model.isNull() | (model == "")
    return F.struct(F.when(kept, model).otherwise(F.lit(default)).alias("model"), (~none & ~kept).alias("downgraded"))


def first_models(configs: DataFrame) -> DataFrame:
    """(usage_type, model_id, chain): the enabled model of the least priority, and all enabled ones in order."""
    return configs.where("enabled").groupBy("usage_type").agg(F.min_by("model_id", F.struct("priority", "model_id")).alias("model_id"), F.transform(F.array_sort(F.collect_list(F.struct("priority", "model_id"))), lambda s: s["model_id"]).alias("chain"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
