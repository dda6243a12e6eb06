"""Catalog views over cases, checklists and their parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def searchable(applications: DataFrame) -> DataFrame:
    return applications.where(F.col("status").isin("indexed", "analyzed"))


def case_list(applications: DataFrame, links: DataFrame, user_id: int, show_all: bool, checklist_id: int | None, term: str) -> DataFrame:
    """Cases of the list view: own or ownerless unless all are shown, of one checklist if given, by a part of the name."""
    found = applications.where(F.lit(show_all) | F.col("user_id").isNull() | (F.col("user_id") == user_id))
    found = found.where(F.lower("name").contains(term.strip().lower()))
    if checklist_id is not None:
        found = found.join(links.where(F.col("checklist_id") == checklist_id).select(F.col("application_id").alias("id")), "id", "left_semi")
    return found


def visible_checklists(checklists: DataFrame, user_id: int) -> DataFrame:
    return checklists.where((F.col("user_id") == user_id) | F.col("is_public"))


def unassigned_checklists(checklists: DataFrame, links: DataFrame, application_id: int) -> DataFrame:
    used = links.where(F.col("application_id") == application_id).select(F.col("checklist_id").alias("id"))
    return checklists.join(used, "id", "left_anti")


def deletable_checklists(checklists: DataFrame, links: DataFrame) -> DataFrame:
    return checklists.join(links.select(F.col("checklist_id").alias("id")), "id", "left_anti")


def deletion_notice(checklists: DataFrame, links: DataFrame) -> DataFrame:
    """id, n_applications, notice: why a checklist in use stays; null for one that can go."""
    n = F.col("n_applications")
    uses = links.groupBy(F.col("checklist_id").alias("of")).agg(F.count("*").alias("n"))
    joined = checklists.join(uses, F.col("id") == F.col("of"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n_applications"))
    noun = F.when((n % 10 == 1) & (n % 100 != 11), "заявке").otherwise("заявках")
    return joined.withColumn("notice", F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), noun)))


def owner_labels(applications: DataFrame, users: DataFrame, user_id: int) -> DataFrame:
    """id, label: self, none, or the owner's name."""
    names = users.select(F.col("id").alias("owner"), "username")
    joined = applications.join(names, F.col("user_id") == F.col("owner"), "left")
    return joined.select("id", F.when(F.col("user_id") == user_id, "self").when(F.col("owner").isNull(), "none").otherwise(F.col("username")).alias("label"))


def checklist_usage(checklists: DataFrame, parameters: DataFrame, links: DataFrame) -> DataFrame:
    """Parameters and cases of each checklist, each counted before it is joined."""
    p = parameters.groupBy(F.col("checklist_id").alias("p_of")).agg(F.count("*").alias("n_parameters"))
    a = links.groupBy(F.col("checklist_id").alias("a_of")).agg(F.count("*").alias("n_applications"))
    joined = checklists.join(p, F.col("id") == F.col("p_of"), "left").join(a, F.col("id") == F.col("a_of"), "left")
    return joined.select("id", "name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_parameters", "n_applications")))


def case_usage(applications: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """Checklists and files of each case."""
    c = links.groupBy(F.col("application_id").alias("c_of")).agg(F.count("*").alias("n_checklists"))
    f = files.groupBy(F.col("application_id").alias("f_of")).agg(F.count("*").alias("n_files"))
    joined = applications.join(c, F.col("id") == F.col("c_of"), "left").join(f, F.col("id") == F.col("f_of"), "left")
    return joined.select("id", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("n_checklists", "n_files")))


def users_by_role(users: DataFrame) -> DataFrame:
    return users.groupBy("role").agg(F.count("*").alias("n"))


def distinct_checklists(links: DataFrame, checklists: DataFrame) -> DataFrame:
    """Checklists used by any of the cases, once each; order by name, then id."""
    return checklists.join(links.select(F.col("checklist_id").alias("id")), "id", "left_semi").select("id", "name").orderBy("name", "id")


def next_order_index(checklists: DataFrame, parameters: DataFrame) -> DataFrame:
    top = parameters.groupBy(F.col("checklist_id").alias("of")).agg(F.max("order_index").alias("top"))
    return checklists.join(top, F.col("id") == F.col("of"), "left").select("id", F.coalesce(F.col("top") + 1, F.lit(0)).alias("next_index"))


def reindexed(parameters: DataFrame) -> DataFrame:
    """Dense order_index by id within each checklist."""
    w = Window.partitionBy("checklist_id").orderBy("id")
    return parameters.withColumn("order_index", (F.row_number().over(w) - 1).cast("int"))


def llm_query(llm: Column, search: Column) -> Column:
    """The model's question: the search query where there is none, or an empty one."""
    return F.coalesce(F.nullif(llm, F.lit("")), search)


def placed(rows: DataFrame, by: list[str], *order: str | Column) -> DataFrame:
    """Adds place, from 1, in each group's list in that order; ties go to the lower id."""
    w = Window.partitionBy(*by).orderBy(*order, "id")
    return rows.withColumn("place", F.row_number().over(w))


def newest_first(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds place in each group's list from the newest on; ties go to the higher id."""
    return placed(rows, by, F.desc("created_at"), F.desc("id"))


#: The model that only embeds, and what is shown of a model of which nothing is known.
EMBEDDING_MODEL = "bge-m3:latest"
UNKNOWN = {"context_length": 8192, "parameter_size": "Неизвестно", "family": "Неизвестно"}


def usable_models(models: DataFrame) -> DataFrame:
    return models.where(F.col("name") != EMBEDDING_MODEL).select("name")


def model_info(models: DataFrame, info: DataFrame, details: DataFrame) -> DataFrame:
    """name and the fields of UNKNOWN: from info where it has the model, else from its details, else the constants; each fills its own gaps."""
    rows = lambda df, x: df.select(F.col("name").alias(f"{x}_name"), *(F.col(c).alias(f"{x}_{c}") for c in UNKNOWN))
    joined = models.join(rows(info, "i"), F.col("name") == F.col("i_name"), "left").join(rows(details, "d"), F.col("name") == F.col("d_name"), "left")
    known = lambda c: F.when(F.col("i_name").isNotNull(), F.col(f"i_{c}")).otherwise(F.col(f"d_{c}"))
    return joined.select("name", *(F.coalesce(known(c), F.lit(v)).alias(c) for c, v in UNKNOWN.items()))
