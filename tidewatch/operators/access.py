"""Who may see what: semi-joins against memberships and dataset grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANAGERS = ("owner", "admin")


def can_manage(role: Column) -> Column:
    return role.isin(*MANAGERS)


def can_mutate(role: Column) -> Column:
    return role != "viewer"


def visible_datasets(members: DataFrame, access: DataFrame, user_id, manage: bool = False) -> DataFrame:
    """dataset_id values the user can read (or manage, as owner or admin)."""
    mine = members.filter(F.col("user_id") == user_id)
    grants = access
    if manage:
        mine = mine.filter(can_manage(F.col("role")))
        grants = grants.filter(F.col("access_level") == "manage")
    return mine.join(grants, "organization_id").select("dataset_id").distinct()


def administered_datasets(members: DataFrame, datasets: DataFrame, user_id) -> DataFrame:
    """Datasets whose owning organisation the user runs."""
    mine = members.filter((F.col("user_id") == user_id) & can_manage(F.col("role")))
    return datasets.join(
        mine.select(F.col("organization_id").alias("owner_organization_id")),
        "owner_organization_id", "left_semi").select("dataset_id")


def importable_datasets(members: DataFrame, access: DataFrame, user_id) -> DataFrame:
    """Datasets the user may import into: any granted one, unless only a viewer."""
    mine = members.filter((F.col("user_id") == user_id) & can_mutate(F.col("role")))
    return mine.join(access, "organization_id").select("dataset_id").distinct()


def restrict(facts: DataFrame, datasets: DataFrame) -> DataFrame:
    """Rows of the allowed datasets.  Filters pass through to the scan."""
    return facts.join(datasets, "dataset_id", "left_semi")


def restrict_to_organisation(facts: DataFrame, members: DataFrame, user_id) -> DataFrame:
    mine = members.filter(F.col("user_id") == user_id).select("organization_id")
    return facts.join(mine, "organization_id", "left_semi")


def organisations_of(members: DataFrame, organisations: DataFrame, user_id) -> DataFrame:
    return members.filter(F.col("user_id") == user_id).join(
        organisations, "organization_id").select(
        "organization_id", "name", "role").orderBy("name")


def accessible_datasets(members: DataFrame, access: DataFrame, datasets: DataFrame,
                        user_id) -> DataFrame:
    """Datasets of the user with the strongest grant (manage over read), by name."""
    strength = F.when(F.col("access_level") == "manage", 2).otherwise(1)
    mine = members.filter(F.col("user_id") == user_id).select("organization_id").distinct()
    best = access.join(mine, "organization_id", "left_semi").groupBy("dataset_id").agg(
        F.max_by("access_level", strength).alias("access_level"))
    return best.join(datasets, "dataset_id").select(
        "dataset_id", "name", "access_level").orderBy("name")
