"""Roles, scopes, users and navigation as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seeds. Fixed values.
ROLES = ("admin", "user")
SCOPES = ("chat:read", "chat:write", "documents:read", "documents:write", "admin:eval:read", "admin:eval:write", "admin:review:read", "admin:review:write", "admin:rbac:read", "admin:rbac:write")
USER_SCOPES = ("chat:read", "chat:write", "documents:read")


def seed(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """roles(id, name), scopes(id, code), role_scopes(role_id, scope_id): admin has all scopes."""
    roles = spark.createDataFrame([(i + 1, r) for i, r in enumerate(ROLES)], "id int, name string")
    scopes = spark.createDataFrame([(i + 1, s) for i, s in enumerate(SCOPES)], "id int, code string")
    grants = [(1, i + 1) for i in range(len(SCOPES))] + [(2, SCOPES.index(s) + 1) for s in USER_SCOPES]
    return roles, scopes, spark.createDataFrame(grants, "role_id int, scope_id int")


def list_users(users: DataFrame, roles: DataFrame, role_id: int | None = None, search: str | None = None, is_active: bool | None = None) -> DataFrame:
    """Users with their role's name ('' where it is missing), by id; search matches anywhere without case, % and _ being wildcards."""
    if role_id is not None:
        users = users.where(F.col("role_id") == role_id)
    if is_active is not None:
        users = users.where(F.col("is_active") == is_active)
    if search:
        users = users.where(F.col("username").ilike(f"%{search}%"))
    names = roles.select(F.col("id").alias("role_id"), F.col("name").alias("role"))
    return users.join(names, "role_id", "left").withColumn("role", F.coalesce("role", F.lit(""))).orderBy("id")


def role_codes(roles: DataFrame, role_scopes: DataFrame, scopes: DataFrame) -> DataFrame:
    """role, codes: each role's scope codes, sorted; empty for none."""
    granted = role_scopes.join(scopes.select(F.col("id").alias("scope_id"), "code"), "scope_id")
    lists = granted.groupBy(F.col("role_id").alias("id")).agg(F.array_sort(F.collect_list("code")).alias("codes"))
    return roles.join(lists, "id", "left").select(F.col("name").alias("role"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def ungranted(scopes: DataFrame, role_scopes: DataFrame, role_id: int) -> DataFrame:
    """Scopes that a role lacks."""
    return scopes.join(role_scopes.where(F.col("role_id") == role_id).select(F.col("scope_id").alias("id")), "id", "left_anti")


def unknown_codes(requested: DataFrame, scopes: DataFrame) -> DataFrame:
    """Requested codes that no scope has, sorted."""
    return requested.select("code").distinct().join(scopes.select("code"), "code", "left_anti").orderBy("code")


def missing(required: Column, held: Column) -> Column:
    """Required scopes that are not held, in the order required, repeats kept."""
    return F.filter(required, lambda r: ~F.array_contains(held, r))


def visible(required: Column, held: Column, match: Column) -> Column:
    """Whether a navigation entry shows: nothing required, or any or all of it held."""
    required = F.coalesce(required, F.array().cast("array<string>"))
    every = F.forall(required, lambda r: F.array_contains(held, r))
    return F.when(F.size(required) == 0, True).when(match == "all", every).otherwise(F.arrays_overlap(required, held))


def flatten_routes(tree: list[dict]) -> list[dict]:
    """route, label, required_scopes, match and group_path of every leaf of a navigation tree, which is as small as a menu."""
    out: list[dict] = []
    open_ = [(node, ()) for node in reversed(tree)]
    while open_:
        node, path = open_.pop()
        if node.get("isGroup"):
            open_ += [(x, (*path, node.get("label"))) for x in reversed(node.get("children") or [])]
        elif node.get("route"):
            out.append({"route": node["route"], "label": node.get("label"), "required_scopes": list(node.get("requiredScopes") or []), "match": node.get("match") or "any", "group_path": list(path)})
    return out


def visible_groups(leaves: DataFrame, held: Column) -> DataFrame:
    """group: the groups on the path of at least one visible leaf. leaves: route, required_scopes, match, group_path."""
    return leaves.where(visible(F.col("required_scopes"), held, F.coalesce("match", F.lit("any")))).select(F.explode("group_path").alias("group")).distinct()


def replace_grants(role_scopes: DataFrame, role_id: int, codes: list[str] | DataFrame, scopes: DataFrame) -> DataFrame:
    """role_scopes with the role's grants replaced by those of codes, a list or a table with a column code."""
    wanted = scopes.join(codes.select("code").distinct(), "code", "left_semi") if isinstance(codes, DataFrame) else scopes.where(F.col("code").isin(*codes))
    new = wanted.select(F.lit(role_id).alias("role_id"), F.col("id").alias("scope_id"))
    return role_scopes.where(F.col("role_id") != role_id).unionByName(new)


def role_responses(roles: DataFrame) -> DataFrame:
    """What a caller sees of roles."""
    return roles.select("id", "name", "description")


def user_responses(users: DataFrame, roles: DataFrame) -> DataFrame:
    """What a caller sees of users: their role by name ('' where it is missing), when they came and were last here; no secret of theirs."""
    names = roles.select(F.col("id").alias("role_id"), F.col("name").alias("role_name"))
    return users.join(names, "role_id", "left").select("id", "username", "role_id", F.coalesce("role_name", F.lit("")).alias("role_name"), "is_active", "created_at", "last_login_at")
