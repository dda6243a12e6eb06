"""Row-level access rules as reusable predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEVATED = ("admin", "prompt_engineer")
ROLE_NAMES = {"admin": "Администратор", "prompt_engineer": "Промпт-инженер", "user": "Пользователь"}


def elevated(role: Column) -> Column:
    return role.isin(*ELEVATED)


def owns(user_id: int, owner: Column) -> Column:
    return F.coalesce(owner == user_id, F.lit(False))


def may_use_case(role: str, user_id: int, owner: Column) -> Column:
    """View, edit, delete or analyse a case: elevated, or its owner."""
    return F.lit(role in ELEVATED) | owns(user_id, owner)


def may_see_checklist(role: str, user_id: int, owner: Column, public: Column) -> Column:
    return F.lit(role in ELEVATED) | owns(user_id, owner) | F.coalesce(public, F.lit(False))


def role_of(users: DataFrame, user_id: int) -> str:
    """The role of one user; a point lookup, which fails for an unknown id."""
    row = users.where(F.col("id") == user_id).select("role").first()
    if row is None:
        raise LookupError(f"no user {user_id}")
    return row.role


def accessible_cases(applications: DataFrame, role: str, user_id: int) -> DataFrame:
    return applications.where(may_use_case(role, user_id, F.col("user_id")))


def rejected_cases(requested: DataFrame, applications: DataFrame, role: str, user_id: int) -> DataFrame:
    """Requested ids that are unknown or not accessible; a search runs only if there are none."""
    return requested.join(accessible_cases(applications, role, user_id).select("id"), "id", "left_anti")


def visible_counts(users: DataFrame, applications: DataFrame, checklists: DataFrame) -> DataFrame:
    """Cases and checklists each user can count: all of them if elevated, else the owned ones."""
    per = lambda df, name: df.groupBy(F.col("user_id").alias("owner")).agg(F.count("*").alias(name))
    totals = applications.agg(F.count("*").alias("all_apps")).crossJoin(checklists.agg(F.count("*").alias("all_lists")))  # one row each
    a, c = per(applications, "own_apps").alias("a"), per(checklists, "own_lists").alias("c")
    joined = users.join(a, F.col("a.owner") == F.col("id"), "left").join(c, F.col("c.owner") == F.col("id"), "left").crossJoin(F.broadcast(totals))
    pick = lambda everything, own: F.when(elevated(F.col("role")), F.col(everything)).otherwise(F.coalesce(F.col(own), F.lit(0)))
    return joined.select("id", pick("all_apps", "own_apps").alias("applications"), pick("all_lists", "own_lists").alias("checklists"))


def publishable(role: str, user_id: int, requested: Column, owner: Column, creating: bool) -> Column:
    """is_public as stored: on create only for the elevated, on edit also for the owner; else false."""
    allowed = F.lit(role in ELEVATED) if creating else F.lit(role in ELEVATED) | owns(user_id, owner)
    return F.when(allowed, requested).otherwise(F.lit(False))


#: What is shown of each role's rights.
PERMISSIONS = {
    "admin": ["Полный доступ ко всем функциям системы", "Управление пользователями", "Управление LLM моделями", "Создание и редактирование всех чек-листов", "Просмотр и управление всеми заявками", "Доступ к системной статистике"],
    "prompt_engineer": ["Полный доступ ко всем функциям системы (кроме управления пользователями)", "Создание и редактирование всех чек-листов", "Управление LLM моделями", "Создание и управление всеми заявками", "Просмотр всех заявок и статистики"],
    "user": ["Создание и редактирование своих чек-листов", "Просмотр только своих чек-листов", "Создание и управление своими заявками", "Семантический поиск"],
}
RESTRICTIONS = {"prompt_engineer": ["Управление пользователями"], "user": ["Редактирование чужих чек-листов", "Просмотр чужих заявок", "Управление пользователями", "Управление LLM моделями"]}


def _texts(items: list[str]) -> Column:
    return F.array(*map(F.lit, items)).cast("array<string>")


def permissions(role: Column) -> Column:
    """An unknown role has a user's."""
    return F.when(role == "admin", _texts(PERMISSIONS["admin"])).when(role == "prompt_engineer", _texts(PERMISSIONS["prompt_engineer"])).otherwise(_texts(PERMISSIONS["user"]))


def restrictions(role: Column) -> Column:
    """None for the admin and unknown roles."""
    return F.when(role == "prompt_engineer", _texts(RESTRICTIONS["prompt_engineer"])).when(role == "user", _texts(RESTRICTIONS["user"])).otherwise(_texts([]))


def has_role(role: Column, *roles: str) -> Column:
    """What a view asks for that only some roles may open; a missing role has none."""
    return F.coalesce(role.isin(*roles), F.lit(False))
