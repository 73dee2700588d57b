"""Management hierarchy, row scope and dashboard entitlements."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlens.operators.ranking import ranked
from reachlens.session import materialize

# Role names, the channel that stands for every channel, and the text of a missing role.
TOP_ROLE = "HO GROUP"
EXECUTIVE_ROLE = "SALES EXECUTIVE"
HEAD_ROLES = ("CLUSTER HEAD", "BRANCH HEAD", "HO GROUP")
EVERYTHING = "ALL"
NO_ROLE = "NONE"
FIRST_GROUP = "GROUP 1"

# Keys in one text of a key list.
LIST_KEYS = 1000


def _person_name(column: str) -> Column:
    """Names are compared in upper case with spaces for underscores."""
    return F.upper(F.replace(F.col(column), F.lit("_"), F.lit(" ")))


def _people(hierarchy: DataFrame) -> DataFrame:
    """Name, manager and role, one row per name: of people with the same name the smallest key counts."""
    entry = F.struct("EMPLOYEE_KEY", "MANAGER_NAME", "EMPLOYEE_ROLE")
    first = hierarchy.groupBy(_person_name("EMPLOYEE_NAME").alias("manager")).agg(F.min(entry).alias("entry"))
    return first.select(
        "manager",
        F.upper(F.replace("entry.MANAGER_NAME", F.lit("_"), F.lit(" "))).alias("parent"),
        F.col("entry.EMPLOYEE_ROLE").alias("role"),
    )


def _climb(start: DataFrame, people: DataFrame, carried: str) -> DataFrame:
    """All (manager, carried) pairs above the start rows, up to but not including the top role.

    Paths are doubled: ``jumps`` leads from a manager to the one 2^k levels up, and a round adds to all pairs found so far those
    that many levels higher, so depth d takes about log2(d) rounds, each written to the shared folder. Jumps have
    a row per manager at most. The walk is over when no jump is left, or when a round adds nothing, which is
    how a cycle of managers ends.
    """
    below_top = ~F.col("role").eqNullSafe(F.lit(TOP_ROLE))
    listed = materialize(people.where(below_top).select("manager", "parent"), "listed")
    jumps = materialize(listed.join(listed.select(F.col("manager").alias("parent")), "parent", "left_semi"), "jumps")
    pairs = materialize(start.join(listed, "manager", "left_semi").select("manager", carried).distinct(), "climb")
    before, found = 0, pairs.count()
    while found > before and not jumps.isEmpty():
        higher = pairs.join(jumps, "manager").select(F.col("parent").alias("manager"), carried)
        pairs = materialize(pairs.unionByName(higher).distinct(), "climb")
        before, found = found, pairs.count()
        onward = jumps.select(F.col("manager").alias("parent"), F.col("parent").alias("above"))
        jumps = materialize(jumps.join(onward, "parent").select("manager", F.col("above").alias("parent")), "jumps")
    return pairs


def _managers_of(hierarchy: DataFrame) -> DataFrame:
    """Employee key with own and manager name; the smallest entry counts for a repeated key."""
    entry = F.struct(_person_name("EMPLOYEE_NAME").alias("name"), _person_name("MANAGER_NAME").alias("manager"))
    first = hierarchy.groupBy("EMPLOYEE_KEY").agg(F.min(entry).alias("entry"))
    return first.select("EMPLOYEE_KEY", "entry.name", "entry.manager")


def reportees(hierarchy: DataFrame, access: DataFrame) -> DataFrame:
    """(manager, employee key) for every employee with access rows below a manager, at any depth.

    Rows, not lists: the manager of a third of the company is a third of the rows, not one huge value.
    """
    employees = access.select("EMPLOYEE_KEY").distinct()
    start = employees.join(_managers_of(hierarchy), "EMPLOYEE_KEY").where(F.col("manager").isNotNull())
    return _climb(start, _people(hierarchy), "EMPLOYEE_KEY")


def channels_below(hierarchy: DataFrame, access: DataFrame) -> DataFrame:
    """(name, channel key): own channels and those of everyone below, at any depth."""
    grants = access.select("EMPLOYEE_KEY", "CHANNEL_GROUP_KEY").distinct().join(_managers_of(hierarchy), "EMPLOYEE_KEY")
    own = grants.select(F.col("name").alias("manager"), "CHANNEL_GROUP_KEY")
    start = grants.where(F.col("manager").isNotNull()).select("CHANNEL_GROUP_KEY", "manager").distinct()
    above = _climb(start, _people(hierarchy), "CHANNEL_GROUP_KEY")
    return own.unionByName(above).distinct()


def row_scope(hierarchy: DataFrame, reports: DataFrame, include_self: bool = True) -> DataFrame:
    """Employees whose rows a user sees: (user, scope, employee key).

    The top role sees everything, told by scope ``all`` and no key instead of a row per employee. An
    executive sees the own rows; everyone else those of the reportees, and the own ones with
    ``include_self``. Without it executives see their reportees only, as any other role.
    """
    user = F.col("EMPLOYEE_NT_ID")
    people = hierarchy.select(
        user, "EMPLOYEE_KEY", "EMPLOYEE_ROLE", _person_name("EMPLOYEE_NAME").alias("manager")
    )
    is_top = F.col("EMPLOYEE_ROLE").eqNullSafe(F.lit(TOP_ROLE))
    is_executive = F.col("EMPLOYEE_ROLE").eqNullSafe(F.lit(EXECUTIVE_ROLE))
    top = people.where(is_top).select(user, F.lit("all").alias("scope"), F.lit(None).cast("string").alias("EMPLOYEE_KEY"))
    looks_down = ~is_top & ~is_executive if include_self else ~is_top
    below = (
        people.where(looks_down)
        .drop("EMPLOYEE_KEY")
        .join(reports, "manager")
        .select(user, F.lit("listed").alias("scope"), "EMPLOYEE_KEY")
    )
    scopes = [top, below]
    if include_self:
        scopes.append(people.where(~is_top).select(user, F.lit("listed").alias("scope"), "EMPLOYEE_KEY"))
    return reduce(DataFrame.unionByName, scopes).distinct()


def rows_in_scope(access: DataFrame, scope: DataFrame, user: str) -> DataFrame:
    """Access rows one user sees."""
    mine = scope.where(F.col("EMPLOYEE_NT_ID") == user)
    listed = mine.where(F.col("scope") == "listed").select("EMPLOYEE_KEY")
    sees_all = mine.where(F.col("scope") == "all").agg(F.count(F.lit(1)) > 0).scalar()
    marked = access.join(listed.distinct().withColumn("listed", F.lit(True)), "EMPLOYEE_KEY", "left")
    return marked.where(sees_all | F.col("listed").isNotNull()).drop("listed")


def without_everything(access: DataFrame) -> DataFrame:
    """Access rows of real channels."""
    return access.where(F.col("CHANNEL_GROUP_DISPLAY_NAME") != EVERYTHING)


def may_see_all(hierarchy: DataFrame, access: DataFrame) -> DataFrame:
    """Top-role users that hold the grant for every channel."""
    grants = access.where(F.col("CHANNEL_GROUP_DISPLAY_NAME") == EVERYTHING).select("EMPLOYEE_KEY")
    top = hierarchy.where(F.col("EMPLOYEE_ROLE") == TOP_ROLE)
    return top.join(grants, "EMPLOYEE_KEY", "left_semi").select("EMPLOYEE_NT_ID", "EMPLOYEE_KEY")


def key_lists(df: DataFrame, name: str, key: str, most: int = LIST_KEYS) -> DataFrame:
    """Distinct keys per name joined by ``;``, in parts of ``most`` keys.

    Keys that are no number come first, in order of their text, then the numbers in numeric order. Part n has the keys at the places from
    ``n * most`` on, so no text has more than ``most`` keys, whatever the keys are, and the parts of a name in
    their order are the sorted list.
    """
    pairs = df.select(F.col(name).alias("name"), F.col(key).cast("string").alias("key")).dropna().distinct()
    placed = ranked(pairs.withColumn("number", F.col("key").try_cast("long")), "name", ["number", "key"])
    parts = placed.withColumn("part", F.floor(F.col("rank") / most))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "key")))
    return parts.groupBy("name", "part").agg(F.array_join(F.transform(ordered, lambda entry: entry["key"]), ";").alias("keys"))


def role_or_none(role: Column) -> Column:
    """Role in upper case; a missing role and one that starts with a dash are no role."""
    return F.when(role.isNull() | role.startswith("-"), NO_ROLE).otherwise(F.upper(role))


def roles_of(hierarchy: DataFrame) -> DataFrame:
    """User, key, and both roles."""
    return hierarchy.select(
        F.upper("EMPLOYEE_NT_ID").alias("EMPLOYEE_NT_ID"),
        "EMPLOYEE_KEY",
        role_or_none(F.col("EMPLOYEE_ROLE")).alias("EMPLOYEE_ROLE"),
        role_or_none(F.col("SECONDARY_ROLE")).alias("SECONDARY_ROLE"),
    )


@dataclass(frozen=True)
class Entitlements:
    """Dashboards per authorization group, and the dashboards that roles take away again.

    ``executive_view`` is only for executives, ``manager_view`` not for pure executives, and the first
    group keeps ``home_view`` only in a head role.
    """

    groups: dict[str, tuple[str, ...]]
    executive_view: str
    manager_view: str
    home_view: str


def entitlement_matrix(hierarchy: DataFrame, entitlements: Entitlements) -> DataFrame:
    """(user, dashboard) pairs."""
    group_map = F.create_map(
        *[
            part
            for group, dashboards in entitlements.groups.items()
            for part in (F.lit(group), F.array(*[F.lit(dashboard) for dashboard in dashboards]))
        ]
    )
    primary, secondary = role_or_none(F.col("EMPLOYEE_ROLE")), role_or_none(F.col("SECONDARY_ROLE"))
    is_executive = primary == EXECUTIVE_ROLE
    dashboard = F.col("dashboard")
    removed = (
        ((dashboard == entitlements.executive_view) & ~is_executive & (secondary != EXECUTIVE_ROLE))
        | ((dashboard == entitlements.manager_view) & is_executive & secondary.isin(EXECUTIVE_ROLE, NO_ROLE))
        | (
            (dashboard == entitlements.home_view)
            & (F.upper("AUTH_GROUP") == FIRST_GROUP)
            & ~primary.isin(*HEAD_ROLES)
        )
    )
    granted = hierarchy.withColumn("dashboard", F.explode(F.try_element_at(group_map, F.col("AUTH_GROUP"))))
    return granted.where(~removed).select("EMPLOYEE_NT_ID", "dashboard").distinct()


def remove_entitlement(matrix: DataFrame, removals: DataFrame) -> DataFrame:
    """Take listed (user, dashboard) pairs away."""
    return matrix.join(removals, ["EMPLOYEE_NT_ID", "dashboard"], "left_anti")
