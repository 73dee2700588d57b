from helpers import rows

from reachlens.operators import ranking, scope
from reachlens.schemas import REF_EMPLOYEE_ACCESS, REF_EMPLOYEE_HIERARCHY

ENTITLEMENTS = scope.Entitlements(
    {"Group 1": ("mine", "team", "home", "tv"), "Group 2": ("home", "tv")}, "mine", "team", "home"
)


def hierarchy(spark, *people):
    """(key, name, role, second role, manager, group)"""
    return spark.createDataFrame(
        [(k, f"u{k}", n, r, s, m, g) for k, n, r, s, m, g in people], REF_EMPLOYEE_HIERARCHY
    )


def access(spark, *grants):
    return spark.createDataFrame([(k, c, c if c == "ALL" else f"Channel {c}", loc) for k, c, loc in grants], REF_EMPLOYEE_ACCESS)


def company(spark):
    people = hierarchy(
        spark,
        ("0", "Top", "HO GROUP", None, None, "Group 1"),
        ("1", "Head_A", "CLUSTER HEAD", "-", "Top", "Group 1"),
        ("2", "Mid", "BRANCH HEAD", "-", "Head A", "Group 2"),
        ("3", "Low", "SALES EXECUTIVE", None, "Mid", "Group 1"),
        ("4", "Lone", "SALES EXECUTIVE", "BRANCH HEAD", "Nobody", "Group 1"),
    )
    grants = access(
        spark, ("0", "ALL", "9"), ("2", "a", "1"), ("3", "b", "2"), ("3", "a", "2"), ("4", "c", "3"), ("8", "z", "4")
    )
    return people, grants


def test_reportees_stop_below_the_top(spark):
    assert rows(scope.reportees(*company(spark)), "manager", "EMPLOYEE_KEY") == [
        ("HEAD A", "2"),
        ("HEAD A", "3"),
        ("MID", "3"),
    ]


def test_channels_of_everyone_below_and_own(spark):
    """An employee without hierarchy entry is skipped, the others are not."""
    assert rows(scope.channels_below(*company(spark)), "manager", "CHANNEL_GROUP_KEY") == [
        ("HEAD A", "a"),
        ("HEAD A", "b"),
        ("LONE", "c"),
        ("LOW", "a"),
        ("LOW", "b"),
        ("MID", "a"),
        ("MID", "b"),
        ("TOP", "ALL"),
    ]


def test_a_cycle_of_managers_ends(spark):
    people = hierarchy(
        spark,
        ("1", "A", "BRANCH HEAD", None, "B", "Group 1"),
        ("2", "B", "BRANCH HEAD", None, "C", "Group 1"),
        ("3", "C", "BRANCH HEAD", None, "A", "Group 1"),
        ("4", "D", "SALES EXECUTIVE", None, "A", "Group 1"),
    )
    grants = access(spark, ("4", "x", "1"), ("1", "y", "1"))
    assert rows(scope.reportees(people, grants), "manager", "EMPLOYEE_KEY") == [
        (manager, key) for manager in "ABC" for key in "14"
    ]
    assert rows(scope.channels_below(people, grants), "manager", "CHANNEL_GROUP_KEY") == [
        (manager, channel) for manager in "ABC" for channel in "xy"
    ] + [("D", "x")]


def test_a_deep_chain_has_no_depth_limit(spark):
    people = hierarchy(
        spark, *[(str(i), f"P{i}", "BRANCH HEAD", None, f"P{i - 1}" if i else None, "Group 1") for i in range(12)]
    )
    found = scope.reportees(people, access(spark, ("11", "x", "1")))
    assert found.count() == 11


def test_row_scope_per_role(spark):
    people, grants = company(spark)
    reports = scope.reportees(people, grants)
    assert rows(scope.row_scope(people, reports), "EMPLOYEE_NT_ID", "scope", "EMPLOYEE_KEY") == [
        ("u0", "all", None),
        ("u1", "listed", "1"),
        ("u1", "listed", "2"),
        ("u1", "listed", "3"),
        ("u2", "listed", "2"),
        ("u2", "listed", "3"),
        ("u3", "listed", "3"),
        ("u4", "listed", "4"),
    ]
    only_reports = scope.row_scope(people, reports, include_self=False)
    assert rows(only_reports, "EMPLOYEE_NT_ID", "EMPLOYEE_KEY") == [("u0", None), ("u1", "2"), ("u1", "3"), ("u2", "3")]


def test_rows_in_scope(spark):
    people, grants = company(spark)
    scopes = scope.row_scope(people, scope.reportees(people, grants))
    mine = scope.without_everything(scope.rows_in_scope(grants, scopes, "u2"))
    assert rows(mine, "EMPLOYEE_KEY", "CHANNEL_GROUP_KEY") == [("2", "a"), ("3", "a"), ("3", "b")]
    assert scope.rows_in_scope(grants, scopes, "u0").count() == 6
    assert scope.rows_in_scope(grants, scopes, "nobody").isEmpty()


def test_only_the_top_role_with_the_grant_sees_all(spark):
    people, grants = company(spark)
    assert rows(scope.may_see_all(people, grants), "EMPLOYEE_NT_ID") == [("u0",)]
    assert scope.may_see_all(people, grants.where("CHANNEL_GROUP_KEY <> 'ALL'")).isEmpty()


def test_entitlements(spark):
    found = rows(scope.entitlement_matrix(company(spark)[0], ENTITLEMENTS), "EMPLOYEE_NT_ID", "dashboard")
    assert found == [
        ("u0", "home"),
        ("u0", "team"),
        ("u0", "tv"),
        ("u1", "home"),
        ("u1", "team"),
        ("u1", "tv"),
        ("u2", "home"),
        ("u2", "tv"),
        ("u3", "mine"),
        ("u3", "tv"),
        ("u4", "mine"),
        ("u4", "team"),
        ("u4", "tv"),
    ]


def test_entitlements_of_an_unknown_group_and_removals(spark):
    people = hierarchy(spark, ("1", "A", "BRANCH HEAD", None, None, "Group 9"), ("2", "B", "X", None, None, "Group 2"))
    matrix = scope.entitlement_matrix(people, ENTITLEMENTS)
    assert rows(matrix, "EMPLOYEE_NT_ID", "dashboard") == [("u2", "home"), ("u2", "tv")]
    removed = spark.createDataFrame([("u2", "tv")], "EMPLOYEE_NT_ID string, dashboard string")
    assert rows(scope.remove_entitlement(matrix, removed), "dashboard") == [("home",)]


def key_parts(spark, pairs, most):
    found = scope.key_lists(spark.createDataFrame(pairs, "n string, k string"), "n", "k", most=most).collect()
    return {(row["name"], row["part"]): row["keys"] for row in found}


def test_key_lists_have_one_form_at_every_size(spark):
    pairs = [("long", str(i)) for i in range(95)] * 2 + [("short", "b"), ("short", "a"), ("short", "7")]
    assert key_parts(spark, pairs, 10) == {
        **{("long", part): ";".join(str(i) for i in range(10 * part, min(10 * part + 10, 95))) for part in range(10)},
        ("short", 0): "a;b;7",
    }


def test_no_key_text_is_longer_than_the_rest(spark):
    """Texts, negative, equal and huge numbers: every part has its number of keys, the parts make up the sorted list."""
    keys = [f"key {i:03}" for i in range(57)] + [str(i - 20) for i in range(40)] + ["07", "7", str(3 * 10**15), str(2**63), "-9"]
    expected = sorted(
        set(keys), key=lambda k: (int(k) if k.lstrip("-").isdigit() and int(k) < 2**63 else -(2**70), k)
    )
    parts = key_parts(spark, [("x", k) for k in keys] + [("x", None), (None, "y"), ("", "z")], 8)
    texts = [parts["x", part].split(";") for part in range(len(parts) - 1)]
    assert [len(t) for t in texts[:-1]] == [8] * (len(texts) - 1) and 0 < len(texts[-1]) <= 8
    assert [k for t in texts for k in t] == expected and parts["", 0] == "z"


def test_ranks_over_partitions(spark):
    rows_ = [(g, i) for g in "abc" for i in range(200 if g == "b" else 3)] + [("b", None), (None, 5)]
    df = spark.createDataFrame(rows_, "g string, i int").where("g is not null").repartition(6)
    found = {(r.g, r.i): r.place for r in ranking.ranked(df, "g", ["i"], "place").collect()}
    assert found[("b", None)] == 0 and all(found["b", i] == i + 1 for i in range(200))
    assert all(found[g, i] == i for g in "ac" for i in range(3))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """A thousand managers above each other: rounds go with the logarithm of the depth."""
    people = hierarchy(
        spark,
        ("0", "P0", "HO GROUP", None, None, "Group 1"),
        *[(str(i), f"P{i}", "BRANCH HEAD", None, f"P{i - 1}", "Group 1") for i in range(1, 1002)],
    )
    rounds, write = [], scope.materialize
    monkeypatch.setattr(scope, "materialize", lambda df, label: rounds.append(label) or write(df, label))
    found = scope.reportees(people, access(spark, ("1001", "a", "1"), ("500", "a", "1")))
    assert rounds.count("climb") <= 11
    pairs = {(r.manager, r.EMPLOYEE_KEY) for r in found.collect()}
    assert pairs == {(f"P{i}", "1001") for i in range(1, 1001)} | {(f"P{i}", "500") for i in range(1, 500)}
    assert found.count() == len(pairs)


def test_long_and_short_cycles_end(spark):
    """Paths of different lengths that run into a cycle of seven, and one who manages oneself."""
    people = hierarchy(
        spark,
        *[(str(i), f"C{i}", "BRANCH HEAD", None, f"C{(i + 1) % 7}", "Group 1") for i in range(7)],
        *[(str(i), f"C{i}", "BRANCH HEAD", None, f"C{i - 1}", "Group 1") for i in range(7, 20)],
        ("99", "Self", "BRANCH HEAD", None, "Self", "Group 1"),
    )
    found = scope.reportees(people, access(spark, ("19", "a", "1"), ("99", "a", "1"), ("3", "a", "1")))
    pairs = {(r.manager, r.EMPLOYEE_KEY) for r in found.collect()}
    assert pairs == {(f"C{i}", "19") for i in range(19)} | {(f"C{i}", "3") for i in range(7)} | {("SELF", "99")}


def test_a_manager_over_most_rows(spark):
    """One manager has nearly everyone below; the closure is still a row per employee."""
    people = hierarchy(
        spark,
        ("0", "Top", "HO GROUP", None, None, "Group 1"),
        ("1", "Hot", "BRANCH HEAD", None, "Top", "Group 1"),
        *[(str(i), f"E{i}", "SALES EXECUTIVE", None, "Hot" if i % 10 else "Top", "Group 1") for i in range(2, 400)],
    )
    grants = access(spark, *[(str(i), "a", "1") for i in range(2, 400)])
    found = rows(scope.reportees(people, grants), "manager", "EMPLOYEE_KEY")
    assert found == sorted(("HOT", str(i)) for i in range(2, 400) if i % 10)
