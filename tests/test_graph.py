import itertools
import random

import pytest

from codequarry.operators import graph, inheritance as inh

CALL = "caller string, callee string, caller_file string, caller_line int, repo_name string, call_type string"


def calls(spark, *pairs, repo="r"):
    return spark.createDataFrame([(a, b, f"{a}.py", i, repo, "direct") for i, (a, b) in enumerate(pairs)], CALL)


def nodes(df, column="node"):
    return sorted(r[column] for r in df.collect())


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_chain(spark):
    c = calls(spark, ("A", "B"), ("B", "C"), ("D", "C"))
    assert nodes(graph.find_callers(c, "C"), "caller") == ["B", "D"]
    assert nodes(graph.find_callers(c, "C", max_depth=2), "caller") == ["A", "B", "D"]
    assert nodes(graph.find_callees(c, "A", max_depth=1), "callee") == ["B"]
    assert graph.find_callees(c, "missing").isEmpty() and graph.find_callees(c, "missing", max_depth=3).isEmpty()


def test_start_in_a_cycle_is_its_own_caller_once(spark):
    c = calls(spark, ("A", "B"), ("B", "A"), ("A", "A"))
    rows = {(r["caller"], r["depth"]) for r in graph.find_callers(c, "A", max_depth=5).collect()}
    assert rows == {("A", 1), ("B", 1)}


def test_first_relation_represents_a_caller(spark):
    c = spark.createDataFrame([("X", "B", "z.py", 9, "r", "d"), ("X", "B", "a.py", 5, "r", "d"), ("X", "A", "z.py", 1, "r", "d"), ("A", "B", "q.py", 1, "r", "d")], CALL)
    row = graph.find_callers(c, "B", max_depth=2).where("caller = 'X'").first()
    assert (row["caller_file"], row["caller_line"], row["depth"]) == ("a.py", 5, 1)


def test_path(spark):
    c = calls(spark, ("A", "C"), ("A", "B"), ("B", "D"), ("C", "D"), ("D", "E"), ("E", "A"))
    assert graph.find_path(c, "A", "D").first()["path"] == ["A", "B", "D"]
    assert graph.find_path(c, "A", "A").first()["path"] == ["A", "B", "D", "E", "A"]
    assert graph.find_path(c, "A", "E", max_depth=2).isEmpty()
    assert graph.find_path(c, "D", "X").isEmpty()


def test_dead_code(spark):
    c = calls(spark, ("main", "used"), ("used", "helper"), ("orphan", "helper"), ("loop1", "loop2"), ("loop2", "loop1"))
    assert nodes(graph.reachable(c, seeds(spark, "main", "main", "absent"))) == ["absent", "helper", "main", "used"]
    assert nodes(graph.unreachable(c, seeds(spark, "main"))) == ["loop1", "loop2", "orphan"]
    assert nodes(graph.never_called(c)) == ["main", "orphan"]


def test_scopes_without_starts_or_without_edges(spark):
    c = calls(spark, ("A", "B"), repo="r1").union(calls(spark, ("A", "B"), repo="r2"))
    starts = spark.createDataFrame([("r1", "A"), ("r3", "Z")], "repo_name string, node string")
    found = graph.reachable(c, starts, ["repo_name"])
    assert sorted((r["repo_name"], r["node"], r["depth"]) for r in found.collect()) == [("r1", "A", 0), ("r1", "B", 1), ("r3", "Z", 0)]
    none = starts.where("repo_name = 'r9'")
    assert graph.reachable(c, none, ["repo_name"]).isEmpty()
    assert graph.reachable(c, none.select("node")).isEmpty()


def components(df):
    found = {}
    for r in df.collect():
        found.setdefault((r["repo_name"], r["component"]), set()).add(r["node"])
    return {(repo, frozenset(m)) for (repo, _), m in found.items()}


def test_cycles(spark):
    one = calls(spark, ("A", "B"), ("B", "C"), ("C", "A"), ("D", "E"), ("S", "S"), ("E", "A"), ("A", "X"), repo="r1")
    two = calls(spark, ("A", "B"), ("B", "A"), ("P", "Q"), ("Q", "P"), ("B", "P"), repo="r2")
    found = graph.cycles(one.union(two), "caller", "callee", ["repo_name"])
    assert components(found) == {("r1", frozenset("ABC")), ("r2", frozenset("AB")), ("r2", frozenset("PQ"))}
    assert graph.cycles(calls(spark, ("A", "B")), "caller", "callee", ["repo_name"]).isEmpty()


def closure(edges):
    reach = {n: {t for s, t in edges if s == n} for n in set(itertools.chain(*edges))}
    changed = True
    while changed:
        changed = False
        for n, targets in reach.items():
            bigger = targets.union(*(reach[t] for t in targets)) if targets else targets
            changed |= bigger != targets
            reach[n] = bigger
    return reach


def test_cycles_and_reachability_against_brute_force(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)]
    reach = closure(edges)
    expected = {frozenset(m for m in reach if m in reach[n] and n in reach[m]) for n in reach if n in reach[n]}
    c = calls(spark, *edges)
    assert {m for _, m in components(graph.cycles(c, "caller", "callee", ["repo_name"]))} == {m for m in expected if len(m) > 1}
    start = edges[0][0]
    assert set(nodes(graph.reachable(c, seeds(spark, start)))) == reach[start] | {start}


@pytest.mark.parametrize("seed", range(3))
def test_components_and_distances_of_random_graphs(spark, seed):
    """Chains, trees in both directions, rings with tails and dense parts, in two scopes."""
    rng = random.Random(seed)
    edges = []
    for repo in ("r1", "r2"):
        n = rng.randint(20, 50)
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([n // 2, n, 2 * n]))]
        at = n
        for _ in range(rng.randint(2, 5)):
            size, shape = rng.randint(2, 12), rng.choice(["chain", "ring", "in", "out"])
            own = list(range(at, at + size))
            at += size
            pairs += list(zip(own, own[1:])) if shape in ("chain", "ring") else []
            pairs += [(own[-1], own[0])] if shape == "ring" else []
            pairs += [(own[k], own[(k - 1) // 2]) if shape == "in" else (own[(k - 1) // 2], own[k]) for k in range(1, size)] if shape in ("in", "out") else []
            pairs += [(rng.randrange(at), rng.choice(own)), (rng.choice(own), rng.randrange(at))][: rng.randint(0, 2)]
        edges += [(repo, f"n{a:03d}", f"n{b:03d}") for a, b in pairs]
    df = spark.createDataFrame([(a, b, "f", 1, repo, "d") for repo, a, b in edges], CALL)
    want = set()
    for repo in ("r1", "r2"):
        own = [(a, b) for r, a, b in edges if r == repo]
        reach = closure(own)
        want |= {(repo, frozenset(m for m in reach if m in reach[x] and x in reach[m])) for x in reach if x in reach[x]}
    found = graph.cycles(df, "caller", "callee", ["repo_name"])
    assert components(found) == {(r, m) for r, m in want if len(m) > 1}
    assert all(row["component"] == min(m) for row in found.collect() for r, m in want if r == row["repo_name"] and row["node"] in m)
    starts = [(r, f"n{rng.randrange(40):03d}") for r in ("r1", "r1", "r2")]
    depth = {(r, x): 0 for r, x in starts}
    frontier = list(depth)
    while frontier:
        step = [(r, b) for r, x in frontier for q, a, b in edges if (q, a) == (r, x)]
        frontier = [k for k in dict.fromkeys(step) if k not in depth]
        depth.update(dict.fromkeys(frontier, max(depth.values()) + 1))
    got = graph.reachable(df, spark.createDataFrame(starts, "repo_name string, node string"), ["repo_name"]).collect()
    assert len(got) == len(depth) and {(r["repo_name"], r["node"]): r["depth"] for r in got} == depth


def counted(monkeypatch):
    """How many tables a walk writes."""
    from codequarry.operators import contraction

    written, real = [], contraction.cut

    def cut(df):
        written.append(1)
        return real(df)

    monkeypatch.setattr(contraction, "cut", cut)
    return written


def test_long_chains_and_rings_take_few_rounds(spark, monkeypatch):
    n = 5000
    written = counted(monkeypatch)
    chain = spark.range(n).selectExpr("concat('n', lpad(id, 5, '0')) AS caller", "concat('n', lpad(id + 1, 5, '0')) AS callee", "'r' AS repo_name")
    found = graph.reachable(chain, seeds(spark, "n00003"))
    assert found.count() == n - 2 and found.where("node = 'n05000'").first()["depth"] == n - 3
    assert len(written) < 30
    written.clear()
    ring = chain.union(spark.createDataFrame([("n05000", "n00010", "r"), ("n05000", "x", "r")], "caller string, callee string, repo_name string"))
    members = graph.cycles(ring, "caller", "callee", ["repo_name"])
    assert members.count() == n - 9 and members.select("component").distinct().collect()[0][0] == "n00010"
    assert len(written) < 80
    written.clear()
    lone = chain.where("caller >= 'n00010'").union(spark.createDataFrame([("n05000", "n00010", "r")], "caller string, callee string, repo_name string"))
    assert graph.cycles(lone, "caller", "callee", ["repo_name"]).count() == n - 9
    assert graph.reachable(lone, seeds(spark, "n00010")).agg({"depth": "max"}).first()[0] == n - 10
    assert len(written) < 80


def test_injection(spark):
    deps = spark.createDataFrame([("UserController", "userService", "UserService", "field", "r")], "class_name string, field_name string, field_type string, injection_type string, repo_name string")
    c = calls(spark, ("UserController.get", "userService.save"), ("UserController.get", "this.userService"), ("UserController.get", "other.x"), ("Else.get", "userService.save"))
    rows = {(r["caller"], r["callee"], r["call_type"]) for r in graph.resolve_callees(c, deps).collect()}
    assert rows == {
        ("UserController.get", "UserService.save", "resolved"), ("UserController.get", "this.userService", "direct"), ("UserController.get", "other.x", "direct"),
        ("Else.get", "userService.save", "direct"),
    }


INH = "child_name string, child_qualified string, parent_name string, relation_type string, file_path string, repo_name string, line_number int"


def test_polymorphic_calls(spark):
    edges = spark.createDataFrame([("Impl", "Impl", "Service", "implements", "f", "r", 1), ("Sub", "Sub", "Service", "extends", "f", "r", 1)], INH)
    syms = spark.createDataFrame([("Service", "Service", "interface"), ("Impl", "Impl", "class")], "name string, qualified_name string, symbol_type string")
    deps = spark.createDataFrame([], "class_name string, field_name string, field_type string, injection_type string, repo_name string")
    c = calls(spark, ("Web.create", "Service.save"), ("Web.create", "Impl.save"))
    assert nodes(graph.polymorphic_callees(c, "Web.create", deps, syms, edges), "callee") == ["Impl.save", "Impl.save", "Service.save", "Sub.save"]
    rows = [(r["caller"], r["callee"], r["call_type"]) for r in graph.polymorphic_callers(c, "Impl.save", edges).collect()]
    assert sorted(rows) == [("Web.create", "Impl.save", "direct"), ("Web.create", "Impl.save", "virtual")]
    assert graph.polymorphic_callers(c, "Sub.save", edges).isEmpty()


def test_transitive_implementations_list_a_child_under_every_parent(spark):
    rows = [("B", "A"), ("C", "A"), ("D", "B"), ("D", "C"), ("A", "D"), ("Z", "Y")]
    edges = spark.createDataFrame([(c, c, p, "extends", "f", "r", 1) for c, p in rows], INH)
    found = sorted((r["child_name"], r["parent_name"], r["indirect"]) for r in inh.all_implementations(edges, "A").collect())
    assert found == [("A", "D", True), ("B", "A", False), ("C", "A", False), ("D", "B", True), ("D", "C", True)]
    assert nodes(inh.implementations(edges, "A"), "child_name") == ["B", "C"]


def test_file_edges_use_the_callee_home(spark):
    c = calls(spark, ("A", "B"), ("B", "A"), ("B", "external"))
    assert {(r["src"], r["dst"]) for r in graph.file_edges(c).collect()} == {("A.py", "B.py"), ("B.py", "A.py")}


def test_one_symbols_interfaces_are_picked_before_the_shuffle(spark):
    calls = spark.createDataFrame([("A", "I.run", "f", 1, "r", "direct"), ("A", "C.run", "f", 2, "r", "direct"), ("B", "J.run", "f", 3, "r", "direct")], "caller string, callee string, caller_file string, caller_line int, repo_name string, call_type string")
    edges = spark.createDataFrame([("X", "I"), ("Y", "I"), ("X", "I"), ("Z", "J"), ("W", "C")], "child_name string, parent_name string").selectExpr("*", "'r' as repo_name").distinct()
    symbols = spark.createDataFrame([("I", "I", "interface"), ("J", "J", "interface"), ("C", "C", "class")], "name string, qualified_name string, symbol_type string")
    none = spark.createDataFrame([], "repo_name string, class_name string, field_name string, field_type string")
    found = graph.polymorphic_callees(calls, "A", none, symbols, edges)
    assert sorted((r["callee"], r["call_type"]) for r in found.collect()) == [("C.run", "direct"), ("I.run", "direct"), ("X.run", "virtual"), ("Y.run", "virtual")]
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(plan) if "Aggregate [child_name" in line)
    assert "Join LeftSemi" in " ".join(line for line in plan[at + 1 : at + 4] if depth(line) > depth(plan[at]))


def test_rounds_hold_only_what_lies_between(spark, monkeypatch):
    """Edges on no ring, or from nodes that nothing leads to, are gone before the first table; rounds move numbers, not names."""
    from codequarry.operators import contraction

    written = []

    def counted(df):
        result = cut(df)
        written.append((result.count(), {f.dataType.simpleString() for f in result.schema}))
        return result

    cut = contraction.cut
    monkeypatch.setattr(contraction, "cut", counted)
    ring = [("a", "b"), ("b", "c"), ("c", "a")]
    rows = [("r", s, t) for s, t in [*ring, *((f"in{i}", "a") for i in range(500)), *((f"out{i}", f"sink{i}") for i in range(500))]]
    edges = spark.createDataFrame(rows, "scope string, s string, t string")
    members = contraction.strong_components(edges, ["scope"]).collect()
    assert {r["node"] for r in members} == {"a", "b", "c"} and len({r["colour"] for r in members}) == 1
    assert max(n for n, _ in written) <= 6
    assert sum("string" in types for _, types in written) <= 2
    written.clear()
    seeds = spark.createDataFrame([("r", "in7"), ("r", "elsewhere")], "scope string, node string")
    found = {r["node"]: r["depth"] for r in contraction.distances(edges, seeds, ["scope"]).collect()}
    assert found == {"in7": 0, "elsewhere": 0, "a": 1, "b": 2, "c": 3}
    assert max(n for n, _ in written) <= 6
