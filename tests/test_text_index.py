"""The word index against plain evaluation of the same queries."""

import math
import random
import re

import pytest

from codequarry.operators import text_index
from codequarry.operators.text_index import Near, Node, Parser, Phrase, TextIndex

WORDS = "load save user order the data cache user_id".split()


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(f"k{i:03d}", "_".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))), ".".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))) for i in range(150)]
    rows += [("none", None, None), ("mark", "--", "..")]
    table = spark.createDataFrame(rows, "key string, name string, path string").repartition(3)
    return table, TextIndex.build(table, str(tmp_path_factory.mktemp("words") / "ix"), "key", ["name", "path"]), rows


def tokens(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def starts(phrase, fields):
    """{field: places} of a phrase."""
    out = {}
    for name, found in fields.items():
        if phrase.column in (None, name):
            m = len(phrase.words)
            fits = lambda got: got == phrase.words or phrase.prefix and got[:-1] == phrase.words[:-1] and got[-1].startswith(phrase.words[-1])
            out[name] = [i for i in range(len(found) - m + 1) if m and fits(found[i : i + m])]
    return out


def matches(node, fields):
    if isinstance(node, Phrase):
        return any(starts(node, fields).values())
    if isinstance(node, Near):
        for name in fields:
            places = [starts(p, fields).get(name, []) for p in node.phrases]
            for i, own in enumerate(places):
                for x in own:
                    reach = x + len(node.phrases[i].words) + node.within
                    if all(any(x <= y <= reach for y in other) for j, other in enumerate(places) if j != i):
                        return True
        return False
    found = [matches(p, fields) for p in node.parts]
    return {"AND": all(found), "OR": any(found), "NOT": found[0] and not any(found[1:])}[node.operator]


QUERIES = [
    "load", "load user", "load AND user OR cache", "sav*", '"save the"', '"load us"*', "name:load path:save", "NEAR(load save, 1)", "NEAR(load save cache)", "load NOT user NOT cache",
    "(load OR save) AND NOT_A_WORD OR data", "(load OR save) (user OR data) NOT the", 'name:"user id"', "user_id", "absent", "NEAR(name:the name:data, 0) OR cach*",
]


@pytest.mark.parametrize("query", QUERIES)
def test_same_rows_and_scores_as_plain_evaluation(built, query):
    table, index, rows = built
    tree = Parser(query).parse()
    all_fields = {key: {"name": tokens(a), "path": tokens(b)} for key, a, b in rows}
    leaves = text_index.asked(tree)
    counts = [{k: n for k, f in all_fields.items() if (n := sum(map(len, starts(p, f).values())))} for p in leaves]
    mean = sum(len(t) for f in all_fields.values() for t in f.values()) / len(rows)
    want = {}
    for key, f in all_fields.items():
        if matches(tree, f):
            size = sum(map(len, f.values()))
            want[key] = sum(
                max(math.log((len(rows) - len(c) + 0.5) / (len(c) + 0.5)), 1e-6) * c.get(key, 0) * 2.2 / (c.get(key, 0) + 1.2 * (0.25 + 0.75 * size / mean)) for c in counts
            )
    got = {r["key"]: r["score"] for r in index.search(query).collect()}
    assert got == pytest.approx(want)


def test_order_limit_and_filters(built):
    table, index, _ = built
    found = text_index.indexed_search(table, index, "load OR save", 5).collect()
    assert [(-r["score"], r["key"]) for r in found] == sorted((-r["score"], r["key"]) for r in found) and len(found) == 5
    assert text_index.indexed_search(table, index, "load", None, key="none").collect() == []


def test_tree_of_a_query():
    tree = Parser('a b OR c NOT name:"d e"*').parse()
    assert isinstance(tree, Node) and tree.operator == "OR" and [p.operator for p in tree.parts] == ["AND", "NOT"]
    assert tree.parts[1].parts[1] == Phrase(["d", "e"], True, "name")
    for wrong in ("(a", "a)", "a NOT", "NEAR(a", ": a"):
        with pytest.raises(ValueError):
            Parser(wrong).parse()


def test_unknown_field(built):
    with pytest.raises(ValueError):
        built[1].search("title:load")


def test_tokens_reach_the_scan(built):
    plan = built[1]._word("load", False, None)._jdf.queryExecution().toString()
    assert "EqualTo(token,load)" in plan
    plan = built[1]._word("sa", True, "name")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(token,sa)" in plan and "LessThan(token,sa" in plan
