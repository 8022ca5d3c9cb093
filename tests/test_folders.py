"""Moves of folders against the recursion, on random trees with collisions at every level."""

import hashlib
import random

import pytest

from siltstone.operators import folders

SHAPE = "id string, parent_id string, name string, kind string, location string"


def recursion(rows, sources, target):
    """The move, entry by entry."""
    tree = {r[0]: list(r) for r in rows}

    def put(i, dest):
        _, _, name, kind, _ = tree[i]
        if kind == "folder":
            same = sorted(k for k, r in tree.items() if r[1] == dest and r[2] == name and r[3] == "folder")
            to = same[0] if same else hashlib.md5(f"{dest}/{name}".encode()).hexdigest()
            tree.setdefault(to, [to, dest, name, "folder", ""])
            for child in sorted(k for k, r in tree.items() if r[1] == i):
                put(child, to)
            del tree[i]
        else:
            moves.append((i, dest, name))

    moves = []
    for s in sorted(sources):
        if s in tree and tree[s][1] != target:
            put(s, target)
    moving = {i for i, _, _ in moves}
    taken = {(r[1], r[4]) for i, r in tree.items() if r[3] == "file" and i not in moving}
    for i, dest, name in sorted(moves):
        location = name
        while (dest, location) in taken:
            location += "_"
        taken.add((dest, location))
        tree[i][1], tree[i][4] = dest, location
    return sorted(map(tuple, tree.values()), key=str)


def made(rng, n=60):
    rows, held = [("root", "root", "/", "folder", ""), ("t", "root", "target", "folder", ""), ("u", "t", "a", "folder", "")], ["root", "t", "u"]
    taken = set()
    for i in range(n):
        kind, parent, name = rng.choice(["folder", "file", "file"]), rng.choice(held[-12:] + ["t", "u"]), rng.choice(["a", "b", "b_", "c"])
        location = "" if kind == "folder" else name
        while kind == "file" and (parent, location) in taken:
            location += "_"
        taken.add((parent, location))
        rows.append((f"x{i:03d}", parent, name, kind, location))
        held += [f"x{i:03d}"] * (kind == "folder")
    return rows


def test_moves_against_the_recursion(spark):
    rng = random.Random(12)
    for _ in range(5):
        rows = made(rng)
        above = {r[0]: r[1] for r in rows}

        def path(i):
            return [] if i == "root" else [i, *path(above[i])]  # noqa: B023

        free = [r[0] for r in rows if "t" not in path(r[0]) and r[0] not in ("root", "t")] + ["x999"]
        picked = rng.sample(free, min(8, len(free)))
        tops = [i for i in picked if i not in above or not set(path(i)[1:]) & set(picked)] + [r[0] for r in rows if r[1] == "t"][:1]
        found = folders.move_into(spark.createDataFrame(rows, SHAPE), spark.createDataFrame([(i,) for i in tops], "id string"), "t")
        assert sorted(map(tuple, found.collect()), key=str) == recursion(rows, tops, "t")


def test_nothing_to_move_and_a_target_below_its_source(spark):
    tree = spark.createDataFrame([("r", None, "r", "folder", ""), ("a", "r", "a", "folder", ""), ("b", "a", "b", "folder", ""), ("f", "a", "f", "file", "f")], SHAPE)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert folders.move_into(tree, ids("nope", "a"), "r").count() == 4
    with pytest.raises(ValueError):
        folders.move_into(tree, ids("a"), "b")
    with pytest.raises(ValueError):
        folders.move_into(tree, ids("a"), "a")
    both = {tuple(r) for r in folders.move_into(tree, ids("a", "f"), "nowhere").collect()}
    to = hashlib.md5(b"nowhere/a").hexdigest()
    assert both == {("r", None, "r", "folder", ""), (to, "nowhere", "a", "folder", ""), (hashlib.md5(f"{to}/b".encode()).hexdigest(), to, "b", "folder", ""), ("f", to, "f", "file", "f")}
