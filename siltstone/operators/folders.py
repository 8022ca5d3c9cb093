"""Moving folders into a folder: trees are merged level by level, by name.

A tree is a table (id, parent_id, name, kind: folder or file, location). A moved folder goes into the folder of the same name below the
target, or a new one; so do its children, by joins on the mapped parent, one for each level of the moved trees. Folders that were
moved are gone afterwards. Files keep their name; their location is the name with as many underscores as it takes to be free there.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import relational as R
from siltstone.session import cut

_COLUMNS = ["id", "parent_id", "name", "kind", "location"]


def _free_turns(rows: pd.DataFrame) -> pd.DataFrame:
    """Numbers of underscores of the moved files of one folder and family, in the order of their ids.

    ``jumps`` has, for each taken number, one that nothing free lies before; it is shortened by each walk, so no file steps through
    the numbers that are taken one by one. Names and locations are numbers here, as a location is longer than the number of those before it.
    """
    jumps = {int(k): int(k) + 1 for k in rows.loc[~rows["moved"], "turn"].dropna()}
    moved = rows[rows["moved"]].sort_values("id")
    found = []
    for turn in moved["turn"].fillna(0).astype(int):
        walked = []
        while turn in jumps:
            walked.append(turn)
            turn = jumps[turn]
        jumps.update(dict.fromkeys(walked, turn + 1))
        jumps[turn] = turn + 1
        found.append(turn)
    return moved[["id", "dest", "name", "family"]].assign(turn=pd.Series(found, index=moved.index, dtype="int32"))


def move_into(tree: DataFrame, sources: DataFrame, target: str) -> DataFrame:
    """The tree after the move of ``sources`` (column id) into the folder ``target``.

    Sources that are in the target already stay as they are, as does one that is below another source: it moves with that. Ids of new
    folders are digests of their parent and name. A target that is one of the sources or below one is an error.
    """
    tree = tree.select(*_COLUMNS)
    asked = sources.select("id").distinct().join(tree.select("id", "parent_id", "name", "kind"), "id").where(F.coalesce("parent_id", F.lit("")) != target)
    nodes = tree.where("kind = 'folder'").select("id", "parent_id").unionByName(asked.where("kind <> 'folder'").select("id", "parent_id"))
    above = R.ancestors(nodes).select(F.col("node").alias("id"), F.col("ancestor").alias("_over"))
    under = asked.select("id").join(above, "id").join(asked.select(F.col("id").alias("_over")), "_over", "left_semi").select("id")
    front = cut(asked.join(under, "id", "left_anti").select("id", "parent_id", "name", "kind", F.lit(target).alias("dest")))
    files, gone, new = [], [], []
    while True:
        n, bad = front.agg(F.count(F.lit(1)), F.max(F.col("id") == target)).first()
        if bad:
            raise ValueError(f"{target} is moved itself")
        if not n:
            break
        files.append(front.where("kind = 'file'").select("id", "name", "dest"))
        folders = front.where("kind = 'folder'")
        there = tree.where("kind = 'folder'").groupBy(F.col("parent_id").alias("dest"), "name").agg(F.min("id").alias("_there"))
        mapped = folders.join(there, ["dest", "name"], "left").withColumn("to", F.coalesce("_there", F.md5(F.concat_ws("/", "dest", "name"))))
        gone.append(mapped.select("id"))
        new.append(mapped.where("_there IS NULL").select(F.col("to").alias("id"), F.col("dest").alias("parent_id"), "name", F.lit("folder").alias("kind"), F.lit("").alias("location")).distinct())
        below = tree.join(mapped.select(F.col("id").alias("parent_id"), F.col("to").alias("dest")), "parent_id").select("id", "parent_id", "name", "kind", "dest")
        front = cut(below)
    if not files:
        return tree
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    moved = union(files).dropDuplicates(["id"])
    # A name or location is its family and a number of underscores: texts that grow with the files of a name are neither shuffled nor compared.
    family = lambda name: F.rtrim(F.col(name), F.lit("_"))
    turn = lambda name: (F.length(name) - F.length(family(name))).alias("turn")
    short = tree.select("id", "parent_id", "name", "kind", family("location").alias("family"), turn("location"))
    stay = short.join(moved.select("id").unionByName(union(gone)), "id", "left_anti")
    settled = stay.where("kind = 'file'").join(moved.select(F.col("dest").alias("parent_id")).distinct(), "parent_id", "left_semi")
    both = moved.select("id", "dest", "name", F.lit(True).alias("moved"), family("name").alias("family"), turn("name")).unionByName(
        settled.select("id", F.col("parent_id").alias("dest"), "name", F.lit(False).alias("moved"), "family", "turn")
    )
    placed = both.groupBy("dest", "family").applyInPandas(_free_turns, "id string, dest string, name string, family string, turn int")
    put = stay.unionByName(placed.select("id", F.col("dest").alias("parent_id"), "name", F.lit("file").alias("kind"), "family", "turn"))
    location = F.concat("family", F.repeat(F.lit("_"), F.col("turn"))).alias("location")
    return put.select("id", "parent_id", "name", "kind", location).unionByName(union(new).distinct())
