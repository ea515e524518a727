"""An album tree changed by a log of operations, each checked against the tree as it is at its turn.

Albums and folders are rows ``id, parent, name, folder, smart, filled``; operations are rows ``seq, op, id, parent, name,
folder, smart, filled`` with ``op`` one of ``add``, ``remove``, ``rename`` and ``move``.

The log is not walked. Every round supposes which operations were accepted, makes the versions of each
album that follow (from one accepted operation to the next), and checks all operations against the versions
of their time; ancestors at that time are climbed for all moves together, some levels a job. Rounds end
when the supposition stands. The first operation is judged rightly at once, so what stands is what the
order gives. A false supposition may hold folders that lie in each other: a climb that comes back to a folder
ends there, whatever it says, since the next round judges again.

Defined results: a null parent is the root; an operation on an unknown album, or with a null id, is refused;
albums that repeat an id are one; an empty log leaves the tree; other operations are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.checkpoints import stored

_ROW = ["id", "parent", "name", "folder", "smart", "filled"]
#: Levels climbed in one job.
LEVELS = 6


def _versions(albums: DataFrame, accepted: DataFrame) -> DataFrame:
    """``id, since, until, there, parent, name, folder, smart, filled``: what each album is between two operations on it."""
    first = albums.dropDuplicates(["id"]).select(F.lit(-(1 << 62)).cast("long").alias("seq"), F.lit("add").alias("op"), *_ROW)
    log = first.unionByName(accepted.select("seq", "op", *_ROW))
    turn = Window.partitionBy("id").orderBy("seq")
    so_far = turn.rowsBetween(Window.unboundedPreceding, 0)
    # What was set last: a parent, even a null one, by adding or moving; a name by adding or renaming.
    last = lambda ops, c: F.last(F.when(F.col("op").isin(ops), F.struct(F.col(c).alias("v"))), ignorenulls=True).over(so_far)["v"].alias(c)
    there = (F.last(F.when(F.col("op").isin("add", "remove"), F.col("op")), ignorenulls=True).over(so_far) == "add").alias("there")
    kept = [last(["add", "move"], "parent"), last(["add", "rename"], "name"), *[last(["add"], c) for c in ("folder", "smart", "filled")]]
    return log.select("id", F.col("seq").alias("since"), F.lead("seq").over(turn).alias("until"), there, *kept)


def _at(rows: DataFrame, versions: DataFrame, node: str, prefix: str) -> DataFrame:
    """``rows`` (with ``seq``) and the version of ``node`` just before; its columns begin with ``prefix``."""
    v = versions.where("there").select(*[F.col(c).alias(f"{prefix}{c}") for c in versions.columns])
    then = (F.col(f"{prefix}since") < F.col("seq")) & (F.col(f"{prefix}until").isNull() | (F.col(f"{prefix}until") >= F.col("seq")))
    return rows.join(v, (F.col(node) == F.col(f"{prefix}id")) & then, "left").drop(f"{prefix}since", f"{prefix}until", f"{prefix}there")


def _loops(moves: DataFrame, versions: DataFrame) -> DataFrame:
    """``seq`` of the moves (``seq, id, node``) that meet their own album when they climb from ``node``."""
    there = versions.where("there").select(F.col("id").alias("_id"), F.col("since").alias("_since"), F.col("until").alias("_until"), F.col("parent").alias("_parent"))
    then = (F.col("_since") < F.col("seq")) & (F.col("_until").isNull() | (F.col("_until") >= F.col("seq")))
    moves = stored(moves.where("node IS NOT NULL").withColumn("mark", F.lit(None).cast(moves.schema["node"].dataType)), "album-climb")
    loops, job = moves.where("node = id").select("seq"), 0
    while True:
        moves = moves.where("node <> id")
        if moves.isEmpty():
            return loops
        job += 1
        # A circle without the own album leads back to the mark, which moves on at jobs 1, 2, 4, 8 and so on.
        if job & (job - 1) == 0:
            moves = moves.withColumn("mark", F.col("node"))
        for _ in range(LEVELS):
            # Who has met itself stays at its own album, which is there.
            up = F.when(F.col("node") == F.col("id"), F.col("id")).otherwise(F.col("_parent"))
            moves = moves.join(there, (F.col("node") == F.col("_id")) & then).select("seq", "id", up.alias("node"), "mark").where("node <> mark")
        moves = stored(moves, "album-climb")
        loops = loops.unionByName(moves.where("node = id").select("seq"))


def _judged(ops: DataFrame, versions: DataFrame) -> DataFrame:
    """``seq, problem``: what is wrong with each operation, null if nothing."""
    seen = stored(_at(_at(ops, versions, "id", "own_"), versions, "parent", "up_"), "album-ops")
    loops = _loops(seen.where("op = 'move' AND up_folder AND parent <> id AND own_id IS NOT NULL").select("seq", "id", F.col("up_parent").alias("node")), versions)
    held = versions.where("there AND parent IS NOT NULL").select(F.col("parent").alias("_parent"), "since", "until")
    within = (F.col("since") < F.col("seq")) & (F.col("until").isNull() | (F.col("until") >= F.col("seq")))
    full = seen.where("op = 'remove'").join(held, (F.col("id") == F.col("_parent")) & within, "left_semi").select("seq").withColumn("full", F.lit(True))
    rows = seen.join(loops.withColumn("loop", F.lit(True)), "seq", "left").join(full, "seq", "left")
    exists, into = F.col("own_id").isNotNull(), F.col("parent").isNull() | F.coalesce("up_folder", F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    add = F.when(F.col("id").isNull(), "no id").when(exists, "album exists").when(~into, "parent must be an existing folder").when(yes("smart") & (yes("folder") | yes("filled")), "a smart album holds rules, not photos")
    remove = F.when(yes("full"), "folder is not empty").when(~exists, "no such album")
    move = F.when(~into | (F.col("parent") == F.col("id")), "parent must be another folder").when(yes("loop"), "cannot move a folder into itself").when(~exists, "no such album")
    problem = F.when(F.col("op") == "add", add).when(F.col("op") == "remove", remove).when(F.col("op") == "move", move).when(F.col("op") == "rename", F.when(~exists, "no such album")).otherwise("unknown operation")
    return rows.select("seq", problem.alias("problem"))


def apply(albums: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tree after the log; ``seq, problem`` of every operation; and the inverse log, which undoes what was
    accepted, the last first."""
    ops = stored(ops.select("seq", "op", *_ROW), "album-log")
    judged, before = stored(ops.select("seq", F.lit(None).cast("string").alias("problem")), "album-judged"), None
    while True:
        accepted = ops.join(judged.where("problem IS NULL"), "seq", "left_semi")
        versions = stored(_versions(albums, accepted), "album-versions")
        judged = stored(_judged(ops, versions), "album-judged")
        sign = judged.agg(F.count("problem"), F.sum(F.xxhash64("seq", "problem").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    done = ops.join(judged.where("problem IS NULL"), "seq", "left_semi")
    was = _at(done, versions, "id", "own_")
    turned = F.when(F.col("op") == "add", "remove").when(F.col("op") == "remove", "add").otherwise(F.col("op"))
    back = was.select((-F.col("seq")).alias("seq"), turned.alias("op"), "id", *[F.col(f"own_{c}").alias(c) for c in _ROW[1:]])
    return versions.where("there AND until IS NULL").select(*_ROW), judged, back


def paths(albums: DataFrame) -> DataFrame:
    """``id, depth, path``: the names from the root, by going down from it one level a step, so that no folder
    is asked for by more than its own albums. What the root does not reach has no path."""
    level = done = stored(albums.where("parent IS NULL").select("id", F.array("name").alias("names")), "album-paths")
    below = albums.where("parent IS NOT NULL").select(F.col("id").alias("_id"), "parent", "name")
    while not level.isEmpty():
        level = stored(below.join(level, F.col("parent") == F.col("id")).select(F.col("_id").alias("id"), F.concat("names", F.array("name")).alias("names")), "album-paths")
        done = done.unionByName(level)
    return done.select("id", F.size("names").alias("depth"), F.array_join("names", "/").alias("path"))
