"""Process graph of a tick: foreground family, edges, criticality and workload protection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefleet.functions import scoring as S
from pulsefleet.operators.process import is_audio_video, is_compiler
from pulsefleet.session import checkpointed


#: Levels that are searched one by one before pointers double.
SHALLOW = 4


def descendants(
    edges: DataFrame, roots: DataFrame, keys: Sequence[str], parent: str = "parent_pid", child: str = "pid"
) -> DataFrame:
    """All nodes reachable from the roots, each with its distance to the nearest one above it; cycles end.

    The first levels are searched one by one, which touches only the families and ends shallow trees. Where some are
    deeper and each child of a key has one parent, pointers double from there, so the rounds grow with the logarithm of
    the depth. Every round is checkpointed, so the plan stays short and a lost executor does not replay the search.
    """
    keys = list(keys)
    links = edges.select(*keys, F.col(parent).alias("__from"), F.col(child).alias("node")).where(
        F.col("__from") != F.col("node")
    )
    # Written once, hashed by the join keys; equal edges meet there, so that they are told apart without another shuffle.
    links = checkpointed(links.repartition(*keys, "__from").distinct())
    frontier = checkpointed(roots.select(*keys, "node").distinct().withColumn("depth", F.lit(0)))
    seen, level = frontier, 0
    while not frontier.isEmpty():
        if level == SHALLOW:
            several = links.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("parents")).where("parents > 1")
            if several.isEmpty():
                return _by_pointers(links, seen, keys)
        step = (
            frontier.select(*keys, F.col("node").alias("__from"), "depth")
            .join(links, [*keys, "__from"])
            .select(*keys, "node", (F.col("depth") + 1).alias("depth"))
            .distinct()
            .join(seen.select(*keys, "node"), [*keys, "node"], "left_anti")
        )
        frontier = checkpointed(step)
        seen = seen.unionByName(frontier)
        level += 1
    return seen


def _by_pointers(links: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """``seen`` (keys, node, depth) and all nodes below it, where each node has at most one parent (keys, __from, node).

    An open node points ``steps`` up, and none of the nodes passed is known. A round looks up the node pointed at: if
    that one's depth is known, so is this one's; if it is a top without parent, the node is dropped; otherwise the
    pointer is extended by its pointer. A round that settles no node leaves only nodes whose pointers stay among
    themselves, that is nodes at a cycle without a root.
    """
    found = [seen]
    start = links.join(seen, [*keys, "node"], "left_anti")
    pointers = checkpointed(start.select(*keys, "node", F.col("__from").alias("__up"), F.lit(1).alias("__steps")))
    no_pointer = [F.lit(None).cast(pointers.schema["__up"].dataType).alias("__up"), F.lit(0).alias("__steps")]
    left, before = pointers.count(), None
    while left and left != before:
        known = pointers.withColumn("depth", F.lit(None).cast("int"))
        for part in found:
            known = known.unionByName(part.select(*keys, "node", *no_pointer, "depth"))
        target = known.select(
            *keys, F.col("node").alias("__up"), F.col("__up").alias("__next"), F.col("__steps").alias("__more"), "depth"
        )
        steps = F.col("__steps")
        met = checkpointed(
            pointers.join(target, [*keys, "__up"]).select(
                *keys,
                "node",
                F.col("__next").alias("__up"),
                (steps + F.col("__more")).alias("__steps"),
                (steps + F.col("depth")).alias("depth"),
            )
        )
        found.append(met.where("depth IS NOT NULL").select(*keys, "node", "depth"))
        pointers = met.where("depth IS NULL").drop("depth")
        left, before = pointers.count(), left
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def foreground_family(edges: DataFrame, intents: DataFrame, tick: Sequence[str]) -> DataFrame:
    """The foreground process of each tick and its descendants. Pid 0 is no process: it starts no family."""
    roots = intents.where(F.col("foreground_pid") != 0).select(*tick, F.col("foreground_pid").alias("node"))
    return descendants(edges, roots, tick)


def family_edges(processes: DataFrame, family: DataFrame, tick: Sequence[str]) -> DataFrame:
    """Parent-child edges whose parent runs in the tick; weight 1.0 inside the foreground family."""
    tick = list(tick)
    parents = processes.select(*tick, F.col("pid").alias("parent_pid")).distinct()
    inside = family.select(*tick, F.col("node").alias("parent_pid")).distinct().withColumn("__in", F.lit(True))
    return (
        processes.where(F.col("parent_pid") != 0)
        .select(*tick, "parent_pid", "pid")
        .join(parents, [*tick, "parent_pid"])
        .join(inside, [*tick, "parent_pid"], "left")
        .select(
            *tick,
            "parent_pid",
            "pid",
            F.lit("PARENT_CHILD").alias("kind"),
            F.when(F.col("__in"), 1.0).otherwise(0.45).alias("weight"),
        )
    )


def criticality(processes: DataFrame, family: DataFrame, tick: Sequence[str]) -> DataFrame:
    """Criticality of each process: the strongest of its reasons; protected from 70 upwards.

    processes needs the columns of ``process.classify`` and ``workload_phase``.
    """
    tick = list(tick)
    inside = family.select(*tick, F.col("node").alias("pid")).distinct().withColumn("__in", F.lit(True))
    rows = processes.join(inside, [*tick, "pid"], "left").withColumn("__in", F.coalesce("__in", F.lit(False)))
    phase, front = F.col("workload_phase"), F.col("pid") == F.col("foreground_pid")
    io = F.col("io_read_kbps") + F.col("io_write_kbps")
    rules = (
        (front, 100.0, "active foreground process"),
        (F.col("__in") & ~front, 92.0, "foreground process-family dependency"),
        (F.col("matches_user_intent"), 95.0, "matches current user intent"),
        (F.col("is_recently_active"), 82.0, "recently active application"),
        (F.col("has_visible_window"), 72.0, "visible user-facing window"),
        (F.col("is_system_critical") | (F.col("safety") == "PROTECTED"), 100.0, "deterministic protected target"),
        (
            is_audio_video(F.col("name")) & phase.isin("VIDEO_MEETING", "PASSIVE_PLAYBACK", "GAMING"),
            96.0,
            "audio/video deadline dependency",
        ),
        (is_compiler(F.col("name")) & (phase == "COMPILATION"), 88.0, "active compilation throughput dependency"),
        ((io > 1024.0) & phase.isin("APP_LAUNCHING", "LARGE_FILE_TRANSFER"), 75.0, "current workload I/O dependency"),
    )
    # A number per rule, no array of reasons: only plans that read the reasons build it.
    score = F.greatest(*[F.when(condition, points).otherwise(10.0) for condition, points, _ in rules])
    found = F.array_compact(F.array(*[F.when(condition, text) for condition, _, text in rules]))
    rows = rows.withColumns({"criticality": score, "__found": found})
    reasons = F.when(F.size("__found") > 0, F.col("__found")).otherwise(F.array(F.lit("no observed foreground dependency")))
    return rows.withColumns(
        {
            "criticality_reasons": reasons,
            "on_foreground_path": F.col("__in") | F.col("matches_user_intent"),
            "protected_from_intervention": (F.col("criticality") >= 70.0) | F.col("is_system_critical"),
        }
    ).drop("__found", "__in")


def workload_protection(name: Column, phase: Column, is_foreground: Column, matches_intent: Column) -> Column:
    """Reason a process is protected in a workload phase, or null."""
    lowered = F.lower(name)
    is_audio = lowered == "audiodg.exe"
    return S.first_match(
        [
            (
                (phase == "COMPILATION") & ((lowered == "cl.exe") | S.has_any(lowered, ("msbuild", "clang", "ninja", "language-server"))),
                "compilation and IDE dependency protected",
            ),
            (
                (phase == "GAMING") & (is_foreground | is_audio | S.has_any(lowered, ("gamebar", "steam"))),
                "game, audio, or launcher dependency protected",
            ),
            (
                (phase == "VIDEO_MEETING") & (is_audio | S.has_any(lowered, ("teams", "zoom", "meet", "camera"))),
                "meeting audio/video dependency protected",
            ),
            (
                (phase == "PASSIVE_PLAYBACK") & (is_audio | S.has_any(lowered, ("vlc", "spotify")) | matches_intent),
                "media playback dependency protected",
            ),
        ],
        F.lit(None).cast("string"),
    )


def protected_processes(nodes: DataFrame, tick: Sequence[str]) -> DataFrame:
    """(tick, pid, name, reason) of protected processes, one row per process.

    Kept as rows: a tick's protected set is joined on, never gathered into an array.
    """
    reason = workload_protection(
        F.col("name"), F.col("workload_phase"), F.col("is_foreground"), F.col("matches_user_intent")
    )
    rows = nodes.withColumn("protection", reason).where(
        F.col("protected_from_intervention") | F.col("protection").isNotNull() | (F.col("pid") == F.col("foreground_pid"))
    )
    return rows.select(*tick, "pid", "name", F.coalesce("protection", F.lit("critical path")).alias("reason"))


def target_criticality(decisions: DataFrame, nodes: DataFrame, tick: Sequence[str], default: float = 100.0) -> DataFrame:
    """Decisions with the criticality of their target; an unknown target counts as fully critical."""
    known = nodes.groupBy(*tick, F.col("pid").alias("target_pid")).agg(F.max("criticality").alias("target_criticality"))
    joined = decisions.join(known, [*tick, "target_pid"], "left")
    return joined.withColumn("target_criticality", F.coalesce("target_criticality", F.lit(default)))
