"""Min-cost flow from membership patterns to the quotas of sources: at once for few patterns, in parts that Spark spreads for many."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut

FLOW = "part int, p array<string>, words long, members array<int>, sent array<long>, spare long"


def cheapest_flow(
    capacity: list[int],
    members: list[list[int]],
    quota: list[int],
    costs: list[int],
    state: tuple[list[int], list[dict[int, int]]] | None = None,
) -> list[dict[int, int]]:
    """Words that each pattern sends to each of its sources, as many as fit at least total cost.

    Pattern p may be used once at costs[0] a word, again at costs[1], and so on (ascending, so the cost is convex). Only
    these uses cost anything, so a shortest augmenting path is one that begins with the cheapest use still open: the uses are
    opened one by one, and each time blocking flows in the layered residual network route what fits. All figures are whole words.
    `state` is what earlier uses left: spare words, and words sent, by pattern; both go on from there.
    """
    if sorted(costs) != costs:
        raise ValueError("costs must ascend")
    n, left = len(capacity), list(quota)
    spare, sent = state or ([0] * n, [dict.fromkeys(m, 0) for m in members])
    # Nodes: patterns, then sources. A pattern can send to all its sources, a source give back what patterns have sent.
    links = [[n + s for s in m] for m in members] + [[] for _ in quota]
    for p, m in enumerate(members):
        for s in m:
            links[n + s].append(p)
    for _ in costs:
        spare = [x + c for x, c in zip(spare, capacity, strict=True)]
        while True:
            level, queue, ends = [-1] * len(links), deque(p for p in range(n) if spare[p]), False
            for p in queue:
                level[p] = 0
            while queue:
                a = queue.popleft()
                ends |= a >= n and left[a - n] > 0
                for b in links[a]:
                    if level[b] < 0 and (a < n or sent[b][a - n]):
                        level[b] = level[a] + 1
                        queue.append(b)
            if not ends:
                break
            turn = [0] * len(links)
            for p in [p for p in range(n) if spare[p]]:
                path = [p]
                while path and spare[p]:
                    a = path[-1]
                    if a >= n and left[a - n]:
                        back = list(zip(path[1:-1:2], path[2::2], strict=True))
                        words = min([spare[p], left[a - n], *(sent[b][s - n] for s, b in back)])
                        spare[p] -= words
                        left[a - n] -= words
                        for s, b in back:
                            sent[b][s - n] -= words
                        for b, s in zip(path[::2], path[1::2], strict=True):
                            sent[b][s - n] += words
                        path = [p]
                        continue
                    while turn[a] < len(links[a]):
                        b = links[a][turn[a]]
                        if level[b] == level[a] + 1 and (a < n or sent[b][a - n]):
                            path.append(b)
                            break
                        turn[a] += 1
                    else:
                        path.pop()
                        if path:
                            turn[path[-1]] += 1
    return sent


def _route_part(quotas: dict[int, list[int]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One more use of every pattern of a part, routed within the part's quotas."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members = [[int(s) for s in m] for m in pdf.members]
        words, spare = [int(w) for w in pdf.words], [int(x) for x in pdf.spare]
        sent = [{s: int(x) for s, x in zip(m, own, strict=True)} for m, own in zip(members, pdf.sent, strict=True)]
        before = [sum(own.values()) for own in sent]
        sent = cheapest_flow(words, members, quotas[int(pdf.part.iloc[0])], [0], (spare, sent))
        left = [x + w - sum(own.values()) + b for x, w, own, b in zip(pdf.spare, words, sent, before, strict=True)]
        return pdf.assign(sent=[[own[s] for s in m] for m, own in zip(members, sent, strict=True)], spare=left)

    return run


def _shares(flow: DataFrame, left: list[int], parts: int) -> dict[int, list[int]]:
    """Whole shares of what each source still takes, by the words of its patterns in each part; they add up to all of it."""
    told = flow.select("part", "words", F.explode("members").alias("s")).groupBy("part", "s").agg(F.sum("words").alias("n")).collect()  # parts x sources
    own = {(r.part, r.s): r.n for r in told}
    out: dict[int, list[int]] = {part: [] for part in range(parts)}
    for s, rest in enumerate(left):
        total, upto = sum(own.get((part, s), 0) for part in range(parts)), 0
        for part in range(parts):
            before, upto = upto, upto + own.get((part, s), 0)
            out[part].append(rest * upto // total - rest * before // total if total else 0)
    return out


def _sent_to(s: int) -> Column:
    """Words a pattern sends to source s (0 where it is no member)."""
    at = F.array_position("members", F.lit(s).cast("int"))
    return F.when(at > 0, F.element_at("sent", at.cast("int"))).otherwise(0)


def _paths(left: list[int], edges: dict[tuple[int, int], int]) -> tuple[list[int], list[list[int]]]:
    """Sources in order of their distance from one that still takes words, and shortest ways there that share no source."""
    into: dict[int, list[int]] = {}
    for a, b in sorted(edges):
        into.setdefault(b, []).append(a)
    queue = deque(sorted((s for s, x in enumerate(left) if x), key=lambda s: (-left[s], s)))
    then: dict[int, int | None] = dict.fromkeys(queue)
    while queue:
        b = queue.popleft()
        for a in into.get(b, ()):
            if a not in then:
                then[a] = b
                queue.append(a)
    paths = []
    for s in then:
        way: list[int] = []
        at: int | None = s
        while at is not None:
            way.append(at)
            at = then[at]
        paths.append(way)
    return list(then), paths


def _augment(flow: DataFrame, left: list[int], parts: int) -> tuple[DataFrame, list[int]]:
    """Routes spare words over all parts until no path is left that takes any.

    A path enters at a source of a pattern with spare words and goes from source to source, since words sent to one can be sent
    to the next by patterns of both, up to a source that still takes words. What passes between two sources is summed over all
    patterns, and the words of a path are taken from them in their order by running sums within parts, after the sums of
    earlier parts. Paths of a turn share no source, and a pattern's spare words enter at one source only, the nearest one.
    """
    parts_of = range(parts)
    while any(left):
        sends = flow.select("members", F.posexplode("sent").alias("i", "n")).where("n > 0")
        moves = sends.select(F.get("members", "i").alias("a"), "n", F.explode("members").alias("b")).where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))
        edges = {(r.a, r.b): r.n for r in moves.collect()}  # pairs of sources
        order, ways = _paths(left, edges)
        # A member's place in the order of distances (none: unreachable); a null index must not reach element_at.
        ranked = F.array(*[F.lit(s).cast("int") for s in order])
        nearest = F.array_min(F.filter(F.transform("members", lambda m: F.array_position(ranked, m)), lambda x: x > 0))
        starts = flow.withColumn("enter", F.when(nearest.isNotNull(), F.element_at(ranked, F.coalesce(nearest, F.lit(1)).cast("int"))))
        entry = {(r.part, r.enter): r.n for r in starts.where("spare > 0 and enter is not null").groupBy("part", "enter").agg(F.sum("spare").alias("n")).collect()}  # parts x sources
        chosen, used = [], set()
        for way in ways:
            enters = sum(entry.get((part, way[0]), 0) for part in parts_of)
            if enters and not used & set(way):
                used |= set(way)
                chosen.append((way, min([enters, left[way[-1]], *(edges[x] for x in zip(way, way[1:], strict=False))])))
        if not chosen:
            break
        steps = [(way, k, words) for way, words in chosen for k in range(len(way))]
        has = lambda s: F.array_contains("members", F.lit(s).cast("int"))
        ready = [F.when(F.col("enter") == way[0], F.col("spare")).otherwise(0) if k == 0 else F.when(has(way[k]), _sent_to(way[k - 1])).otherwise(0) for way, k, _ in steps]
        offered = cut(starts.withColumn("ready", F.array(*[x.cast("long") for x in ready])))
        sums = {r.part: r for r in offered.groupBy("part").agg(*[F.sum(F.get("ready", F.lit(i))).alias(f"n{i}") for i in range(len(steps))]).collect()}
        lines, before = [], [0] * len(steps)
        for part in parts_of:
            own = [sums[part][f"n{i}"] if part in sums else 0 for i in range(len(steps))]
            lines.append((part, [max(0, min(n, words - b)) for n, b, (_, _, words) in zip(own, before, steps, strict=True)]))
            before = [b + n for b, n in zip(before, own, strict=True)]
        want = flow.sparkSession.createDataFrame(lines, "part int, want array<long>")
        along = Window.partitionBy("part").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        taken = [F.greatest(F.lit(0), F.least(F.get("ready", F.lit(i)), F.get("want", F.lit(i)) - F.coalesce(F.sum(F.get("ready", F.lit(i))).over(along), F.lit(0)))) for i in range(len(steps))]
        moved = offered.join(F.broadcast(want), "part").withColumn("taken", F.array(*taken))  # a row a part
        change: dict[int, Column] = {}
        for i, (way, k, _) in enumerate(steps):
            t = F.get("taken", F.lit(i))
            change[way[k]] = change.get(way[k], F.lit(0)) + t
            if k:
                change[way[k - 1]] = change.get(way[k - 1], F.lit(0)) - t
        gains = F.array(*[F.struct(F.lit(s).cast("int").alias("s"), c.alias("n")) for s, c in sorted(change.items())])
        added = F.transform("members", lambda m: F.coalesce(F.get(F.filter(F.col("gains"), lambda g: g["s"] == m), F.lit(0))["n"], F.lit(0)))
        spent = sum((F.get("taken", F.lit(i)) for i, (_, k, _) in enumerate(steps) if k == 0), F.lit(0))
        flow = cut(
            moved.withColumns({"gains": gains, "spent": spent})
            .withColumn("sent", F.zip_with("sent", added, lambda a, b: a + b))
            .select("part", "p", "words", "members", "sent", (F.col("spare") - F.col("spent")).alias("spare"))
        )
        for way, words in chosen:
            left[way[-1]] -= words
    return flow, left


def flow_in_parts(totals: DataFrame, order: list, quota: list[int], uses: int, parts: int) -> DataFrame:
    """The cheapest flow for any number of patterns: p, words and sent (all its words), one row per pattern.

    totals: pattern (an array of sources) and words; order: the sources, as quota lists them. For each use in turn, every
    part routes what it can within its share of the quotas, one part a task; then paths over all parts route what is
    left. As nothing fits any more after each use, the words of each use are as many as when all patterns are routed at once.
    """
    names = totals.sparkSession.createDataFrame([(i, s) for i, s in enumerate(order)], "i int, s string")
    by_name = totals.select("pattern", "words", F.posexplode("pattern").alias("k", "s"))
    joined = by_name.alias("a").join(F.broadcast(names).alias("b"), F.col("a.s").eqNullSafe(F.col("b.s"))).select("pattern", "words", "k", "i")  # a row a source
    flow = joined.groupBy("pattern", "words").agg(F.array_sort(F.collect_list(F.struct("k", "i"))).alias("m"))
    flow = flow.select(F.pmod(F.xxhash64("pattern"), F.lit(parts)).cast("int").alias("part"), F.col("pattern").alias("p"), "words", F.col("m.i").alias("members"))
    flow = cut(flow.withColumns({"sent": F.transform("members", lambda m: F.lit(0).cast("long")), "spare": F.lit(0).cast("long")}))
    left = list(quota)
    for _ in range(uses):
        flow = cut(flow.groupBy("part").applyInPandas(_route_part(_shares(flow, left, parts)), FLOW))
        got = {r.s: r.n for r in flow.select(F.explode(F.arrays_zip("members", "sent")).alias("x")).groupBy(F.col("x.members").alias("s")).agg(F.sum("x.sent").alias("n")).collect()}
        left = [q - got.get(s, 0) for s, q in enumerate(quota)]
        flow, left = _augment(flow, left, parts)
    return flow.select("p", "words", "members", F.aggregate("sent", F.lit(0).cast("long"), lambda a, b: a + b).alias("sent"))
