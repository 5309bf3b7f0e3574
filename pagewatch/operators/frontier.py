"""Url batches: expanding a frontier in waves, lanes, pools, paging and retries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewatch.functions.text import bound, query_pairs
from pagewatch.operators.ordered import GROUP_ROWS, numbered
from pagewatch.session import BROADCAST_ROWS, durable, small

# Fixed value: urls a single monitor cycle takes, seeds and accepted pushes together. It holds only where it is passed as a limit.
CYCLE_LIMIT = 10_000
# Waves kept apart before they are written together again, so that plans stay short.
WAVES_KEPT = 8
# Waves followed one by one before what lies farther is followed by paths; and rows of paths for each link, with a floor.
NEAR_WAVES, PATHS_A_LINK, LEAST_PATHS = 8, 32, 2_000_000


def expand(
    seeds: DataFrame, links: DataFrame, limit: int | None = None, stored: bool = False, near_waves: int = NEAR_WAVES
) -> tuple[DataFrame, DataFrame]:
    """Follow ``links(src, dst, pos)`` from ``seeds(url)`` until nothing new turns up.

    Every wave reads the links once more; unless they come from a stored table (``stored``) they are written out first.
    What lies more than ``near_waves`` away is followed several waves at a time (``beyond``), unless there is a limit.
    Returns ``visited(url, wave)`` and one row of counts (processed, failed, pushed, duplicates, rejected). Urls are
    the same when their text is. A seed listed twice is processed twice. With ``limit``, seeds and accepted pushes
    stop there, in (src, pos) order within the wave.
    """
    spark = seeds.sparkSession
    links = links if stored else durable(links.select("src", "dst", "pos"))
    frontier = durable(seeds.groupBy("url").agg(F.count(F.lit(1)).alias("times")))
    size, processed = frontier.agg(F.count(F.lit(1)), F.sum("times")).first()
    processed = processed or 0
    waves = [frontier.select("url", F.lit(0).alias("wave"))]
    pushed = duplicates = rejected = 0
    known, wave = size, 0
    while size:
        if limit is None and wave >= max(near_waves, 1):
            far, fresh, total = beyond(links, _union(waves), wave)
            waves.append(far)
            processed, pushed, duplicates = processed + fresh, pushed + fresh, duplicates + total - fresh
            break
        wave += 1
        todo = F.broadcast(frontier) if size <= BROADCAST_ROWS else frontier
        pushes = links.join(todo, links["src"] == todo["url"]).select("dst", "times", "src", "pos")
        # A popular target is counted before the shuffle, so it does not pile up in one task.
        targets = pushes.groupBy("dst").agg(F.sum("times").alias("times"), F.min(F.struct("src", "pos")).alias("first"))
        visited = _union(waves).select(F.col("url").alias("dst"), F.lit(True).alias("known"))
        marked = durable(targets.join(visited, "dst", "left"))
        total, fresh = marked.agg(F.sum("times"), F.count_if(F.col("known").isNull())).first()
        total = total or 0
        new = marked.where(F.col("known").isNull())
        refused = 0
        if limit is not None and known + fresh > limit:
            room = max(0, limit - known)
            late = new.orderBy("first").offset(room).agg(F.sum("times")).first()[0]
            refused, fresh = late or 0, room
            new = durable(new.orderBy("first").limit(room))
        rejected += refused
        pushed += fresh
        duplicates += total - fresh - refused
        processed += fresh
        known += fresh
        size = fresh
        frontier = new.select(F.col("dst").alias("url"), F.lit(1).cast("bigint").alias("times"))
        if size:
            waves.append(frontier.select("url", F.lit(wave).alias("wave")))
            if len(waves) > WAVES_KEPT:
                # Partitioned anew, or the number of partitions would grow with every wave.
                waves = [durable(_union(waves).repartition("url"))]
    counts = spark.range(1).select(
        *[F.lit(v).cast("bigint").alias(n) for n, v in (
            ("processed", processed), ("failed", 0), ("pushed", pushed), ("duplicates", duplicates), ("rejected", rejected)
        )]
    )
    return _union(waves), counts


def beyond(links: DataFrame, visited: DataFrame, wave: int) -> tuple[DataFrame, int, int]:
    """What the urls of the last ``wave`` of ``visited(url, wave)`` lead to, with how many rows and pushes that makes.

    A url that is first reached ``d`` waves after a wave is the end of a shortest path of ``d`` links from some url of it. So
    with all shortest paths of up to ``k`` links (``paths``) ``k`` waves are one step. Paths are made of what is still
    unvisited and anew when half of that is done, so few urls have long ones. A null target is in each wave that a link to it
    makes, and leads nowhere.
    """
    ends = links.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    last = visited.where(F.col("wave") == wave).select("url").where("url IS NOT NULL")
    before = visited.where(F.col("wave") < wave).select("url")
    ends = ends.join(visited.select(F.col("url").alias("dst")), "dst", "left_anti").join(before.withColumnRenamed("url", "src"), "src", "left_anti")
    ends = durable(ends)
    urls = ends.select(F.col("src").alias("url")).union(ends.select("dst")).distinct()
    # Paths are told by numbers, which are shorter than urls.
    urls = durable(urls.withColumn("id", F.monotonically_increasing_id()))
    edges = durable(ends.join(urls.toDF("src", "s"), "src").join(urls.toDF("dst", "t"), "dst").select("s", "t"))
    frontier = durable(last.join(urls, "url").select("id"))
    found, size, at = [frontier.select("id", F.lit(wave).alias("wave"))], frontier.count(), wave
    while size:
        reach, length = paths(edges)
        built = left = edges.select("t").distinct().count()
        while size and left * 2 >= built:
            todo = F.broadcast(frontier) if size <= BROADCAST_ROWS else frontier
            ahead = reach.join(todo, F.col("s") == F.col("id")).groupBy("t").agg(F.min("d").alias("d"))
            known = _union(found).select(F.col("id").alias("t"))
            new = durable(ahead.join(known, "t", "left_anti").select(F.col("t").alias("id"), (F.col("d") + at).alias("wave")))
            at += length
            fresh, size = new.agg(F.count(F.lit(1)), F.count_if(F.col("wave") == at)).first()
            left -= fresh
            if fresh:
                found.append(new)
            frontier = new.where(F.col("wave") == at).select("id")
            if len(found) > WAVES_KEPT:
                found = [durable(_union(found).repartition("id"))]
        if size:
            done = durable(_union(found))
            ended = done.where(F.col("wave") < at).select(F.col("id").alias("s"))
            edges = durable(edges.join(done.select(F.col("id").alias("t")), "t", "left_anti").join(ended, "s", "left_anti").select("s", "t"))
    far = durable(_union(found).where(F.col("wave") > wave).join(urls, "id").select("url", "wave"))
    # The pushes of the last wave known and of all farther ones.
    pushing = far.unionByName(visited.where(F.col("wave") == wave)).select(F.col("url").alias("src"), "wave")
    nowhere = durable(links.where("dst IS NULL").join(pushing, "src").select(F.lit(None).cast("string").alias("url"), (F.col("wave") + 1).alias("wave")).distinct())
    far = far.unionByName(nowhere)
    return far, far.count(), links.join(pushing, "src").count()


def paths(edges: DataFrame, rows: int | None = None) -> tuple[DataFrame, int]:
    """(s, t, d) for every shortest path of ``edges(s, t)`` of up to some length, and that length.

    The length is doubled as long as the paths that this puts together, which are counted first, are at most ``rows``.
    """
    reach, length = durable(edges.where("s <> t").select("s", "t", F.lit(1).alias("d"))), 1
    rows = rows or max(LEAST_PATHS, PATHS_A_LINK * reach.count())
    while True:
        longest = reach.where(F.col("d") == length)
        into, out = longest.groupBy(F.col("t").alias("m")).agg(F.count("*").alias("into")), reach.groupBy(F.col("s").alias("m")).agg(F.count("*").alias("out"))
        longer = into.join(out, "m").agg(F.sum(F.col("into") * F.col("out"))).first()[0]
        if not longer or longer > rows:
            return reach, length
        on = longest.select("s", F.col("t").alias("m")).join(reach.select(F.col("s").alias("m"), "t", (F.col("d") + length).alias("d")), "m")
        reach = durable(reach.union(on.where("s <> t").select("s", "t", "d")).groupBy("s", "t").agg(F.min("d").alias("d")))
        length *= 2


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def seed_batch(
    spark: SparkSession, urls: DataFrame, seed_fn: Callable[[SparkSession], DataFrame | None] | None, limit: int | None = None
) -> DataFrame:
    """The batch of a cycle: what ``seed_fn`` returns, unless it returns None or an invalid batch.

    Valid means a ``url`` column of text without NULLs and no more rows than ``limit``; an empty one means no work.
    """
    computed = seed_fn(spark) if seed_fn else None
    if computed is None or dict(computed.dtypes).get("url") != "string":
        return urls
    missing, size = computed.agg(F.count_if(F.col("url").isNull()), F.count(F.lit(1))).first()
    if missing or (limit is not None and size > limit):
        return urls
    return computed.select("url")


def admitted(pushed: DataFrame, known: DataFrame) -> DataFrame:
    """What becomes of pushed urls: (url, times, fresh) per url, ``fresh`` unless ``known(url)`` has it.

    Of the pushes of a fresh url the first is admitted and the others are duplicates; of a known url all are duplicates.
    A null url is no push.
    """
    asked = pushed.where(F.col("url").isNotNull()).groupBy("url").agg(F.count(F.lit(1)).alias("times"))
    listed = known.select("url").distinct().withColumn("_known", F.lit(True))
    return asked.join(listed, "url", "left").select("url", "times", F.col("_known").isNull().alias("fresh"))


def push_counts(admitted: DataFrame) -> DataFrame:
    """One row: urls ``pushed``, and pushes that were ``duplicates``."""
    return admitted.agg(
        F.count_if("fresh").alias("pushed"), F.coalesce(F.sum(F.col("times") - F.col("fresh").cast("bigint")), F.lit(0)).alias("duplicates")
    )


def lanes(batch: DataFrame, count: int, order: Sequence[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """Deal a batch over ``count`` lanes, numbered from 1, one row after another."""
    placed = numbered(batch, [], order, "_place", group_rows)
    return placed.withColumn("lane", F.pmod(F.col("_place") - 1, F.lit(count)) + 1).drop("_place")


def assign_pool(
    batch: DataFrame, pool: Sequence[str], rotate: str, order: Sequence[str], enabled: bool = True, seed: int = 0,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Give every row a pool member: always the first, in turn, or at random (repeatable for a seed)."""
    if not enabled or not pool:
        return batch.withColumn("proxy", F.lit(None).cast("string"))
    members = F.array(*[F.lit(p) for p in pool])
    if rotate == "Sticky":
        return batch.withColumn("proxy", F.lit(pool[0]))
    if rotate == "Random":
        at = F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(len(pool)))
        return batch.withColumn("proxy", F.get(members, at.cast("int")))
    placed = numbered(batch, [], order, "_place", group_rows)
    at = F.pmod(F.col("_place") - 1, F.lit(len(pool)))
    return placed.withColumn("proxy", F.get(members, at.cast("int"))).drop("_place")


def first_success(attempts: DataFrame, keys: Sequence[str], order: Sequence[str], ok: Column, taken: Sequence[str]) -> DataFrame:
    """The first successful attempt per key, or ``exhausted`` when all failed."""
    first = F.min(F.when(ok, F.struct(*order, *taken))).alias("_first")
    rows = attempts.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("attempts"))
    outcome = F.when(F.col("_first").isNull(), "exhausted").otherwise("ok")
    return rows.select(*keys, "attempts", outcome.alias("outcome"), *[F.col(f"_first.{c}").alias(c) for c in (*order, *taken)])


def numbered_pages(urls: DataFrame, pages: int, url: str = "url") -> DataFrame:
    """Each url once per page number, with ``?page=N`` or ``&page=N`` added."""
    joiner = F.when(F.contains(F.col(url), F.lit("?")), "&page=").otherwise("?page=")
    return urls.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages)))).withColumn(
        "page_url", F.concat(F.col(url), joiner, F.col("page").cast("string"))
    )


def page_of_run(run_no: Column, pages: int) -> Column:
    """The page number of the n-th run (from 1), starting over after the last."""
    return F.pmod(run_no - 1, F.lit(pages)) + 1


def monitor_targets(batch: DataFrame, targets: DataFrame, how: str = "inner") -> DataFrame:
    """``monitor:<id>`` entries with their target row; an entry whose target is gone is skipped."""
    named = batch.withColumn("id", F.regexp_extract("entry", r"^monitor:(.+)$", 1))
    return named.join(targets, "id", how)


def route(jobs: DataFrame, pages: DataFrame, job: str = "name") -> DataFrame:
    """Pages of every job's own url batch (``urls``), by exact address; broadcast only when the batches are small."""
    wanted = jobs.select(job, F.explode("urls").alias("url"))
    return small(wanted).join(pages, "url")


def url_parameters(urls: DataFrame, keys: Sequence[str], url: str = "url") -> DataFrame:
    """(keys, url, key, value) of the query strings; of a name given twice the last value counts."""
    pairs = query_pairs(F.col(url))

    def last(pairs: Column) -> Column:
        return F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["key"] == p["key"]) & (q["pos"] > p["pos"])))

    # All pairs of a name stand in the same row, so nothing needs to be shuffled to find the last one.
    rows = urls.select(*keys, url, F.inline(bound(pairs, last)))
    return rows.select(*keys, url, "key", "value")
