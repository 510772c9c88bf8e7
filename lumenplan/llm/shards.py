"""Shards of even row counts by balanced label propagation.

Rows that share a link should share a shard.  Linked rows start in order of their links, so that only links
at the borders of shards are cut.  In each round every link tells how many of its rows each shard holds; every row asks for the shard where most of its
linked rows are (among those with room, as long as that brings linked rows together; else among all); where
its links have more rows than a shard holds, for one of as many shards as they need.  Rows that two shards want to swap
are exchanged, and beyond that a shard admits as many as its quota leaves.  Rows of one link are
admitted together where the quota allows.  Rows without links then fill the shards up, so
the counts of any two shards differ by at most one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .hot import join_keys
from .ranks import add_rank

SHARDS = 16
#: Rounds at most.
ROUNDS = 12
#: Buckets of links for ranks, and rows of one bucket, of which there are so many more as the rows grow.
LINK_BUCKETS, BUCKET_ROWS = 1024, 100_000


def _buckets(n_rows: int) -> int:
    """Buckets of about BUCKET_ROWS rows, a multiple of LINK_BUCKETS; the table of their sizes stays small."""
    return LINK_BUCKETS * max(4, -(-n_rows // (LINK_BUCKETS * BUCKET_ROWS)))


def _spread(column: str, n: int):
    return F.pmod(F.xxhash64(F.lit(7), column), F.lit(n))


def _link_bucket(buckets: int):
    """Rows of one link next to each other; those of a large one in parts."""
    parts = buckets // LINK_BUCKETS
    return _spread("salt", LINK_BUCKETS) * parts + _spread("row", parts)


def _goal(n_rows: int, shards: int) -> list[int]:
    return [n_rows // shards + (s < n_rows % shards) for s in range(shards)]


def _filled(rank: str, room: list[int]):
    """The shard of a rank where shards are filled one after the other."""
    shard, end = None, 0
    for s, n in enumerate(room):
        end += n
        shard = F.when(F.col(rank) < end, s) if shard is None else shard.when(F.col(rank) < end, s)
    return shard.cast("int")


def _sizes(labels: DataFrame, shards: int) -> list[int]:
    found = {r.shard: r.n for r in labels.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _together(links: DataFrame, labels: DataFrame) -> int:
    """Pairs of rows that share a link and a shard, each twice and each row with itself; the more, the fewer cut."""
    held = links.join(labels, "row").groupBy("link", "shard").agg(F.count("*").cast("decimal(18,0)").alias("n"))
    return int(held.agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).first().pairs or 0)


def _quotas(wanted: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many rows may move from each shard to each other: exchanges, and shares of the room left."""
    n = len(room)
    out = [[min(wanted[a][b], wanted[b][a]) for b in range(n)] for a in range(n)]
    for b in range(n):
        rest = [wanted[a][b] - out[a][b] for a in range(n)]
        total = max(1, sum(rest))
        seats = min(room[b], sum(rest))
        shares = [seats * r // total for r in rest]
        for a in sorted(range(n), key=lambda a: (-(seats * rest[a] % total), a))[: seats - sum(shares)]:
            shares[a] += 1
        for a in range(n):
            out[a][b] += shares[a]
    return out


def _round(links: DataFrame, n_links: int, labels: DataFrame, room: list[int], quota: int, shards: int, anywhere: bool, buckets: int) -> DataFrame:
    """The labels after one round; ``room`` is how many rows each shard may still take, ``quota`` how many it holds.

    What the shards hold of a link with many rows is broadcast, so these rows never meet in one task.
    """
    held = links.join(labels, "row").groupBy("link", "shard").agg(F.count("*").alias("n"))
    counts = held.groupBy("link").agg(
        *[F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in range(shards)], F.sum("n").alias("n")
    )
    seen = join_keys(links, counts, "link", n_links).groupBy("row").agg(
        F.min("link").alias("salt"), *[F.sum(f"n{s}").alias(f"n{s}") for s in range(shards)]
    )
    own = seen.join(labels, "row")
    options = F.array(
        *[
            F.when(
                (F.col("shard") == s) | F.lit(anywhere or room[s] > 0),
                F.struct(F.col(f"n{s}").alias("n"), F.xxhash64("salt", F.lit(s)).alias("tie"), F.lit(s).alias("to")),
            )
            for s in range(shards)
        ]
    )
    # links of more rows than a shard holds need several: as many of the best are filled at once
    best = F.transform(F.sort_array(F.array_compact(options), asc=False), lambda o: o["to"])
    needed = F.ceil(sum((F.col(f"n{s}") for s in range(1, shards)), F.col("n0")) / F.lit(max(1, quota)))
    needed = F.greatest(F.lit(1), F.least(needed, F.size("best"))).cast("int")
    wishing = own.withColumn("best", best).withColumn("needed", needed)
    stays = F.array_position(F.slice("best", F.lit(1), F.col("needed")), F.col("shard")) > 0
    to = F.when(stays, F.col("shard")).otherwise(F.element_at("best", 1 + F.pmod(F.xxhash64(F.lit(11), "row"), F.col("needed")).cast("int")))
    wished = scratch.save(wishing.select("row", "salt", "shard", to.alias("to")), "wishes")
    wanted = [[0] * shards for _ in range(shards)]
    for r in wished.where("to != shard").groupBy("shard", "to").agg(F.count("*").alias("n")).collect():
        wanted[r.shard][r.to] = r.n
    quotas = F.array(*[F.array(*[F.lit(int(q)) for q in row]) for row in _quotas(wanted, room)])
    movers = add_rank(wished.where("to != shard"), ["shard", "to"], _link_bucket(buckets), buckets, ["salt", "row"])
    moved = movers.where(F.col("rank") < F.get(F.get(quotas, F.col("shard")), F.col("to"))).select("row", F.col("to").alias("moved"))
    return wished.join(moved, "row", "left").select("row", F.coalesce("moved", "shard").alias("shard"))


def propagate(links: DataFrame, n_rows: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Labels ``(row, shard)`` of the rows in ``links (row, link)``; no shard exceeds its share of ``n_rows``.

    Rounds end when two in turn bring no linked rows together, and after ``rounds`` at most.  What is left
    then are links that more rounds might still join; sizes are even whatever the round.
    """
    rows = links.groupBy("row").agg(F.min("link").alias("salt"))
    buckets = _buckets(n_rows)
    start = add_rank(rows, [], _link_bucket(buckets), buckets, ["salt", "row"])
    labels = scratch.save(start.select("row", _filled("rank", _goal(n_rows, shards)).alias("shard")), "labels")
    sizes = _sizes(labels, shards)
    n_links = links.count()
    anywhere, still, together = True, 0, _together(links, labels) if sum(sizes) else 0
    for _ in range(rounds if sum(sizes) else 0):
        room = [max(0, n_rows // shards - n) for n in sizes]
        after = scratch.save(_round(links, n_links, labels, room, n_rows // shards, shards, anywhere, buckets), "labels")
        now = _together(links, after)
        if now > together:
            labels, sizes, together, still = after, _sizes(after, shards), now, 0
            # a link larger than a shard fills one after the other as long as there is room
            anywhere = False
        else:
            still += 1
            anywhere = not anywhere
        if still == 2:
            break
    return labels


def assign(rows: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Add ``shard`` and the gapless ``slot`` within it to ``rows``, which have a unique long ``row``.

    ``links`` has a line ``(row, link)`` for each link of a row, a value of any type that can be grouped;
    a link of one row only says nothing.
    """
    sizes = links.groupBy("link").agg(F.count("*").alias("n")).where("n > 1")
    numbered = sizes.withColumn("number", F.monotonically_increasing_id())  # join_keys saves it, so a link keeps its number
    linked = scratch.save(join_keys(links, numbered, "link", links.count()).select("row", F.col("number").alias("link")), "links")
    n_rows = rows.count()
    labels = propagate(linked, n_rows, shards, rounds)
    sizes = _sizes(labels, shards)
    free = rows.join(labels, "row", "left_anti").select("row")
    buckets = _buckets(n_rows)
    ranked = add_rank(free, [], _spread("row", buckets), buckets, ["row"])
    room = [g - n for g, n in zip(_goal(n_rows, shards), sizes)]
    every = scratch.save(ranked.select("row", _filled("rank", room).alias("shard")).unionByName(labels), "shards")
    slots = add_rank(every, ["shard"], _spread("row", buckets), buckets, ["row"], "slot")
    return rows.join(slots, "row")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null).

    Equal texts (by 128 bits and their size) are linked; a null text has size 1 and counts as empty.  Repeated rows are rows of
    their own, also with a null doc_id; with fewer rows than shards some shards stay empty; an empty
    table gives none; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = scratch.save(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        ),
        "rows",
    )
    linked = rows.select("row", F.struct("digest", "size").alias("link"))
    return assign(rows.drop("digest"), linked, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
