"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard has ``vnodes`` virtual nodes on a ring of hashed places; a row goes to the node
at or after the place of its id.  A shard takes no more rows than its bound; the bounds are
the row count over the shards, rounded so that they add up to it, so counts are at most one
apart (law ``rows``).  A shard takes the rows of its own arcs first, in ring order and inside
an arc in the order of a hash of the row.  What does not fit goes on clockwise in that order
and is taken by the next node whose shard has room, first come first served; two rounds place
everything.

How many rows pass from which arc to which shard depends on the counts of the arcs alone, and
their number is fixed by the parameters, so the walk is one fold over one row.  It gives for
every arc a few ranges of ranks, each with a shard and a first slot.  A row's rank in its arc
comes from a window over a cell of the arc; cells hold about ``CELL_ROWS`` rows, whatever the
arc holds.  Equal rows (same id and text) are counted before anything is dealt and spread as
chunks of at most ``CHUNK`` copies, so neither an id nor a text can make a task large.

Defined cases: a null text has no bytes and the checksum of none; a null id is one more id;
rows that repeat an id and its text are interchangeable and get a slot each; with fewer rows
than shards the first shards get one row each; no row gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagemill.llm.common import cut_lineage

SHARDS, VNODES = 40, 64
#: Rows of an arc that one window task ranks; copies of a row that one task spreads.
CELL_ROWS, CHUNK = 1 << 16, 1 << 16
#: Bytes that a stored row has besides its text.
HEADER = 16
#: Places of the ring per virtual node (rounded up to a power of two).
ROOM = 8


def hash32(of: Column, start: int = 1) -> Column:
    """Eight hexadecimal digits of MD5 as a number: the same in every engine."""
    return F.conv(F.substring(F.md5(of.cast("binary")), start, 8), 16, 10).cast("bigint")


def ring(spark: SparkSession, shards: int, vnodes: int) -> tuple[DataFrame, DataFrame]:
    """(arc, shard) in clockwise order, and (place, arc) of every place; sizes follow from the parameters."""
    places = 1 << (ROOM * shards * vnodes - 1).bit_length()
    node = spark.range(shards * vnodes).select(
        (F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("vnode"))
    node = node.withColumn("place", hash32(F.concat_ws("#", "shard", "vnode")) % places)
    arcs = node.withColumn("arc", F.row_number().over(Window.orderBy("place", "shard", "vnode")) - 1)
    first = arcs.groupBy("place").agg(F.min("arc").alias("own"))
    # From the last place backwards, the nearest node seen so far is the next one clockwise.
    back = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    every = spark.range(places).withColumnRenamed("id", "place").join(F.broadcast(first), "place", "left")
    found = every.select("place", F.coalesce(F.last("own", ignorenulls=True).over(back), F.lit(0)).alias("arc"))
    return arcs.select("arc", "shard"), found


def keyed(docs: DataFrame, id_column: str, text: str, places: int) -> DataFrame:
    """One row per id, text and chunk of copies: (id, size, crc, chunk, copies, place, turn)."""
    body = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_column).alias("id"), (F.octet_length(body) + HEADER).cast("bigint").alias("size"), F.crc32(body).alias("crc"))
    counted = rows.groupBy("id", "size", "crc").agg(F.count("*").alias("m"))
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / CHUNK))))
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    return chunks.select(
        "id", "size", "crc", "chunk", F.least(F.lit(CHUNK), F.col("m") - F.col("chunk") * CHUNK).alias("copies"),
        (hash32(name) % places).alias("place"), hash32(F.concat_ws("#", name, "size", "crc", "chunk"), 9).alias("turn"),
    )


def bound(n: Column, shards: int, shard: Column) -> Column:
    """Rows that a shard takes: the mean, one more for the first shards where it is not whole."""
    return F.floor(n / shards) + F.when(shard < n % shards, 1).otherwise(0)


def arc_loads(arcs: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """Per arc what its shard keeps, the first slot of that, and the place of the rest in the overflow."""
    whole = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    rows = arcs.join(counts, "arc", "left").withColumn("n", F.coalesce("n", zero))
    rows = rows.withColumn("cap", bound(F.sum("n").over(whole), shards, F.col("shard")))
    rows = rows.withColumn("base", F.least("cap", F.coalesce(F.sum("n").over(before), zero)))
    rows = rows.withColumn("kept", F.least("n", F.col("cap") - F.col("base"))).withColumn("over", F.col("n") - F.col("kept"))
    return rows.withColumn("over_base", F.coalesce(F.sum("over").over(ahead), zero))


def walk(loads: DataFrame, shards: int) -> DataFrame:
    """(start, shard, slot): from overflow row ``start`` on, rows go to ``shard`` from ``slot`` on.

    The queue is first come first served, so the order of taking is the order of overflowing.
    """
    ordered = loads.agg(F.sort_array(F.collect_list(F.struct("arc", "shard", "over", "kept", "cap"))).alias("arcs"))
    caps = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.aggregate("arcs", F.lit(0).cast("bigint"), lambda a, x: F.when(x["shard"] == s, x["cap"]).otherwise(a)),
    )
    free = F.aggregate(
        "arcs", caps, lambda a, x: F.transform(a, lambda f, s: F.when(s == x["shard"], f - x["kept"]).otherwise(f)))
    ordered = ordered.select("arcs", free.alias("free"))
    once_more = F.transform("arcs", lambda x: x.withField("over", F.lit(0).cast("bigint")))
    none = F.array().cast("array<struct<start:bigint,shard:bigint,slot:bigint>>")
    state = F.struct(
        F.col("free").alias("free"), F.lit(0).cast("bigint").alias("carry"), F.lit(0).cast("bigint").alias("done"), none.alias("taken"))

    def step(a: Column, x: Column) -> Column:
        room = F.element_at(a["free"], x["shard"].cast("int") + 1)
        take = F.least(room, a["carry"] + x["over"])
        event = F.struct(a["done"].alias("start"), x["shard"].alias("shard"), (x["cap"] - room).alias("slot"))
        return F.struct(
            F.when(take > 0, F.transform(a["free"], lambda f, s: F.when(s == x["shard"], f - take).otherwise(f))).otherwise(
                a["free"]).alias("free"),
            (a["carry"] + x["over"] - take).alias("carry"), (a["done"] + take).alias("done"),
            F.when(take > 0, F.concat(a["taken"], F.array(event))).otherwise(a["taken"]).alias("taken"),
        )

    taken = F.aggregate(F.concat("arcs", once_more), state, step, lambda a: a["taken"])
    return ordered.select(F.inline(taken))


def ranges(loads: DataFrame, taken: DataFrame) -> DataFrame:
    """(arc, lo, hi, shard, slot): ranks ``lo`` to ``hi`` - 1 of an arc go to ``shard`` from ``slot`` on."""
    kept = loads.where("kept > 0").select("arc", F.lit(0).cast("bigint").alias("lo"), F.col("kept").alias("hi"), "shard", F.col("base").alias("slot"))
    # Both sides cut the overflow into ranges; every cut starts a range of the common refinement.
    left = loads.where("over > 0").select(F.col("over_base").alias("start"), F.struct("arc", "kept", "over_base", "over").alias("arc"))
    right = taken.select("start", F.struct("start", "shard", "slot").alias("to"))
    cuts = left.join(right, "start", "full")
    order = Window.orderBy("start")
    seen = order.rowsBetween(Window.unboundedPreceding, 0)
    cuts = cuts.select(
        "start", F.lead("start").over(order).alias("end"), F.last("arc", ignorenulls=True).over(seen).alias("a"),
        F.last("to", ignorenulls=True).over(seen).alias("t"))
    end = F.coalesce("end", F.col("a.over_base") + F.col("a.over"))
    shift = F.col("a.kept") - F.col("a.over_base")
    passed = cuts.select(
        F.col("a.arc").alias("arc"), (F.col("start") + shift).alias("lo"), (end + shift).alias("hi"), F.col("t.shard").alias("shard"),
        (F.col("t.slot") + F.col("start") - F.col("t.start")).alias("slot"))
    return kept.unionByName(passed)


def assign(
    docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_column: str = "doc_id", text: str = "text",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot, home): the shard of every row, its place there and the shard of its arc."""
    spark = docs.sparkSession
    places = 1 << (ROOM * shards * vnodes - 1).bit_length()
    rows = cut_lineage(keyed(docs, id_column, text, places))
    arcs, place_arc = (cut_lineage(df) for df in ring(spark, shards, vnodes))
    # At most ``places`` small rows, whatever the corpus holds.
    counts = rows.join(F.broadcast(place_arc), "place").groupBy("arc").agg(F.sum("copies").alias("n"))
    loads = cut_lineage(arc_loads(arcs, counts, shards))
    parts = cut_lineage(ranges(loads, walk(loads, shards)))
    cells = loads.select("arc", F.col("shard").alias("home"), F.greatest(F.lit(1), F.ceil(F.col("n") / cell_rows)).alias("cells"))
    located = rows.join(F.broadcast(place_arc.join(cells, "arc")), "place").withColumn("cell", F.col("turn") % F.col("cells"))
    ahead = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = located.groupBy("arc", "cell").agg(F.sum("copies").alias("held"))
    sizes = sizes.select("arc", "cell", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("arc", "cell").orderBy("turn", "id", "size", "crc", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("ahead") + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    ranked = located.join(sizes, ["arc", "cell"]).withColumn("rank", rank)
    part = F.broadcast(parts.withColumnRenamed("arc", "of"))
    met = (F.col("arc") == F.col("of")) & (F.col("lo") < F.col("rank") + F.col("copies")) & (F.col("hi") > F.col("rank"))
    last = F.least("hi", F.col("rank") + F.col("copies")) - 1
    placed = ranked.join(part, met).withColumn("at", F.explode(F.sequence(F.greatest("lo", "rank"), last)))
    return placed.select(
        F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"),
        (F.col("slot") + F.col("at") - F.col("lo")).alias("slot"), F.col("home").cast("int").alias("home"))


#: The same in SQL, for ``documents`` and the default parameters.  Fixed values in it: the
#: reversed polynomial 3988292384 and the mask 4294967295 of CRC-32.
SQL = """
        WITH RECURSIVE
        bits AS (
            SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
            UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
        tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
        body AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        keyed AS MATERIALIZED (
            SELECT doc_id, length(h) // 2 + 16 AS size,
                   xor(4294967295::BIGINT, list_reduce(list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS crc
            FROM body, tab),
        copies AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size, crc) - 1 AS copy FROM keyed),
        -- A chunk of copies is hashed as one; they follow each other in its place.
        turned AS (
            SELECT doc_id, size, crc, copy // 65536 AS chunk, copy,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % 32768 AS place,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '#' || size || '#' || crc || '#' || (copy // 65536)), 9, 8))::BIGINT AS turn
            FROM copies),
        node AS (SELECT i % 40 AS shard, i // 40 AS vnode, ('0x' || substr(md5((i % 40) || '#' || (i // 40)), 1, 8))::BIGINT % 32768 AS place FROM range(2560) t(i)),
        arcs AS (SELECT *, row_number() OVER (ORDER BY place, shard, vnode) - 1 AS arc FROM node),
        located AS (
            SELECT d.*, coalesce(a.arc, (SELECT min(arc) FROM arcs)) AS arc
            FROM turned d ASOF LEFT JOIN (SELECT place, min(arc) AS arc FROM arcs GROUP BY place) a ON a.place >= d.place),
        counted AS (SELECT arc, count(*) AS n FROM located GROUP BY arc),
        loads AS MATERIALIZED (
            SELECT arc, shard, n, cap, least(cap, before) AS base, least(n, cap - least(cap, before)) AS kept FROM (
                SELECT arc, shard, coalesce(n, 0) AS n, (SELECT count(*) FROM keyed) // 40 + (shard < (SELECT count(*) FROM keyed) % 40)::INT AS cap,
                       coalesce(sum(n) OVER (PARTITION BY shard ORDER BY arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                FROM arcs LEFT JOIN counted USING (arc))),
        over AS MATERIALIZED (SELECT *, n - kept AS over, sum(n - kept) OVER (ORDER BY arc) - (n - kept) AS over_base FROM loads),
        lap AS MATERIALIZED (
            SELECT list(shard ORDER BY arc) || list(shard ORDER BY arc) AS shards, list(cap ORDER BY arc) || list(cap ORDER BY arc) AS caps,
                   list(over ORDER BY arc) || list(0 ORDER BY arc) AS overs FROM over),
        room AS (SELECT list(free ORDER BY shard) AS free FROM (SELECT shard, any_value(cap) - sum(kept) AS free FROM over GROUP BY shard)),
        walk AS (
            SELECT 0 AS i, free, 0::HUGEINT AS carry, 0::HUGEINT AS done, 0::HUGEINT AS take, 0::BIGINT AS shard, 0::HUGEINT AS slot FROM room
            UNION ALL
            SELECT i + 1, list_transform(free, lambda f, s: f - CASE WHEN s = sh + 1 THEN got ELSE 0 END), carry + own - got, done + got, got, sh, cap - free[sh + 1]
            FROM (SELECT w.i, w.free, w.carry, w.done, shards[w.i + 1] AS sh, caps[w.i + 1] AS cap, overs[w.i + 1] AS own,
                         least(w.free[shards[w.i + 1] + 1], w.carry + overs[w.i + 1]) AS got FROM walk w, lap WHERE w.i < len(shards))),
        taken AS (SELECT done - take AS start, shard, slot FROM walk WHERE take > 0),
        ranked AS (
            SELECT l.*, row_number() OVER (PARTITION BY l.arc ORDER BY turn % greatest(1, ceil(n / 65536.0)::BIGINT), turn, doc_id, size, crc, copy) - 1 AS rank
            FROM located l JOIN counted USING (arc)),
        queued AS (SELECT r.*, o.shard AS home, o.base, o.kept, o.over_base + r.rank - o.kept AS q FROM ranked r JOIN over o USING (arc))
        SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, home::INT AS shard, (base + rank)::BIGINT AS slot, NULL::INT AS grown_shard, home::INT AS home
        FROM queued WHERE rank < kept
        UNION ALL
        SELECT doc_id, size, crc, 'rows', t.shard::INT, (t.slot + q - t.start)::BIGINT, NULL, home::INT
        FROM queued ASOF JOIN taken t ON t.start <= q WHERE rank >= kept"""
