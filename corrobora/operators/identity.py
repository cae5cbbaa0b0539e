"""Near-duplicate operators for short names and perceptual hashes, by blocking rather than all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.operators.layout import dealt
from corrobora.sources.shared import written


def near_names(df: DataFrame, key: str, name: str, most: int = 2, shortest: int = 1, lenient: int = 1) -> DataFrame:
    """Pairs (a, b, distance) of distinct names within ``most`` edits, a before b.

    Names shorter than ``shortest`` take no part; more than one edit is allowed only where both
    have ``lenient`` letters or more.

    Names are cut into most + 1 pieces; within ``most`` edits at least one piece is kept whole
    and moves by at most ``most`` places, so pairs meet on (piece, text) and are verified.
    Equal names are one class: the smallest key stands for it.
    """
    names = df.where(F.length(name) >= shortest).groupBy(F.col(name).alias("name")).agg(F.min(key).alias("key"))
    parts = most + 1
    size = F.length("name")
    cut = lambda n, i: (F.floor(n * i / parts)).cast("int")
    own = F.array(*[
        F.struct(F.lit(i).alias("i"), size.alias("n"), F.substring("name", cut(size, i) + 1, cut(size, i + 1) - cut(size, i)).alias("p"))
        for i in range(parts)
    ])
    filed = names.select("key", "name", F.explode(own).alias("e")).select("key", "name", "e.*")

    def probe(i: int, dn: int) -> Column:
        start, end = cut(size + dn, i), cut(size + dn, i + 1)
        piece = lambda s: F.when(start + s >= 0, F.substring("name", start + 1 + s, end - start))
        shifts = F.sequence(F.lit(-most), F.lit(most))
        return F.transform(shifts, lambda s: F.struct(F.lit(i).alias("i"), (size + dn).alias("n"), piece(s).alias("p")))

    probes = F.flatten(F.array(*[probe(i, dn) for i in range(parts) for dn in range(-most, most + 1)]))
    asked = names.select(F.col("key").alias("k2"), F.col("name").alias("n2"), F.explode(F.array_distinct(probes)).alias("q"))
    asked = asked.select("k2", "n2", F.col("q.i").alias("i"), F.col("q.n").alias("n"), F.col("q.p").alias("p"))
    met = filed.join(asked, ["i", "n", "p"]).where(F.col("name") < F.col("n2"))
    near = met.withColumn("distance", F.levenshtein("name", "n2", most)).where(F.col("distance") > 0)
    short = F.least(F.length("name"), F.length("n2")) < lenient
    near = near.where((F.col("distance") == 1) | ~short)
    return near.select(F.col("name").alias("a"), F.col("n2").alias("b"), "distance").distinct()


def gradient_hash(vector: Column) -> Column:
    """A hash whose bit i tells whether component i + 1 exceeds component i, for up to 64 components."""
    steps = F.greatest(F.least(F.size(vector) - 1, F.lit(63)), F.lit(0))
    pairs = F.zip_with(F.slice(vector, F.lit(2), steps), F.slice(vector, F.lit(1), steps), lambda b, a: F.when(b > a, 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda h, x: h * 2 + x)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex strings; null (never near) if their lengths differ or one is empty."""
    value = lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1
    places = F.sequence(F.lit(1), F.length(a))
    one = lambda i: F.bit_count(value(F.substring(F.lower(a), i, F.lit(1))).bitwiseXOR(value(F.substring(F.lower(b), i, F.lit(1)))))
    total = F.aggregate(places, F.lit(0), lambda n, i: n + one(i))
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), total)


def near_hashes(df: DataFrame, hash_: str, bits: int = 63, most: int = 8, bands: int | None = None) -> DataFrame:
    """Pairs (a, b, distance) of distinct hashes within ``most`` bits, a before b.

    The bits are cut into few wide ``bands``; near hashes differ by ``most // bands`` bits at most
    in one of them, two by default. Each side is filed under its band and the bands a bit away,
    so such pairs meet half way, once a band. Equal hashes are one class.
    """
    bands = bands or -(-(most + 1) // 3)
    radius = most // bands
    if radius > 2:
        raise ValueError(f"{bands} bands are too few for {most} bits")
    size = -(-bits // bands)
    # Hashes are small but filed many times: dealt by number, or few tasks would file them all and one side, taken for as small, be broadcast.
    distinct = dealt(df.select(F.col(hash_).alias("h")).where("h IS NOT NULL"), "h").distinct()

    def filed(flipped: bool) -> DataFrame:
        def turned(i: int) -> Column:
            piece = F.shiftright("h", i * size).bitwiseAND(F.lit((1 << size) - 1))
            flips = F.array(*[F.lit(f).cast("long") for f in [0] + [1 << j for j in range(size)][: size * flipped]])
            return F.transform(flips, lambda f: F.struct(F.lit(i).alias("band"), piece.bitwiseXOR(f).alias("value"), f.alias("flip")))

        return dealt(distinct.select("h", F.inline(F.flatten(F.array(*map(turned, range(bands)))))), "band", "value")

    x, y = filed(radius > 1).alias("x"), filed(radius > 0).alias("y")
    # Of the places where two bands meet, one has the smaller flip on the left, or none at all.
    once = (F.col("x.flip") < F.col("y.flip")) | (F.col("y.flip") == 0) & (F.col("x.flip") == 0)
    distance = hamming(F.col("x.h"), F.col("y.h"))
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.value") == F.col("y.value")) & once & (F.col("x.h") < F.col("y.h")) & (distance <= most))
    return met.select(F.col("x.h").alias("a"), F.col("y.h").alias("b"), distance.alias("distance")).distinct()


def suspected_duplicates(reasons: dict[str, DataFrame], strong: str) -> DataFrame:
    """Pairs (a, b, reasons) met for two reasons or for the strong one; each frame has a < b."""
    tagged = [df.select("a", "b", F.lit(n).alias("why")) for n, df in reasons.items()]
    every = tagged[0]
    for more in tagged[1:]:
        every = every.unionByName(more)
    found = every.groupBy("a", "b").agg(F.array_sort(F.collect_set("why")).alias("reasons"))
    return found.where((F.size("reasons") >= 2) | F.array_contains("reasons", strong))


def greedy_groups(pairs: DataFrame) -> DataFrame:
    """(node, seed): near-duplicate groups as a walk in order makes them, from ``pairs`` (a, b) with a before b.

    Nodes are taken in their order; one that no group has yet is a seed and takes all its
    neighbours that no group has. Seeds are the first independent set in that order: a node is
    a seed when none before it can be any more. Each round settles all nodes without an open
    neighbour before them, and drops those and their neighbours; its open pairs are written
    out. Groups differ from connected components: two members need not be near each other.
    Seeds without members and nodes in no pair do not come; a seed comes with itself as seed.
    """
    links = pairs.where("a < b").select("a", "b").distinct()
    links = written(links)
    open_, taken = links, None
    while not open_.isEmpty():
        first = open_.select(F.col("a").alias("node")).distinct().join(open_.select(F.col("b").alias("node")).distinct(), "node", "left_anti")
        now = open_.join(first.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        gone = written(first.withColumn("seed", F.lit(True)).unionByName(now.withColumn("seed", F.lit(False))))
        lost = gone.where("NOT seed").select("node")
        taken = lost if taken is None else taken.unionByName(lost)
        for end in ("a", "b"):
            open_ = open_.join(gone.select(F.col("node").alias(end)), end, "left_anti")
        open_ = written(open_.select("a", "b"))
    if taken is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("seed"))
    free = links.join(taken.withColumnRenamed("node", "a"), "a", "left_anti")
    members = free.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("seed"))
    return members.unionByName(members.select(F.col("seed").alias("node"), "seed").distinct())


def prefix_pairs(texts: DataFrame, prefixes: DataFrame, text: str, prefix: str, longest: int = 1 << 20) -> DataFrame:
    """``texts`` joined with the ``prefixes`` that they begin with (column names must differ; empty prefixes match nothing).

    A prefix is filed by the hash of its longest beginning of 1, 2, 4, ... characters, a text
    asks with each of its own such beginnings that prefixes are filed by. It brings no more of
    itself than a prefix filed there can have, so that what meets can be compared whole.
    Prefixes over ``longest`` characters are filed by that many.
    """
    powers = [1 << i for i in range(longest.bit_length())]
    at = lambda c, n: F.struct(F.lit(n).alias("n"), F.xxhash64(F.substring(c, 1, n)).alias("h"))
    filing = F.lit(None)
    for n in powers:
        filing = F.when(F.length(prefix) >= n, at(prefix, n)).otherwise(filing)
    filed = prefixes.where(F.length(prefix) > 0).withColumn("__at", filing)
    used = filed.select(F.col("__at.n").alias("__n")).distinct()  # a row for each power at most
    asks = F.explode(F.filter(F.array(*map(F.lit, powers)), lambda n: n <= F.length(text))).alias("__n")
    asked = texts.select("*", asks).join(F.broadcast(used), "__n", "left_semi")
    head = F.when(F.col("__n") == powers[-1], F.col(text)).otherwise(F.substring(F.col(text), F.lit(1), F.col("__n") * 2 - 1))
    begun = F.struct(F.col("__n").alias("n"), F.xxhash64(F.substring(F.col(text), F.lit(1), F.col("__n"))).alias("h"))
    asked = asked.withColumns({"__at": begun, "__head": head}).drop("__n")
    return asked.join(filed, "__at").where(F.startswith("__head", prefix)).drop("__at", "__head")
