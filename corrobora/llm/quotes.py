r"""Reply-ordered conversations from quoting messages, in SQL functions only.

A line's quote level is the number of '>' marks in front of it. Within a message, runs of
lines of one level are passages. A passage and its lines, normalised (lower case, runs of
anything but letters and digits, line breaks too, as one space), are hashed and joined to the
hashed lines, paragraphs and whole texts of earlier messages of the same conversation, so
that a passage wrapped anew still finds its paragraph. The shallowest level that finds
anything decides which message is replied to: the one that gave most of the quoted letters
(ties: the latest). What is left of each message are its own lines, without quotes and
without the line that introduces one ("... wrote:").

A conversation is ordered by thread: messages follow the one they reply to, threads come in
the order of their first messages, by turn within. Threads are found by doubling the links,
in rounds that grow with the logarithm of the longest chain. No group of rows is collected.
A line's last earlier bearer is found by a window over the (conversation, line, block of
turns), and over block summaries beyond that; positions are counted the same way, so that a
very long conversation, or thread, is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.llm.common import durable

#: Turns per block of a conversation.
BLOCK = 256
MARKS = r"^(?:[ \t]*>)+"
#: How mail programs introduce a quote in English, German, French and Spanish.
INTRODUCTION = r"(?i)^[^\n]{0,200}\b(?:wrote|schrieb|a écrit|escribió)[^\n]{0,100}:\s*$"


def quote_lines(text: Column) -> Column:
    """array<struct<level, body>>: the lines of a text with their quote levels."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1),
        lambda x: F.struct(
            F.regexp_count(F.regexp_extract(x, MARKS, 0), F.lit(">")).alias("level"),
            F.regexp_replace(x, MARKS + " ?", "").alias("body"),
        ),
    )


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _message_parts(messages: DataFrame) -> DataFrame:
    """Messages with their own text and their quoted passages (level, text)."""
    lines = messages.withColumn("lines", quote_lines(F.col("text")))
    n = F.size("lines")
    level = lambda i: F.element_at("lines", i)["level"]
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (level(i) != level(F.greatest(i - 1, F.lit(1)))))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), F.array(n + 1))
    own = F.filter(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), F.element_at("lines", i).alias("l"))),
        lambda x: (x["l"]["level"] == 0)
        & ~((x["i"] < n) & (level(F.least(x["i"] + 1, n)) > 0) & x["l"]["body"].rlike(INTRODUCTION)),
    )
    passages = F.filter(
        F.zip_with(
            "starts",
            ends,
            lambda i, j: F.struct(
                level(i).alias("level"),
                F.array_join(F.transform(F.slice("lines", i, j - i), lambda x: x["body"]), "\n").alias("text"),
            ),
        ),
        lambda p: p["level"] > 0,
    )
    return (
        lines.withColumn("starts", starts)
        .withColumn("own", F.trim(F.array_join(F.transform(own, lambda x: x["l"]["body"]), "\n")))
        .withColumn("passages", passages)
        .drop("lines", "starts")
    )


def _hashed_units(text: Column) -> Column:
    """array<struct<hash, letters>>: a text's lines, paragraphs and itself, normalised, without repeats."""
    parts = F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t]*\n"), F.array(text))
    units = F.array_distinct(F.filter(F.transform(parts, normalised), lambda x: x != ""))
    return F.transform(units, lambda x: F.struct(F.xxhash64(x).alias("hash"), F.length(x).alias("letters")))


def _last_bearers(asked: DataFrame, borne: DataFrame) -> DataFrame:
    """``asked`` (conv_id, hash, turn, ...) with ``source``: the last earlier turn of ``borne`` (conv_id, hash, turn) there."""
    names = [c for c in asked.columns if c not in ("conv_id", "hash", "turn")]
    both = asked.withColumn("borne", F.lit(None).cast("long")).unionByName(
        borne.withColumn("borne", F.col("turn")), allowMissingColumns=True
    )
    both = both.withColumn("block", F.floor(F.col("turn") / BLOCK))
    key = ["conv_id", "hash"]
    before = Window.partitionBy(*key, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("borne").over(before)).where("borne IS NULL")
    blocks = both.groupBy(*key, "block").agg(F.max("borne").alias("last"))
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = blocks.withColumn("far", F.max("last").over(earlier)).select(*key, "block", "far")
    same = [near["conv_id"].eqNullSafe(far["conv_id"]), near["hash"] == far["hash"], near["block"] == far["block"]]
    joined = near.join(far, same, "left")
    return joined.select(
        near["conv_id"], near["hash"], near["turn"], *[near[c] for c in names], F.coalesce("near", "far").alias("source")
    )


def _threads(replies: DataFrame) -> DataFrame:
    """``replies`` (c, t, reply_to, ...) with the first turn of the thread and the number of links to it.

    Every round replaces a link by that of the message it leads to, so that it spans twice as
    many; a message replies to an earlier one, so the rounds end.
    """
    up = replies.withColumn("thread", F.col("reply_to")).withColumn("depth", F.lit(1).cast("long"))
    rest = [c for c in up.columns if c not in ("thread", "depth")]
    while True:
        a, b = up.alias("a"), up.select("c", "t", "thread", "depth").alias("b")
        same = F.col("a.c").eqNullSafe(F.col("b.c")) & (F.col("a.thread") == F.col("b.t"))
        longer = durable(
            a.join(b, same, "left").select(
                *[F.col(f"a.{c}") for c in rest],
                F.coalesce("b.thread", "a.thread").alias("thread"),
                (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth"),
                F.col("b.t").isNotNull().alias("open"),
            )
        )
        up = longer.drop("open")
        if longer.where("open").isEmpty():
            return up


def reply_order(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, position, turn, role, text, reply_to, thread, depth, n_quotes, n_linked) per message.

    text is the message without quotes; reply_to is the turn of the message that its quotes
    come from most, or null; n_quotes counts quoted passages and n_linked those with a known
    origin. thread is the turn its chain of replies leads to (its own if it replies to none)
    and depth the length of that chain. position numbers the messages of a conversation from
    1: by thread, then turn, role and text. Rows that repeat a turn are messages of their own
    and share their links. Null turns come last and link to nothing; a null conversation is
    one of its own; null texts are empty. Other columns are ignored; an empty table gives an
    empty result.
    """
    named = messages.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
    )
    parts = durable(_message_parts(named))
    quoting = parts.where((F.size("passages") > 0) & F.col("turn").isNotNull())
    asked = durable(
        quoting.select("conv_id", "turn", F.posexplode(F.array_distinct("passages")).alias("passage", "p"))
        .select("conv_id", "turn", "p.level", F.xxhash64("p").alias("passage"), F.explode(_hashed_units(F.col("p.text"))).alias("l"))
        .select("conv_id", "turn", "level", "passage", "l.hash", "l.letters")
        .distinct()
    )
    origins = parts.where(F.col("turn").isNotNull()).select(
        "conv_id", "turn", F.explode(_hashed_units(F.col("own"))).alias("l")
    )
    wanted = durable(asked.select(F.col("conv_id").alias("c"), F.col("hash").alias("h")).distinct())
    o = origins.select("conv_id", "turn", F.col("l.hash").alias("hash"))
    borne = o.join(wanted, o["conv_id"].eqNullSafe(wanted["c"]) & (o["hash"] == wanted["h"]), "left_semi").distinct()
    links = durable(_last_bearers(asked, borne).where(F.col("source").isNotNull()))
    votes = links.groupBy("conv_id", "turn", "level", "source").agg(F.sum("letters").alias("letters"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "letters", "source")).alias("best"))
    known = links.groupBy("conv_id", "turn").agg(F.countDistinct("passage").alias("n_linked"))
    replies = durable(
        best.alias("b")
        .join(known.alias("k"), F.col("b.conv_id").eqNullSafe(F.col("k.conv_id")) & (F.col("b.turn") == F.col("k.turn")))
        .select(F.col("b.conv_id").alias("c"), F.col("b.turn").alias("t"), F.col("best.source").alias("reply_to"), "n_linked")
    )
    linked = parts.join(_threads(replies), parts["conv_id"].eqNullSafe(F.col("c")) & (parts["turn"] == F.col("t")), "left")
    # Positions: messages of earlier blocks of threads, of earlier stretches within the block, and the rank in a stretch,
    # which is a thread's messages of one block of turns. The keys are never null; nulls come last.
    last = F.lit(1 << 62)
    stretch = ["kc", "kr", "kt"]
    keyed = linked.withColumn("thread", F.coalesce("thread", "turn")).withColumns(
        {
            "kc": F.coalesce(F.col("conv_id").cast("string"), F.lit("")),
            "kr": F.coalesce("thread", last),
            "kt": F.coalesce(F.floor(F.col("turn") / BLOCK), last),
        }
    )
    sizes = keyed.groupBy(*stretch).agg(F.count("*").alias("size")).withColumn("block", F.floor(F.col("kr") / BLOCK))
    sizes = durable(sizes)
    before = Window.partitionBy("kc", "block").orderBy("kr", "kt").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("kc", "block").agg(F.sum("size").alias("size"))
    so_far = Window.partitionBy("kc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("kc", "block", F.coalesce(F.sum("size").over(so_far), F.lit(0)).alias("earlier"))
    offsets = sizes.withColumn("skip", F.coalesce(F.sum("size").over(before), F.lit(0))).join(blocks, ["kc", "block"])
    offsets = durable(offsets.select(*stretch, (F.col("skip") + F.col("earlier")).alias("skip")))
    within = Window.partitionBy(*stretch).orderBy(F.asc_nulls_last("turn"), "role", "text")
    out = keyed.withColumn("rank", F.row_number().over(within)).join(offsets, stretch)
    return out.select(
        "conv_id",
        (F.col("rank") + F.col("skip")).cast("long").alias("position"),
        "turn",
        "role",
        F.col("own").alias("text"),
        "reply_to",
        "thread",
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.size("passages").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
