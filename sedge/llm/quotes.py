"""Chat formatting by quotation linking.

Lines that start with `>` are quotes, one level for each mark; lines of one level in a row
are a passage. The normalised words of a passage are hashed in windows, so that line breaks
do not matter, and joined to the latest earlier message of the conversation that holds the window
in its own words; a message that holds half of a passage's windows or more is a source of it. The
source of most windows of a message's outermost quotes is the one it replies to. Conversations are
then put in the order of replies, and quotes and the lines that introduce them are left out.

Defined results: a null text counts as empty; a passage of fewer words than a window matches whole
own lines; blank passages match nothing; of sources with equally many windows the latest counts; a message
whose quotes match no earlier one, or that has none, starts a thread; rows with a null conversation or
turn start threads of their own; of rows that repeat conversation and turn each is kept; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.common import partitions, written

_QUOTE = r"^((?:[ \t]*>)+)(.*)$"
_INTRODUCES = r"(wrote|writes|said|schrieb|a écrit|escribió)\s*:$"
#: Words of a window.
WORDS = 4
#: A formatted turn, and the turns that a row of a formatted conversation holds at most; longer ones go on in the next row.
TURN = ("<|", "|>\n", "\n<|end|>\n")
TURNS = 256


def _line(x):
    """Level and normalised words of a line."""
    marks = F.regexp_extract(x, _QUOTE, 1)
    rest = F.when(marks != "", F.regexp_extract(x, _QUOTE, 2)).otherwise(x)
    level = F.length(F.regexp_replace(marks, "[^>]", ""))
    return F.struct(level.alias("level"), F.trim(F.regexp_replace(F.lower(rest), r"[^\p{L}\p{N}]+", " ")).alias("words"), x.alias("raw"))


def _windows(words, size: int):
    """Hashes of all windows of a text's words; a shorter text has one of its own kind."""

    def of(split):
        n = F.size(split)
        windows = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(split, i, F.lit(size)), " ")))
        return F.when(n < size, F.array(F.xxhash64(F.concat(F.lit("= "), F.array_join(split, " "))))).otherwise(windows)

    # The words are bound once: an expression in a lambda is computed anew for each element.
    return F.transform(F.array(F.split(words, " ")), of)[0]


def quote_links(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quoted, reply_to, root, depth."""
    rows = messages.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"),
        F.transform(F.split(F.coalesce(text_col, F.lit("")), r"\r\n|\r|\n"), _line).alias("lines"),
    )
    n = F.size("lines")
    level = lambda i: F.element_at("lines", i.cast("int"))["level"]
    after = lambda i: F.when(i + 1 < n, level(i + 2)).otherwise(F.lit(0))
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~((after(i) > 0) & F.rtrim(x["raw"]).rlike(_INTRODUCES)))
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (level(i) != level(F.greatest(i - 1, F.lit(1)))))
    joined = lambda part: F.array_join(F.filter(F.transform(part, lambda x: x["words"]), lambda w: w != ""), " ")
    parsed = rows.withColumn("own", own).withColumn("starts", starts)
    end = lambda k: F.when(k + 1 < F.size("starts"), F.element_at("starts", (k + 2).cast("int"))).otherwise(n + 1)
    passages = F.transform("starts", lambda s, k: F.struct(k.alias("passage"), level(s).alias("level"), joined(F.slice("lines", s, end(k) - s)).alias("words")))
    clean = F.regexp_replace(F.array_join(F.transform("own", lambda x: x["raw"]), "\n"), r"^\n+|\n+$", "")
    parsed = parsed.select(
        "conv_id", "turn", "role", clean.alias("text"),
        F.size(F.filter("lines", lambda x: (x["level"] > 0) & (x["words"] != ""))).cast("long").alias("n_quoted"),
        F.filter(passages, lambda p: (p["level"] > 0) & (p["words"] != "")).alias("passages"),
        F.transform(F.filter("own", lambda x: x["words"] != ""), lambda x: x["words"]).alias("own"),
    )
    base = written(parsed, "quotes-parsed")
    keyed = base.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoted = keyed.where(F.size("passages") > 0).select("conv_id", "turn", F.explode("passages").alias("p"))
    quoted = quoted.select("conv_id", "turn", "p.passage", "p.level", F.explode(_windows(F.col("p.words"), size)).alias("hash"))
    quoted = written(quoted.distinct(), "quotes-windows")
    # Only what somebody quotes is looked up. Both sides of a join may grow: none is broadcast, at any size.
    wanted = quoted.select("conv_id", "hash").distinct()
    short = F.filter("own", lambda w: F.size(F.split(w, " ")) < size)
    owned = keyed.where(F.size("own") > 0).withColumn("all", F.array_join("own", " "))
    owned = owned.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(F.flatten(F.transform(short, lambda w: _windows(w, size))), _windows(F.col("all"), size)))).alias("hash"))
    owned = owned.join(wanted.hint("merge"), ["conv_id", "hash"], "left_semi").distinct()
    both = quoted.select("conv_id", "hash", "turn", "level", "passage", F.lit(None).cast("long").alias("source")).union(
        owned.select("conv_id", "hash", "turn", F.lit(0), F.lit(0), F.col("turn").alias("source"))
    )
    # The latest earlier holder of each window: one pass over the sorted rows, never pairs of them.
    earlier = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("source", F.last("source", True).over(earlier)).where("level > 0")
    counts = found.groupBy("conv_id", "turn", "level", "passage", "source").count()
    whole = Window.partitionBy("conv_id", "turn", "level", "passage")  # a row for each source of a passage
    sources = counts.withColumn("windows", F.sum("count").over(whole)).where("source IS NOT NULL AND 2 * count >= windows")
    votes = sources.groupBy("conv_id", "turn", "level", "source").agg(F.sum("count").alias("count"))
    links = written(votes.groupBy("conv_id", "turn").agg(F.max_by("source", F.struct(-F.col("level"), F.col("count"), F.col("source"))).alias("up")), "quotes-links")
    # Pointer doubling over the links: after k rounds a message knows its ancestor 2^k levels up.
    state = links.select("conv_id", "turn", F.col("up").alias("reply_to"), F.col("up").alias("root"), F.lit(1).cast("long").alias("depth"))
    for step in range(64):
        jump = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        if state.join(jump.hint("merge"), ["conv_id", "root"], "left_semi").isEmpty():
            break
        told = state.join(jump.hint("merge"), ["conv_id", "root"], "left")
        told = told.select("conv_id", "turn", "reply_to", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        state = written(told, f"quotes-threads{step}")
    out = base.join(state.hint("merge"), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "text", "n_quoted", "reply_to", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"))


def in_order(links: DataFrame) -> DataFrame:
    """links with seq, the place of a message in its thread: by depth, so that a message follows the one it replies to,
    then by turn. Threads of any length are numbered over the partitions of one sort, not within a task."""
    spark = links.sparkSession
    order = ["conv_id", "root", "depth", "turn", "role", "text"]
    alone = links.where("conv_id IS NULL OR turn IS NULL").withColumn("seq", F.lit(0).cast("long"))
    rows = links.where("conv_id IS NOT NULL AND turn IS NOT NULL").repartitionByRange(partitions(spark, links), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    rows = written(rows.withColumn("part", F.shiftright(place, 33)).withColumn("at", place.bitwiseAND((1 << 33) - 1)), "quotes-order")
    ahead = Window.partitionBy("conv_id", "root").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of a thread
    firsts = rows.groupBy("conv_id", "root", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    firsts = written(firsts.select("conv_id", "root", "part", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")), "quotes-firsts")
    placed = rows.join(firsts.hint("merge"), ["conv_id", "root", "part"]).withColumn("seq", F.col("at") - F.col("first") + F.col("before"))
    return placed.select(*links.columns, "seq").unionByName(alone)


def conversations(messages: DataFrame, turns: int = TURNS, **columns) -> DataFrame:
    """conv_id, root, part, n_turns, chat: threads as formatted text in the order of replies, `turns` messages to a row."""
    rows = in_order(quote_links(messages, **columns))
    turn = F.concat(F.lit(TURN[0]), F.coalesce("role", F.lit("")), F.lit(TURN[1]), F.col("text"), F.lit(TURN[2]))
    parts = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("part", F.floor(F.col("seq") / turns))
    parts = parts.groupBy("conv_id", "root", "part").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("seq", turn.alias("turn")))).alias("held"))
    whole = parts.select("conv_id", "root", "part", "n_turns", F.array_join(F.transform("held", lambda h: h["turn"]), "").alias("chat"))
    alone = rows.where("conv_id IS NULL OR turn IS NULL")
    return whole.unionByName(alone.select("conv_id", "root", F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("n_turns"), turn.alias("chat")))


def with_quoting_replies(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) and for each with a conversation and turn a reply, a million turns later, that quotes it
    with line breaks of its own, after every seventh word. The given conversations hold no quotes; these are the query's."""
    told = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    quoted = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " "), r"((?:[^ ]+ ){6}[^ ]+) ", "$1\n> ")
    replies = told.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", (F.col("turn") + 1_000_000).alias("turn"), F.lit("reader").alias("role"),
        F.concat(F.lit("On that, the "), F.coalesce("role", F.lit("other")), F.lit(" wrote:\n> "), quoted, F.lit("\n\nNoted as point "), F.col("turn").cast("string"), F.lit(".")).alias("text"),
    )
    return told.unionByName(replies)
