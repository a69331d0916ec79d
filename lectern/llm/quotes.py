"""Chat formatting by quotation linking.

Nested quote levels are parsed from ``>`` marks.  A quoted passage is a run of lines of one level, joined and
normalised to words, so it doesn't matter where its lines were broken; a line that announces a deeper quote right
after it isn't part of it, and a line of dots alone parts it.  Passages are hashed and joined to the runs of as many
words of the messages' own texts, so a passage may be any part of a message.  Its author is the latest earlier message
that holds it whole; if none does, the latest that holds its longest line that any holds.  Messages come back without
quotes, in reply order.  Built from DataFrame functions only.

Only messages with a quote mark are parsed.  Each quoted hash meets its author as of its turn (`latest_authors`), so
the join is many-to-one and common lines don't multiply.  Own texts are hashed only in conversations that quote, at the
lengths quoted there.  No conversation is gathered: reply order is given by (conv_id, root_turn, depth, turn), in which
a message follows the one that it answers.

Defined results: null texts are empty; a null conv_id or turn links to nothing; a quote whose author isn't earlier in
the conversation is no link; of several quotes the latest author counts; repeated rows each give a row; an empty table
gives an empty table; other columns are not read.  Own lines stay as they are, but for line breaks; a line that
announces a quote goes only where a quote follows.  In ``formatted``, ``<|`` of a role or text gets a backslash within,
so that it can't be taken for a mark; taking one backslash out of each ``<\\…|`` gives the text again.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, skew_lookup

#: Turns of one bucket of `latest_authors`.
TURNS = 1024

_MARKS = r"^[ \t]*((?:>[ \t]?)*)"
_QUOTES = r"(?m)^[ \t]*>"
_ELISION = r"^[\[(]?[ .…]*(?:\.{3}|…)[ .…]*[\])]?$"
_ATTRIBUTION = r"^(?:On .* wrote|.* (?:wrote|said|schrieb|escribió|a écrit)) ?:$"


def parsed(messages: DataFrame, text: str) -> DataFrame:
    """Adds ``__lines``, array<struct<level:int,line:string,raw:string,announces:boolean>> of the lines of a text."""
    lines = messages.withColumn("__parsed", F.transform(F.split(F.col(text), "\n"), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), r"[ \t]", "")).alias("level"), F.trim(F.regexp_replace(x, _MARKS, "")).alias("line"), x.alias("raw"))))

    def announces(x, i):
        after, second = (F.get(F.col("__parsed"), i + k) for k in (1, 2))
        deeper = (after["level"] > x["level"]) | (after["line"] == "") & (after["level"] <= x["level"]) & (second["level"] > x["level"])
        return x["line"].rlike(_ATTRIBUTION) & F.coalesce(deeper, F.lit(False))

    return lines.withColumn("__lines", F.transform("__parsed", lambda x, i: F.struct(x["level"].alias("level"), x["line"].alias("line"), x["raw"].alias("raw"), announces(x, i).alias("announces")))).drop("__parsed")


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "), " +", " "))


def trimmed(text: Column) -> Column:
    """Without white space and empty lines around; the first line keeps its indentation."""
    return F.regexp_replace(text, r"^(?:[ \t]*\n)+|\s+$", "")


def own_text(lines: Column) -> Column:
    """The unquoted lines, without a line that announces a quote."""
    own = F.filter(lines, lambda x: (x["level"] == 0) & ~x["announces"])
    return trimmed(F.array_join(F.transform(own, lambda x: x["raw"]), "\n"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(normalised(text), " "), lambda w: w != "")


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, run, lines) of the quoted runs of lines of one level of `parsed` messages; lines of dots part them."""
    parted = F.transform(F.filter("__lines", lambda x: ~x["announces"]), lambda x: F.struct(F.when(x["line"].rlike(_ELISION), 0).otherwise(x["level"]).alias("level"), x["line"].alias("line")))
    rows = messages.select("conv_id", "turn", parted.alias("__m"))
    numbers = F.transform("__m", lambda x, i: F.when((i == 0) | (F.get("__m", i - 1)["level"] != x["level"]), i))
    rows = rows.withColumn("__s", F.filter(numbers, lambda i: i.isNotNull()))
    runs = F.transform("__s", lambda i, k: F.slice("__m", i + 1, F.coalesce(F.get("__s", k + 1), F.size("__m")) - i))
    quoted = F.transform(F.filter(runs, lambda r: F.get(r, F.lit(0))["level"] > 0), lambda r: F.transform(r, lambda x: x["line"]))
    return rows.select("conv_id", "turn", F.explode(quoted).alias("lines")).withColumn("run", F.xxhash64("lines"))


def latest_authors(quoted: DataFrame, authors: DataFrame) -> DataFrame:
    """Adds to (conv_id, turn, hash) rows the latest turn of ``authors`` (conv_id, turn, hash) before theirs, or null.

    Turns go in buckets, so that a hash that everyone writes isn't sorted in one task; what earlier buckets hold is
    carried over by a window over one row a bucket.
    """
    bucket = F.floor(F.col("turn") / TURNS).alias("__b")
    # At equal turns the quote comes first: an author is strictly earlier.
    events = quoted.select("conv_id", "turn", "hash", bucket, F.lit(0).alias("__own")).union(authors.select("conv_id", "turn", "hash", bucket, F.lit(1))).distinct()
    wrote = F.when(F.col("__own") == 1, F.col("turn"))
    within = Window.partitionBy("conv_id", "hash", "__b").orderBy("turn", "__own").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("conv_id", "hash").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    found = events.withColumn("author", F.max(wrote).over(within)).filter("__own = 0")
    carried = events.groupBy("conv_id", "hash", "__b").agg(F.max(wrote).alias("__last")).withColumn("__last", F.max("__last").over(over))
    return found.join(carried, ["conv_id", "hash", "__b"]).select("conv_id", "turn", "hash", F.coalesce("author", "__last").alias("author"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def parents_of(known: DataFrame, runs: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn) of the messages whose quotes have an author; ``known`` holds (conv_id, turn, own)."""
    whole = runs.select("conv_id", "turn", "run", F.lit(True).alias("whole"), words_of(F.array_join("lines", " ")).alias("__w"))
    alone = runs.select("conv_id", "turn", "run", F.explode("lines").alias("__l")).select("conv_id", "turn", "run", F.lit(False), words_of(F.col("__l")))
    quoted = cut(whole.union(alone).select("conv_id", "turn", "run", "whole", F.size("__w").alias("n_words"), F.xxhash64(F.array_join("__w", " ")).alias("hash")).filter("n_words > 0").distinct())
    # The lengths that a conversation quotes; a hot conversation's messages stay dealt out.
    lengths = quoted.groupBy("conv_id").agg(F.collect_set("n_words").alias("__lengths"))
    sizes = known.groupBy("conv_id").agg(F.count("*").alias("__n"))
    own = skew_lookup(known, lengths.join(sizes, "conv_id"), ["conv_id"], known.count(), "__n", F.monotonically_increasing_id()).filter("__lengths is not null")
    own = own.select("conv_id", "turn", words_of(F.col("own")).alias("__w"), "__lengths")
    own = own.select("conv_id", "turn", "__w", F.explode("__lengths").alias("__n")).filter("size(__w) >= __n")
    places = F.sequence(F.lit(1), F.size("__w") - F.col("__n") + 1)
    hashes = F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice("__w", i, F.col("__n")), " "))))
    authors = own.select("conv_id", "turn", F.explode(hashes).alias("hash")).join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    met = quoted.join(latest_authors(quoted.select("conv_id", "turn", "hash").distinct(), authors), ["conv_id", "turn", "hash"]).filter("author is not null")
    best = met.groupBy("conv_id", "turn", "run").agg(F.max(F.struct("whole", "n_words", "author"))["author"].alias("author"))
    return best.groupBy("conv_id", "turn").agg(F.max("author").alias("parent_turn"))


def link_quotes(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, quote_levels, parent_turn, root_turn, depth, formatted) of every row."""
    said = conversations.select("conv_id", "turn", "role", F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n").alias("__t")).withColumn("__q", F.col("__t").rlike(_QUOTES))
    plain, marked = said.filter("not __q"), parsed(said.filter("__q"), "__t")
    rows = plain.select("conv_id", "turn", "role", trimmed(F.col("__t")).alias("own"), F.lit(0).alias("quote_levels")).union(
        marked.select("conv_id", "turn", "role", own_text(F.col("__lines")), F.array_max(F.transform("__lines", lambda x: x["level"]))))
    addressed = "conv_id is not null and turn is not null"
    runs = cut(passages(marked.filter(addressed)))
    turn_type = conversations.schema["turn"].dataType
    none = [F.lit(None).cast(turn_type).alias("parent_turn"), F.lit(None).cast(turn_type).alias("root_turn"), F.lit(None).cast("int").alias("depth")]
    if runs.limit(1).count():
        tree = cut(roots(cut(parents_of(rows.filter(addressed).select("conv_id", "turn", "own"), runs))))
        # Only messages that quote can answer one; of a repeated turn, each row gets the same parent.
        times = said.filter("__q").groupBy("conv_id", "turn").agg(F.count("*").alias("__n"))
        asking = rows.filter("quote_levels > 0")
        linked = skew_lookup(asking, tree.join(times, ["conv_id", "turn"]), ["conv_id", "turn"], asking.count(), "__n", F.monotonically_increasing_id())
        out = rows.filter("quote_levels = 0").select("*", *none).union(linked.select(*rows.columns, "parent_turn", "root_turn", "depth"))
    else:
        out = rows.select("*", *none)
    out = out.withColumn("root_turn", F.coalesce("root_turn", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)).cast("int"))
    shown = F.concat(F.lit("<|"), escaped(F.coalesce("role", F.lit("user"))), F.lit("|>\n"), escaped(F.col("own")), F.lit("\n<|end|>\n"))
    return out.select("conv_id", "turn", "role", F.col("own").alias("text"), "quote_levels", "parent_turn", "root_turn", "depth", shown.alias("formatted"))


def roots(parents: DataFrame) -> DataFrame:
    """Adds root_turn and depth to (conv_id, turn, parent_turn) by pointer doubling; parents are always earlier."""
    at = parents.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth"))
    while True:
        up = at.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("__up"), F.col("depth").alias("__more"))
        # How many rows point at each message, for the lookup.
        pointed = at.groupBy("conv_id", "root_turn").agg(F.count("*").alias("n"))
        total = at.count()
        if not total:
            return at
        step = skew_lookup(at, up.join(pointed, ["conv_id", "root_turn"]), ["conv_id", "root_turn"], total, "n", F.xxhash64("turn"))
        moved = step.filter("__up is not null").limit(1).count()
        if not moved:
            return at
        at = cut(step.select("conv_id", "turn", "parent_turn", F.coalesce("__up", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("__more", F.lit(0))).alias("depth")))
