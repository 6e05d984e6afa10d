"""Chat formatting into budgeted windows, in DataFrame operations only.

A turn's tokens are its words plus ``TURN``; their prefix sums within a conversation, behind
the system turn, choose turn-aligned spans of new turns (no turn is ever cut). A span holds the
turns inside one stretch of the room that the system turn and ``history`` leave; a turn across
a border joins the stretch behind or before it where both fit the room, or is a span of its own.
A window is the conversation's system turn, the last turns of the span before (at most
``history`` tokens), and its span; a conversation within the budget is one window. No window
is above the budget unless a single new turn is: history and then the system turn are left
out where they do not fit. Only new assistant turns are under the loss mask, so a
repeated target is masked.

A turn reads ``<s>[role]`` newline text ``</s>`` newline. Control strings inside roles
and texts get a backslash behind their first character, backslashes are doubled. Null
text or role: empty. Rows with equal turn numbers are ordered by role and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, TURN = 2048, 512, 4


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(c, r"(<|\[)(/?s>|/?INST\]|</?SYS>>|/?SYS>>)", "$1\\\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _spans(t: DataFrame, budget: int) -> DataFrame:
    """(c2, k2, win): the span of each stretch; turns across a border join a neighbour where they fit."""
    g = t.groupBy("conv_id", "key").agg(F.sum("tok").alias("n"), F.first("room").alias("room"))
    w = Window.partitionBy("conv_id").orderBy("key")
    key, across = F.col("key"), (F.col("key") > 0) & (F.col("key") % 2 == 0)
    g = g.withColumn("fore", across & F.coalesce((F.lead("key").over(w) == key + 1) & (F.col("n") + F.lead("n").over(w) <= F.col("room")), F.lit(False)))
    g = g.withColumn("k1", F.lag("key").over(w)).withColumn("n1", F.lag("n").over(w))
    taken = F.coalesce((F.lag("key", 2).over(w) == F.col("k1") - 1) & F.lag("fore", 2).over(w), F.lit(False))
    back = across & ~taken & F.coalesce((F.col("k1") % 2 == 1) & (F.col("n") + F.col("n1") <= F.col("room")), F.lit(False))
    g = g.withColumn("win", F.when(F.col("fore"), key + 1).when(back, F.col("k1")).otherwise(key))
    # the system turn (key -1) stands with the first span if both fit
    g = g.withColumn("all", F.sum("n").over(Window.partitionBy("conv_id", "win")))
    first = F.when((key == -1) & (F.col("n") + F.lead("all").over(w) <= budget), F.lead("win").over(w))
    return g.select(F.col("conv_id").alias("c2"), key.alias("k2"), F.coalesce(first, F.col("win")).alias("win"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, win, text, n_repeated, loss array<struct<start, length>>); starts count code points from 0."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("turn"), F.col("role"), F.col("text")]
    w = Window.partitionBy("conv_id").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("tok", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + TURN)
    t = t.withColumn("pos", F.row_number().over(w)).withColumn("end", F.sum("tok").over(run))
    whole = Window.partitionBy("conv_id")
    t = t.withColumn("first_sys", (F.col("pos") == 1) & (F.col("role") == "system") & (F.col("tok") < budget))
    t = t.withColumn("sys", F.max(F.when(F.col("first_sys"), F.col("tok")).otherwise(0)).over(whole)).withColumn("total", F.max("end").over(whole))
    t = t.withColumn("room", F.greatest(F.lit(budget - history) - F.col("sys"), F.floor((F.lit(budget) - F.col("sys")) / 2), F.lit(1)))
    # stretch of a turn: 2k + 1 inside the k-th, 2k across its lower border; the system turn before all
    last = F.floor((F.col("end") - F.col("sys") - 1) / F.col("room"))
    inside = F.floor((F.col("end") - F.col("sys") - F.col("tok")) / F.col("room")) == last
    t = t.withColumn("key", F.when(F.col("total") <= budget, F.lit(0)).when(F.col("first_sys"), F.lit(-1)).otherwise(2 * last + inside.cast("int")).cast("long"))
    t = t.join(_spans(t, budget), F.expr("conv_id <=> c2 AND key = k2")).drop("c2", "k2")
    piece = F.concat(F.lit("<s>["), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("]\n"), escape(F.col("text")), F.lit("</s>\n"))
    t = t.withColumn("piece", piece).withColumn("answer", F.col("role") == "assistant")
    span = Window.partitionBy("conv_id", "win")
    t = t.withColumn("span_end", F.max("end").over(span))
    spans = t.groupBy("conv_id", "win").agg(F.sum("tok").alias("fresh"), F.first("sys").alias("sys"))
    spans = spans.withColumn("with_sys", F.col("fresh") + F.col("sys") <= budget)
    spans = spans.withColumn("left", F.least(F.lit(history), F.lit(budget) - F.col("fresh") - F.when(F.col("with_sys"), F.col("sys")).otherwise(0)))
    by_win = Window.partitionBy("conv_id").orderBy("win")
    spans = spans.withColumn("next", F.lead("win").over(by_win)).withColumn("next_left", F.lead("left").over(by_win))
    t = t.join(spans.select(F.col("conv_id").alias("c2"), F.col("win").alias("w2"), "next", "next_left"), F.expr("conv_id <=> c2 AND win = w2")).drop("c2", "w2")
    new = t.select("conv_id", "win", "pos", "piece", "answer", "role", F.lit(True).alias("new"))
    again = t.where(F.col("next").isNotNull() & ~F.col("first_sys") & (F.col("span_end") - F.col("end") + F.col("tok") <= F.col("next_left"))) \
        .select("conv_id", F.col("next").alias("win"), "pos", "piece", "answer", "role", F.lit(False).alias("new"))
    head = t.where("first_sys").select(F.col("conv_id").alias("c2"), F.col("win").alias("own"), "pos", "piece", "answer", "role")
    head = spans.where("with_sys").select("conv_id", "win").join(head, F.expr("conv_id <=> c2 AND win <> own")).select("conv_id", "win", "pos", "piece", "answer", "role", F.lit(False).alias("new"))
    rows = new.unionByName(again).unionByName(head)
    size = F.char_length("piece")
    rows = rows.withColumn("from", F.sum(size).over(Window.partitionBy("conv_id", "win").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - size)
    # a text starts behind "<s>[role]\n" and ends before "</s>\n"
    lead = F.char_length(F.lit("<s>[assistant]\n"))
    loss = F.when(F.col("new") & F.col("answer"), F.struct((F.col("from") + lead).alias("start"), (size - lead - 5).alias("length")))
    got = rows.groupBy("conv_id", "win").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"),
                                             F.sort_array(F.collect_list(loss)).alias("loss"), F.sum((~F.col("new")).cast("int")).alias("n_repeated"))
    return got.select("conv_id", "win", F.array_join(F.col("p.piece"), "").alias("text"), "n_repeated", "loss")


def read_back(wins: DataFrame) -> DataFrame:
    """Digest of what the formatted windows hold, a row per conversation: turns, their
    sha256, characters and sha256 under the loss mask, formatted characters."""
    d = wins.withColumn("t", F.expr("slice(split(text, '</s>\\n', -1), 1 + n_repeated, 1000000000)"))
    d = d.withColumn("t", F.expr("slice(t, 1, size(t) - 1)"))  # behind the last end mark stands nothing
    d = d.withColumn("r", F.transform("t", lambda x: F.regexp_extract(x, r"(?s)^<s>\[((?:[^\n\\]|\\.)*)\]\n", 1)))
    body = F.transform("t", lambda x, i: F.substr(x, F.char_length(F.get(F.col("r"), i)) + 7))
    d = d.withColumn("b", body)
    said = F.array_join(F.transform("r", lambda x, i: F.concat(unescape(x), F.lit("\n"), unescape(F.get(F.col("b"), i)), F.lit("\n"))), "")
    aim = F.array_join(F.transform("loss", lambda x: unescape(F.substr(F.col("text"), x["start"].cast("int") + 1, x["length"].cast("int")))), "")
    d = d.select("conv_id", "win", F.size("t").alias("n"), said.alias("said"), aim.alias("aim"), F.char_length("text").alias("chars"))
    g = d.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("win", "said", "aim"))).alias("w"),
                                 F.sum("chars").cast("long").alias("formatted_chars"))
    said, aim = F.array_join(F.col("w.said"), ""), F.array_join(F.col("w.aim"), "")
    return g.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.char_length(aim).cast("long").alias("loss_chars"),
                    F.sha2(aim, 256).alias("loss_sha256"), "formatted_chars")
