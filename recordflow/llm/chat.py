"""Reply trees as chat transcripts, DataFrame operations only.

A message names the message it answers, so a conversation is a tree. Paths from root to leaf
are found by self-joins that double their reach: a jump table holds for each message the
one 2^i steps above it and the score gathered on the way, and is joined with itself until no
message has anything that far above. Leaves are ranked by the score of their branch. Only
then are the chosen branches written out: from each leaf the jump tables reach every
ancestor once, the messages come in by one more join, and each branch becomes one text.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per message. Inside texts every ``<``,
backslashes and ``|`` get one more backslash, so no marker can be written there, and taking
one away reads the text back. In roles ``%``, ``<`` and the line feed are written %25, %3C, %0A.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordflow.llm.common import saved

START, STOP = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def reply_chain(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages (conv, node, parent, score, role, text) of plain conversations: every turn answers the one before.

    Turns are numbered by one sort of the whole table by range, not by a window per
    conversation, so a conversation with a third of all turns is spread over tasks. Turns
    with equal numbers follow by role and text. Nulls in role and text count as empty; a null
    conversation is one of its own.
    """
    t = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["conv", "turn", "role", "text"]
    placed = saved(t.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "chat-order")
    # monotonically_increasing_id is the partition in the upper bits and the row in the lower 33.
    placed = placed.withColumn("block", F.shiftright("at", 33)).withColumn("row", F.expr("at & 8589934591"))
    sizes = placed.groupBy("block").agg((F.max("row") + 1).alias("n"))  # one row per partition
    start = sizes.withColumn("start", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("block", "start")
    numbered = placed.join(start, "block").select("conv", (F.col("start") + F.col("row")).alias("node"), "role", "text")
    first = numbered.groupBy("conv").agg(F.min("node").alias("first")).withColumnRenamed("conv", "_conv")
    both = numbered.join(first, F.col("conv").eqNullSafe(F.col("_conv")))
    return both.select("conv", "node", F.when(F.col("node") > F.col("first"), F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def _jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables (node, up) for 1, 2, 4, ... steps, and (node, root, total): the score from the root."""
    step = saved(messages.select("node", F.col("parent").alias("up"), F.col("score").alias("sum")), "chat-jump")
    tables, totals = [], None
    while True:
        reach = step.where("up IS NOT NULL")
        ended = step.where("up IS NULL").select("node", F.col("sum").alias("total"))
        if reach.isEmpty():
            return tables, step.select("node", F.col("sum").alias("total"))
        tables.append(reach.select("node", "up"))
        above = step.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("sum").alias("more"))
        moved = reach.join(above, "up").select("node", F.col("next").alias("up"), (F.col("sum") + F.col("more")).alias("sum"))
        step = saved(moved.unionByName(ended.select("node", F.lit(None).cast("long").alias("up"), F.col("total").alias("sum"))), "chat-jump")


def branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """(leaf, node, above) for the ``top`` best branches of each conversation: the messages of
    each from leaf (above 0) to root. Branches are ranked by the sum of their scores, equal
    ones by the smaller leaf."""
    tables, totals = _jumps(messages)
    parents = messages.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    leaves = messages.select("conv", "node").join(parents, "node", "left_anti").join(totals, "node")
    best = W.partitionBy("conv").orderBy(F.col("total").desc(), F.col("node"))
    chosen = leaves.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    path = saved(chosen.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above")), "chat-path")
    for i in reversed(range(len(tables))):
        up = path.join(tables[i], "node").select("leaf", F.col("up").alias("node"), (F.col("above") + (1 << i)).alias("above"))
        path = saved(path.unionByName(up), "chat-path")
    return path


def transcripts(messages: DataFrame, top: int = 1, learned: str = LEARNED) -> DataFrame:
    """(conv, leaf, formatted, mask) for each chosen branch.

    ``mask`` lists runs of code points of ``formatted`` as (length, loss): three per message,
    its head, its text and its end; loss is true for texts of the learned role. Each branch
    is one row, so a branch must fit into memory as one text. Empty tables give no rows.
    """
    path = branches(messages, top)
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    lines = path.join(messages.select("conv", "node", "role", "text"), "node").select(
        "conv", "leaf", (-F.col("above")).alias("at"), head.alias("head"), body.alias("body"), (F.col("role") == learned).alias("loss"))
    by = lines.groupBy("conv", "leaf").agg(F.sort_array(F.collect_list(F.struct("at", "head", "body", "loss"))).alias("m"))
    text = F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"])), STOP)
    runs = F.flatten(F.transform("m", lambda x: F.array(
        F.struct(F.char_length(x["head"]).alias("length"), F.lit(False).alias("loss")),
        F.struct(F.char_length(x["body"]).alias("length"), x["loss"].alias("loss")),
        F.struct(F.lit(len(STOP)).alias("length"), F.lit(False).alias("loss")))))
    return by.select("conv", "leaf", F.concat(text, F.lit(STOP)).alias("formatted"), runs.alias("mask"))


def learned_text(pieces: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped. Runs of the mask are laid over the messages of a transcript
    one by one, so that the work grows with its length; a mask that does not fit the messages fails."""
    def under(piece: Column, i: Column) -> Column:
        head, body, end = (F.get(mask, 3 * i + n) for n in range(3))
        fits = (F.char_length(piece) == head["length"] + body["length"]) & (end["length"] == len(STOP))
        found = F.concat(*[F.when(run["loss"], F.substr(piece, at, run["length"])).otherwise("") for run, at in ((head, F.lit(1)), (body, head["length"] + 1))], F.when(end["loss"], STOP).otherwise(""))
        return F.when(F.coalesce(fits, F.lit(False)), unescape(found)).otherwise(F.raise_error("the mask does not fit the transcript").cast("string"))
    return F.array_join(F.transform(pieces, under), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv, leaf, formatted, mask, loss, turns array of (role, text)) read from the transcripts alone; ``loss`` is the text under the mask."""
    pieces = F.split(F.expr("left(formatted, char_length(formatted) - %d)" % len(STOP)), r"<\|im_end\|>\n", -1)
    bare = F.transform(pieces, lambda p: F.substr(p, F.lit(len(START) + 1)))
    turn = F.transform(bare, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, F.char_length(F.substring_index(p, "\n", 1)) + 2)).alias("text")))
    return formatted.select("conv", "leaf", "formatted", "mask", learned_text(pieces, F.col("mask")).alias("loss"), turn.alias("turns"))


def figures(read: DataFrame) -> DataFrame:
    """Digests of what was read back; those of the loss are of the text under the mask."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    covered = F.aggregate("mask", F.lit(0).cast("long"), lambda a, r: a + r["length"])
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda a, r: a + F.when(r["loss"], r["length"]).otherwise(0))
    return read.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), covered.alias("mask_chars"), masked.alias("masked_chars"))
