"""Chat logs as events: fold deltas, edits and regenerations into final messages, render them, and read them back.

DataFrame functions only. Events of a message are folded per (conversation, turn), so a long log spreads over tasks;
only the rendering, which is one string per conversation by nature, brings a conversation together.

Template: ``<turn ROLE>`` newline, escaped text, ``</turn>`` newline. Inside texts and roles a backslash becomes
``\\b`` and ``<`` becomes ``\\l`` (in roles also ``>`` becomes ``\\g``), so an unescaped ``<`` starts a marker, always.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RESETS = ("message", "edit", "regenerate")  # replace what the turn held so far
BRANCHES = ("edit", "regenerate")  # also void all later turns written before


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, turn, role, text)`` of a log ``(conv_id, seq, turn, kind, role, text)``.

    Kinds: ``message`` sets the text of a turn, ``delta`` appends to it, ``edit`` replaces it and voids every later turn
    written before, ``regenerate`` clears it and voids likewise (its own text, if any, starts the new one). Null texts
    are empty, null roles are empty, other kinds (also null) are deltas. A null ``conv_id`` or ``turn`` is a value like
    any other; null turns come first. Two events of one message with the same ``seq`` are taken in text order. A turn
    whose events are all void gives no message. An empty log gives an empty result; other columns are ignored.
    """
    log = events.select(
        "conv_id", "turn", "seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("kind", F.lit("delta")).alias("kind"))
    turns = log.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("kind").isin(*RESETS), F.col("seq"))).alias("own"), F.max(F.when(F.col("kind").isin(*BRANCHES), F.col("seq"))).alias("branch"))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "own", F.max("branch").over(earlier).alias("voided"))
    same = log["conv_id"].eqNullSafe(turns["c"]) & log["turn"].eqNullSafe(turns["t"])
    alive = (F.col("own").isNull() | (F.col("seq") >= F.col("own"))) & (F.col("voided").isNull() | (F.col("seq") > F.col("voided")))
    pieces = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return log.join(turns, same).where(alive).groupBy("conv_id", "turn").agg(
        F.min_by("role", "seq").alias("role"), F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, turn_starts, loss)`` from final messages.

    ``turn_starts`` has the offset of each turn's marker, ``loss`` for each turn the span (start, length) of text to be
    trained on, null for other roles; offsets count code points of ``formatted``. Equal turns keep (role, text) order.
    """
    head = F.concat(F.lit("<turn "), F.replace(escape(F.col("role")), F.lit(">"), F.lit("\\g")), F.lit(">\n"))
    pieces = messages.withColumn("__head", head).withColumn("__body", escape(F.col("text")))
    pieces = pieces.withColumn("__piece", F.concat("__head", "__body", F.lit("</turn>\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    offset = F.coalesce(F.sum(F.length("__piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("__n", F.row_number().over(order)).withColumn("__at", offset.cast("long"))
    span = F.when(F.col("role") == trained_role, F.struct((F.col("__at") + F.length("__head")).alias("start"), F.length("__body").cast("long").alias("length")))
    turn = F.struct(F.col("__n").alias("n"), F.col("__piece").alias("piece"), F.col("__at").alias("at"), span.alias("loss"))
    gathered = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return gathered.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("turns", lambda t: t["at"]).alias("turn_starts"), F.transform("turns", lambda t: t["loss"]).alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Add ``turns`` (role, text) and ``loss_texts`` (unescaped text under the mask, in order) from ``formatted`` alone."""
    chunks = F.split("formatted", "</turn>\n")
    chunks = F.slice(chunks, 1, F.size(chunks) - 1)

    def parse(chunk: Column) -> Column:
        end = F.instr(chunk, ">\n")
        role = F.replace(unescape_role(F.substr(chunk, F.lit(7), end - 7)), F.lit("\\b"), F.lit("\\"))
        return F.struct(role.alias("role"), unescape(F.substr(chunk, end + 2)).alias("text"))

    def unescape_role(role: Column) -> Column:
        return F.replace(F.replace(role, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))

    under = F.transform(
        F.arrays_zip(chunks.alias("chunk"), F.col("turn_starts").alias("at"), F.col("loss").alias("loss")),
        lambda z: F.when(z["loss"].isNotNull(), unescape(F.substr(z["chunk"], (z["loss"]["start"] - z["at"] + 1).cast("int"), z["loss"]["length"].cast("int")))))
    return rendered.withColumn("turns", F.transform(chunks, parse)).withColumn("loss_texts", F.filter(under, lambda x: x.isNotNull()))
