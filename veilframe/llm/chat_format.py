"""Chat formatting: budgeted, turn-aligned windows of conversations, by built-in functions only.

A turn is written ``<s>[INST] role [/INST] text</s>``. Inside roles and texts a control string,
whatever number of backslashes follows its first character, gets one more there; reading back
takes one away. So escaped text holds no control string, and the step is one to one.

Windows: a turn counts ``TURN_TOKENS`` and a token for each ``TOKEN_CHARS`` characters. What ``budget`` leaves
beside ``history`` and the conversation's system turn is its room. Turns of over a third of the room
stand alone; the others are placed by running sums since the last such turn, into slots of two thirds: a
slot's turns, the one that reaches into it included, so fill the room at most. No window is over the budget but that of a
single turn that is. A later window begins with the
conversation's first turn, if that is a system turn, and with up to ``HISTORY_TURNS`` of the
turns before its own, as far as ``history`` tokens, or what a turn that stands alone leaves of the budget, go. Such repeated turns are under no loss:
each assistant text is a target once, in the window that owns its turn.

Defined cases: rows are ordered by turn, then role, then text, so ties and repeated rows have
an order; a null role or text is written as empty, a null turn comes first, rows of a null id
are one conversation; empty tables give no windows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, HISTORY_TURNS, TURN_TOKENS, TOKEN_CHARS = 1024, 128, 3, 4, 4
BEGIN, MIDDLE, END = "<s>[INST] ", " [/INST] ", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*/?s>)", r"<\\$1"), r"\[(\\*/?INST\])", r"[\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<\\(\\*/?s>)", "<$1"), r"\[\\(\\*/?INST\])", "[$1")


def windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per window: ``id_col``, ``window``, ``formatted``, ``n_repeated`` (its leading repeated turns) and ``loss`` (character spans of targets)."""
    turns = df.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ordered = Window.partitionBy("id").orderBy("turn", "role", "text")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.withColumn("tokens", F.ceil(F.length("text") / TOKEN_CHARS) + TURN_TOKENS).select(
        "id", "role", "tokens", F.row_number().over(ordered).alias("place"), F.sum("tokens").over(so_far).alias("upto"),
        (F.first("role").over(so_far) == "system").alias("is_system"), F.first("tokens").over(so_far).alias("first_tokens"),
        escape(F.col("role")).alias("marked"), escape(F.col("text")).alias("body"))
    by_place = Window.partitionBy("id").orderBy("place")
    running = by_place.rowsBetween(Window.unboundedPreceding, 0)
    system_tokens = F.when(F.col("is_system"), F.col("first_tokens")).otherwise(0)
    room = F.greatest(F.lit(budget - history) - system_tokens, F.lit(0))
    placed = placed.withColumn("third", F.floor(room / 3)).withColumn("stride", F.greatest(room - F.col("third"), F.lit(1))).withColumn("alone", F.col("tokens") > F.col("third"))
    placed = placed.withColumn("spare", F.when(F.col("alone"), F.least(F.lit(history), F.greatest(F.lit(budget) - system_tokens - F.col("tokens"), F.lit(0)))).otherwise(history))
    placed = placed.withColumn("short", F.sum(F.when(~F.col("alone"), F.col("tokens")).otherwise(0)).over(running)).withColumn("run", F.sum(F.col("alone").cast("int")).over(running))
    since = F.col("short") - F.coalesce(F.max(F.when(F.col("alone"), F.col("short"))).over(running), F.lit(0))
    placed = placed.withColumn("slot", F.struct("run", F.when(F.col("alone"), -1).otherwise(F.floor((since - 1) / F.col("stride"))).alias("n")))
    piece = F.concat(F.lit(BEGIN), "marked", F.lit(MIDDLE), "body", F.lit(END))
    placed = placed.withColumn("opens", F.coalesce(F.lag("slot").over(by_place) != F.col("slot"), F.lit(False))).withColumn("piece", piece)
    known = placed.withColumn("window", F.sum(F.col("opens").cast("long")).over(running)).withColumn("system", F.when(F.col("is_system"), F.first("piece").over(running)))
    # a turn d places before the first turn of a later window is repeated there, if the turns from it on fit the history
    ahead = [F.lead(F.struct("opens", (F.col("upto") - F.col("tokens")).alias("before"), "window", "spare"), d).over(by_place).alias(f"ahead{d}") for d in range(1, HISTORY_TURNS + 1)]
    base = known.select("*", *ahead)

    def repeated_in(d: int) -> Column:
        later = F.col(f"ahead{d}")
        fits = later["before"] - F.col("upto") + F.col("tokens") <= later["spare"]
        return F.when(later["opens"] & fits & ((F.col("place") > 1) | F.col("system").isNull()), later["window"])

    use = lambda window, rank, piece, own: F.struct(window.alias("window"), rank.alias("rank"), piece.alias("piece"), F.lit(own).alias("own"))
    uses = F.array(
        use(F.col("window"), F.col("place"), F.col("piece"), True),
        *[use(repeated_in(d), F.col("place"), F.col("piece"), False) for d in range(1, HISTORY_TURNS + 1)],
        use(F.when(F.col("opens") & F.col("system").isNotNull(), F.col("window")), F.lit(0), F.col("system"), False),
    )
    used = base.select("id", "role", F.length("marked").alias("n_role"), F.length("body").alias("n_body"), F.explode(F.filter(uses, lambda u: u["window"].isNotNull())).alias("u")).select("*", "u.*")
    inside = Window.partitionBy("id", "window").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(inside), F.lit(0)) + F.lit(len(BEGIN) + len(MIDDLE)) + F.col("n_role")
    span = F.when(F.col("own") & (F.col("role") == "assistant"), F.struct(start.alias("start"), (start + F.col("n_body")).alias("end")))
    return used.select("id", "window", "rank", "piece", "own", span.alias("span")).groupBy("id", "window").agg(
        F.array_sort(F.collect_list(F.struct("rank", "piece", "span"))).alias("p"), F.count(F.when(~F.col("own"), 1)).alias("n_repeated"),
    ).select(
        F.col("id").alias(id_col), "window", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), "n_repeated",
        F.filter(F.transform("p", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted window: an array of (role, text)."""
    marked = F.filter(F.split(formatted, END), lambda x: x != "")

    def turn(x: Column) -> Column:
        rest = F.substring(x, F.lit(len(BEGIN) + 1), F.length(x))
        cut = F.locate(MIDDLE, rest)
        return F.struct(unescape(F.substring(rest, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(rest, cut + len(MIDDLE), F.length(rest))).alias("text"))

    return F.transform(marked, turn)


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What windows say, read from their text alone: turns, text under loss, and sizes, per conversation."""
    turns = F.slice(read_back(F.col("formatted")), F.col("n_repeated").cast("int") + 1, F.size(F.split("formatted", END)))
    said = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    per = formatted.select(id_col, "window", F.length("formatted").alias("n"), F.size(turns).alias("k"), F.array_join(said, "").alias("said"), F.array_join(loss, "").alias("loss"))
    whole = per.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("k").alias("n_turns"), F.sum("n").alias("formatted_chars"))
    text = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return whole.select(
        id_col, "n_turns", F.sha2(F.encode(text("said"), "UTF-8"), 256).alias("turns_sha256"), F.length(text("loss")).cast("long").alias("loss_chars"),
        F.sha2(F.encode(text("loss"), "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")
