"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into spans of whole turns: a span takes turns as long as they and the
system turn keep within the budget, of which all windows but the first set `history` aside; it ends at the latest where a
block of `BLOCK` turns ends, so that no more turns than that are looked at together. Each span becomes a window: the
system turn, then the latest turns of the span before that together hold at most `history` tokens and leave the window
within the budget, then the span's own turns. So a window passes the budget only if one turn with the system turn does.
Assistant turns are targets in their own window and masked where they are repeated as history.

Template: `<turn ROLE>` line, the text, `</turn>` line. In roles and texts a backslash becomes `\\s`, `<` becomes
`\\l`, and in roles `>` becomes `\\g` and a line feed `\\n`; so no control string can come from a text, and `unescape`
gives the text back exactly.

Defined results: null roles and texts are empty; null turns come first; rows with equal turn numbers are ordered by
role and text, repeated rows stay repeated turns; a conversation whose id is null is one conversation; the first turn
is the system turn if its role is "system"; an empty table gives no windows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens (words between white space) of a window, and of the history that it may repeat.
BUDGET, HISTORY = 512, 128
#: Turns after which a span ends in any case.
BLOCK = 1024
TARGET, SYSTEM = "assistant", "system"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\g"), F.lit(">")), F.lit("\\n"), F.lit("\n")))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a window: conv_id, window (long, from 0), n_tokens, formatted, and `parts`.

    parts lists the window's turns in order as struct<begin, length, repeated, loss>: where the turn's escaped text
    lies in `formatted` (code points from 0), whether it was shown before, and whether it is under the loss mask.
    """
    turns = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", token_count("text").cast("long"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.withColumn("n", F.row_number().over(order))
    conversation = Window.partitionBy("conv_id").orderBy("n")
    turns = turns.withColumn("system", (F.col("n") == 1) & (F.col("role") == SYSTEM))
    head = F.first(F.when(F.col("system"), F.struct("role", "text", "tokens")), ignorenulls=True).over(conversation.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the system turn stands before the first span and spends nothing of any
    turns = turns.withColumns({"head": head, "spent": F.when(F.col("system"), 0).otherwise(F.col("tokens")), "block": F.floor((F.col("n") - 1) / block), "place": (F.col("n") - 1) % block})
    room = budget - F.coalesce(F.col("head.tokens"), F.lit(0))
    all_of_block = Window.partitionBy("conv_id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = turns.withColumn("sizes", F.collect_list("spent").over(all_of_block))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("span"), F.expr("cast(array() as array<int>)").alias("done"))

    def take(state: Column, size: Column) -> Column:
        most = F.when((F.col("block") == 0) & (state["span"] == 0), room).otherwise(room - history)
        fits = (F.size(state["done"]) == 0) | ((state["used"] + size) <= most)
        span = F.when(fits, state["span"]).otherwise(state["span"] + 1)
        return F.struct(F.when(fits, state["used"] + size).otherwise(size).alias("used"), span.alias("span"), F.concat(state["done"], F.array(span)).alias("done"))

    spans = F.when(F.col("place") == 0, F.aggregate("sizes", start, take, lambda s: s["done"]))
    turns = turns.withColumn("spans", F.first(spans, ignorenulls=True).over(all_of_block)).drop("sizes")
    begins = (F.col("place") == 0) | (F.get("spans", F.col("place")) != F.get("spans", F.col("place") - 1))
    turns = turns.withColumn("span", F.sum(F.when(begins, 1).otherwise(0)).over(conversation) - 1).drop("spans")
    # what a span repeats comes from the span before
    after = F.sum("spent").over(Window.partitionBy("conv_id").orderBy("span").rangeBetween(1, 1))
    tail = F.sum("spent").over(Window.partitionBy("conv_id", "span").orderBy("n").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    turns = turns.withColumns({"after": after, "tail": tail, "next_span": F.col("span") + 1})
    repeats = ~F.col("system") & F.coalesce(F.col("tail") <= F.least(F.lit(history), room - F.col("after")), F.lit(False)) & F.col("after").isNotNull()
    shown = F.filter(F.array(F.struct(F.col("span").alias("window"), F.lit(False).alias("repeated")), F.when(repeats, F.struct(F.col("next_span").alias("window"), F.lit(True).alias("repeated")))), lambda x: x.isNotNull())
    piece = F.struct("n", (F.col("shown.repeated")).alias("repeated"), F.struct("role", "text", "tokens").alias("turn"))
    shown_rows = turns.withColumn("shown", F.explode(shown))
    grouped = shown_rows.groupBy("conv_id", F.col("shown.window").alias("window")).agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.first("head").alias("head"))
    again = F.when(F.col("head").isNotNull() & (F.col("window") > 0), F.array(F.struct(F.lit(1).alias("n"), F.lit(True).alias("repeated"), F.col("head").alias("turn")))).otherwise(F.expr("cast(array() as array<struct<n:int,repeated:boolean,turn:struct<role:string,text:string,tokens:bigint>>>)"))
    grouped = grouped.withColumn("pieces", F.concat(again, F.col("pieces")))
    opened = F.transform("pieces", lambda p: F.concat(F.lit("<turn "), escape_role(p["turn"]["role"]), F.lit(">\n")))
    bodies = F.transform("pieces", lambda p: escape(p["turn"]["text"]))
    made = grouped.withColumns({"opened": opened, "bodies": bodies})
    closing = "\n</turn>\n"
    formatted = F.concat_ws("", F.transform(F.arrays_zip("opened", "bodies"), lambda z: F.concat(z["opened"], z["bodies"], F.lit(closing))))
    lengths = F.transform(F.arrays_zip("opened", "bodies"), lambda z: F.struct(F.char_length(z["opened"]).cast("long").alias("open"), F.char_length(z["bodies"]).cast("long").alias("length")))
    made = made.withColumns({"formatted": formatted, "lengths": lengths})
    first = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<begin:bigint,length:bigint>>)").alias("done"))
    places = F.aggregate(
        "lengths",
        first,
        lambda s, x: F.struct((s["at"] + x["open"] + x["length"] + len(closing)).alias("at"), F.concat(s["done"], F.array(F.struct((s["at"] + x["open"]).alias("begin"), x["length"].alias("length")))).alias("done")),
        lambda s: s["done"],
    )
    parts = F.zip_with("pieces", F.col("places"), lambda p, at: F.struct(at["begin"].alias("begin"), at["length"].alias("length"), p["repeated"].alias("repeated"), (~p["repeated"] & (p["turn"]["role"] == TARGET)).alias("loss")))
    tokens = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p["turn"]["tokens"])
    return made.withColumn("places", places).select("conv_id", F.col("window").cast("long").alias("window"), tokens.alias("n_tokens"), "formatted", parts.alias("parts"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From the windows alone, one row a turn not repeated: conv_id, window, place, role, text, loss."""
    part = formatted.select("conv_id", "window", "formatted", F.posexplode("parts").alias("place", "part")).filter(~F.col("part.repeated"))
    before = F.substring(F.col("formatted"), F.lit(1), (F.col("part.begin") - 2).cast("int"))  # up to the line feed and ">" that open the text
    role = F.substring_index(before, "<turn ", -1)
    return part.select("conv_id", "window", "place", unescape_role(role).alias("role"), unescape(F.substring(F.col("formatted"), (F.col("part.begin") + 1).cast("int"), F.col("part.length").cast("int"))).alias("text"), F.col("part.loss").alias("loss"))


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation with what its windows hold: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = F.sort_array(F.collect_list(F.struct("window", "place", "role", "text", "loss")))
    back = read_back(formatted).groupBy("conv_id").agg(turns.alias("turns"))
    loss = F.concat_ws("", F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]))
    back = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"), loss.alias("loss"))
    back = back.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"))
    size = formatted.groupBy(F.col("conv_id").alias("__conv")).agg(F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    return back.join(size, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
