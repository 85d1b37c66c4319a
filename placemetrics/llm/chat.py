"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written as `[INST]role[/INST]text</s>`. The three marks are the only control strings;
inside roles and texts each gets one backslash more after its first sign, and reading takes it away
again, so every text comes back as it was and no text can begin or end a turn.

A conversation becomes windows of whole turns, chosen by prefix sums of the turns' tokens. What the
budget leaves beside the system turn and the history is the room. Turns of more than half the room
are windows of their own. The others, the largest of them having m tokens, are cut where the sum of
the turns before passes a multiple of room - m, so a window never holds more than the room; a
conversation that fits whole is one window. Only a single turn larger than the room can exceed it.

The system turn (the first turn, if its role is `system`) stands at the head of every window. A later
window repeats the last turns before it, as many of `history` as have `history_tokens` at most. The
loss mask covers the texts of assistants that are new in a window, so each counts once.

Turns are dealt to blocks of `block` turn numbers, so no long conversation has to meet in one task; a
block begins a new window and gets system turn and history from the blocks before it. `digests` puts
the texts of a conversation into one row, as a digest of a whole cannot be added up from its parts;
only conversations of several blocks are moved for it.

Order within a conversation: turn (null first), then role and text as written. Repeated rows are
turns of their own. Null roles and texts are empty; rows of a null conv_id are one conversation. Roles
are free; only `system` (as the first turn) and `assistant` have a meaning. An empty table has no
windows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 2
HISTORY_TOKENS = 256
BLOCK = 256
#: Block of turns without a number; before all others.
UNNUMBERED = -(1 << 60)

# The marks of the template, and the patterns of a mark inside a text, before and after escaping.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
CONTROL = r"([\[<])(\\*)(/?INST\]|/s>)"
ESCAPED = r"([\[<])\\(\\*)(/?INST\]|/s>)"
#: A token for budgets: up to six letters or digits, or one other sign.
TOKEN = r"[\p{L}\p{N}]{1,6}|[^\x20\x09-\x0D\p{L}\p{N}]"

# Kinds of rows of a block: turns carried into it, and its own.
SYSTEM, BEFORE, OWN = range(3)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def count_tokens(text: Column) -> Column:
    """Tokens of a text for the budget."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def turns(conversations: DataFrame, tokens: Callable[[Column], Column] = count_tokens, block: int = BLOCK) -> DataFrame:
    """conv, block, turn, role, body (escaped), tokens of every row. `conv` holds the conv_id and is itself never null, so null ids meet like others."""
    role, text = (escape(F.coalesce(F.col(c), F.lit(""))) for c in ("role", "text"))
    number = F.col("turn").cast("long")
    plain = conversations.select(F.struct("conv_id").alias("conv"), F.coalesce(F.floor(number / F.lit(block)), F.lit(UNNUMBERED)).alias("block"), number.alias("turn"),
                                 role.alias("role"), text.alias("body"))
    return plain.withColumn("tokens", tokens(F.col("role")) + tokens(F.col("body")) + 3)


def carried(rows: DataFrame, history: int) -> DataFrame:
    """conv, block, before: the turns that blocks of a conversation of several blocks get from those before; none for the first.

    Blocks are told from the two key columns alone; conversations of one block have no row here. The
    turns are dealt by (conv, block) as for the windows, so the shuffle is the same one.
    """
    order = Window.partitionBy("conv").orderBy("block")
    keys = rows.select("conv", "block").distinct().select("conv", "block", F.lead("block").over(order).alias("next"), F.lag("block").over(order).alias("previous"))
    several = keys.where("next IS NOT NULL OR previous IS NOT NULL")

    near = Window.partitionBy("conv", "block")
    met = rows.join(several, ["conv", "block"]).withColumn("place", F.row_number().over(near.orderBy("turn", "role", "body")))
    is_system = F.col("previous").isNull() & (F.col("place") == 1) & (F.col("role") == "system")
    turn = F.struct("turn", "role", "body", "tokens")
    ends = met.where(~is_system & F.col("next").isNotNull()).withColumn("k", F.row_number().over(near.orderBy(F.desc("place")))).where(F.col("k") <= history)
    before = ends.select("conv", F.col("next").alias("block"), F.struct(F.lit(BEFORE).alias("kind"), "turn", "role", "body", "tokens").alias("t"))
    system = met.where(is_system).select("conv", turn.alias("system"))
    heads = several.where("previous IS NOT NULL").select("conv", "block").join(system, "conv").select(
        "conv", "block", F.struct(F.lit(SYSTEM).alias("kind"), "system.*").alias("t"))
    signs = several.select("conv", "block", F.lit(None).cast(heads.schema["t"].dataType).alias("t"))
    return before.unionByName(heads).unionByName(signs).groupBy("conv", "block").agg(F.sort_array(F.collect_list("t")).alias("before"))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS,
                   tokens: Callable[[Column], Column] = count_tokens, block: int = BLOCK) -> DataFrame:
    """conv (conv_id in a struct, the key it is dealt by), conv_id, block, window, several, n_context, n_turns, tokens, text, loss for every window.

    The first n_context turns of `text` are repeated ones, the other n_turns new. `loss` holds the
    spans (start, length in code points) of `text` that are learned from. `several` tells that the
    conversation has more blocks.
    """
    own = turns(conversations, tokens, block)
    whole = Window.partitionBy("conv", "block")
    order = whole.orderBy("kind", "turn", "role", "body")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    rows = own.join(carried(own, history), ["conv", "block"], "left")
    # The carried turns come in with the first turn of the block.
    rows = rows.withColumn("first", F.row_number().over(whole.orderBy("turn", "role", "body")) == 1)
    rows = rows.withColumn("several", F.col("before").isNotNull()).withColumn("later", F.coalesce(F.size("before"), F.lit(0)) > 0)
    one = F.array(F.struct(F.lit(OWN).alias("kind"), "turn", "role", "body", "tokens"))
    rows = rows.select("conv", "block", "several", "later", F.inline(F.when(F.col("first") & F.col("later"), F.concat("before", one)).otherwise(one)))
    rows = rows.withColumn("place", F.row_number().over(order))
    begins = (F.col("kind") == OWN) & (F.col("role") == "system") & ~F.col("later") & (F.col("place") == 1)
    rows = rows.withColumn("is_system", (F.col("kind") == SYSTEM) | begins)
    rows = rows.withColumn("new", (F.col("kind") == OWN) & ~F.col("is_system"))
    rows = rows.select("*", F.max(F.when(F.col("is_system"), F.struct("role", "body", "tokens"))).over(whole).alias("system"), F.sum(F.when(F.col("new"), F.col("tokens")).otherwise(0)).over(whole).alias("total"))
    rows = rows.withColumn("room", F.greatest(F.lit(budget) - F.coalesce("system.tokens", F.lit(0)) - history_tokens, F.lit(1)))
    rows = rows.withColumn("large", F.col("new") & (F.col("total") > F.col("room")) & (2 * F.col("tokens") > F.col("room")))
    rows = rows.withColumn("small", F.when(F.col("new") & ~F.col("large"), F.col("tokens")).otherwise(0))
    rows = rows.select("*", F.max("small").over(whole).alias("most"), F.sum("small").over(so_far).alias("sum"), F.sum(F.col("large").cast("int")).over(so_far).alias("larges"))
    span = F.when(F.col("total") <= F.col("room"), F.col("room") + 1).otherwise(F.col("room") - F.col("most"))
    rows = rows.withColumn("group", F.when(F.col("new"), F.struct("larges", "large", F.floor((F.col("sum") - F.col("small")) / span))))
    past = F.lag("group").over(order)
    rows = rows.withColumn("opens", F.col("new") & past.isNotNull() & ~past.eqNullSafe(F.col("group")))
    rows = rows.withColumn("window", F.when(F.col("kind") == OWN, F.sum(F.col("opens").cast("int")).over(so_far)).otherwise(-1))

    # A turn is shown in its own window, and again in the window that begins k turns later if it and those after it fit the history.
    places, weight = [F.when(F.col("kind") == OWN, F.struct(F.col("window"), F.lit(False).alias("again")))], F.lit(0)
    for k in range(1, history + 1):
        weight = weight + F.lead("tokens", k - 1).over(order)
        begin, end = F.lead("window", k - 1).over(order), F.lead("window", k).over(order)
        places.append(F.when(~F.col("is_system") & (end > begin) & (weight <= history_tokens), F.struct(end.alias("window"), F.lit(True).alias("again"))))
    rows = rows.select("conv", "block", "several", "later", "place", "role", "body", "tokens", "system", F.array_compact(F.array(*places)).alias("places"))
    shown = rows.select("*", F.inline("places")).drop("places")

    # Every window that is not the very first gets the system turn in front of all.
    head = F.when(F.col("system").isNotNull() & (F.col("later") | (F.col("window") > 0)), F.col("system"))
    shown = shown.withColumn("head", head)
    piece = _written("role", "body")
    front = F.coalesce(F.length(_written("head.role", "head.body")), F.lit(0))
    inside = Window.partitionBy("conv", "block", "window").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shown = shown.withColumn("start", front + F.sum(F.length(piece)).over(inside) - F.length(F.lit(END)) - F.length("body"))
    learned = F.when((F.col("role") == "assistant") & ~F.col("again"), F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    made = shown.groupBy("conv", "block", "window").agg(
        F.max("several").alias("several"), F.sum(F.col("again").cast("long")).alias("again"), F.sum((~F.col("again")).cast("long")).alias("n_turns"), F.sum("tokens").alias("tokens"),
        F.max("head").alias("head"), F.sort_array(F.collect_list(F.struct("place", piece.alias("piece")))).alias("pieces"), F.sort_array(F.collect_list(learned)).alias("loss"))
    has = F.col("head").isNotNull().cast("long")
    return made.select("conv", F.col("conv.conv_id").alias("conv_id"), "block", "window", "several", (F.col("again") + has).alias("n_context"), "n_turns", (F.col("tokens") + F.coalesce("head.tokens", F.lit(0))).alias("tokens"),
                       F.concat(F.coalesce(_written("head.role", "head.body"), F.lit("")), F.array_join("pieces.piece", "")).alias("text"), "loss")


def _written(role: str, body: str) -> Column:
    return F.concat(F.lit(OPEN), F.col(role), F.lit(CLOSE), F.col(body), F.lit(END))


def read_back(windows: DataFrame) -> DataFrame:
    """The columns of the windows and, from `text` and `loss` alone, `turns` (role and text of the new turns) and `learned` (texts under the mask)."""
    parts = F.slice(F.split("text", END), F.col("n_context") + 1, F.col("n_turns"))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, CLOSE, 1)
        return F.struct(unescape(F.substring(role, len(OPEN) + 1, F.length(role))).alias("role"),
                        unescape(F.substring(part, F.length(role) + len(CLOSE) + 1, F.length(part))).alias("text"))

    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return windows.select("*", F.transform(parts, turn).alias("turns"), learned.alias("learned"))


def digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars for every conversation, read back from its windows.

    Windows of a block lie together already. Of conversations with one block only digests are moved.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_back(windows).select("conv", "block", "window", "several", "n_turns", lines.alias("lines"), F.array_join("learned", "").alias("loss"), F.length("text").cast("long").alias("chars"))
    blocks = read.groupBy("conv", "block").agg(
        F.max("several").alias("several"), F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("chars"), F.sum(F.length("loss")).alias("loss_chars"),
        F.sort_array(F.collect_list(F.struct("window", "lines", "loss"))).alias("w"))
    joined = blocks.select("*", F.array_join("w.lines", "").alias("lines"), F.array_join("w.loss", "").alias("loss")).drop("w")
    light = joined.select("conv", "n_turns", "chars", "loss_chars", *(F.when(~F.col("several"), F.sha2(c, 256)).alias(f"{c}_sha256") for c in ("lines", "loss")),
                          F.when(F.col("several"), F.struct("block", "lines", "loss")).alias("part"))
    found = light.groupBy("conv").agg(F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("chars"), F.sum("loss_chars").alias("loss_chars"),
                                         F.max("lines_sha256").alias("lines_sha256"), F.max("loss_sha256").alias("loss_sha256"), F.sort_array(F.collect_list("part")).alias("parts"))
    return found.select("conv.conv_id", "n_turns", F.coalesce("lines_sha256", F.sha2(F.array_join("parts.lines", ""), 256)).alias("turns_sha256"), F.col("loss_chars").cast("long").alias("loss_chars"),
                        F.coalesce("loss_sha256", F.sha2(F.array_join("parts.loss", ""), 256)).alias("loss_sha256"), F.col("chars").alias("formatted_chars"))
