"""Chat formatting in budgeted, turn-aligned windows, with DataFrame functions only.

Prefix sums of the turns' tokens cut a conversation into bins of ``budget`` less what is kept
for repeats: ``reserve`` tokens, or the conversation's system turn (its first turn, if that is
one) where that is longer.  Turns that lie inside a bin share a window; a turn that crosses a
bin's border has one of its own.  Each window starts with the system turn and repeats up to
``history`` turns before its first new one, as far as the rest of the kept tokens goes.  So a
window exceeds the budget only where its system turn and one new turn alone do.  The loss mask
covers the new assistant turns; repeated turns are never targets, so each is one exactly once.
A turn is reckoned at a quarter of its code points, rounded up, and four tokens for its marks.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings inside a text, with any
number of backslashes after their first character, get one backslash more there; reading back
takes one away, so any text is restored exactly.  In roles, backslash and line feed are escaped.

Cases: null texts and roles are empty; turns are ordered by turn, then role and text, so that
repeated turn numbers have a fixed order (a null turn first); turns without a conversation id
make one conversation, whose id is null; an unknown role is kept as it is and is no target; an
empty table gives no windows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 2048
RESERVE = 512
HISTORY = 2
#: Strings with a meaning in common chat templates, this one's first.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def _rest(words: list[str], first: str) -> str:
    tails = [w[1:] for w in words if w[0] == first]
    return "|".join("".join("\\" + c if not c.isalnum() and c != "_" else c for c in t) for t in tails)


_ANY = f"(<(?=\\\\*(?:{_rest(CONTROL, '<')}))|\\[(?=\\\\*(?:{_rest(CONTROL, '[')})))"
_ESCAPED = f"(<(?=\\\\+(?:{_rest(CONTROL, '<')}))|\\[(?=\\\\+(?:{_rest(CONTROL, '[')})))\\\\"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ANY, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def escape_role(role: Column) -> Column:
    """A backslash becomes one and an ``s``, a line feed one and an ``n``; no backslash stands by itself."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\")))


def turn_tokens(text: Column) -> Column:
    """Tokens a turn is reckoned at: a quarter of its code points, rounded up, and four for its marks."""
    return F.ceil(F.length(text) / 4).cast("long") + 4


def windows(turns: DataFrame, budget: int = BUDGET, reserve: int = RESERVE, history: int = HISTORY) -> DataFrame:
    """Windows: conv_id, window, n_repeated (leading turns that are repeats), formatted, loss (array of start, length)."""
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumns({"i": F.row_number().over(order), "tokens": turn_tokens(F.col("text"))})
    is_system = (F.col("i") == 1) & (F.col("role") == "system")
    # The system turn is in every window, so it takes no room of a bin.
    t = t.withColumns({"size": F.when(is_system, F.lit(0)).otherwise(F.col("tokens")), "system_tokens": F.first(F.when(is_system, F.col("tokens")).otherwise(0)).over(order)})
    t = t.withColumns({"end": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "room": F.greatest(F.lit(budget) - F.greatest(F.lit(reserve), F.col("system_tokens")), F.lit(1))})
    begin_at = F.col("end") - F.col("size")
    low, high = F.floor(begin_at / F.col("room")), F.floor(F.greatest(F.col("end") - 1, begin_at) / F.col("room"))
    t = t.withColumn("w", F.when(low == high, 2 * low).otherwise(2 * low + 1))
    same = Window.partitionBy("conv_id", "w")
    t = t.withColumn("first", F.min("i").over(same))
    by_i = Window.partitionBy("conv_id").orderBy("i")
    # Turn i is repeated by the window that starts k turns later, if all turns from i up to there fit the reserve.
    begin = lambda k: F.lead("end", k).over(by_i) - F.lead("size", k).over(by_i) - begin_at
    ahead = [F.struct(F.lead("w", k).over(by_i).alias("w"), F.lead("first", k).over(by_i).alias("first"), begin(k).alias("span"), F.lit(k).alias("k")) for k in range(1, history + 1)]
    system = F.when(is_system, F.struct("role", "text"))
    t = t.withColumn("ahead", F.array(*ahead)).withColumn("system", F.first(system).over(by_i.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.lit(budget) - F.col("room") - F.col("system_tokens")
    later = F.filter("ahead", lambda a: (a["first"] == F.col("i") + a["k"]) & (a["span"] <= left) & ~is_system)
    own = F.array(F.struct(F.col("w").alias("w"), F.lit(2).alias("kind")))
    others = F.transform(later, lambda a: F.struct(a["w"].alias("w"), F.lit(1).alias("kind")))
    head = F.when((F.col("i") == F.col("first")) & F.col("system").isNotNull() & ~is_system, F.array(F.struct(F.col("w").alias("w"), F.lit(0).alias("kind")))).otherwise(F.array().cast("array<struct<w:bigint,kind:int>>"))
    cast = "array<struct<w:bigint,kind:int>>"
    placed = t.select("conv_id", "i", "role", "text", "system", F.explode(F.concat(own.cast(cast), others.cast(cast), head.cast(cast))).alias("p"))
    is_head = F.col("p.kind") == 0
    piece = placed.select(
        "conv_id", F.col("p.w").alias("window"),
        F.struct(
            F.col("p.kind").alias("kind"), F.col("i").alias("i"),
            F.concat(F.lit("<|im_start|>"), escape_role(F.when(is_head, F.col("system.role")).otherwise(F.col("role"))), F.lit("\n")).alias("mark"),
            escape(F.when(is_head, F.col("system.text")).otherwise(F.col("text"))).alias("body"),
            ((F.col("p.kind") == 2) & (F.col("role") == "assistant")).alias("target"),
        ).alias("x"),
    )
    tail = "<|im_end|>\n"
    made = piece.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    spans = F.aggregate(
        "xs", start,
        lambda s, x: F.struct(
            (s["at"] + F.length(x["mark"]) + F.length(x["body"]) + len(tail)).alias("at"),
            F.when(x["target"], F.concat(s["loss"], F.array(F.struct((s["at"] + F.length(x["mark"])).alias("start"), F.length(x["body"]).alias("length"))))).otherwise(s["loss"]).alias("loss"),
        ),
    )["loss"]
    return made.select(
        "conv_id", "window", F.size(F.filter("xs", lambda x: x["kind"] < 2)).alias("n_repeated"),
        F.concat_ws("", F.transform("xs", lambda x: F.concat(x["mark"], x["body"], F.lit(tail)))).alias("formatted"), spans.alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window the new turns (array of role, text) and the texts under the loss mask, parsed from ``formatted`` alone."""
    pieces = F.slice(F.split("formatted", F.lit("<\\|im_end\\|>\n")), 1, F.greatest(F.size(F.split("formatted", F.lit("<\\|im_end\\|>\n"))) - 1, F.lit(0)))
    new = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - F.col("n_repeated"), F.lit(0)))

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len("<|im_start|>") + 1))
        cut = F.locate("\n", body)
        return F.struct(unescape_role(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(body, cut + 1)).alias("text"))

    masked = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "window", F.length("formatted").alias("n_chars"), F.transform(new, turn).alias("turns"), masked.alias("targets"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what the output holds, read back from it."""
    w = read_back(formatted).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("ws"), F.sum("n_chars").alias("formatted_chars"))
    turns = F.flatten(F.transform("ws", lambda w: w["turns"]))
    loss = F.concat_ws("", F.flatten(F.transform("ws", lambda w: w["targets"])))
    listing = F.concat_ws("", F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return w.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(listing, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
