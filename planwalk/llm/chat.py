"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and its text alone trainable. A
conversation whose last turn isn't the assistant's ends in one more example without a trainable text, so that no turn
is lost. The template writes a turn as

    </s>[ROLE]role[/ROLE]text[/INST]

with `</s>[ROLE]`, `[/ROLE]` and `[/INST]` as control strings. Inside roles and texts `~` is written `~0`, `<` is `~1` and
`[` is `~2`: every control string starts with `<` or `[`, so none can come from a text, and undoing the three gives the
text back.

    formatted: the turns end to end. target_first, target_chars: where the trainable text lies (0-based code points).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, ROLE_END, TURN_END = "</s>[ROLE]", "[/ROLE]", "[/INST]"
TRAINED_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape(role), F.lit(ROLE_END), escape(text), F.lit(TURN_END))


def format_examples(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, target_turn, formatted, target_first, target_chars): the examples of each conversation.

    Turns come by turn_col, ties by role and text; repeated rows are turns of their own. A null text or role is empty; a
    null conversation id is a conversation; null turns come first. target_turn counts turns from 0; target_first and
    target_chars are null in an example without a trainable text. An empty trainable text has 0 characters. An empty table gives
    no examples. Other columns are not read.

    An example holds its whole context, so a conversation of n turns costs up to n times its text: that is the format.
    The context is put together for each example from the turns of its conversation, which meet in one row.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    talks = df.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    shown = F.transform("turns", lambda x: F.struct(_turn(x["role"], x["text"]).alias("shown"), (x["role"] == TRAINED_ROLE).alias("trained"), F.char_length(escape(x["role"])).alias("role_chars"), F.char_length(escape(x["text"])).alias("text_chars")))
    talks = talks.select("conv_id", shown.alias("turns"))
    last = F.size("turns") - 1
    places = F.filter(F.sequence(F.lit(0), last), lambda k: F.get("turns", k)["trained"] | (k == last))
    targets = talks.select("conv_id", "turns", F.explode(places).alias("target_turn"))
    context = F.array_join(F.transform(F.slice("turns", 1, F.col("target_turn")), lambda x: x["shown"]), "")
    targets = targets.select("conv_id", "target_turn", context.alias("context"), F.get("turns", F.col("target_turn")).alias("target"))
    trained = F.col("target.trained")
    return targets.select(
        "conv_id",
        F.col("target_turn").cast("bigint").alias("target_turn"),
        F.concat("context", "target.shown").alias("formatted"),
        F.when(trained, F.char_length("context") + F.lit(len(START) + len(ROLE_END)) + F.col("target.role_chars")).cast("bigint").alias("target_first"),
        F.when(trained, F.col("target.text_chars")).cast("bigint").alias("target_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    parts = F.slice(F.split(formatted, F.lit(r"\Q" + START + r"\E"), -1), 2, 1 << 30)
    cut = F.transform(parts, lambda x: F.split(F.substring(x, F.lit(1), F.char_length(x) - len(TURN_END)), F.lit(r"\Q" + ROLE_END + r"\E"), 2))
    return F.transform(cut, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def read_target(formatted: Column, first: Column, chars: Column) -> Column:
    """The trainable text of an example; null if it has none."""
    return unescape(F.substring(formatted, (first + 1).cast("int"), chars.cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """What the examples say of each conversation: its turns from the longest example, its trainable texts from each one's span.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars); formatted_chars adds up all examples.
    Texts are only put together within a conversation.
    """
    target = read_target(F.col("formatted"), F.col("target_first"), F.col("target_chars"))
    parts = examples.select("conv_id", "target_turn", "formatted", target.alias("target"))
    grouped = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("target_turn", "target"))).alias("targets"), F.max_by("formatted", "target_turn").alias("longest"), F.sum(F.char_length("formatted")).alias("formatted_chars"))
    turns = grouped.select("conv_id", "formatted_chars", read_turns(F.col("longest")).alias("turns"), F.array_join(F.transform("targets", lambda x: x["target"]), "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return turns.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("bigint").alias("formatted_chars"))
