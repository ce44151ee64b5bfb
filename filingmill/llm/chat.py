"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is
trainable. A conversation that does not end with an assistant turn gets one further example without a trainable part, so
that every turn can be read back.

The template writes `<s>text</s>` for an assistant and `[INST]role`, a line feed, `text[/INST]` for any other role. Of
the four control strings none can be left in a text: one backslash is put after the first character of each
(`</s>` to `<\\/s>`), and one more where backslashes stand there already, which reading takes out again.

Defined results: null text or role is empty; turns are ordered by (turn, role, text), so ties and repeated rows stay,
next to each other; rows with a null conv_id are one conversation; an empty table gives no examples; other columns are
not read. One example holds a whole conversation, so that is also what one row has to hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(/?(?:s>|INST\]))", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(/?(?:s>|INST\]))", r"$1$2$3")


def _escape_role(role: Column) -> Column:
    """A role has no line feed of its own in the output: every backslash is followed by s (itself) or n."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\")))


def render_turn(role: Column, text: Column) -> Column:
    return F.when(role == TARGET_ROLE, F.concat(F.lit("<s>"), escape(text), F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST]"), _escape_role(role), F.lit("\n"), escape(text), F.lit("[/INST]"))
    )


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, target (position of the trained turn, from 1), formatted, mask_start (from 1; null without a trained
    turn), mask_chars, final (whether formatted has all turns of the conversation)."""
    turns = conversations.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
                )
            )
        ).alias("turns")
    )
    rendered = turns.select(
        "conv_id",
        F.transform("turns", lambda t: t.role == TARGET_ROLE).alias("_own"),
        F.transform("turns", lambda t: render_turn(t.role, t.text)).alias("_out"),
    )
    ends = F.expr("filter(sequence(1, size(_out)), i -> _own[i - 1] OR i = size(_out))")
    one = rendered.select("conv_id", "_own", "_out", F.explode(ends).alias("target"))
    is_target = F.expr("_own[target - 1]")
    before = F.array_join(F.expr("slice(_out, 1, target - 1)"), "")
    own = F.expr("_out[target - 1]")
    one = one.select(
        "conv_id", "target", before.alias("_before"), own.alias("_last"), is_target.alias("_trained"),
        (F.col("target") == F.size("_out")).alias("final"),
    )
    return one.select(
        "conv_id",
        "target",
        F.concat("_before", "_last").alias("formatted"),
        F.when(F.col("_trained"), F.length("_before") + 4).alias("mask_start"),
        F.when(F.col("_trained"), F.length("_last") - 7).otherwise(0).alias("mask_chars"),
        "final",
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> out of a formatted example."""
    pieces = F.filter(F.split(formatted, r"(?<=</s>)|(?<=\[/INST\])"), lambda p: p != "")

    def one(p: Column) -> Column:
        body = F.when(p.startswith("<s>"), F.substring(p, 4, 2**30)).otherwise(F.substring(p, 7, 2**30))
        role = F.substring_index(body, "\n", 1)
        rest = F.substr(body, F.length(role) + 2)
        return F.when(
            p.startswith("<s>"),
            F.struct(F.lit(TARGET_ROLE).alias("role"), unescape(F.substr(body, F.lit(1), F.length(body) - 4)).alias("text")),
        ).otherwise(
            F.struct(_unescape_role(role).alias("role"), unescape(F.substr(rest, F.lit(1), F.length(rest) - 7)).alias("text"))
        )

    return F.transform(pieces, one)


def read_loss(formatted: Column, mask_start: Column, mask_chars: Column) -> Column:
    """The text under the loss mask; empty where nothing is trained."""
    return F.when(mask_start.isNotNull(), unescape(F.substr(formatted, mask_start, mask_chars))).otherwise("")


def conversation_digest(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples alone. No second shuffle: examples of a conversation are
    already together."""
    read = examples.select(
        "conv_id",
        "target",
        read_loss(F.col("formatted"), F.col("mask_start"), F.col("mask_chars")).alias("_loss"),
        F.when(F.col("final"), read_turns(F.col("formatted"))).alias("_turns"),
        F.length("formatted").cast("long").alias("_chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target", "_loss"))), lambda x: x["_loss"]), "").alias("_loss"),
        F.element_at(F.collect_list("_turns"), 1).alias("_turns"),
        F.sum("_chars").alias("formatted_chars"),
    )
    text = F.array_join(F.transform("_turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return whole.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
