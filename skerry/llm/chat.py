"""Chat formatting by prefix-target expansion (native).

A conversation is rendered once; every assistant turn becomes an example of its own whose context is
all that stands before it and of which only that reply is trainable.  An example is a pair of spans
in the rendered conversation, so ``n`` turns give ``n`` short rows instead of ``n`` copies of a
growing prefix; :func:`example_texts` writes the prefixes out where they are wanted.

Template: ``<|turn|>`` role ``<|text|>`` text ``<|end|>``.  In roles and texts every ``<`` that is
followed by backslashes (or none) and ``|`` gets one more backslash, so no control string of the
template can occur in them; :func:`unescaped` takes it away again.

Defined results: a null text or role is empty; rows of one conversation are ordered by turn (null
first), then role, then text, and repeated rows are turns of their own; a null conv_id is a
conversation; a conversation without assistant turns has no examples and is still rendered; an
empty table gives an empty result; further columns are ignored.  A conversation of any length is one
row while it is formatted, so its text must fit into a task's memory (2 GB at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The control strings.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def rendered(conversations: DataFrame, *, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_id, formatted: each conversation in the template."""
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("row"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    one = F.transform("turns", lambda t: F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT), escaped(t["text"]), F.lit(END)))
    return turns.select("conv_id", F.array_join(one, "").alias("formatted"))


def parsed(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text), still escaped, read from the template."""
    parts = F.split(formatted, r"<\|end\|>")
    parts = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(parts, lambda p: F.struct(
        F.substring_index(F.substring(p, F.lit(len(TURN) + 1), F.length(p)), TEXT, 1).alias("role"),
        F.substring(p, F.length(F.substring_index(p, TEXT, 1)) + F.lit(len(TEXT) + 1), F.length(p)).alias("text"),
    ))


def examples(render: DataFrame) -> DataFrame:
    """conv_id, target, loss_start, loss_end, first_byte, end_byte, reply: one row per assistant turn.

    The example's text is the first ``loss_end`` code points of ``formatted`` and the end mark; its
    context is the first ``loss_start`` of them, and only what lies between (``reply``, as it stands
    there) bears loss.  ``first_byte`` and ``end_byte`` are the same mask over the text's UTF-8.
    """
    each = render.select("conv_id", F.posexplode(parsed(F.col("formatted"))).alias("target", "turn"))
    role, text, marks = F.col("turn.role"), F.col("turn.text"), len(TURN) + len(TEXT) + len(END)
    # One prefix sum over the turns of a conversation, which the rendering has put into one row.
    before = Window.partitionBy("conv_id").orderBy("target").rowsBetween(Window.unboundedPreceding, -1)
    for name, size in (("chars", F.length), ("bytes", F.octet_length)):
        each = each.withColumn(name, F.coalesce(F.sum(size(role).cast("long") + size(text) + marks).over(before), F.lit(0)) + size(role) + len(TURN) + len(TEXT))
    each = each.filter(role == TRAINED_ROLE)
    return each.select(
        "conv_id", "target", F.col("chars").alias("loss_start"), (F.col("chars") + F.length(text)).alias("loss_end"),
        F.col("bytes").alias("first_byte"), (F.col("bytes") + F.octet_length(text)).alias("end_byte"), text.alias("reply"),
    )


def example_texts(render: DataFrame) -> DataFrame:
    """conv_id, target, context, reply: the examples with their prefixes written out.

    The output of a conversation grows with the square of its length, as its examples do.
    """
    spans = examples(render)
    joined = spans.join(render.withColumnRenamed("conv_id", "of_id"), F.col("conv_id").eqNullSafe(F.col("of_id")))
    return joined.select("conv_id", "target", F.substring(F.col("formatted"), F.lit(1), F.col("loss_start").cast("int")).alias("context"), "reply")


def digests(render: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the rendering.

    The loss text is what ``masks`` (the examples of ``render``, if not given) cut out of
    ``formatted``, in order; bytes are cut, so a conversation costs its length once.
    """
    turns = parsed(F.col("formatted"))
    plain = F.transform(turns, lambda t: F.concat(unescaped(t["role"]), F.lit("\n"), unescaped(t["text"]), F.lit("\n")))
    whole = render.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(F.encode(F.array_join(plain, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.encode("formatted", "UTF-8").alias("raw"),
    )
    spans = F.sort_array(F.collect_list(F.struct("target", "first_byte", "end_byte")))
    mask = (examples(render) if masks is None else masks).groupBy("conv_id").agg(spans.alias("mask")).withColumnRenamed("conv_id", "of_id")

    def under(span: Column) -> Column:
        cut = F.substring(F.col("raw"), (span["first_byte"] + 1).cast("int"), (span["end_byte"] - span["first_byte"]).cast("int"))
        return unescaped(F.decode(cut, "UTF-8"))

    read = whole.join(mask, F.col("conv_id").eqNullSafe(F.col("of_id")), "left")
    read = read.withColumn("loss", F.array_join(F.transform(F.coalesce("mask", F.array()), under), ""))
    return read.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars"
    )
