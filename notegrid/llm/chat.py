"""Chat formatting of typed content parts, with a reversible escape and a loss mask.

A message holds ordered parts: text, image, audio or document. A visitor turns each part into text:
texts are escaped, other parts become placeholders numbered by message and part, with the attachment's
reference and the number of tokens it will expand to recorded beside them. The template is
``<|turn|>role<|text|>body<|end|>`` and a line end. Inside roles and texts a backslash is doubled and
``<|`` gets a backslash between its two characters, as does a ``|`` that begins a later part, so no
control string can arise there, nor across neighbouring parts.

The loss mask is a list of (start, length) spans, in code points of the formatted text: one for the
body of each message whose role is learnt from. Offsets come from a running sum over a conversation's
messages; collecting them uses the same distribution by conversation. Nothing leaves SQL functions.

Null texts and roles are empty; null parts or parts of an unknown type give no text. Messages are
ordered by turn, then role, then text, nulls first; repeated rows stay. Rows without conv_id are one
conversation. A conversation is one output row, so it must fit into one, as its contract asks. Other
columns of the input, whatever their names, have no influence, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """The parts of a message that is one plain text."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"),
                            none.cast("int").alias("width"), none.cast("int").alias("height"),
                            none.cast("double").alias("seconds"), none.cast("int").alias("pages")))


def expanded_tokens(part: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """Tokens a part stands for beside its text: image patches, audio frames or document pages."""
    tiles = F.ceil(F.coalesce(part["width"], F.lit(0)) / patch) * F.ceil(F.coalesce(part["height"], F.lit(0)) / patch)
    return (F.when(part["type"] == "image", tiles)
            .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * audio_rate))
            .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * page_tokens)
            .otherwise(F.lit(0)).cast("long"))


def format_chats(messages: DataFrame, learn_roles: tuple[str, ...] = ("assistant",), patch: int = 14,
                 audio_rate: float = 25.0, page_tokens: int = 800) -> DataFrame:
    """(conv_id, turn, role, parts) to one row per conversation.

    conv_id, n_turns, formatted, loss_spans array<struct<start, length>>, attachments
    array<struct<message, part, type, ref, tokens>> in order, and attachment_tokens.
    """
    slim = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                           F.coalesce("parts", F.expr(f"cast(array() as {PART})")).alias("parts"))
    plain = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), plain)
    rows = slim.withColumn("message", F.row_number().over(order) - 1)

    def visit(part: Column, k: Column) -> Column:
        mark = F.concat(F.lit("<|"), part["type"], F.lit(" "), F.col("message").cast("string"), F.lit("."), k.cast("string"), F.lit("|>"))
        # A text that goes on after another one must not complete a control string with it.
        glued = F.when((k > 0) & F.startswith(part["text"], F.lit("|")), F.lit("\\")).otherwise(F.lit(""))
        return (F.when(part["type"] == "text", F.concat(glued, escape(part["text"])))
                .when(part["type"].isin("image", "audio", "document"), mark).otherwise(F.lit("")))

    def attachment(part: Column, k: Column) -> Column:
        return F.struct(F.col("message"), k.alias("part"), part["type"].alias("type"), part["ref"].alias("ref"),
                        expanded_tokens(part, patch, audio_rate, page_tokens).alias("tokens"))

    body = F.array_join(F.transform("parts", visit), "")
    lead = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    listed = F.filter(F.transform("parts", attachment), lambda a: a["type"].isin("image", "audio", "document"))
    rows = rows.select("conv_id", "message", F.col("role").isin(*learn_roles).alias("learnt"), lead.alias("lead"),
                       body.alias("body"), listed.alias("attachments"))
    run = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("lead") + F.length("body") + len(END)
    rows = rows.withColumn("start", F.sum(size.cast("long")).over(run) - len(END) - F.length("body"))
    piece = F.struct("message", "start", F.length("body").cast("long").alias("length"), "learnt",
                     F.concat("lead", "body", F.lit(END)).alias("text"), "attachments")
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["learnt"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    attachments = F.flatten(F.transform("p", lambda x: x["attachments"]))
    return held.select("conv_id", F.size("p").cast("long").alias("n_turns"),
                       F.array_join(F.transform("p", lambda x: x["text"]), "").alias("formatted"),
                       spans.alias("loss_spans"), attachments.alias("attachments"),
                       F.aggregate(attachments, F.lit(0).cast("long"), lambda t, a: t + a["tokens"]).alias("attachment_tokens"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from formatted text; placeholders stay as they are."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")

    def parse(piece: Column) -> Column:
        # The first control string ends the role; the last one, always there, ends the body.
        at = F.instr(piece, TEXT)
        inner = F.substr(piece, at + len(TEXT), F.length(piece) - at - len(TEXT) - len(END) + 1)
        return F.struct(unescape(F.substr(piece, F.lit(1), at - 1)).alias("role"), unescape(inner).alias("text"))

    return F.transform(pieces, parse)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, one span after another."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
