"""Chat formatting: typed content parts flattened into one training string.

A visitor turns each message's parts (text, image, audio, document) into text: text
parts are escaped, the others become an ordered placeholder, with an attachment row
holding its reference and the number of tokens it expands to. Messages become

    <|turn|>ROLE newline CONTENT<|end|> newline

Every control string starts with a head (``<`` or ``[``) followed by a tail (``|``,
``s>``, ``/s>``, ``INST]``, ``/INST]``). Inside texts a ``~`` is stuffed between head
and tail, one more than stand there already, so no control string survives and
removing one ``~`` restores the text.

Everything is DataFrame expressions. A conversation is one output string, so its
rows meet in one place; before that the turns are only measured by a running sum,
and nothing in a conversation is scanned twice.

Defined results
* turns are ordered by (turn, role, text), nulls first; repeated rows are turns;
* null role or text: empty; null ``conv_id``: a conversation of its own;
* only turns whose role is ``assistant`` are under the loss mask;
* unknown part types are treated as documents; a null list of parts is empty;
* an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed control strings of the template.
TURN, END = "<|turn|>", "<|end|>"
_TAILS = r"(?:\||/?s>)"
_STUFF = rf"(<(?=~*{_TAILS})|\[(?=~*/?INST\]))"
_UNSTUFF = rf"(<(?=~+{_TAILS})|\[(?=~+/?INST\]))~"

#: Tokens an attachment expands to: image patches of 28 x 28, audio frames a second,
#: document tokens a page. Fixed values of this template.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _STUFF, "$1~")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNSTUFF, "$1")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # escaped backslashes come in pairs from the left; what lies between them has only \\n
    between = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(between, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def expanded_tokens(part: Column) -> Column:
    """Tokens that stand for a part in the model's input; null for text."""
    patches = F.ceil(F.coalesce(part["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / PATCH)
    return (
        F.when(part["type"] == "text", F.lit(None).cast("long"))
        .when(part["type"] == "image", patches.cast("long"))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE).cast("long"))
        .otherwise((F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS).cast("long"))
    )


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("")) == "text"


def visit(parts: Column) -> tuple[Column, Column]:
    """Content string and attachments (ordinal, type, ref, tokens) of a list of parts."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    kind = lambda p: F.when(p["type"].isin("image", "audio"), p["type"]).otherwise("document")
    content = F.array_join(
        F.transform(
            parts,
            lambda p: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
                F.concat(F.lit("<|"), kind(p), F.lit("|>"))
            ),
        ),
        "",
    )
    others = F.filter(parts, lambda p: ~_is_text(p))
    attachments = F.transform(
        others,
        lambda p, i: F.struct(
            i.alias("ordinal"), kind(p).alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")
        ),
    )
    return content, attachments


def text_parts(text: Column) -> Column:
    """A plain text as a list with one text part."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            text.alias("text"),
            none.cast("string").alias("ref"),
            none.cast("int").alias("width"),
            none.cast("int").alias("height"),
            none.cast("double").alias("seconds"),
            none.cast("int").alias("pages"),
        )
    )


def format_conversations(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, parts) -> conv_id, formatted, loss, attachments, n_tokens_attached.

    ``loss`` lists (turn, start, length): the place of each masked text, in code
    points, inside the formatted text of its turn. ``attachments`` lists (turn,
    ordinal, type, ref, tokens).
    """
    content, attached = visit(F.col("parts"))
    role = F.coalesce(F.col("role"), F.lit(""))
    raw = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "")
    rows = messages.select(
        "conv_id", "turn", role.alias("role"), raw.alias("raw"), content.alias("content"), attached.alias("attached")
    )
    # equal turns go by the texts themselves, not by what escaping makes of them
    order = W.partitionBy("conv_id").orderBy("turn", "role", "raw", "content")
    rows = rows.withColumn("place", F.row_number().over(order) - 1).withColumn("head", _escape_role(F.col("role")))
    span = F.struct(
        F.col("place").alias("turn"),
        (F.char_length("head") + len(TURN) + 1).alias("start"),
        F.char_length("content").alias("length"),
    )
    turn = F.struct(
        F.col("place"),
        F.concat(F.lit(TURN), F.col("head"), F.lit("\n"), F.col("content"), F.lit(END + "\n")).alias("piece"),
        F.when(F.col("role") == "assistant", span).alias("span"),
        F.col("attached"),
    )
    turns = F.sort_array(F.collect_list(turn))
    convs = rows.groupBy("conv_id").agg(turns.alias("turns"))
    attachments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.transform(
                t["attached"],
                lambda a: F.struct(t["place"].alias("turn"), a["ordinal"], a["type"], a["ref"], a["tokens"]),
            ),
        )
    )
    return convs.select(
        "conv_id",
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss"),
        attachments.alias("attachments"),
    ).withColumn(
        "n_tokens_attached",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + F.coalesce(a["tokens"], F.lit(0).cast("long"))),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted strings: conv_id, turns array<struct<role,text>>, loss_text."""
    # the text before the first marker is empty; a null string has no turns
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 1 << 30)
    df = formatted.withColumn("_pieces", pieces)

    def parse(piece):
        head = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.char_length(head) + 2, F.char_length(piece) - F.char_length(head) - 2 - len(END))
        return F.struct(_unescape_role(head).alias("role"), unescape(body).alias("text"))

    masked = F.transform(
        "loss",
        # a span counts from the turn's marker, which the split has taken away
        lambda s: unescape(F.substr(F.get(F.col("_pieces"), s["turn"]), s["start"] - len(TURN) + 1, s["length"])),
    )
    return df.select(
        "conv_id",
        "formatted",
        F.transform("_pieces", parse).alias("turns"),
        F.array_join(masked, "").alias("loss_text"),
    )


def digest(parsed: DataFrame) -> DataFrame:
    """The contract's columns from what ``read_back`` found."""
    lines = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
