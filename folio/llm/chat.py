"""Chat formatting with typed content parts, in DataFrame functions alone.

format_chats() takes one row per turn: conv_id, turn, role, parts, the last an
array of PART structs. A visitor has one method per part type; it flattens the
parts in order into text and placeholders, records each attachment's reference,
and counts the tokens that its placeholder expands to.

Template. A turn is its mark "<|turn:ROLE|>" (role URL-encoded), then
"[INST] TEXT [/INST]", or "TEXT</s>" for the assistant. In texts a backslash
goes behind the bracket of each control string ("[INST]" becomes "[\\INST]",
"[\\INST]" becomes "[\\\\INST]"), which unescape() reverses; other texts stay
as they are.

Defined cases: a null text or a null parts array is the empty text, a null role
the empty role, a null part type a text part; an unknown type is an attachment
of no tokens. Turns go by turn, ties by role then text, null first; repeated
rows are repeated turns. A null conv_id is a conversation of its own. An empty
table gives an empty table. Extra columns are ignored. A conversation is one
row of output, so it must fit into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART = "struct<type:string,text:string,ref:string,units:int>"
#: What stands behind the opening bracket of a control string.
_CONTROL = r"(INST\]|/INST\]|s>|/s>|\|)"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])(\\*)" + _CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)" + _CONTROL, "$1$2$3")


class Visitor:
    """Turns one part into struct(text, kind, ref, tokens); subclass to change a type's rule."""

    #: Tokens for each unit: an image's patches, an audio's 40 ms frames, a document's pages.
    image_tokens, audio_tokens, document_tokens = 1, 1, 256
    types = ("image", "audio", "document")

    def text(self, part: Column, at: Column) -> Column:
        return self._made(escape(F.coalesce(part["text"], F.lit(""))), None, None, F.lit(0))

    def image(self, part: Column, at: Column) -> Column:
        return self._attached("image", part, at, self.image_tokens)

    def audio(self, part: Column, at: Column) -> Column:
        return self._attached("audio", part, at, self.audio_tokens)

    def document(self, part: Column, at: Column) -> Column:
        return self._attached("document", part, at, self.document_tokens)

    def other(self, part: Column, at: Column) -> Column:
        return self._attached("other", part, at, 0)

    def visit(self, part: Column, at: Column) -> Column:
        kind = self.kind(part)
        out = F.when(kind == "text", self.text(part, at))
        for name in self.types:
            out = out.when(kind == name, getattr(self, name)(part, at))
        return out.otherwise(self.other(part, at))

    def kind(self, part: Column) -> Column:
        return F.coalesce(part["type"], F.lit("text"))

    def _attached(self, kind: str, part: Column, at: Column, each: int) -> Column:
        mark = F.concat(F.lit(f"<|{kind}:"), at.cast("string"), F.lit("|>"))
        return self._made(mark, kind, part["ref"], F.coalesce(part["units"], F.lit(1)) * each)

    @staticmethod
    def _made(text: Column, kind: str | None, ref: Column | None, tokens: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(kind).cast("string").alias("kind"), (F.lit(None) if ref is None else ref).cast("string").alias("ref"), tokens.cast("long").alias("tokens"))


def format_chats(turns: DataFrame, visitor: Visitor | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, expanded_tokens.

    loss_spans: array of (start, length) in code points, start from 0, over the
    escaped assistant texts in formatted; attachments: array of (idx, kind, ref,
    tokens) in order.
    """
    visitor = visitor or Visitor()
    parts = F.coalesce(F.col("parts"), F.expr(f"cast(array() as array<{PART}>)"))
    attached = lambda xs: F.size(F.filter(xs, lambda p: visitor.kind(p) != "text"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts")).withColumn("n_attached", attached(F.col("parts")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.to_json("parts"))
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("offset", F.sum("n_attached").over(before) - F.col("n_attached"))
    earlier = lambda i: F.col("offset") + attached(F.slice(F.col("parts"), F.lit(1), i))
    rows = rows.withColumn("made", F.transform("parts", lambda p, i: visitor.visit(p, earlier(i))))
    learnt = F.col("role") == LEARNT
    body = F.array_join(F.transform("made", lambda x: x["text"]), "")
    head = F.concat(F.lit("<|turn:"), F.url_encode("role"), F.lit("|>"), F.when(learnt, "").otherwise("[INST] "))
    rows = rows.withColumns({"head": head, "body": body, "tail": F.when(learnt, "</s>").otherwise(" [/INST]"), "learnt": learnt})
    width = F.length("head") + F.length("body") + F.length("tail")
    rows = rows.withColumn("end", F.sum(width).over(before)).withColumn("at", F.row_number().over(order))
    rows = rows.withColumn("start", F.col("end") - F.length("tail") - F.length("body"))
    kept = F.transform(F.filter("made", lambda x: x["kind"].isNotNull()), lambda x, i: F.struct((F.col("offset") + i).alias("idx"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))
    turn = F.struct("at", F.concat("head", "body", "tail").alias("text"), "learnt", "start", F.length("body").alias("length"), kept.alias("attached"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, x: n + x["tokens"]))


def read_back(chats: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, read from formatted and loss_spans alone.

    Adds turns: array of (role, text), placeholders staying in the text, and loss_text.
    """

    def turn(piece: Column) -> Column:
        role = F.url_decode(F.substring_index(piece, "|>", 1))
        shape = r"(?s)^[^|]*\|>(?:\[INST\] (.*) \[/INST\]|(.*)</s>)$"
        text = F.concat(F.regexp_extract(piece, shape, 1), F.regexp_extract(piece, shape, 2))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    pieces = F.filter(F.split("formatted", r"<\|turn:"), lambda x, i: i > 0)
    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return chats.withColumns({"turns": F.transform(pieces, turn), "loss_text": F.array_join(under, "")})


def text_turns(conversations: DataFrame) -> DataFrame:
    """Rows of plain text as turns of one text part each."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units"))
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def digest(chats: DataFrame) -> DataFrame:
    back = read_back(chats)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
