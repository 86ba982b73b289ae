"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation:

    conversation := "<s>" turn*
    turn         := "[INST]" text "[/INST]"            user
                  | "[OUT]" text "</s>"                assistant
                  | "[SYS]" text "[/SYS]"              system
                  | "[ROLE]" name "[:]" text "[/ROLE]" any other role

`[` and `<` open every control string. Inside texts three escapes are reserved, `%5B`,
`%3C` and `%25`; the reader always resolves them. A conversation is rendered verbatim
first, read back by the parser below and compared with its source; if any turn differs,
its conflicting texts (those holding a control string or a reserved escape) are escaped,
and if the result still differs, all texts are. The last form always reads back, since
no `[` or `<` is left in any text.

Defined results: null text or role is empty; rows of a conversation are ordered by
(turn, role, text), nulls first, so ties and repeated rows have one order; a null conv_id is one
conversation of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

BEGIN = "<s>"
#: role -> (opening, closing) control strings
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER_OPEN, OTHER_MID, OTHER_CLOSE = "[ROLE]", "[:]", "[/ROLE]"
CONTROL = (BEGIN, *[m for pair in MARKS.values() for m in pair], OTHER_OPEN, OTHER_MID, OTHER_CLOSE)
#: (plain, escaped), in the order in which they are escaped; they are resolved in the opposite order
ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def contains_any(text: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(text, F.lit(mark))
    return found


def conflicts(text: Column) -> Column:
    """True where a text holds a control string or a reserved escape."""
    return contains_any(text, (*CONTROL, *[coded for _, coded in ESCAPES]))


def _open(role: Column) -> Column:
    out = F.concat(F.lit(OTHER_OPEN), escape(role), F.lit(OTHER_MID))
    for name, (opening, _) in MARKS.items():
        out = F.when(role == name, F.lit(opening)).otherwise(out)
    return out


def _close(role: Column) -> Column:
    out = F.lit(OTHER_CLOSE)
    for name, (_, closing) in MARKS.items():
        out = F.when(role == name, F.lit(closing)).otherwise(out)
    return out


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>> (escapes resolved).

    Deterministic: the string is cut before every opening mark; each piece names its role
    by that mark and ends with its closing mark. A control string left inside a text is a
    grammar error: that turn's text is null, so it equals no source.
    """
    opens = [opening for opening, _ in MARKS.values()] + [OTHER_OPEN]
    cut = "(?=" + "|".join("\\Q" + o + "\\E" for o in opens) + ")"
    body = F.substr(formatted, F.lit(len(BEGIN) + 1))
    found = F.filter(F.split(body, cut), lambda p: p != "")

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(OTHER_OPEN) + 1))
        inner = F.substr(inner, F.lit(1), F.greatest(F.char_length(inner) - len(OTHER_CLOSE), F.lit(0)))
        mid = F.locate(OTHER_MID, inner)
        role, text = F.substr(inner, F.lit(1), mid - 1), F.substr(inner, mid + len(OTHER_MID))
        for name, (opening, closing) in MARKS.items():
            hit = F.startswith(piece, F.lit(opening))
            own = F.substr(piece, F.lit(len(opening) + 1),
                           F.greatest(F.char_length(piece) - len(opening) - len(closing), F.lit(0)))
            role, text = F.when(hit, F.lit(name)).otherwise(role), F.when(hit, own).otherwise(text)
        clean = ~contains_any(text, CONTROL)
        return F.struct(unescape(role).alias("role"), F.when(clean, unescape(text)).alias("text"))

    return F.transform(found, turn)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, level (0 verbatim, 1 conflicting texts escaped, 2 all escaped), loss_spans.

    `loss_spans` are the (start, length) code-point ranges of the assistant texts inside
    `formatted`, in order: the loss mask. Offsets come from running sums of the rendered
    lengths under the same partitioning as the grouping, so one shuffle serves both.
    """
    src = rows.select(F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
                      F.coalesce(F.col("text"), F.lit("")).alias("text"))
    src = src.withColumn("opening", _open(F.col("role"))).withColumn("closing", _close(F.col("role")))
    src = src.withColumn("escaped", escape(F.col("text")))
    src = src.withColumn("mild", F.when(conflicts(F.col("text")), F.col("escaped")).otherwise(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = ("text", "mild", "escaped")
    marks = F.char_length("opening") + F.char_length("closing")
    placed = src.select("*", F.row_number().over(order).alias("pos"), *[
        (F.coalesce(F.sum(marks + F.char_length(c)).over(before), F.lit(0)) + len(BEGIN)
         + F.char_length("opening") + 1).cast("long").alias(f"at_{c}") for c in levels])
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "pos", "role", *levels, "opening", "closing", *[f"at_{c}" for c in levels]))).alias("turns"))

    def render(field: str) -> Column:
        return F.concat(F.lit(BEGIN), F.array_join(F.transform(
            "turns", lambda t: F.concat(t["opening"], t[field], t["closing"])), ""))

    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    plain = turns.withColumn("source", source).withColumn("f0", render("text"))
    plain = plain.withColumn("ok0", parse(F.col("f0")) == F.col("source"))
    mild = plain.withColumn("f1", F.when(~F.col("ok0"), render("mild")))
    mild = mild.withColumn("ok1", F.when(~F.col("ok0"), parse(F.col("f1")) == F.col("source")))
    done = mild.withColumn("level", F.when(F.col("ok0"), 0).when(F.col("ok1"), 1).otherwise(2))

    def spans(field: str) -> Column:
        own = F.filter("turns", lambda t: t["role"] == "assistant")
        return F.transform(own, lambda t: F.struct(t[f"at_{field}"].alias("start"),
                                                   F.char_length(t[field]).alias("length")))

    return done.select(
        "conv_id",
        F.when(F.col("level") == 0, F.col("f0")).when(F.col("level") == 1, F.col("f1"))
         .otherwise(render("escaped")).alias("formatted"),
        "level",
        F.when(F.col("level") == 0, spans("text")).when(F.col("level") == 1, spans("mild"))
         .otherwise(spans("escaped")).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader of the formatted strings and loss masks recovers."""
    out = formatted.withColumn("turns", parse(F.col("formatted")))
    masked = F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), s["start"].cast("int"), s["length"]))
    out = out.withColumn("loss", F.array_join(F.transform(masked, unescape), ""))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
