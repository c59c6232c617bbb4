"""Chat formatting: typed content parts become one marked text per conversation, read back without loss."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Control strings of this template and of common others; none of them survives inside a text.
CONTROLS = ("<|turn|>", "<|says|>", "<|done|>", "<|image|>", "<|audio|>", "<|document|>",
            "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
#: Put after the first character of a control string that is meant as text.
GUARD = "␛"
ATTACHED = ("image", "audio", "document")


@dataclass(frozen=True)
class Template:
    """The marks around turns, the roles to learn from, and what an attachment expands to in tokens."""

    turn: str = "<|turn|>"
    says: str = "<|says|>"
    done: str = "<|done|>"
    learned: tuple[str, ...] = ("assistant",)
    patch: int = 14
    audio_rate: float = 25.0
    page_tokens: int = 256
    controls: tuple[str, ...] = CONTROLS


def _spots(template: Template, guard: str) -> str:
    """A pattern for the place after the first character of a control string, with ``guard`` there; more guards may follow."""
    rests: dict[str, list[str]] = {}
    for control in dict.fromkeys((template.turn, template.says, template.done, *template.controls)):
        rests.setdefault(control[0], []).append(re.escape(control[1:]))
    return "|".join(f"(?<={re.escape(first)}){guard}(?={GUARD}*(?:{'|'.join(rest)}))" for first, rest in rests.items())


def escape(text: Column, template: Template = Template()) -> Column:
    """The text with one guard more in each control string, guarded or not; any other text stays as it is."""
    return F.regexp_replace(text, _spots(template, ""), GUARD)


def unescape(text: Column, template: Template = Template()) -> Column:
    """The inverse of :func:`escape`: one guard less in each guarded control string."""
    return F.regexp_replace(text, _spots(template, GUARD), "")


def text_parts(text: Column) -> Column:
    """A plain text (null is empty) as a list with one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text")))


def _shown(parts: Column, template: Template) -> Column:
    """Visits the parts: neighbouring texts are joined and escaped as one text, attachments become placeholders."""
    text = F.lit("").cast("string")
    visited = F.aggregate(
        parts, F.struct(text.alias("out"), text.alias("run")),
        lambda a, p: F.when(p["type"].isin(*ATTACHED), F.struct(
            F.concat(a["out"], escape(a["run"], template), F.lit("<|"), p["type"], F.lit("|>")).alias("out"), text.alias("run")))
        .otherwise(F.struct(a["out"].alias("out"), F.concat(a["run"], F.coalesce(p["text"], text)).alias("run"))),
        lambda a: F.concat(a["out"], escape(a["run"], template)))
    return F.coalesce(visited, text)


def _attached(parts: Column, names: set[str], template: Template) -> Column:
    """The attachments among the parts as ``(kind, ref, tokens)``; tokens are 0 where a size is missing."""
    def of(part: Column, name: str, kind: str) -> Column:
        return (part[name] if name in names else F.lit(None)).cast(kind)

    def tokens(p: Column) -> Column:
        many = (F.when(p["type"] == "image", F.ceil(of(p, "width", "int") / template.patch) * F.ceil(of(p, "height", "int") / template.patch))
                .when(p["type"] == "audio", F.ceil(of(p, "seconds", "double") * template.audio_rate))
                .otherwise(of(p, "pages", "long") * template.page_tokens))
        return F.coalesce(many.cast("long"), F.lit(0).cast("long"))

    return F.transform(F.filter(parts, lambda p: p["type"].isin(*ATTACHED)), lambda p: F.struct(
        p["type"].alias("kind"), of(p, "ref", "string").alias("ref"), tokens(p).alias("tokens")))


def format_chats(turns: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: its marked text, where the loss applies, and its attachments.

    ``parts`` is an array of structs with ``type`` and ``text`` and, for attachments, any of ``ref``, ``width``,
    ``height``, ``seconds`` and ``pages``. Text parts become escaped text; an image, audio or document part
    becomes a placeholder. Placeholders and ``attachments`` are in the same order. Unknown and null types
    count as text. Null texts and roles are empty; a null or empty list says nothing.

    Columns: the conversation key, ``formatted``, ``loss`` (byte offset and byte length of each learned turn's
    text), ``attachments`` (``ordinal, turn, kind, ref, tokens``) and ``expanded_tokens``, their sum.
    Turns are ordered by number (null first), then role and text; repeated rows stay. Rows with a null key form
    one conversation. Other columns are ignored. Turns share one shuffle; a conversation is one row in the end,
    so each must fit in a task, however many there are.
    """
    kind = turns.schema[parts].dataType
    names = set(kind.elementType.names)
    said = turns.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(parts, F.array().cast(kind)).alias("p"))
    said = said.select("c", "t", "r", F.concat(F.lit(template.turn), escape(F.col("r"), template), F.lit(template.says)).alias("head"),
                       _shown(F.col("p"), template).alias("shown"), _attached(F.col("p"), names, template).alias("a"))
    order = W.partitionBy("c").orderBy("t", "r", "shown", "a")
    size = F.octet_length("head") + F.octet_length("shown") + len(template.done.encode())
    placed = said.select("c", "t", "r", "head", "shown", "a", F.row_number().over(order).alias("n"),
                         F.coalesce(F.sum(size.cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("at"))
    one = F.struct("n", F.concat("head", "shown", F.lit(template.done)).alias("text"), "t", "a", F.when(
        F.col("r").isin(*template.learned), F.struct((F.col("at") + F.octet_length("head")).alias("start"),
                                                      F.octet_length("shown").cast("long").alias("length"))).alias("span"))
    whole = placed.groupBy("c").agg(F.sort_array(F.collect_list(one)).alias("all"))
    found = F.flatten(F.transform("all", lambda x: F.transform(x["a"], lambda p: F.struct(x["t"].alias("turn"), p["kind"], p["ref"], p["tokens"]))))
    return whole.select(
        F.col("c").alias(conv), F.array_join("all.text", "").alias("formatted"), F.filter("all.span", lambda s: s.isNotNull()).alias("loss"),
        F.transform(found, lambda p, i: F.struct(i.alias("ordinal"), p["turn"], p["kind"], p["ref"], p["tokens"])).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """``array<struct<role, text>>`` of a formatted conversation, unescaped; attachments show as placeholders."""
    marked = F.split(formatted, re.escape(template.done))
    whole = F.slice(marked, 1, F.size(marked) - 1)
    # A turn is its mark, the role, the second mark and the text: each mark occurs once.
    return F.transform(whole, lambda t: F.struct(
        unescape(F.substring_index(F.substr(t, F.lit(len(template.turn) + 1)), template.says, 1), template).alias("role"),
        unescape(F.get(F.split(t, re.escape(template.says)), F.lit(1)), template).alias("text")))


def read_loss(formatted: Column, loss: Column, template: Template = Template()) -> Column:
    """The unescaped texts under the loss mask, in order, as an array."""
    data = formatted.cast("binary")
    return F.transform(loss, lambda s: unescape(
        F.substr(data, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"), template))
