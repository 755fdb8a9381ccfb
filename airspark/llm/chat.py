"""Chat formatting: a finite-state machine over roles, and text with a loss mask.

A declarative template gives each role the strings around its text and says whether
its text counts for the loss. Control strings contain ``<`` or ``[``; texts cannot,
because ``~``, ``<`` and ``[`` are written as ``~0``, ``~1`` and ``~2`` there. So no
text can open or close a turn, and reading back is exact.

The machine walks over the roles of a conversation; a role without a transition from
the present state leaves the state as it is and counts as a violation. Conversations
with violations are formatted whole and flagged.

Defined cases: null texts and roles are empty strings; roles that the template does
not know are written with their name; rows without a conv_id form one conversation
with that id; equal turn numbers are ordered by role, then text, null turns come
first; an empty table gives an empty result; other columns are not read. The text of
one conversation is one value, as the digest over all its turns requires.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Part:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    start: str = "<s>"
    roles: dict[str, Part] = field(
        default_factory=lambda: {
            "system": Part("<<SYS>>", "<</SYS>>"),
            "user": Part("[INST]", "[/INST]"),
            "assistant": Part("[OUT]", "</s>", loss=True),
        }
    )
    #: Around the name of any other role; its text follows.
    named: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/END]")
    #: (state, role) to state; the first state is "start".
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    ends: tuple[str, ...] = ("answered",)


DEFAULT = Template()


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("~"), F.lit("~0"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("~1"), F.lit("<")), F.lit("~2"), F.lit("["))
    return F.replace(text, F.lit("~0"), F.lit("~"))


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id and ``turns``, an ordered array of role and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def walk(turns: Column, template: Template = DEFAULT) -> Column:
    """The machine's end: ``state`` and the number of ``violations``."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])

    def step(at: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat(at["state"], F.lit("\n"), turn["role"]))
        return F.struct(
            F.coalesce(to, at["state"]).alias("state"),
            (at["violations"] + F.when(to.isNull(), 1).otherwise(0)).alias("violations"),
        )

    return F.aggregate(turns, F.struct(F.lit("start").alias("state"), F.lit(0).alias("violations")), step)


def segments(turns: Column, template: Template = DEFAULT) -> Column:
    """Text pieces in order, each with its loss flag; control strings are pieces without loss."""

    def pieces(turn: Column) -> Column:
        role = turn["role"]
        before = F.concat(F.lit(template.named[0]), escape(role), F.lit(template.named[1]))
        after, loss = F.lit(template.named[2]), F.lit(False)
        for name, part in template.roles.items():
            before = F.when(role == name, part.before).otherwise(before)
            after = F.when(role == name, part.after).otherwise(after)
            loss = F.when(role == name, part.loss).otherwise(loss)
        piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(piece(before, F.lit(False)), piece(escape(turn["text"]), loss), piece(after, F.lit(False)))

    head = F.array(F.struct(F.lit(template.start).alias("text"), F.lit(False).alias("loss")))
    return F.concat(head, F.flatten(F.transform(turns, pieces)))


def format_chats(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation.

    Columns: conv_id, formatted, loss_spans (array of start and end in code points of
    ``formatted``, end exclusive), violations, complete (no violation and an end state).
    """
    seen = conversations_of(rows).select(
        "conv_id", segments(F.col("turns"), template).alias("segments"), walk(F.col("turns"), template).alias("walk")
    )
    ends = F.transform("segments", lambda s: F.length(s["text"]))
    # Running lengths: each step prepends to nothing and appends one number.
    spans = F.aggregate(
        F.arrays_zip(ends.alias("n"), F.transform("segments", lambda s: s["loss"]).alias("loss")),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + s["n"]).alias("at"),
            F.when(
                s["loss"],
                F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + s["n"]).alias("end")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return seen.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.col("walk.violations").alias("violations"),
        ((F.col("walk.violations") == 0) & F.col("walk.state").isin(*template.ends)).alias("complete"),
    )


def read_chats(formatted: Column, template: Template = DEFAULT) -> Column:
    """Turns (role, text) from formatted text alone."""
    opened = {part.before: name for name, part in template.roles.items()}
    quote = lambda s: "\\Q" + s + "\\E"
    closers = "|".join(quote(x) for x in [p.after for p in template.roles.values()] + [template.named[2]])
    openers = "|".join([quote(x) for x in opened] + [f"{quote(template.named[0])}[^<\\[]*{quote(template.named[1])}"])
    raw = F.regexp_extract_all(formatted, F.lit(f"({openers})[^<\\[]*({closers})"), F.lit(0))

    def turn(piece: Column) -> Column:
        body = F.regexp_extract(piece, f"^(?:{openers})([^<\\[]*)", 1)
        head = F.regexp_extract(piece, f"^({openers})", 1)
        role = unescape(F.regexp_extract(piece, f"^{quote(template.named[0])}([^<\\[]*)", 1))
        for before, name in opened.items():
            role = F.when(head == before, name).otherwise(role)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(raw, turn)


def chat_digest(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """The contract's columns, read back from ``formatted`` and ``loss_spans``."""
    turns = F.col("turns")
    loss = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))),
        "",
    )
    return (
        formatted.withColumn("turns", read_chats(F.col("formatted"), template))
        .withColumn("_loss", loss)
        .select(
            "conv_id",
            F.size(turns).cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            F.sha2("_loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "violations",
            "complete",
        )
    )
