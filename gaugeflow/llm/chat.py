"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

The template names each role's opening and closing marks and whether its text is trained on; the
machine's transitions say which role may follow which. Formatting emits segments (text, loss flag)
in order; their concatenation is the formatted conversation, and the loss mask is also given as spans of it. Inside texts and unknown role names every
character that can begin a mark, and the escape character itself, is replaced by an escape code, so
no mark can arise inside a text or across its borders, and ``parse`` gets every text back exactly.

Behaviour: null text counts as empty, a null role as the role ''. Turns are taken by ``turn`` (nulls
first), then role and text, so ties and repeated rows have one order. An unknown role or a transition
that the machine lacks makes the conversation invalid (``valid`` false, ``error_turn`` the first such
place from 0); it is formatted all the same. An empty table gives an empty result; extra columns are
ignored. A conversation is one row of output, so its turns do meet in one task; conversations of a
hot key are of the same task only if they share an id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    name: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks, roles, transitions and escapes; ``{role}`` in ``opening`` stands for the role's name.

    ``marks`` has every control string that a model or another template may read as such. Each of
    them, and each opening and closing, must begin with a character of ``lead``.
    """

    opening: str = "<|start|>{role}\n"
    closing: str = "<|end|>\n"
    roles: tuple[Role, ...] = (Role("system"), Role("user"), Role("assistant", loss=True))
    transitions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("user", "assistant")
    marks: tuple[str, ...] = ("<|start|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    lead: str = "<["
    escape: str = "\\"

    def codes(self) -> list[tuple[str, str]]:
        """(character, code): the escape character first, as 0."""
        return [(c, f"{self.escape}{i}") for i, c in enumerate(self.escape + self.lead)]

    def check(self) -> None:
        for mark in (*self.marks, self.opening, self.closing):
            if not mark or mark[0] not in self.lead or self.escape in mark or any(c in mark[1:] for c in self.lead if mark in (self.opening, self.closing)):
                raise ValueError(f"mark {mark!r} must begin with one of {self.lead!r}, without the escape character")


def escaped(text: Column, template: Template) -> Column:
    for c, code in template.codes():
        text = F.replace(text, F.lit(c), F.lit(code))
    return text


def unescaped(text: Column, template: Template) -> Column:
    for c, code in reversed(template.codes()):
        text = F.replace(text, F.lit(code), F.lit(c))
    return text


def role_code(role: Column, template: Template) -> Column:
    """A role's name on the opening's line: escaped, line ends too."""
    e = template.escape
    return F.replace(escaped(role, template), F.lit("\n"), F.lit(f"{e}n"))


def format_conversations(turns: DataFrame, template: Template = Template(), conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """conv_id, segments (array of text and loss), formatted, loss_spans (start and end, exclusive, of the trained texts in ``formatted``), n_turns, valid and error_turn; one row a conversation."""
    template.check()
    d = turns.select(
        F.col(conv_column).cast("long").alias("conv_id"), F.col(turn_column).cast("long").alias("turn"),
        F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    trained = [r.name for r in template.roles if r.loss]
    before, after = template.opening.split("{role}")
    head = lambda t: F.concat(F.lit(before), role_code(t["role"], template), F.lit(after))
    row = {"role": F.col("role"), "text": F.col("text")}
    # where each text lies in the formatted conversation: lengths of what comes before it, summed in the turns' order
    d = d.withColumns({"opens": F.char_length(head(row)), "size": F.char_length(escaped(row["text"], template))})
    earlier = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("opens") + F.col("size") + len(template.closing)).over(earlier), F.lit(0)) + F.col("opens")
    d = d.select("conv_id", F.struct("turn", "role", "text", start.alias("start"), (start + F.col("size")).alias("end")).alias("t"))
    d = d.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # the machine: state is the last role, "!" once a turn is out of order; bad is that turn's place
    moves = F.array(*[F.lit(f"{a}>{b}") for a, nexts in template.transitions.items() for b in nexts])
    first = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))
    step = lambda s, t: F.struct(t["role"].alias("state"), (s["at"] + 1).alias("at"), F.when((s["bad"] < 0) & ~F.array_contains(moves, F.concat(s["state"], F.lit(">"), t["role"])), s["at"]).otherwise(s["bad"]).alias("bad"))
    d = d.withColumn("end", F.aggregate("turns", first, step))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    d = d.withColumn("segments", F.flatten(F.transform("turns", lambda t: F.array(part(head(t), no), part(escaped(t["text"], template), t["role"].isin(*trained)), part(F.lit(template.closing), no)))))
    ended = F.col("end.state").isin(*template.final)
    return d.select(
        "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["role"].isin(*trained)), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"),
        F.size("turns").cast("long").alias("n_turns"), ((F.col("end.bad") < 0) & ended).alias("valid"),
        F.when(F.col("end.bad") >= 0, F.col("end.bad")).when(~ended, F.col("end.at")).alias("error_turn"),
    )


def parse(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds ``turns`` (array of role and text), read back from ``formatted`` alone."""
    template.check()
    before, after = template.opening.split("{role}")
    bodies = F.filter(F.split(F.col("formatted"), _quoted(template.closing)), lambda x: x != "")
    # a role's code holds no line end, so the first one ends the opening
    opened = lambda x: F.substr(x, F.lit(len(before) + 1))
    role = lambda x: F.substring_index(opened(x), after, 1)
    text = lambda x: F.substr(x, F.lit(len(before) + len(after) + 1) + F.char_length(role(x)))
    back = lambda r: unescaped(F.replace(r, F.lit(f"{template.escape}n"), F.lit("\n")), template)
    return formatted.withColumn("turns", F.transform(bodies, lambda x: F.struct(back(role(x)).alias("role"), unescaped(text(x), template).alias("text"))))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else "\\n" if c == "\n" else "\\" + c for c in text)


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What the formatted conversations hold: digests of the turns parsed from them and of the texts that the loss spans cut out of them."""
    d = parse(formatted, template)
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), template)), "")
    d = d.withColumn("loss_text", loss)
    return d.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
