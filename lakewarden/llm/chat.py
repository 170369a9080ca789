r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Template: every turn is `### Role: text</turn>` and a line feed. A text is first rendered as it is;
a deterministic parser reads the rendered conversation back, and where the turns it finds are not
those of the source, the texts are escaped and the result is parsed again. The parser cuts at
`### ` and demands exactly one `</turn>` and line feed at the end of each piece, splits the role off
at the first `: `, and then undoes escapes: `\l` is `<`, `\h` is `#`, `\c` is `:`, `\b` is a
backslash. Escaping replaces backslashes, `<` before `/turn>`, and `###` before a blank; as an
escape holds none of the characters it stands for, the escaped text holds no control string, and
undoing it gives the text back. That is checked, not assumed: `round_trip` is the comparison.

Roles user, assistant and system are written with a capital; any other role is written as `@` and
the escaped name, so that it comes back as it was. A null role is the role `null` written as `@\0`.

The loss mask is a list of (begin, length) in code points of the formatted text, one per assistant
turn, covering its text and nothing of the template.

Defined results: a null text is empty. Rows of a conversation are ordered by turn, then role and
text (nulls first), so repeated turns are kept and reruns agree. Rows without conv_id form a
conversation of their own. An empty table gives no rows. Extra columns are ignored. A conversation
is one output row, so all its turns meet in one group; nothing larger is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, COLON = "### ", "</turn>", ": "
NAMED = ("user", "assistant", "system")


def _replaced(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escaped(text: Column) -> Column:
    text = _replaced(text, "\\", "\\b")
    text = _replaced(text, CLOSE, "\\l/turn>")
    return _replaced(text, OPEN, "\\h\\h\\h ")


def unescaped(text: Column) -> Column:
    for code, plain in (("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\b", "\\")):
        text = _replaced(text, code, plain)
    return text


def _header(role: Column) -> Column:
    other = F.concat(F.lit("@"), _replaced(escaped(role), ":", "\\c"))
    return F.when(role.isNull(), "@\\0").when(role.isin(*NAMED), F.initcap(role)).otherwise(other)


def _role(header: Column) -> Column:
    named = F.when(header.isin(*[n.capitalize() for n in NAMED]), F.lower(header))
    return named.when(header == "@\\0", F.lit(None)).otherwise(
        unescaped(F.substr(header, F.lit(2))))


def _rendered(turns: Column, text) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), _header(t["role"]), F.lit(COLON), text(t["text"]), F.lit(CLOSE + "\n"))), "")


def _pieces(formatted: Column) -> Column:
    """What follows each opening mark. Nothing stands before the first one."""
    pieces = F.split(formatted, OPEN, -1)
    return F.slice(pieces, F.lit(2), F.size(pieces))


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text; null in place of a turn that is malformed."""
    pieces = _pieces(formatted)
    end = CLOSE + "\n"

    def turn(piece: Column) -> Column:
        body = F.substring_index(piece, end, 1)
        at = F.instr(body, COLON)
        whole = (F.concat(body, F.lit(end)) == piece) & ~F.contains(body, F.lit(CLOSE)) & (at > 0)
        return F.when(whole, F.struct(
            _role(F.substr(body, F.lit(1), at - 1)).alias("role"),
            unescaped(F.substr(body, at + len(COLON))).alias("text")))

    return F.transform(pieces, turn)


def _same(turns: Column, other: Column) -> Column:
    pairs = F.zip_with(turns, other, lambda a, b: (
        b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])))
    return (F.size(turns) == F.size(other)) & F.forall(pairs, lambda same: same)


def loss_spans(formatted: Column) -> Column:
    """(begin, length) of each assistant text in the formatted text, found by the grammar."""
    pieces = _pieces(formatted)
    head, tail = len(OPEN), len(CLOSE) + 1
    start = F.struct(F.lit(1).alias("at"), F.array().cast(
        "array<struct<begin:int,length:int>>").alias("spans"))
    mark = "Assistant" + COLON

    def step(state: Column, piece: Column) -> Column:
        span = F.struct((state["at"] + head + len(mark)).cast("int").alias("begin"),
                        (F.length(piece) - len(mark) - tail).cast("int").alias("length"))
        spans = F.when(F.startswith(piece, F.lit(mark)),
                       F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + head + F.length(piece)).cast("int").alias("at"),
                        spans.alias("spans"))

    return F.aggregate(pieces, start, step, lambda state: state["spans"])


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, turns, formatted, escaped (whether it took escapes), loss_spans, round_trip."""
    row = F.struct(
        F.col("turn"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = (conversations.select(F.col("conv_id"), row.alias("row"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
             .select("conv_id", F.transform("rows", lambda r: F.struct(
                 r["role"].alias("role"), r["text"].alias("text"))).alias("turns")))
    plain = turns.withColumn("plain", _rendered(F.col("turns"), lambda text: text))
    tried = plain.withColumn("clean", _same(F.col("turns"), parsed(F.col("plain"))))
    done = tried.withColumn("formatted", F.when(F.col("clean"), F.col("plain")).otherwise(
        _rendered(F.col("turns"), escaped)))
    return done.select(
        "conv_id", "turns", "formatted", (~F.col("clean")).alias("escaped"),
        loss_spans(F.col("formatted")).alias("loss_spans"),
        _same(F.col("turns"), parsed(F.col("formatted"))).alias("round_trip"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, the turns parsed from `formatted`, and the text under the loss mask, unescaped."""
    under = F.array_join(F.transform("loss_spans", lambda s: unescaped(
        F.substr(F.col("formatted"), s["begin"], s["length"]))), "")
    return chats.select("conv_id", parsed(F.col("formatted")).alias("turns"),
                        under.alias("loss_text"), "formatted")
