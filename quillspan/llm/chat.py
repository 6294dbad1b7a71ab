"""Chat formatting: rendered conversations that a deterministic parser reads back as they were.

Grammar: ``conversation = turn*``, ``turn = "<s>" role "[INST]" text "[/INST]" "</s>"``. The four marks are the
control strings. A mark inside a role or text would be read as template, so it is escaped: an escape
sign is put behind the mark's first character. A mark that already has such signs gets one more, and
reading takes one away, so escaping can always be undone. A conversation is rendered as it stands and
read back; if what comes back is not what went in, it is rendered again with escapes and read back
again, and a conversation that were still not identical would end the job. Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, TEXT_END, TURN_END = "<s>", "[INST]", "[/INST]", "</s>"
#: U+241B, SYMBOL FOR ESCAPE
SIGN = "␛"
_MARK = r"/?(?:s>|INST\])"
TRAINED = "assistant"

SOURCE = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    """Every control string with one escape sign more behind its first character."""
    return F.regexp_replace(text, rf"([<\[])({SIGN}*{_MARK})", f"$1{SIGN}$2")


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`; a text without escaped control strings is left as it is."""
    return F.regexp_replace(text, rf"([<\[]){SIGN}({SIGN}*{_MARK})", "$1$2")


def render(turns: Column, written) -> Column:
    """The conversation as one string; ``written`` is applied to roles and texts."""
    one = lambda t: F.concat(F.lit(TURN), written(t["role"]), F.lit(TEXT), written(t["text"]), F.lit(TEXT_END + TURN_END))
    return F.array_join(F.transform(turns, one), "")


def _literal(mark: str) -> str:
    return rf"\Q{mark}\E"


def _pieces(formatted: Column) -> Column:
    """What stands before each end of a turn; the last one is what is left over."""
    return F.split(formatted, _literal(TURN_END), -1)


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, or null if it does not follow the grammar."""
    pieces = _pieces(formatted)
    heads = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    fits = F.forall(heads, lambda p: p.startswith(TURN) & p.endswith(TEXT_END) & (F.size(F.split(p, rf"{_literal(TURN)}|{_literal(TEXT)}|{_literal(TEXT_END)}", -1)) == 4))

    def turn(p: Column) -> Column:
        cut = F.instr(p, TEXT)
        role = F.substring(p, F.lit(len(TURN) + 1), cut - (len(TURN) + 1))
        text = F.substring(p, cut + len(TEXT), F.length(p) - cut - (len(TEXT) + len(TEXT_END)) + 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.when(fits & (F.element_at(pieces, -1) == ""), F.transform(heads, turn))


def trained_spans(formatted: Column) -> Column:
    """Where the loss is taken: (start, length) in code points, from 0, of each assistant text as it is written."""
    pieces = _pieces(formatted)
    heads = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def step(state: Column, p: Column) -> Column:
        cut = F.instr(p, TEXT)
        trained = F.substring(p, F.lit(len(TURN) + 1), cut - (len(TURN) + 1)) == TRAINED
        span = F.struct((state["at"] + cut + (len(TEXT) - 1)).alias("start"), (F.length(p) - cut - (len(TEXT) + len(TEXT_END)) + 1).alias("length"))
        spans = F.when(trained, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + F.length(p) + len(TURN_END)).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(heads, start, step, lambda s: s["spans"])


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, formatted, rounds, loss_spans): a row for each conversation; ``rounds`` counts renderings.

    Turns are ordered by turn (nulls first), then role and text. Null roles and texts are empty; rows of a
    null conversation id belong to nothing and are a conversation each; repeated rows are repeated turns; an
    empty table gives an empty result; other columns take no part. A conversation is one row by nature; its
    turns are combined per task before they meet.
    """
    said = rows.select(F.col(conv_col), F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("said"))
    whole = said.filter(F.col(conv_col).isNotNull()).groupBy(conv_col).agg(F.array_sort(F.collect_list("said")).alias("said"))
    whole = whole.union(said.filter(F.col(conv_col).isNull()).select(conv_col, F.array("said")))
    turns = whole.select(conv_col, F.transform("said", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).cast(SOURCE).alias("turns"))
    now = turns.withColumn("formatted", render(F.col("turns"), lambda x: x)).withColumn("rounds", F.lit(1))
    now = now.withColumn("same", parse(F.col("formatted")).eqNullSafe(F.col("turns")))
    now = now.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(render(F.col("turns"), escape))).withColumn("rounds", F.when(F.col("same"), 1).otherwise(2))
    checked = now.withColumn("same", parse(F.col("formatted")).eqNullSafe(F.col("turns")))
    sure = F.when(F.col("same"), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation cannot be read back")))
    return checked.select(conv_col, sure.alias("formatted"), "rounds").withColumn("loss_spans", trained_spans(F.col("formatted")))
