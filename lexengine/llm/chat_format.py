"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "### " name ": " body "\\n</turn>\\n"
    body         := any text without a bare control string
    control      := "### " | "</turn>"        bare: not preceded by a backslash

Escaping puts one backslash in front of every control string of a text; reading a body takes one
backslash away from every control string that has any. The template writes a line feed in front of
its own control strings, so a text that ends in a backslash cannot hide them.

A conversation is first rendered as it is, parsed, and compared with its source. Where the turns
that come back differ, its texts are escaped and the round trip is made again; a conversation that
still differed would raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.llm.common import table

#: Roles with a name of their own in the template; any other role is written as role=<URL-encoded>.
ROLE_NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
CONTROL = r"(### |</turn>)"
BARE_CONTROL = r"(?<!\\)(?:### |</turn>)"
END = "\n</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, r"\\" + CONTROL, "$1")


def role_name(role: Column) -> Column:
    name = F.concat(F.lit("role="), F.url_encode(role))
    for known, shown in ROLE_NAMES.items():
        name = F.when(role == known, F.lit(shown)).otherwise(name)
    return name


def _role_of(name: Column) -> Column:
    role = F.when(name.startswith("role="), F.try_url_decode(F.substr(name, F.lit(6))))
    for known, shown in ROLE_NAMES.items():
        role = F.when(name == shown, F.lit(known)).otherwise(role)
    return role


def head(role: Column) -> Column:
    return F.concat(F.lit("### "), role_name(role), F.lit(": "))


def render(turns: Column, escaped: bool) -> Column:
    """The formatted text of an array of (role, text)."""
    shown = (lambda t: escape(t)) if escaped else (lambda t: t)
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t.role), shown(t.text), F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """The (role, text) turns of a formatted text; null if it breaks the grammar."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")

    def turn(piece: Column) -> Column:
        name = F.regexp_extract(piece, "(?s)^### ([^:\n]*): ", 1)
        body = F.regexp_replace(piece, "(?s)^### [^:\n]*: ", "")
        sound = piece.rlike("(?s)^### [^:\n]*: ") & ~body.rlike(BARE_CONTROL)
        return F.when(sound, F.struct(_role_of(name).alias("role"), unescape(body).alias("text")))

    turns = F.transform(pieces, turn)
    whole = F.forall(turns, lambda t: t.isNotNull()) & ((formatted == "") | formatted.endswith(END))
    return F.when(whole, turns)


def _spans(turns: Column, escaped: Column) -> Column:
    """The places (start from 0, end exclusive; code points) of assistant bodies in the text."""

    def add(acc: Column, t: Column) -> Column:
        body = F.when(escaped, escape(t.text)).otherwise(t.text)
        start = acc["at"] + F.length(head(t.role))
        end = start + F.length(body)
        span = F.when(t.role == "assistant", F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + F.lit(len(END))).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, first, add)["spans"]


def format_chats(rows: DataFrame) -> DataFrame:
    """One row per conv_id: formatted text, loss spans and the turns that reading it back gives.

    rows needs conv_id, turn, role and text; other columns are ignored. Turns come by turn (nulls
    first), ties by role and text. Null texts and null roles count as empty; a null conv_id is a
    conversation of its own. An empty table gives no rows. One conversation is one text, so its
    turns meet in one row; conversations are spread over all tasks.
    """
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn"), F.lit(-(2**63))).alias("turn"), "role", "text"))).alias("sorted"))
    chats = chats.select("conv_id", F.transform("sorted", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))
    plain = chats.withColumn("plain", render(F.col("turns"), False))
    plain = plain.withColumn("escaped", ~F.coalesce(parse(F.col("plain")) == F.col("turns"), F.lit(False)))
    done = plain.withColumn("formatted", F.when(F.col("escaped"), render(F.col("turns"), True)).otherwise(F.col("plain"))).drop("plain")
    done = done.withColumn("parsed", parse(F.col("formatted")))
    same = F.coalesce(F.col("parsed") == F.col("turns"), F.lit(False))
    done = done.withColumn("parsed", F.when(same, F.col("parsed")).otherwise(F.raise_error(F.concat(F.lit("the round trip changes conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))))
    return done.select("conv_id", "formatted", "escaped", "parsed", _spans(F.col("turns"), F.col("escaped")).alias("loss_spans"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    probe = spark.sql(
        "SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, t AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role) CROSS JOIN (SELECT :t AS t)",
        args={"t": tricky},
    )
    chats = format_chats(rows.unionByName(probe))
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s.start + 1, s.end - s.start))), "")
    told = F.array_join(F.transform("parsed", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    read = chats.withColumn("loss", masked)
    return read.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(length('### ')
           + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE length('role=' || url_encode(role)) END
           + length(': ') + length(regexp_replace(text, '(### |</turn>)', '\\\1', 'g'))
           + length(chr(10) || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
