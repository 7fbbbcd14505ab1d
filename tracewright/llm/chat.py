"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes one example: all preceding turns as context and that reply as the
only trainable text.  A conversation that does not end in an assistant turn adds one example
without trainable text that holds its remaining turns, so the output holds every turn.

A turn is written ``<s>[ROLE]role[/ROLE][INST]text[/INST]</s>``.  Inside roles and texts, each
control string gets a backslash after its first character (one more than it has), which is
undone by taking one away; no text can therefore end a turn or start another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TAIL = r"(/?s>|/?INST\]|/?ROLE\])"
ESCAPE = (r"([<\[])(\\*)" + _TAIL, r"$1$2\\$3")
UNESCAPE = (r"([<\[])\\(\\*)" + _TAIL, r"$1$2$3")
HEAD, MIDDLE, END = "<s>[ROLE]", "[/ROLE][INST]", "[/INST]</s>"
TURN = r"(?s)<s>\[ROLE\](.*?)\[/ROLE\]\[INST\](.*?)\[/INST\]</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def expand(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trainable_role: str = "assistant",
) -> DataFrame:
    """One row per example: conv, example (int, from 0), n_turns (int), formatted (string), loss_start and
    loss_chars (int; code points of the trainable text in ``formatted``, start from 0, null where
    nothing is trainable), last (boolean: holds all turns of the conversation).

    Turns are ordered by turn, then role and text, so ties and repeated rows stay in a fixed
    order; null turns come first, null roles and texts are empty, rows of a null conversation
    form one.  An empty table gives no rows; other columns are not carried.  The examples of one
    conversation are built row by row from its turns, which must fit a task; they hold a turn
    as often as replies follow it, by the definition of the expansion.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = df.groupBy(F.col(conv_col).alias("conv")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")))).alias("turns")
    )
    made = turns.select(
        "conv",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(HEAD), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(END)).alias("whole"),
                F.length(escape(t["text"])).alias("chars"),
                (t["role"] == trainable_role).alias("target"),
            ),
        ).alias("turns"),
    )
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda k: (k == n) | F.element_at("turns", k)["target"])
    rows = made.select("conv", "turns", F.posexplode(ends).alias("example", "n_turns"))
    mine = F.element_at("turns", F.col("n_turns"))
    formatted = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("n_turns")), lambda t: t["whole"]), "")
    out = rows.select(
        "conv",
        "example",
        "n_turns",
        formatted.alias("formatted"),
        F.when(mine["target"], mine["chars"]).alias("loss_chars"),
        (F.col("n_turns") == n).alias("last"),
    )
    start = F.when(F.col("loss_chars").isNotNull(), F.length("formatted") - F.col("loss_chars") - len(END))
    return out.select("conv", "example", "n_turns", "formatted", start.alias("loss_start"), "loss_chars", "last")


def read_back(examples: DataFrame) -> DataFrame:
    """Turns and trainable text of each conversation as parsed from the formatted examples.

    Returns conv, turns (array of role and text), loss_text, formatted_chars.
    """
    whole = F.when(F.col("last"), F.col("formatted"))
    loss = unescape(F.expr("substring(formatted, loss_start + 1, loss_chars)"))
    slim = examples.select(
        "conv", "example", whole.alias("whole"), F.length("formatted").cast("long").alias("chars"), F.coalesce(loss, F.lit("")).alias("loss")
    )
    got = slim.groupBy("conv").agg(
        F.max("whole").alias("whole"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses")
    )
    pairs = F.arrays_zip(
        F.regexp_extract_all("whole", F.lit(TURN), F.lit(1)).alias("role"), F.regexp_extract_all("whole", F.lit(TURN), F.lit(2)).alias("text")
    )
    return got.select(
        "conv",
        F.transform(pairs, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss_text"),
        "formatted_chars",
    )


def digests(read: DataFrame) -> DataFrame:
    """The digest columns of a read-back table."""
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    33 + length(regexp_replace(coalesce(role, ''), '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\])', '\1\2\\\3', 'g'))
       + length(regexp_replace(coalesce(text, ''), '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\])', '\1\2\\\3', 'g')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM c
), x AS (
  SELECT *, sum(CASE WHEN role = 'assistant' OR k = n THEN 1 ELSE 0 END)
    OVER (PARTITION BY conv_id ORDER BY k DESC) AS times
  FROM e
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars * times)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""
assert len(HEAD + MIDDLE + END) == 33
