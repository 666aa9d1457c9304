"""Chat formatting by grammar round trip, with DataFrame functions only.

A conversation is rendered without escapes, parsed back by a deterministic grammar and compared with its source; turns
that don't come back are rendered again with their control strings escaped, until all are identical. An escape is one
backslash after the opening bracket of anything that looks like a control string, however many are there already, so
that taking one away is exact. Grammar: `[SYS] text [/SYS]`, `[INST] text [/INST]`, `[BOT] text</s>`, and for any other
role `[AS hex] text [/AS]` (role in hex). Null texts and roles count as empty; rows go by turn (null first), then role
and text; an empty table gives no rows. The loss mask covers the texts of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspine.llm.common import table

# The control strings of the template.
CONTROL = r"/?s>|/?INST\]|/?SYS\]|BOT\]|/?AS[ \]]"
LOOKS_LIKE = rf"([<\[])(\\*)({CONTROL})"
ESCAPED = rf"([<\[])\\(\\*)({CONTROL})"
TURN = r"(?s)\[INST\] .*? \[/INST\]|\[SYS\] .*? \[/SYS\]|\[BOT\] .*?</s>|\[AS [0-9A-F]*\] .*? \[/AS\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, LOOKS_LIKE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def opening(role: Column) -> Column:
    return F.when(role == "user", "[INST] ").when(role == "system", "[SYS] ").when(role == "assistant", "[BOT] ").otherwise(F.concat(F.lit("[AS "), F.hex(F.encode(role, "UTF-8")), F.lit("] ")))


def closing(role: Column) -> Column:
    return F.when(role == "user", " [/INST]").when(role == "system", " [/SYS]").when(role == "assistant", "</s>").otherwise(" [/AS]")


def parse_turn(turn: Column) -> Column:
    """Struct of role and text (unescaped) of one rendered turn."""
    as_role = F.decode(F.unhex(F.regexp_extract(turn, r"^\[AS ([0-9A-F]*)\]", 1)), "UTF-8")
    role = F.when(turn.startswith("[INST]"), "user").when(turn.startswith("[SYS]"), "system").when(turn.startswith("[BOT]"), "assistant").otherwise(as_role)
    head, tail = F.char_length(opening(role)), F.char_length(closing(role))
    return F.struct(role.alias("role"), unescape(F.substring(turn, head + 1, F.char_length(turn) - head - tail)).alias("text"))


def parse(formatted: Column) -> Column:
    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), parse_turn)


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans, escaped): one row a conversation.

    loss_spans: start and length in code points of each assistant text as it stands in formatted. escaped: whether the
    plain rendering did not come back and control strings had to be escaped.
    """
    src = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # A turn comes back if it parses to itself, alone: no control string inside, nothing that unescaping would change.
    plain = F.concat(opening(F.col("role")), F.col("text"), closing(F.col("role")))
    back = parse(F.col("plain"))
    same = (F.size("back") == 1) & (F.col("back")[0]["role"] == F.col("role")) & F.col("back")[0]["text"].eqNullSafe(F.col("text")) & ~F.col("text").rlike(LOOKS_LIKE)
    body = F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text")))
    turns = src.withColumn("plain", plain).withColumn("back", back).withColumn("same", same).withColumn("body", body).drop("plain", "back")
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length(opening(F.col("role"))) + F.char_length("body") + F.char_length(closing(F.col("role")))
    turns = turns.withColumn("size", size).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    each = F.struct("start", "turn", "role", "text", "body", "same")
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("turns"))
    rendered = F.concat_ws("", F.transform("turns", lambda x: F.concat(opening(x["role"]), x["body"], closing(x["role"]))))
    spans = F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: F.struct((x["start"] + F.char_length(opening(x["role"]))).cast("int").alias("start"), F.char_length(x["body"]).alias("length")))
    source = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    out = grouped.select("conv_id", rendered.alias("formatted"), spans.alias("loss_spans"), F.exists("turns", lambda x: ~x["same"]).alias("escaped"), source.alias("source"))
    # The whole conversation must come back too; the escapes make that hold, and a break of the grammar shows at once.
    whole = F.when(parse(F.col("formatted")) == F.col("source"), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("chat does not come back: "), F.col("conv_id").cast("string"))))
    return out.select("conv_id", whole.alias("formatted"), "loss_spans", "escaped")


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = rows.sparkSession.range(2).select(F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    out = format_chats(rows.unionByName(extra)).select("conv_id", "formatted", "loss_spans").withColumn("turns", parse(F.col("formatted")))
    spelled = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    masked = F.concat_ws("", F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["length"]))))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spelled, 256).alias("turns_sha256"), F.char_length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


# The rendering is spelled out: two code points for each pair of brackets and so on; only conversations of the three known roles occur.
SQL = r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 10
    ELSE 12 + 2 * strlen(role) END
    + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|BOT\]|/?AS[ \]])', '\1#\2\3', 'g')) - length(text) AS size
  FROM src
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
