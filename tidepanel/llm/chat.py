"""Chat formatting with Spark expressions only.

The rows of a conversation are collected as structs, sorted by turn, and turned into one string: adjacent turns of one
role share a block, in which their texts stay apart, so that the turns can be read back.

    <|turn:ROLE|>\\nTEXT<|and|>TEXT<|end|>\\n

Control strings inside roles and texts, this template's and those of other common ones, get a backslash behind their
first character, and backslashes are doubled; ``unescaped`` undoes both. The loss mask is a list of spans of the string,
in code points from 0, end exclusive: exactly the texts of the given role.

Null texts and roles count as empty. Rows without a conversation id form one conversation with a null id. Turns with
equal numbers follow each other by role, then text; null turns come first. Repeated rows are turns of their own. Texts of
any length and any number of turns are whole, in time by their length. Other columns are left out, whatever their names.
An empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

#: Turns whose offsets are worked out together.
STRETCH = 128
OPEN, HEAD_END, AND, END = "<|turn:", "|>\n", "<|and|>", "<|end|>\n"
#: The strings that texts must not hold as they are.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _java(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\|[]<>/" else c for c in text)


ESCAPED = "(\\\\" + "".join(f"|{_java(c[0])}(?={_java(c[1:])})" for c in CONTROL) + ")"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1\\\\"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """A row for each conversation: its id, ``formatted`` and ``loss``, the spans of the texts whose role is ``learn``."""
    rows = df.select(F.col(conv).alias(conv), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy(conv).agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        starts = (i == 0) | (t["role"] != F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"])
        head = F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(OPEN), escaped(t["role"]), F.lit(HEAD_END))
        return F.struct(F.when(starts, head).otherwise(F.lit(AND)).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == learn).alias("learn"))

    spans = "array<struct<start:int,end:int>>"

    def grown(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    # Offsets within stretches of turns, then those of the stretches: a list that grows by one is copied each time.
    pieces = turns.select(conv, F.transform("turns", piece).alias("pieces"))
    stretch = lambda i: F.slice("pieces", i * STRETCH + 1, STRETCH)
    of_stretch = lambda i: F.aggregate(stretch(i), F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans")), grown)
    last = F.floor((F.size("pieces") - 1) / STRETCH).cast("int")
    cut = pieces.select(conv, "pieces", F.transform(F.sequence(F.lit(0), last), of_stretch).alias("stretches"))
    ends = F.aggregate("stretches", F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s["at"])))
    cut = cut.select(conv, "pieces", "stretches", ends.alias("ends"))
    moved = lambda s, i: F.transform(s["spans"], lambda x: F.struct((x["start"] + F.col("ends")[i]).alias("start"), (x["end"] + F.col("ends")[i]).alias("end")))
    return cut.select(
        conv,
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), ""), F.lit(END)).alias("formatted"),
        F.flatten(F.transform("stretches", moved)).alias("loss"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns, as role and text, that a formatted string holds."""
    blocks = F.filter(F.split(formatted, "<\\|end\\|>\n", -1), lambda b: b != "")

    def of(block: Column) -> Column:
        head = F.substring_index(block, HEAD_END, 1)
        role = unescaped(F.substr(head, F.lit(len(OPEN) + 1)))
        body = F.substr(block, F.length(head) + F.lit(len(HEAD_END) + 1))
        return F.transform(F.split(body, "<\\|and\\|>", -1), lambda s: F.struct(role.alias("role"), unescaped(s).alias("text")))

    return F.flatten(F.transform(blocks, of))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, CAST(n AS BIGINT) AS turn, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END AS role, '{said}' AS text FROM VALUES (0), (1) AS t(n)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = format_chat(rows).select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("learnt"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_GROWTH = " + ".join(["(length({0}) - length(replace({0}, '\\', '')))"] + [f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in CONTROL])

ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS starts,
    length(text) + {_GROWTH.format("text")} AS body, length(role) + {_GROWTH.format("role")} AS head
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN starts THEN head + {len(OPEN) + len(HEAD_END) + len(END)} ELSE {len(AND)} END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
