"""Chat formatting with Spark expressions only.

Each conversation becomes one string: adjacent turns of one role form a block

    <|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT...]<|im_end|>\\n

Inside roles and texts a backslash is doubled and `<|` becomes `<\\|`; a line feed in a role becomes `<\\n>`. As other
backslashes come in pairs, this can be undone, and no control string can come from a text. The loss mask is a list of
runs (bytes, loss) over the UTF-8 bytes of the string; assistant texts are under it, headers and separators are not.

Turns are collected as structs, partly on the map side, and sorted by (turn, role, text), so ties and repeated rows
have one result. Null roles and texts are empty; a null conv_id is a conversation of its own; an empty table gives no
rows; other columns are not touched. A conversation is one string by definition, so its turns meet in one row; all
work on its text is linear in its length (the list of loss texts is copied by reference with each turn).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<\\n>"), F.lit("\n")))


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted string, loss_mask array<struct<bytes, loss>>."""
    rows = turns.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    ts = F.col("ts")

    def pieces(t: Column, i: Column) -> Column:
        same_before = F.when(i == 0, F.lit(False)).otherwise(F.try_element_at(ts, F.greatest(i, F.lit(1)))["role"] == t["role"])
        same_after = F.coalesce(F.try_element_at(ts, i + 2)["role"] == t["role"], F.lit(False))
        head = F.when(same_before, F.lit(SEP)).otherwise(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")))
        tail = F.when(same_after, F.lit("")).otherwise(F.lit(END + "\n"))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), tail.alias("tail"), (t["role"] == LOSS_ROLE).alias("loss"))

    built = sorted_turns.select("conv_id", F.transform("ts", pieces).alias("ps"))
    run = lambda c, loss: F.struct(F.octet_length(c).alias("bytes"), loss.alias("loss"))
    return built.select(
        "conv_id",
        F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.flatten(F.transform("ps", lambda p: F.array(run(p["head"], F.lit(False)), run(p["body"], p["loss"]), run(p["tail"], F.lit(False))))).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>."""
    quoted = lambda s: s.replace("|", "\\|")
    blocks = F.filter(F.split(formatted, quoted(END) + "\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        inner = F.substring(block, len(START) + 1, 2147483647)
        role = F.substring_index(inner, "\n", 1)
        body = F.substr(inner, F.char_length(role) + 2)
        return F.transform(F.split(body, quoted(SEP), -1), lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    raw = F.encode(formatted, "UTF-8")
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, run: Column) -> Column:
        text = F.decode(F.substr(raw, acc["at"], run["bytes"]), "UTF-8")
        return F.struct((acc["at"] + run["bytes"]).alias("at"), F.when(run["loss"], F.array_append(acc["parts"], text)).otherwise(acc["parts"]).alias("parts"))

    return F.aggregate(mask, start, step, lambda acc: F.transform(acc["parts"], unescape))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("ts"), F.array_join(masked_texts(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    return read.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
