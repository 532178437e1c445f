"""Chat records for fine-tuning: building, validation, prompt choice and split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions.order import hashed_position
from colophon.functions.text import strip
from colophon.functions.vocab import DEPTH, TRAINING_FUNCTION
from colophon.operators.quality import validity

# Roles of a turn, and the lines of the user turn with the column of each.
ROLES = ("system", "user", "assistant")
USER_LINES = (("Self-cited Article Index", "article_index"), ("Self-cited Article Title", "title"), ("Citation Location", "location"), ("Citation Content", "content"))
MESSAGE_SCHEMA = "messages array<struct<role:string,content:string>>"


def user_prompt() -> Column:
    """The four lines of a user turn, from the columns of ``USER_LINES``."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c), F.lit(""))) for name, c in USER_LINES])


def assistant_answer(function: Column, depth: Column) -> Column:
    """The answer as a JSON object, with a space after colon and comma."""
    # a JSON text is what to_json writes between the name and the closing brace
    value = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'^\{"x":(.*)\}$', 1)
    return F.concat(F.lit('{"Final Citation Function": '), value(function), F.lit(', "Final Citation Depth": '), value(depth), F.lit("}"))


def labelled_rows(rows: DataFrame) -> DataFrame:
    """Rows (key, article_index, title, content, location, function, depth) with trimmed cells and ``reason``.

    ``reason`` is '' for a valid row, 'blank' for a blank one, else the first required field that is blank or the label
    that isn't in its list.
    """
    cells = ["article_index", "title", "content", "location", "function", "depth"]
    clean = rows.select("key", *[F.coalesce(strip(F.col(c)), F.lit("")).alias(c) for c in cells])
    return validity(clean, ["title", "content", "location"], {"function": TRAINING_FUNCTION, "depth": DEPTH})


def build(rows: DataFrame, long_prompt: str, short_prompt: str, long_rate: float = 0.5, seed: int = 42) -> DataFrame:
    """(key, messages) of the valid rows: system, user and assistant turn. The prompt is drawn by a hash of seed and key."""
    share = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col("key").cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    system = F.when(share < long_rate, long_prompt).otherwise(short_prompt)
    turns = [("system", system), ("user", user_prompt()), ("assistant", assistant_answer(F.col("function"), F.col("depth")))]
    listed = F.array(*[F.struct(F.lit(role).alias("role"), c.alias("content")) for role, c in turns])
    return labelled_rows(rows).where("reason = ''").select("key", listed.alias("messages"))


def split(records: DataFrame, ratio: float, seed: int = 42, key: str = "key") -> DataFrame:
    """Adds ``place`` (order of a shuffle by hash) and ``split``: validation takes the first max(1, n * ratio), rounded half to even.

    With ratio 0 there is no validation. A validation split that would leave no training record is an error.
    """
    named = records.withColumn("_name", F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    placed = hashed_position(named, [], "_name", "place", "_n") if ratio else hashed_position(named, [], "_name", "place").withColumn("_n", F.lit(0))
    many = F.greatest(F.lit(1), F.bround(F.col("_n") * ratio).cast("long")) if ratio else F.lit(0)
    checked = F.when(F.lit(bool(ratio)) & (many >= F.col("_n")), F.raise_error(F.lit("the validation split leaves no training record")))
    return placed.withColumn("split", F.coalesce(checked, F.when(F.col("place") < many, "validation").otherwise("train"))).drop("_name", "_n")


def message_fault(messages: Column) -> Column:
    """Why the turns of a record are invalid, or '': no list or an empty one, an unknown role, content that is no text."""
    return (
        F.when(messages.isNull() | (F.size(messages) == 0), "no messages")
        .when(F.exists(messages, lambda m: m.isNull()), "message is no object")
        .when(F.exists(messages, lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False))), "unsupported role")
        .when(F.exists(messages, lambda m: m["content"].isNull()), "content is no text")
        .otherwise("")
    )


def line_faults(lines: DataFrame, line: str = "value") -> DataFrame:
    """Adds ``messages`` and ``fault`` to JSON lines: blank line, invalid JSON, not an object, or a fault of the turns.

    Content that is a number or an object is no text, though a parser would turn it into one.
    """
    value = F.col(line)
    parsed = lines.withColumn("_kind", F.expr(f"try_parse_json(`{line}`)")).withColumn("_root", F.expr("schema_of_variant(_kind)"))
    parsed = parsed.withColumn("messages", F.from_json(value, MESSAGE_SCHEMA)["messages"])
    contents = F.expr("try_variant_get(_kind, '$.messages', 'array<variant>')")
    bad_content = F.exists(
        contents, lambda m: F.call_function("schema_of_variant", F.call_function("try_variant_get", m, F.lit("$.content"), F.lit("variant"))) != "STRING"
    )
    bad_turn = F.exists(contents, lambda m: ~F.call_function("schema_of_variant", m).startswith("OBJECT"))
    fault = (
        F.when(value.isNull() | ~value.rlike(r"\S"), "blank line").when(F.col("_kind").isNull(), "invalid JSON")
        .when(~F.col("_root").startswith("OBJECT"), "not an object").when(contents.isNull() | (F.size(contents) == 0), "no messages")
        .when(bad_turn, "message is no object").when(message_fault(F.col("messages")) == "unsupported role", "unsupported role")
        .when(F.coalesce(bad_content, F.lit(True)), "content is no text").otherwise(message_fault(F.col("messages")))
    )
    return parsed.withColumn("fault", fault).drop("_kind", "_root")


def prompt_text(system: str, user: str, template: str = "{system}\n\n{user}") -> str:
    """One prompt of a filter call from its two texts."""
    return template.format(system=system, user=user)
