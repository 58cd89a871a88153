"""Operator 9: chat formatting with a grammar round trip, in DataFrame functions only.

The template writes a user's turn as ``[INST] text [/INST]``, an assistant's as ``<s>text</s>`` and any
other role's as ``<<SYS>>role`` line feed ``text<</SYS>>``. A conversation is first rendered as it is and
parsed again by a fixed grammar, in which a text holds no control string. If the turns that come
back differ from the source, its conflicting content is escaped and the round trip is made again;
a conversation that fails then stops the job. The escape character is U+241B: the first
character of a control string becomes it and a digit, it becomes itself and ``0``, a line feed in a role
itself and ``3``. ``mask`` lists lengths in code points with true for what a model is trained on: the
assistants' texts.

Scale: one shuffle by conversation; a conversation's turns are one row afterwards, as its text is.
Everything after it is per row, without Python.

Cases: null text and null role count as empty (an empty role is written under ``<<SYS>>``); null conv_ids are
one conversation; turns sort by number (null first), then role, then text, repeated rows stay; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "␛"
CONTROL = r"<(?=s>|/s>|<SYS>>|</SYS>>)|\[(?=INST\]|/INST\])"
TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, MARK, MARK + "0")
    text = F.regexp_replace(text, r"<(?=s>|/s>|<SYS>>|</SYS>>)", MARK + "1")
    return F.regexp_replace(text, r"\[(?=INST\]|/INST\])", MARK + "2")


def unescape(text: Column) -> Column:
    for digit, plain in (("1", "<"), ("2", "["), ("3", "\n"), ("0", MARK)):
        text = F.replace(text, F.lit(MARK + digit), F.lit(plain))
    return text


def _escaped_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(MARK + "3"))


def _turn(role: Column, text: Column, raw: Column) -> Column:
    """Opening, text and closing of a turn; ``raw`` is the role as the source has it."""
    opening = F.when(raw == "user", "[INST] ").when(raw == "assistant", "<s>").otherwise(F.concat(F.lit("<<SYS>>"), role, F.lit("\n")))
    closing = F.when(raw == "user", " [/INST]").when(raw == "assistant", "</s>").otherwise("<</SYS>>")
    return F.struct(opening.alias("opening"), text.alias("text"), closing.alias("closing"), (raw == "assistant").alias("loss"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(x.opening, x.text, x.closing)), "")


def parse(formatted: Column) -> Column:
    """role and text, unescaped, and both as they stand there (written_role, written), of every turn of a rendered conversation."""

    def turn(x: Column) -> Column:
        body = F.substring(x, F.lit(8), F.length(x) - 15)
        system = F.when(x.startswith("[INST]"), False).when(x.startswith("<s>"), False).otherwise(True)
        own = F.when(x.startswith("[INST] "), body).when(x.startswith("<s>"), F.substring(x, F.lit(4), F.length(x) - 7)).otherwise(F.substring(x, F.instr(x, "\n") + 1, F.length(x) - F.instr(x, "\n") - 8))
        role = F.when(system, F.substring(x, F.lit(8), F.instr(x, "\n") - 8)).when(x.startswith("<s>"), "assistant").otherwise("user")
        return F.struct(unescape(role).alias("role"), unescape(own).alias("text"), own.alias("written"), role.alias("written_role"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def _same(formatted: Column, turns: Column) -> Column:
    """True if the parser finds the turns, nothing beside them, and no control string in a text or role."""
    found = parse(formatted)
    whole = F.array_join(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), "") == formatted
    equal = F.transform(found, lambda x: F.struct(x.role, x.text)) == F.transform(turns, lambda x: F.struct(x.role, x.text))
    clean = ~F.exists(found, lambda x: F.concat(x.written_role, F.lit(" "), x.written).rlike(CONTROL))
    return whole & equal & clean


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, turns (the source's), formatted, mask (runs of length, loss), escaped (whether it had to be)."""
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    plain = F.transform("turns", lambda x: _turn(x.role, x.text, x.role))
    talks = talks.withColumn("parts", plain).withColumn("escaped", ~_same(_joined(F.col("parts")), F.col("turns")))
    safe = F.transform("turns", lambda x: _turn(_escaped_role(x.role), escape(x.text), x.role))
    talks = talks.withColumn("parts", F.when(F.col("escaped"), safe).otherwise(F.col("parts"))).withColumn("formatted", _joined(F.col("parts")))
    sure = F.when(~F.col("escaped") | _same(F.col("formatted"), F.col("turns")), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("no round trip: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    runs = F.flatten(F.transform("parts", lambda x: F.array(F.struct(F.length(x.opening).alias("length"), F.lit(False).alias("loss")), F.struct(F.length(x.text).alias("length"), x.loss.alias("loss")), F.struct(F.length(x.closing).alias("length"), F.lit(False).alias("loss")))))
    return talks.select("conv_id", "turns", sure.alias("formatted"), runs.alias("mask"), "escaped")


def digests(rendered: DataFrame) -> DataFrame:
    """What the rendered conversations say, read back by the parser and the mask."""
    back = rendered.select("conv_id", "formatted", "mask", parse(F.col("formatted")).alias("found"))
    under = F.filter(F.transform("found", lambda x, i: F.struct(x.text.alias("text"), x.written.alias("written"), F.get("mask", i * 3 + 1).alias("run"))), lambda x: x.run.loss & (x.run.length == F.length(x.written)))
    back = back.withColumn("loss", F.array_join(F.transform(under, lambda x: x.text), ""))
    said = F.array_join(F.transform("found", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return back.select("conv_id", F.size("found").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(t) + (length(t) - length(replace(t, chr(9243), '')))
    + len(regexp_extract_all(t, '<(s>|/s>|<SYS>>|</SYS>>)')) + len(regexp_extract_all(t, '\[(INST\]|/INST\])')) AS n,
    length(r) + (length(r) - length(replace(r, chr(9243), ''))) + (length(r) - length(replace(r, chr(10), '')))
    + len(regexp_extract_all(r, '<(s>|/s>|<SYS>>|</SYS>>)')) + len(regexp_extract_all(r, '\[(INST\]|/INST\])')) AS m FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  coalesce(sum(CASE WHEN r = 'assistant' THEN length(t) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN t END, '' ORDER BY turn NULLS FIRST, r, t), '')) AS loss_sha256,
  sum(n + CASE r WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE m + 16 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
