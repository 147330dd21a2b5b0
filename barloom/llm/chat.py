"""Chat formatting with typed content parts, in DataFrame operations only.

A message is a list of typed parts: text, image, audio or document. A visitor flattens the parts in order: text is escaped, an
attachment becomes a placeholder, its reference is recorded with the number of tokens that it expands to. Turns are then written
between control strings. All of these start with ``<``; in texts and roles ``&`` and ``<`` are written as entities, so no text can
form a control string and everything can be read back.

A conversation is one output row, so it has to fit in one string; only its own turns are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import bind

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Tokens that a placeholder expands to.
EXPANDED = {"audio": 128, "document": 512, "image": 256}
ATTACHMENT = r"!\[(?:audio|document|image)\]\([^()\s]*\)"
PLACEHOLDER = r"<\|(?:audio|document|image)\|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def parts_of(text: Column) -> Column:
    """A plain text as parts (type, value): ``![image](ref)``, ``![audio](ref)`` and ``![document](ref)`` are attachments."""
    text = F.coalesce(text, F.lit(""))
    typed = lambda ref: F.struct(F.regexp_extract(ref, r"^!\[([a-z]+)\]", 1).alias("type"),
                                 F.regexp_extract(ref, r"\(([^()\s]*)\)$", 1).alias("value"))
    return bind(F.struct(F.split(text, ATTACHMENT).alias("between"), F.regexp_extract_all(text, F.lit(ATTACHMENT), F.lit(0)).alias("refs")),
                lambda x: F.filter(F.flatten(F.transform(x["between"], lambda t, i: F.array(
                    F.struct(F.lit("text").alias("type"), t.alias("value")),
                    F.when(i < F.size(x["refs"]), typed(F.get(x["refs"], i)))))), lambda p: p.isNotNull()))


def flattened(parts: Column) -> Column:
    """(body, attachments): the parts in order, attachments as placeholders with (type, ref, tokens) recorded.

    Parts of another type, and null values, are written as empty text.
    """
    known = list(EXPANDED)
    tokens = lambda kind: F.element_at(F.create_map(*[F.lit(x) for kv in EXPANDED.items() for x in kv]), kind)
    visit = lambda p: F.when(p["type"].isin(known), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).when(
        p["type"] == "text", escaped(F.coalesce(p["value"], F.lit("")))).otherwise("")
    return F.struct(
        F.array_join(F.transform(parts, visit), "").alias("body"),
        F.transform(F.filter(parts, lambda p: p["type"].isin(known)), lambda p: F.struct(
            p["type"].alias("type"), F.coalesce(p["value"], F.lit("")).alias("ref"), tokens(p["type"]).alias("tokens"))).alias("attachments"))


def format_chat(messages: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, loss_mask, attachments (a list per turn), expanded_tokens.

    ``messages`` has conv_id, turn, role and parts. Turns stand in order; null turns first, equal turns by role and text. Null
    roles are empty. ``loss_mask`` lists (turn, start, length) in code points: the bodies of assistant turns, nothing else.
    """
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), flattened(F.col("parts")).alias("flat"))
    rows = rows.select("conv_id", "turn", "role", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS)).alias("head"),
                       F.col("flat.body").alias("body"), F.col("flat.attachments").alias("attachments"))
    size = F.char_length("head") + F.char_length("body") + len(END)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body", F.to_json("attachments"))
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn(
        "before", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "before", "role", "head", "body", "attachments"))).alias("t"))
    span = lambda t: F.struct((t["at"] - 1).alias("turn"), (t["before"] + F.char_length(t["head"])).alias("start"),
                              F.char_length(t["body"]).alias("length"))
    return turns.select(
        "conv_id", F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["role"] == "assistant"), span).alias("loss_mask"),
        F.transform("t", lambda t: t["attachments"]).alias("attachments"),
        F.aggregate(F.flatten(F.transform("t", lambda t: t["attachments"])), F.lit(0), lambda n, a: n + a["tokens"]).cast("long").alias("expanded_tokens"))


def restored(body: Column, attachments: Column) -> Column:
    """A formatted body as the text it was made from."""
    source = lambda a: F.concat(F.lit("!["), a["type"], F.lit("]("), a["ref"], F.lit(")"))
    return F.when(F.size(attachments) == 0, unescaped(body)).otherwise(F.array_join(F.transform(
        F.split(body, PLACEHOLDER), lambda t, i: F.concat(unescaped(t), F.when(
            i < F.size(attachments), source(F.get(attachments, i))).otherwise(""))), ""))


def turns_in(formatted: Column, attachments: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    marked = lambda s: s.replace("|", r"\|")
    pieces = F.slice(F.split(formatted, marked(TURN)), 2, 1_000_000_000)
    return F.transform(pieces, lambda p, i: bind(F.split(p, marked(SAYS)), lambda x: F.struct(
        unescaped(x[0]).alias("role"), restored(F.regexp_replace(x[1], marked(END) + "$", ""), F.get(attachments, i)).alias("text"))))


def loss_text(formatted: Column, loss_mask: Column, attachments: Column) -> Column:
    """All text under the loss mask, read back, in order."""
    return F.array_join(F.transform(loss_mask, lambda m: restored(
        F.substring(formatted, (m["start"] + 1).cast("int"), m["length"]), F.get(attachments, m["turn"]))), "")


def digest(chats: DataFrame) -> DataFrame:
    """Per formatted conversation, from the output alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_attachments, expanded_tokens."""
    turns = turns_in(F.col("formatted"), F.col("attachments"))
    loss = loss_text(F.col("formatted"), F.col("loss_mask"), F.col("attachments"))
    told = lambda t: F.struct(
        F.size(t).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"))
    return chats.select("conv_id", bind(turns, told).alias("t"), bind(loss, lambda x: F.struct(
        F.char_length(x).cast("long").alias("loss_chars"), F.sha2(x, 256).alias("loss_sha256"))).alias("l"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.size(F.flatten("attachments")).cast("long").alias("n_attachments"), "expanded_tokens").select(
        "conv_id", "t.*", "l.*", "formatted_chars", "n_attachments", "expanded_tokens")


def with_own_parts(conversations: DataFrame) -> DataFrame:
    """Messages of plain texts (conv_id, turn, role, text) with the parts found in them."""
    return conversations.select("conv_id", "turn", "role", parts_of(F.col("text")).alias("parts"))


#: Same result for DuckDB; formatted_chars from the template's fixed lengths.
DIGEST_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, regexp_extract_all(text, '!\[(?:audio|document|image)\]\([^()\s]*\)') AS refs,
    regexp_replace(text, '!\[(audio|document|image)\]\([^()\s]*\)', '', 'g') AS bare FROM turns),
measured AS (SELECT *, list_sum(list_transform(refs, lambda r: length(regexp_extract(r, '\[([a-z]+)\]', 1)) + 4)) AS marks,
    list_sum(list_transform(refs, lambda r: CASE regexp_extract(r, '\[([a-z]+)\]', 1) WHEN 'image' THEN 256 WHEN 'audio' THEN 128 ELSE 512 END)) AS tokens,
    length(replace(replace(bare, '&', '&amp;'), '<', '&lt;')) AS body, length(replace(replace(role, '&', '&amp;'), '<', '&lt;')) AS head FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(body + head + coalesce(marks, 0) + 23)::BIGINT AS formatted_chars, sum(len(refs))::BIGINT AS n_attachments,
  coalesce(sum(tokens), 0)::BIGINT AS expanded_tokens
FROM measured GROUP BY conv_id"""
