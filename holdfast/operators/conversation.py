"""Assistant replies and conversation lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import rules, schemas
from holdfast.operators.ranks import topk_per_key

WHITESPACE_ENDS = r"(?U)^\s+|\s+$"


def final_answer(payload: Column) -> Column:
    """The answer to show for a reply payload (JSON text).

    The last message whose text is neither empty nor a routing marker; without one, a
    plain ``content`` string, then the first choice, then a constant.
    """
    parsed = F.from_json(payload, schemas.REPLY)

    def message_text(item: Column) -> Column:
        parts = F.filter(F.coalesce(item["content"], F.array()), lambda p: p["type"] == "output_text")
        joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
        return F.regexp_replace(joined, WHITESPACE_ENDS, "")

    messages = F.filter(F.coalesce(parsed["output"], F.array()), lambda item: item["type"] == "message")
    texts = F.filter(
        F.transform(messages, message_text), lambda t: (t != "") & ~t.rlike(rules.ROUTING_MARKER)
    )
    # ``content`` counts only when it is a JSON string, not an object or a list.
    variant = F.try_parse_json(payload)
    content_kind = F.schema_of_variant(F.try_variant_get(variant, "$.content", "variant"))
    plain = F.when(content_kind == "STRING", F.try_variant_get(variant, "$.content", "string"))
    choice = F.when(
        F.size(F.coalesce(parsed["choices"], F.array())) > 0,
        F.coalesce(F.try_element_at(parsed["choices"], F.lit(1))["message"]["content"], F.lit("")),
    )
    return F.coalesce(
        F.try_element_at(texts, F.lit(-1)), plain, choice, F.lit(rules.NO_ANSWER)
    )


def last_turns(
    messages: DataFrame, conversation: str, order: str, n: int = rules.HISTORY_TURNS
) -> DataFrame:
    """The last ``n`` messages of each conversation; ``turns_back`` is 1 for the newest."""
    return topk_per_key(messages, [conversation], [F.desc(order)], n, "turns_back")


def history_payload(messages: DataFrame, conversation: str, order: str, n: int = rules.HISTORY_TURNS) -> DataFrame:
    """The last messages as one ordered array per conversation (at most ``n`` elements each)."""
    recent = last_turns(messages, conversation, order, n)
    turn = F.struct(F.col(order).alias("order"), F.col("role"), F.col("text"))
    ordered = F.array_sort(F.collect_list(turn))
    return recent.groupBy(conversation).agg(
        F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")
    )


def conversation_index(
    messages: DataFrame, conversation: str, order: str, length: int = rules.TITLE_LENGTH,
    owner: list[str] | None = None,
) -> DataFrame:
    """Conversations with the title taken from the first user message, newest first, and by owner where there is one."""
    trimmed = F.regexp_replace("text", WHITESPACE_ENDS, "")
    title = F.substring(trimmed, 1, min(length, rules.TITLE_STORE_LENGTH))
    asked = F.when((F.col("role") == "user") & (trimmed != ""), F.col(order))
    return (
        messages.groupBy(*(owner or []), conversation)
        .agg(F.min_by(title, asked).alias("title"), F.count(F.lit(1)).alias("n_messages"), F.max(order).alias("last_message"))
        .select(*(owner or []), conversation, "title", "n_messages", "last_message")
        .orderBy(*(owner or []), F.desc("last_message"), conversation)
    )
