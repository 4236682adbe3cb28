"""Prompt texts made from summaries, and replies turned back into columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions import strip_ws
from tillbook.plans.summary import summary_json
from tillbook.spec import TENANT

# The instructions around the summary, and the fields of a reply.
PROMPT_HEAD = (
    "You are a business analyst. Analyse this Ghana-based business data (GHS amounts) "
    "and give brief insights.\n\nDATA:\n"
)
PROMPT_TAIL = (
    "\n\nReply ONLY with this JSON — no markdown, no extra text, keep each value under 100 words:\n"
    '{"summary":"1-2 sentences on business health","strengths":"2-3 bullet points using •",'
    '"risks":"2-3 bullet points using •","recommendations":"3 numbered recommendations",'
    '"forecast":"1-2 sentences on outlook"}'
)
REPLY_FIELDS = ("summary", "strengths", "risks", "recommendations", "forecast")


def insight_prompts(summary: DataFrame) -> DataFrame:
    """``(user_id, prompt)`` for every tenant that has data."""
    return summary_json(summary).select(
        TENANT, F.concat(F.lit(PROMPT_HEAD), F.col("summary"), F.lit(PROMPT_TAIL)).alias("prompt")
    )


def parse_replies(replies: DataFrame) -> DataFrame:
    """Five text fields and a ``status`` from reply bodies ``(user_id, body)``.

    The text of the first choice may be fenced. ``status`` is ``ok``, ``bad_json`` when the text is
    not JSON, or ``error`` when the body has no text or the JSON is not an object. Fields of a good
    reply default to the empty text; nested values stay JSON text.
    """
    content = strip_ws(F.get_json_object("body", "$.choices[0].message.content"))
    fenced = F.regexp_replace(content, r"(?s)^```(?:json)?(.*?)(?:```.*)?$", "$1")
    text = strip_ws(fenced)
    fields = ", ".join(f"{f}:string" for f in REPLY_FIELDS)
    strict = {"allowSingleQuotes": "false"}
    # As the only element of an array, an object followed by anything else fails to parse.
    alone = F.from_json(F.concat(F.lit("["), "_text", F.lit("]")), f"array<struct<{fields}>>", strict)
    is_object = F.col("_text").startswith("{") & F.col("_text").endswith("}")
    parsed = F.when(is_object & (F.size("_alone") == 1), F.get("_alone", F.lit(0)))
    listed = F.try_parse_json(F.concat(F.lit("["), "_text", F.lit("]")))
    single = F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(
        listed, "$[1]", "variant"
    ).isNull()
    other_json = ~is_object & F.coalesce(single, F.lit(False))
    status = (
        F.when(F.col("_text").isNull() | other_json, "error")
        .when(F.col("_reply").isNull(), "bad_json")
        .otherwise("ok")
    )
    return (
        replies.withColumn("_text", text)
        .withColumn("_alone", alone)
        .withColumn("_reply", parsed)
        .select(
            TENANT,
            status.alias("status"),
            *[
                F.when(F.col("_reply").isNotNull(), F.coalesce(F.col(f"_reply.{f}"), F.lit(""))).alias(f)
                for f in REPLY_FIELDS
            ],
        )
    )
