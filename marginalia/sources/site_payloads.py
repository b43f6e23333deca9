"""Readers of payloads that pages and site interfaces carry: embedded JSON, configuration values, base64, typed JSON files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import WS, text_of

#: Schemas of the stored interface answers that are read as JSON lines; unknown fields are left out.
CHAT_JSON = "conv_id string, title string, current_leaf string, messages array<struct<node_id:string,parent_id:string,role:string,text:string,created_at:string>>"
TREE_JSON = "repo string, truncated boolean, tree array<struct<path:string,type:string,size:bigint>>"
COMMENT_JSON = "post_id string, things array<struct<kind:string,id:string,parent_id:string,author:string,body:string,score:int,created_utc:bigint>>"


def embedded_json(df: DataFrame, html: str, marker: str, name: str = "payload") -> DataFrame:
    """The first JSON object after ``marker``, as text; null where there is none or it does not parse."""

    @F.pandas_udf("string")
    def find(pages):
        reader = json.JSONDecoder()

        def one(page):
            at = (page or "").find(marker)
            start = page.find("{", at) if at >= 0 else -1
            if start < 0:
                return None
            try:
                _, end = reader.raw_decode(page, start)
            except ValueError:
                return None
            return page[start:end]

        return pages.map(one, na_action=None).astype("object")

    return df.withColumn(name, find(F.col(html)))


def config_value(html: Column, key: str) -> Column:
    """The first ``"key":"value"`` of a page, or null."""
    return F.nullif(F.regexp_extract(text_of(html), f'"{key}":"([^"]+)"', 1), F.lit(""))


def base64_text(content: Column) -> Column:
    return F.decode(F.unbase64(F.regexp_replace(text_of(content), f"[{WS}]+", "")), "UTF-8")


def _tokens(payload: str | None) -> tuple[str | None, str | None]:
    """The comment section's token and the first token of all, in depth-first order; null for what is no JSON."""
    try:
        stack = [json.loads(payload or "")]
    except (ValueError, RecursionError):
        return None, None
    section = following = None
    named = lambda node, *path: (named(node.get(path[0]), *path[1:]) if isinstance(node, dict) else None) if path else node
    inner = ("continuationItemRenderer", "continuationEndpoint", "continuationCommand", "token")
    while stack and (section is None or following is None):
        node = stack.pop()
        if isinstance(node, dict):
            own = named(node, "itemSectionRenderer")
            if section is None and named(own, "sectionIdentifier") == "comment-item-section":
                items = own.get("contents")
                section = next((t for t in (named(item, *inner) for item in items) if t), None) if isinstance(items, list) else None
            following = following or named(node, *inner) or None
        children = list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else []
        stack.extend(reversed(children))
    return tuple(t if t is None or isinstance(t, str) else json.dumps(t) for t in (section, following))


def continuation_tokens(payload: Column) -> Column:
    """(section, following) of a listing's JSON: the token that opens the comment section, and the first one that continues.

    The order is that in which fields stand, which VARIANT and maps of Spark do not keep, so each payload is walked in Python.
    """

    @F.pandas_udf("section string, following string")
    def walk(payloads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_tokens(p) for p in payloads], columns=["section", "following"], dtype="object")

    return walk(text_of(payload))


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """Message graphs (conv_id, node_id, parent_id, role, text, created_at) and the leaf each conversation names."""
    rows = spark.read.schema(CHAT_JSON).json(path)
    return rows.select("conv_id", "title", "current_leaf", F.explode("messages").alias("m")).select("conv_id", "title", "current_leaf", "m.*")


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TREE_JSON).json(path).select("repo", F.explode("tree").alias("t")).select("repo", "t.*")


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(COMMENT_JSON).json(path).select("post_id", F.posexplode("things").alias("pos", "t"))
    return rows.select("post_id", "pos", "t.*")
