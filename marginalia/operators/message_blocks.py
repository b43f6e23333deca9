"""Stored chat messages whose content is an array of blocks of any kind, read as VARIANT and written as Markdown.

No schema is declared: a missing field, and a list or flag of another kind,
count as absent; a number or an object where text is expected is its JSON; a
message that is not JSON gives ''. All of it is expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import trimmed


def said(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _text(v: Column, path: str) -> Column:
    """The value at ``path`` as text, '' for none."""
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _string(v: Column, path: str) -> Column:
    """The same, but '' for what is no JSON string."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", _text(v, path)).otherwise("")


def _flag(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False))


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _first(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def _longest_run(body: Column, least: int) -> Column:
    runs = F.transform(F.regexp_extract_all(body, F.lit(f"`{{{least},}}"), F.lit(0)), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def fence(body: Column, language: Column | str = "") -> Column:
    """A code block whose fence is longer than any run of three or more backticks within."""
    mark = F.repeat(F.lit("`"), F.greatest(_longest_run(body, 3), F.lit(2)) + 1)
    return said(mark, language, "\n", body, "\n", mark)


def inline_code(body: Column) -> Column:
    mark = F.repeat(F.lit("`"), _longest_run(body, 1) + 1)
    pad = F.when(body.rlike(r"^`|`\z"), " ").otherwise("")
    return F.concat(mark, pad, body, pad, mark)


def _thinking(b: Column) -> Column:
    steps = F.filter(F.transform(_items(b, "$.summaries"), lambda s: _text(s, "$.summary")), lambda s: s != "")
    body = trimmed(_text(b, "$.thinking"))
    label = F.when(F.size(steps) > 0, F.get(steps, 0)).otherwise("Thinking")
    rest = F.when(F.size(steps) > 1, said(F.array_join(F.transform(F.slice(steps, F.lit(2), F.size(steps)), lambda s: said("- ", s)), "\n"), "\n\n")).otherwise("")
    cut = F.when(_flag(b, "$.cut_off") | _flag(b, "$.truncated"), "\n\n_(cut off)_").otherwise("")
    shown = said("<details>\n<summary>", label, "</summary>\n\n", rest, body, cut, "\n\n</details>")
    return F.when(_flag(b, "$.hidden") | _flag(b, "$.thinking_hidden") | (body == ""), "").otherwise(shown)


def _tool_use(b: Column) -> Column:
    label = trimmed(F.coalesce(_first(_text(b, "$.message"), _text(b, "$.name")), F.lit("Tool")))
    shown, query = _text(b, "$.display_content.code"), _string(b, "$.input.query")
    body = F.coalesce(_first(_string(b, "$.input.content"), _string(b, "$.input.command")), F.lit(""))
    title = _string(b, "$.input.title")
    title = F.when(title != "", said(" — ", title)).otherwise("")
    raw = F.coalesce(F.to_json(F.try_variant_get(b, "$.input", "variant")), F.lit("{}"))
    return (
        F.when((_text(b, "$.display_content.type") == "code_block") & (shown != ""), said("**", label, "**\n\n", fence(shown, _text(b, "$.display_content.language"))))
        .when(query != "", said("**", label, "**: ", inline_code(query)))
        .when(body != "", said("**", label, title, "**\n\n", fence(body, _string(b, "$.input.language"))))
        .otherwise(said("**", label, "**\n\n", fence(raw, "json")))
    )


def _shell(text: Column) -> Column:
    """A shell's answer as its output and errors, any other text as it is."""
    v = F.when(text.rlike(r"^\s*\{"), F.try_parse_json(text))
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("")) == "STRING"
    without_end = lambda s: F.regexp_replace(s, r"\n\z", "")
    out, err = _text(v, "$.stdout"), _text(v, "$.stderr")
    parts = F.array_compact(F.array(F.when(out != "", fence(without_end(out))), F.when(err != "", said("_stderr_\n\n", fence(without_end(err))))))
    none = said("_exit code ", F.coalesce(F.try_variant_get(v, "$.returncode", "string"), F.lit("undefined")), ", no output_")
    return F.when(kind("$.stdout") | kind("$.stderr"), F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")).otherwise(none)).otherwise(fence(text))


def _tool_result(b: Column) -> Column:
    failed = F.when(_flag(b, "$.is_error"), " (failed)").otherwise("")

    def source(s: Column) -> Column:
        site = _text(s, "$.metadata.site_name")
        return said("- [", trimmed(_first(_text(s, "$.title"), _text(s, "$.url"))), "](", _text(s, "$.url"), ")", F.when(site != "", said(" — ", site)).otherwise(""))

    items = _items(b, "$.content")
    sources = F.transform(F.filter(items, lambda s: (_text(s, "$.type") == "knowledge") & (_text(s, "$.url") != "")), source)
    texts = F.transform(F.filter(items, lambda s: (_text(s, "$.type") == "text") & (_text(s, "$.text") != "")), lambda s: _shell(_text(s, "$.text")))
    return (
        F.when(F.size(sources) > 0, said("**Sources", failed, "**\n\n", F.array_join(sources, "\n")))
        .when(F.size(texts) > 0, said("**Result", failed, "**\n\n", F.array_join(texts, "\n\n")))
        .otherwise("")
    )


def block_markdown(b: Column) -> Column:
    kind = _text(b, "$.type")
    return (
        F.when(kind == "text", trimmed(_text(b, "$.text"))).when(kind == "thinking", _thinking(b))
        .when(kind == "tool_use", _tool_use(b)).when(kind == "tool_result", _tool_result(b)).otherwise("")
    )


def file_list(v: Column) -> Column:
    """Lines of a message's files (links where there is a preview) and attachments."""

    def file(f: Column) -> Column:
        name = trimmed(F.coalesce(_first(_text(f, "$.file_name"), _text(f, "$.file_uuid")), F.lit("file")))
        url = F.coalesce(_first(_text(f, "$.preview_url"), _text(f, "$.thumbnail_url")), F.lit(""))
        kind = F.when(_text(f, "$.file_kind") == "image", "image").otherwise("attached")
        return F.when(url != "", said("- ", kind, ": [", name, "](", url, ")")).otherwise(said("- ", kind, ": ", name))

    attached = lambda a: said("- attached: ", trimmed(F.coalesce(_first(_text(a, "$.file_name"), _text(a, "$.name")), F.lit("attachment"))))
    return F.array_join(F.concat(F.transform(_items(v, "$.files"), file), F.transform(_items(v, "$.attachments"), attached)), "\n")


def message_markdown(payload: Column) -> Column:
    """Markdown of a stored message (JSON text): its blocks, or its flat text where it has none, then its files."""
    v = F.try_parse_json(payload)
    blocks = F.filter(F.transform(_items(v, "$.content"), block_markdown), lambda x: x != "")
    flat = F.when(F.size(_items(v, "$.content")) == 0, F.array(trimmed(_text(v, "$.text")))).otherwise(F.array().cast("array<string>"))
    files = file_list(v)
    tail = F.when(files != "", F.array(files)).otherwise(F.array().cast("array<string>"))
    return trimmed(F.array_join(F.concat(blocks, flat, tail), "\n\n"))
