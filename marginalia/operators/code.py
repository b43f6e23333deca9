"""Code or prose: shape of lines, language by its marks, excerpts with a header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import WS, js_pattern, text_of, trimmed

# Words that open a declaration, operators, language names and their other spellings, marks of languages in order.
DECLARES = (
    r"(?i)^\s*(?:def|class|function|const|let|var|import|from|package|public|private|func|fn|type|struct|interface|return|if|for|while|"
    r"switch|case|else|elif|try|catch|except|async|await|#include|using|SELECT|INSERT|UPDATE|CREATE)\b"
)
OPERATORS = r"=>|->|::|!==|===|\+=|\|\||&&|=\s*\("
ALIASES = {
    "js": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "rs": "rust", "sh": "bash", "shell": "bash", "zsh": "bash",
    "yml": "yaml", "md": "markdown", "cs": "csharp", "text": "", "plaintext": "",
}


def looks_like_code(text: Column) -> Column:
    """At least three points from indentation, line ends, declarations, brackets and operators, less two for sentences."""
    lines = F.filter(F.split(text_of(text), "\n"), lambda x: trimmed(x) != "")
    total = F.size(lines)
    share = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(js_pattern(pattern)))) / total
    sentences = F.size(F.filter(lines, lambda x: trimmed(x).rlike(r"[a-z][.!?]\z"))) / total
    operators = F.regexp_count(text_of(text), F.lit(js_pattern(OPERATORS)))
    add = lambda test, n: F.when(test, n).otherwise(0)
    points = (
        add(share(rf"^[ \t]{{2,}}[^{WS}]") > 0.3, 2) + add(share(rf"[;{{}}][{WS}]*\z") > 0.25, 2) + add(share(DECLARES) > 0.25, 2)
        + add(share(r"[\[\]{}()]") > 0.5, 1) + add(operators >= 2, 1) - add(sentences > 0.4, 2)
    )
    return F.when(total == 0, False).otherwise(points >= 3)


def guess_language(text: Column) -> Column:
    t = text_of(text)
    has = lambda p: t.rlike(js_pattern(p))
    return (
        F.when(has(r"^\s*[{\[][\s\S]*[}\]]\s*\z") & has(r'"[^"]+"\s*:'), "json")
        .when(has(r"(?m)^\s*(?:def|class)\s+[A-Za-z0-9_]+|^\s*from\s+[A-Za-z0-9_]+\s+import\b|^\s*import\s+[A-Za-z0-9_]+$"), "python")
        .when(has(r"(?m)^\s*(?:if|elif|else|for|while|with|try|except)\b.*:\s*$") & has(r"\b(?:elif|print\(|None|True|False)\b"), "python")
        .when(has(r"\b(?:const|let|function)\b[\s\S]*=>|\bconsole\.log\("), "javascript")
        .when(has(r"(?m)^\s*(?:func|package)\s+[A-Za-z0-9_]+") & has(r"\bfmt\."), "go")
        .when(has(r"(?m)^\s*(?:fn|impl|pub fn)\s+[A-Za-z0-9_]+"), "rust")
        .when(has(r"(?im)^\s*(?:SELECT|INSERT INTO|UPDATE|DELETE FROM|CREATE TABLE)\b"), "sql")
        .when(has(r"(?m)^\s*(?:#!/bin/(?:ba)?sh|\$ )"), "bash")
        .when(has(r"(?m)^\s*<[A-Za-z0-9_]+[\s>]") & has(r"</[A-Za-z0-9_]+>"), "html")
        .otherwise("")
    )


def language_name(label: Column) -> Column:
    """The family of a label: small letters, no version digits, usual spelling."""
    key = F.regexp_replace(F.lower(text_of(label)), r"[0-9]+\z", "")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), key), key)


def dedented(text: Column) -> Column:
    lines = F.split(F.regexp_replace(text_of(text), r"\r\n?", "\n"), "\n")
    leads = F.transform(F.filter(lines, lambda x: trimmed(x) != ""), lambda x: F.length(F.regexp_extract(x, r"^[ \t]*", 0)))
    common = F.coalesce(F.array_min(leads), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.substring(x, common + 1, F.greatest(F.length(x), F.lit(1)))), "\n")


def excerpt(text: Column, start: Column, end: Column, in_code: Column, label: Column, url: Column) -> Column:
    """A quoted header with the lines' numbers, then the selection as fenced code or prose; null if it is empty."""
    code = F.coalesce(in_code, F.lit(False)) | looks_like_code(text)
    body = F.regexp_replace(dedented(text), rf"[{WS}]+\z", "")
    runs = F.transform(F.regexp_extract_all(body, F.lit("`{3,}"), F.lit(0)), lambda r: F.length(r))
    mark = F.repeat(F.lit("`"), F.greatest(F.lit(2), F.coalesce(F.array_max(runs), F.lit(2))) + 1)
    fenced = F.concat(mark, guess_language(body), F.lit("\n"), body, F.lit("\n"), mark)
    lines = F.when(start == end, F.concat(F.lit("Line "), start.cast("string"))).otherwise(F.concat(F.lit("Lines "), start.cast("string"), F.lit(" to "), end.cast("string")))
    head = F.concat(F.lit("> "), lines, F.lit(" of "), F.when(code, "code").otherwise("text"), F.lit(" from ["), label, F.lit("]("), url, F.lit(")"))
    return F.when(trimmed(text_of(text)) != "", F.concat(head, F.lit("\n\n"), F.when(code, fenced).otherwise(trimmed(text_of(text)))))


