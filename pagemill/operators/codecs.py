"""Codecs of recognised content: table tokens, strict CSV, CTC, model payloads and answers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import escape_html

CELL_TOKENS = re.compile("<(fcel|ecel|lcel|ucel|xcel|nl)>")


def otsl_html(text: str) -> str:
    """HTML of a table in structure tokens, spans included; text without cell tokens as it is. ValueError where it isn't a table."""
    if "<fcel>" not in text and "<ecel>" not in text:
        return text
    grid: list[list[int]] = []
    owners: list[dict] = []
    row: list[int] = []
    marks = list(CELL_TOKENS.finditer(text))
    for m, after in zip(marks, [*marks[1:], None], strict=True):
        kind, body = m[1], text[m.end() : after.start() if after else len(text)]
        r, c = len(grid), len(row)
        above = grid[r - 1][c] if r and c < len(grid[r - 1]) else None
        left = row[-1] if row else None
        if kind == "nl":
            if not row:
                raise ValueError("an empty table row")
            if grid and len(row) != len(grid[0]):
                raise ValueError("rows of different lengths")
            grid.append(row)
            row = []
        elif kind in ("fcel", "ecel"):
            owners.append({"row": r, "col": c, "rows": 1, "cols": 1, "text": body if kind == "fcel" else ""})
            row.append(len(owners) - 1)
        else:
            owner = above if kind == "ucel" else left
            if owner is None or kind == "xcel" and left != above or kind == "lcel" and owners[owner]["row"] != r:
                raise ValueError(f"nothing for {kind} to extend")
            if kind == "ucel" and owners[owner]["col"] != c:
                raise ValueError("a cell grows from another column")
            o = owners[owner]
            o["rows"], o["cols"] = max(o["rows"], r - o["row"] + 1), max(o["cols"], c - o["col"] + 1)
            row.append(owner)
    if row:
        if grid and len(row) != len(grid[0]):
            raise ValueError("rows of different lengths")
        grid.append(row)
    for k, o in enumerate(owners):
        if any(c >= len(grid[r]) or grid[r][c] != k for r in range(o["row"], o["row"] + o["rows"]) for c in range(o["col"], o["col"] + o["cols"])):
            raise ValueError("a span that isn't a rectangle")
    lines = ["<table>"]
    for r, cells in enumerate(grid):
        out = "<tr>"
        for c, k in enumerate(cells):
            o = owners[k]
            if (o["row"], o["col"]) == (r, c):
                spans = "".join(f' {name}="{n}"' for name, n in (("rowspan", o["rows"]), ("colspan", o["cols"])) if n > 1)
                body = o["text"].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\n", "<br/>")
                out += f"<td{spans}>{body}</td>"
        lines.append(out + "</tr>")
    return "\n".join([*lines, "</table>"])


def guarded(function):
    """An Arrow-batched column function of strings that gives a struct of value and error."""

    @F.pandas_udf("value string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((None, None) if t is None else (function(t), None))
            except ValueError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["value", "error"])

    return run


def otsl_html_column(text: Column) -> Column:
    return guarded(otsl_html)(text)


def otsl_plain(text: Column) -> Column:
    """HTML of a table in tokens without spans, from column functions; null where it has a span or rows differ in length."""
    body = F.regexp_replace(text, r"(<nl>)+$", "")
    rows = F.transform(F.split(body, "<nl>"), lambda r: F.slice(F.split(r, "<(?:fcel|ecel)>"), 2, 1 << 20))
    cells = F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), escape_html(c), F.lit("</td>"))), ""), F.lit("</tr>")))
    lengths = F.transform(rows, lambda r: F.size(r))
    plain = ~text.rlike("<[lux]cel>") & (F.array_min(lengths) == F.array_max(lengths)) & (F.array_min(lengths) > 0)
    return F.when(plain, F.concat(F.lit("<table>\n"), F.array_join(cells, "\n"), F.lit("\n</table>")))


MOST_CSV_BYTES = 16 << 20
DELIMITERS = (",", ";", "\t", "|")


def csv_rows(data: str | bytes, delimiter: str = ",", most: int = MOST_CSV_BYTES) -> list[list[str]]:
    """Rows of strict CSV; cells are literal text. ValueError for what isn't."""
    if delimiter not in DELIMITERS:
        raise ValueError("unknown delimiter")
    if isinstance(data, str):
        data = data.encode("utf-8", "surrogatepass")
    if len(data) > most:
        raise ValueError("the CSV is too large")
    try:
        text = data.decode("utf-8").removeprefix("﻿")
    except UnicodeDecodeError:
        raise ValueError("the CSV isn't UTF-8") from None
    if not text:
        raise ValueError("the CSV is empty")
    if re.search("[\x00-\x08\x0b\x0c\x0e-\x1f]", text):
        raise ValueError("a control character")
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    plain = re.compile(rf"[^{re.escape(delimiter)}\n\"]*")
    rows, row, at = [], [], 0
    while True:
        if text.startswith('"', at):
            end, parts = at + 1, []
            while True:
                close = text.find('"', end)
                if close < 0:
                    raise ValueError("a quote isn't closed")
                parts.append(text[end:close])
                if not text.startswith('"', close + 1):
                    break
                parts.append('"')
                end = close + 2
            row.append("".join(parts))
            at = close + 1
            if at < len(text) and text[at] not in (delimiter, "\n"):
                raise ValueError("text behind a closing quote")
        else:
            m = plain.match(text, at)
            row.append(m[0])
            at = m.end()
            if text.startswith('"', at):
                raise ValueError("a quote inside plain text")
        if at < len(text) and text[at] == delimiter:
            at += 1
            continue
        rows.append(row)
        row = []
        at += 1
        if at >= len(text):
            return rows


def csv_html(data: str | bytes, delimiter: str = ",", most: int = MOST_CSV_BYTES) -> str:
    escape = lambda c: c.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("\n", "<br>")
    rows = ("<tr>" + "".join(f"<td>{escape(c)}</td>" for c in row) + "</tr>" for row in csv_rows(data, delimiter, most))
    return "<table>\n" + "\n".join(rows) + "\n</table>"


def csv_html_column(text: Column, delimiter: str = ",") -> Column:
    return guarded(lambda t: csv_html(t, delimiter))(text)


def argmax(values: Column) -> Column:
    """Index from 0 of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def ctc_steps(logits: Column, classes: int) -> Column:
    """The best class of each time step of a flat [T, classes] array."""
    steps = F.floor(F.size(logits) / classes).cast("int")
    return F.when(steps > 0, F.transform(F.sequence(F.lit(0), steps - 1), lambda t: argmax(F.slice(logits, t * classes + 1, classes)))).otherwise(F.array().cast("array<int>"))


def ctc_text(steps: Column, tokens: Column, blank: int = 0) -> Column:
    """Tokens of the steps, repeats and blanks taken out."""
    kept = F.transform(steps, lambda s, i: F.when((s != blank) & ((i == 0) | (s != F.get(steps, i - 1))), F.get(tokens, s)).otherwise(F.lit("")))
    return F.array_join(kept, "")


def chat_payload(model: Column, prompt: Column, image_url: Column, temperature: float = 0.0, max_tokens: int = 4096) -> Column:
    """Request body of a chat model that gets an image and a prompt."""
    content = F.concat(F.lit('[{"type":"image_url","image_url":'), F.to_json(F.struct(image_url.alias("url"))), F.lit('},{"type":"text","text":'), quoted(prompt), F.lit("}]"))
    return F.concat(
        F.lit('{"model":'), quoted(model), F.lit(',"messages":[{"role":"user","content":'), content, F.lit(f'}}],"temperature":{json.dumps(temperature)},"max_tokens":{max_tokens}}}')
    )


def quoted(x: Column) -> Column:
    """A JSON string."""
    return F.regexp_replace(F.regexp_replace(F.to_json(F.array(x)), r"^\[", ""), r"\]$", "")


ANSWER = "struct<choices:array<struct<finish_reason:string,message:struct<content:string>>>,usage:struct<total_tokens:bigint,completion_tokens:bigint>>"


def chat_answer(response: Column) -> Column:
    """text, error, total_tokens and completion_tokens of a chat response."""
    r = F.from_json(response, ANSWER)
    first = F.get(r["choices"], F.lit(0))
    error = F.when(first.isNull() | first["message"]["content"].isNull(), "no content").when(first["finish_reason"] == "length", "the answer was cut short")
    return F.struct(F.when(error.isNull(), first["message"]["content"]).alias("text"), error.alias("error"), r["usage"]["total_tokens"].alias("total_tokens"), r["usage"]["completion_tokens"].alias("completion_tokens"))
