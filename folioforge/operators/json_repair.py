"""Recovery of generated JSON: five strategies as Column expressions, and a scanner for answers that were cut off.

A strategy counts only if what it gives is JSON as a whole and has the list of items; a broken object is never taken with
null fields. Items are read field by field from VARIANT, so one field of another type doesn't cost the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LIST = "enhancements"


def items_in(text: Column) -> Column:
    """The list of items of a text that is a JSON object with it, as VARIANTs; else null."""
    return F.try_variant_get(F.try_parse_json(text), f"$.{LIST}", "array<variant>")


def closed_lines(text: Column) -> Column:
    """Lines with an odd number of quotation marks that don't end in one get one."""
    odd = lambda line: (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    fixed = F.transform(F.split(text, "\n"), lambda line: F.when(odd(line) & ~F.rtrim(line).endswith('"'), F.concat(F.rtrim(line), F.lit('"'))).otherwise(line))
    return F.array_join(fixed, "\n")


def strategies(raw: Column) -> list[Column]:
    """What each strategy makes of a response, in order: as it is; the fenced object; without trailing commas and with lines' strings closed; with typographic quotation marks made plain; the outermost object; the list alone."""
    commas = F.regexp_replace(raw, r",(\s*[}\]])", "$1")
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    plain = closed_lines(F.regexp_replace(commas, "[“”]", '"'))
    outer = F.regexp_extract(raw, rf'(?s)(\{{.*"{LIST}".*\}})', 1)
    listed = F.concat(F.lit(f'{{"{LIST}": ['), F.regexp_extract(raw, rf'(?s)"{LIST}"\s*:\s*\[(.*?)\]', 1), F.lit("]}"))
    alone = F.concat(F.lit(f'{{"{LIST}": '), F.regexp_extract(raw, r"(?s)(\[\s*\{.*\}\s*\])", 1), F.lit("}"))
    return [raw, fenced, closed_lines(commas), plain, outer, F.when(raw.rlike(rf'(?s)"{LIST}"\s*:\s*\[.*?\]'), listed), alone]


def close_json(text: str) -> str:
    """The first object or list of a text, with what is open at its end closed: strings, brackets, keys without a value, words cut short. Line breaks inside strings become escapes; brackets that don't match close what is open."""
    start = min((k for k in (text.find("{"), text.find("[")) if k >= 0), default=-1)
    if start < 0:
        return ""
    out: list[str] = []
    stack: list[list] = []  # [closing bracket, what comes next: key, colon, value or comma]
    string, word = False, ""
    escape, needed = 0, 0  # where the last escape began, and how many of its signs are to come

    def ended() -> None:
        """A value or key has ended."""
        if stack:
            stack[-1][1] = "colon" if stack[-1][1] == "key" else "comma"

    def end_word() -> None:
        nonlocal word
        if word:
            try:
                float(word)
                good = not word.endswith(".")
            except ValueError:
                good = word in ("true", "false", "null")
            out.append(word if good else "null")
            word = ""
            ended()

    def close() -> None:
        bracket, state = stack.pop()
        if state == "colon":
            out.append(": null")
        elif state == "value" and bracket == "}":
            out.append("null")
        while out and (out[-1] == "," or out[-1].isspace()):
            out.pop()
        out.append(bracket)
        ended()

    for c in text[start:]:
        if string:
            if needed:
                needed = 4 if c == "u" and escape == len(out) - 1 else needed - 1
            elif c == "\\":
                escape, needed = len(out), 1
            elif c == '"':
                string = False
                ended()
            elif c < " ":
                c = f"\\u{ord(c):04x}"
            out.append(c)
            continue
        if c == '"':
            end_word()
            string = True
            out.append(c)
        elif c in "{[":
            end_word()
            stack.append(["}" if c == "{" else "]", "key" if c == "{" else "value"])
            out.append(c)
        elif c in "}]":
            end_word()
            if any(b == c for b, _ in stack):
                while stack[-1][0] != c:
                    close()
                close()
                if not stack:
                    return "".join(out)
        elif c == ",":
            end_word()
            if stack:
                stack[-1][1] = "key" if stack[-1][0] == "}" else "value"
            out.append(c)
        elif c == ":":
            end_word()
            if stack:
                stack[-1][1] = "value"
            out.append(c)
        elif c.isspace():
            end_word()
            out.append(c)
        else:
            word += c
    if string:
        if needed:  # an escape cut short
            del out[escape:]
        out.append('"')
        ended()
    end_word()
    while stack:
        close()
    return "".join(out)


def field(item: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", kind)


def typed(items: Column) -> Column:
    """Items as structs: type, enhancement_type, title, content, source_units, confidence, priority; what isn't there, or of another type, is null."""
    fields = [("type", "string"), ("enhancement_type", "string"), ("title", "string"), ("content", "string"), ("source_units", "array<string>"), ("confidence", "double"), ("priority", "int")]
    return F.transform(items, lambda i: F.struct(*(field(i, name, kind).alias(name) for name, kind in fields)))


def recover(responses: DataFrame, column: str = "response", cut_off: bool = True) -> DataFrame:
    """responses with ``items`` (structs, empty if nothing works) and ``strategy`` (0 to 6, 7 for the scanner, null if nothing works). Only what no strategy reads goes to the scanner, which is one pass over a text in an Arrow batch."""
    from pyspark.sql.functions import pandas_udf

    tried = [items_in(s) for s in strategies(F.col(column))]
    first = F.coalesce(*tried)
    which = F.coalesce(*(F.when(t.isNotNull(), k) for k, t in enumerate(tried)))
    if cut_off:

        @pandas_udf(StringType())
        def closed(texts):
            return texts.map(lambda t: close_json(t) if t else None)

        held = responses.withColumn("_items", first).withColumn("_which", which)
        held = held.withColumn("_last", items_in(closed(F.when(F.col("_which").isNull(), F.col(column)))))
        first, which = F.coalesce("_items", "_last"), F.coalesce("_which", F.when(F.col("_last").isNotNull(), len(tried)))
    else:
        held = responses
    none = F.from_json(F.lit("[]"), "array<struct<type:string,enhancement_type:string,title:string,content:string,source_units:array<string>,confidence:double,priority:int>>")
    return held.withColumn("items", F.coalesce(typed(first), none)).withColumn("strategy", which.cast("int")).drop("_items", "_which", "_last")
