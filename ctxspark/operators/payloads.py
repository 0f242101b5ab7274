"""Requests of chat interfaces as one table of segments, and block dedup over them.

A segment is one text of a request: (payload, msg, part, kind, call_id, name, text).  ``kind`` is system,
user, assistant or tool_result; system texts that stand outside the messages have msg -1.  Names of tools
come from the calls that assistants made.

Defined results: bodies that are null or cannot be read give no segments; empty or missing texts give none.
A string that is itself a JSON list of typed parts is read as these parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once, stripped
from . import blockdedup, chunking

_PART = "type string, text string, id string, name string, tool_use_id string, content string"
_CALL = "struct<id: string, function: struct<name: string>>"
_CHAT = f"messages array<struct<role: string, content: string, tool_call_id: string, name: string, tool_calls: array<{_CALL}>>>"
_ANTHROPIC = "system string, messages array<struct<role: string, content: string>>"
_RESPONSES = "input array<struct<type: string, role: string, content: string, call_id: string, name: string, output: string>>"
SCOPES = {"system": ("system",), "tool_results": ("tool_result",), "all": ("system", "user", "assistant", "tool_result")}
COLUMNS = ("payload", "msg", "part", "kind", "call_id", "name", "text")


def _parts(content: Column) -> Column:
    """A text or a list of typed parts as a list of parts."""
    whole = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text"))), _PART))
    return F.when(content.startswith("["), F.coalesce(F.from_json(content, f"array<struct<{_PART}>>"), whole)).otherwise(whole)


def _texts(content: Column) -> Column:
    """The texts of a text or a list of parts."""
    return F.transform(F.filter(_parts(content), lambda p: p["type"] == "text"), lambda p: p["text"])


def _segments(rows: DataFrame) -> DataFrame:
    return rows.where(F.length("text") > 0).select(*COLUMNS)


def _called(calls: Column) -> Column:
    """Calls (call_id, called) in their order as (ids, names), the last of an id first; calls without id or name are left out."""
    known = F.reverse(F.filter(calls, lambda c: (c["call_id"] != "") & (c["called"] != "")))
    return F.struct(F.transform(known, lambda c: c["call_id"]).alias("ids"), F.transform(known, lambda c: c["called"]).alias("names"))


def _name_of(call_id: Column, *fallback: Column) -> Column:
    """The name of a call, found inside its own request: texts of results meet no other row for it."""
    return F.coalesce(F.get("called.names", (F.array_position("called.ids", call_id) - 1).cast("int")), *fallback, F.lit("tool"))


def openai_chat(bodies: DataFrame, payload: str, body: str) -> DataFrame:
    """Segments of chat completion requests."""
    own = bodies.select(F.col(payload).alias("payload"), F.from_json(body, _CHAT)["messages"].alias("messages"))
    callers = F.filter("messages", lambda m: (m["role"] == "assistant") & m["tool_calls"].isNotNull())
    calls = F.flatten(F.transform(callers, lambda m: F.transform(m["tool_calls"], lambda c: F.struct(c["id"].alias("call_id"), c["function"]["name"].alias("called")))))
    own = own.withColumn("called", _called(calls))
    named = F.transform("messages", lambda m: F.struct(m.alias("m"), F.when(m["role"].isin("tool", "tool_result"), _name_of(m["tool_call_id"], m["name"])).otherwise(m["name"]).alias("name")))
    rows = own.select("payload", F.posexplode(named).alias("msg", "x")).select("payload", "msg", "x.*")
    kind = F.when(F.col("m.role") == "tool", F.lit("tool_result")).otherwise(F.col("m.role"))
    texts = rows.select("payload", "msg", kind.alias("kind"), F.col("m.tool_call_id").alias("call_id"), "name", F.posexplode(_texts(F.col("m.content"))).alias("part", "text"))
    return _segments(texts.where("kind IS NOT NULL"))


def anthropic_messages(bodies: DataFrame, payload: str, body: str) -> DataFrame:
    """Segments of messages requests: system texts, texts of messages, and texts inside tool results."""
    own = bodies.select(F.col(payload).alias("payload"), F.from_json(body, _ANTHROPIC).alias("b"))
    none = F.lit(None).cast("string")
    system = own.select("payload", F.lit(-1).alias("msg"), F.posexplode(_texts(F.col("b.system"))).alias("part", "text"))
    system = system.withColumns({"kind": F.lit("system"), "call_id": none, "name": none})
    read = own.select("payload", F.transform("b.messages", lambda m: F.struct(m["role"].alias("role"), _parts(m["content"]).alias("parts"))).alias("messages"))
    uses = F.transform("messages", lambda m: F.filter(m["parts"], lambda p: p["type"] == "tool_use"))
    read = read.withColumn("called", _called(F.transform(F.flatten(uses), lambda p: F.struct(p["id"].alias("call_id"), p["name"].alias("called")))))
    named = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.transform(m["parts"], lambda p: F.struct(p.alias("p"), F.when(p["type"] == "tool_result", _name_of(p["tool_use_id"])).alias("name"))).alias("parts")))
    rows = read.select("payload", F.posexplode(named).alias("msg", "m"))
    parts = rows.select("payload", "msg", F.col("m.role").alias("role"), F.posexplode("m.parts").alias("part", "x")).select("payload", "msg", "role", "part", "x.*")
    plain = parts.where("p.type = 'text'").select("payload", "msg", "part", F.col("role").alias("kind"), none.alias("call_id"), none.alias("name"), F.col("p.text").alias("text"))
    results = parts.where("p.type = 'tool_result'").select("payload", "msg", "part", F.lit("tool_result").alias("kind"), F.col("p.tool_use_id").alias("call_id"), "name", F.explode(_texts(F.col("p.content"))).alias("text"))
    return _segments(system).unionByName(_segments(plain)).unionByName(_segments(results))


def openai_responses(bodies: DataFrame, payload: str, body: str) -> DataFrame:
    """Segments of responses requests: messages and outputs of function calls."""
    own = bodies.select(F.col(payload).alias("payload"), F.from_json(body, _RESPONSES)["input"].alias("items"))
    calls = F.filter("items", lambda i: i["type"] == "function_call")
    own = own.withColumn("called", _called(F.transform(calls, lambda i: F.struct(i["call_id"].alias("call_id"), i["name"].alias("called")))))
    is_result, none = (lambda i: i["type"] == "function_call_output"), F.lit(None).cast("string")
    named = F.transform("items", lambda i: F.struct(i.alias("i"), F.when(is_result(i), _name_of(i["call_id"], F.nullif(i["call_id"], F.lit("")))).alias("name")))
    rows = own.select("payload", F.posexplode(named).alias("msg", "x")).select("payload", "msg", "x.*")

    def segment(part: Column, kind: Column, call_id: Column, name: Column, text: Column) -> Column:
        return F.struct(part.alias("part"), kind.alias("kind"), call_id.alias("call_id"), name.alias("name"), text.alias("text"))

    result = F.when(is_result(F.col("i")), F.array(segment(F.lit(0), F.lit("tool_result"), F.col("i.call_id"), F.col("name"), F.col("i.output"))))
    said = F.when(F.col("i.role").isNotNull(), F.transform(_texts(F.col("i.content")), lambda t, k: segment(k, F.col("i.role"), none, none, t)))
    some = F.flatten(F.array_compact(F.array(result, said)))
    return _segments(rows.select("payload", "msg", F.explode(some).alias("s")).select("payload", "msg", "s.*"))


FORMATS = {"openai_chat": openai_chat, "anthropic_messages": anthropic_messages, "openai_responses": openai_responses}


def segments(bodies: DataFrame, payload: str, body: str, style: str = "openai_chat", scope: str = "all") -> DataFrame:
    """Segments of requests of one style, of the kinds that the scope takes."""
    if style not in FORMATS or scope not in SCOPES:
        raise ValueError(f"unknown style {style!r} or scope {scope!r}")
    return FORMATS[style](bodies, payload, body).where(F.col("kind").isin(*SCOPES[scope]))


def system_content(segments_: DataFrame) -> DataFrame:
    """(payload, system): the stripped system texts of a request, a blank line between them."""
    own = segments_.where("kind = 'system'").withColumn("t", stripped(F.col("text"))).where("t <> ''")
    items = F.array_sort(F.collect_list(F.struct("msg", "part", "t")))
    return own.groupBy("payload").agg(F.array_join(F.transform(items, lambda x: x["t"]), "\n\n").alias("system"))


def rebuilt(content: Column, field: Column, old: Column, new: Column) -> Column:
    """A tool's result with a new text: in its JSON field, or as a whole.

    The field's JSON text is replaced where it stands; a result that escapes it in another way is
    written anew from its fields.
    """
    as_json = lambda text: F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    place = F.replace(content, as_json(old), as_json(new))
    fields = F.from_json(content, "map<string,string>")
    anew = F.to_json(F.map_concat(F.map_filter(fields, lambda k, _: k != field), F.create_map(field, new)))
    return F.when(field.isNull(), new).when(content.contains(as_json(old)), place).otherwise(anew)


def _looked_at(segments_: DataFrame, min_chars: int) -> DataFrame:
    """``segments_`` with ``field`` and ``content``, the text that is cut into blocks, ``label`` and ``system``."""
    is_result = F.col("kind") == "tool_result"
    own = segments_.withColumn("u", F.when(is_result, blockdedup.unwrapped(F.col("text"), min_chars))).withColumn("system", F.col("kind") == "system")
    own = own.withColumns({"field": F.col("u.field"), "content": F.when(is_result, F.col("u.text")).otherwise(F.col("text"))})
    return own.withColumn("label", F.when(is_result, F.col("name")).otherwise(F.col("kind"))).drop("u")


def _references(own: DataFrame, min_chars: int) -> DataFrame:
    """(payload, msg, part, kind, blocks_total, blocks_deduped, refs) of the long texts: what becomes of their blocks, without a text."""
    blocks = blockdedup.deduped_blocks(own, "payload", "msg", "content", "label", "system", min_chars=min_chars, part="part", carry=("kind",))
    return blockdedup.references(blocks, "payload", "msg", "part", "kind")


def deduped(segments_: DataFrame, min_chars: int = chunking.MIN_CONTENT_CHARS) -> DataFrame:
    """(payload, msg, part, name, blocks_total, blocks_deduped, chars_saved, text) of the long texts of requests.

    System texts give origins and stay as they are; of a tool's JSON result the text field is looked at.
    Blocks of one message never refer to each other.
    """
    own = _looked_at(segments_, min_chars)
    out = own.where("NOT system").join(_references(own, min_chars).drop("kind"), ["payload", "msg", "part"])
    new = blockdedup.with_references(F.col("content"), F.col("refs"))
    changed = F.when(F.col("blocks_deduped") > 0, rebuilt(F.col("text"), F.col("field"), F.col("content"), F.col("new"))).otherwise(F.col("text"))
    out = out.withColumn("new", F.when(F.col("blocks_deduped") > 0, new)).withColumn("result", changed)
    saved = (F.length("text") - F.length("result")).cast("long")
    return out.select("payload", "msg", "part", F.col("label").alias("name"), "blocks_total", "blocks_deduped", saved.alias("chars_saved"), F.col("result").alias("text"))


_LIST = "array<map<string,variant>>"


def _put(fields: Column, name: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(fields, lambda k, _: k != name), F.create_map(F.lit(name), value))


def _said(fields: Column, name: str) -> Column:
    return F.try_variant_get(F.try_element_at(fields, F.lit(name)), "$", "string")


def _as_variant(value: Column) -> Column:
    return F.parse_json(F.to_json(value))


Edit = Callable[[Column, Column, Column], Column]


def _edited(content: Column, msg: Column, edited: Edit, every: bool) -> Column:
    """A content with the texts that ``edited`` (message, part, old text) gives, null where none; parts are numbered among the texts, or among ``every`` kind of part."""
    is_string = F.schema_of_variant(content) == "STRING"
    whole = F.try_variant_get(content, "$", "string")
    parts = F.try_variant_get(F.when(is_string, F.try_parse_json(F.when(whole.startswith("["), whole))).otherwise(content), "$", _LIST)
    is_text = lambda m: F.coalesce(_said(m, "type") == "text", F.lit(False))

    def result(m: Column, k: Column) -> Column:
        inner = F.try_element_at(m, F.lit("content"))
        listed = F.when(F.schema_of_variant(inner) != "STRING", F.try_variant_get(inner, "$", _LIST))
        put = lambda x: once(edited(msg, k, _said(x, "text")), lambda new: F.when(new.isNull(), x).otherwise(_put(x, "text", new.cast("variant"))))
        one = _as_variant(F.transform(listed, lambda x: F.when(is_text(x), put(x)).otherwise(x)))
        texts = F.size(F.filter(listed, is_text))
        whole = once(edited(msg, k, F.try_variant_get(inner, "$", "string")), lambda new: F.when(new.isNull(), m).otherwise(_put(m, "content", new.cast("variant"))))
        return F.when(listed.isNull(), whole).when(texts == 1, _put(m, "content", one)).otherwise(m)

    def part(m: Column, k: Column) -> Column:
        place = k if every else F.size(F.filter(F.slice(parts, 1, k), is_text))
        out = F.when(is_text(m), once(edited(msg, place, _said(m, "text")), lambda new: F.when(new.isNull(), m).otherwise(_put(m, "text", new.cast("variant")))))
        return (out.when(_said(m, "type") == "tool_result", result(m, place)) if every else out).otherwise(m)

    made = F.to_json(F.transform(parts, part))
    one = once(F.when(is_string, edited(msg, F.lit(0), whole)), lambda new: F.coalesce(new.cast("variant"), content))
    return F.when(parts.isNotNull(), F.when(is_string, made.cast("variant")).otherwise(F.parse_json(made))).otherwise(one)


def _written(bodies: DataFrame, edits: DataFrame, payload: str, body: str, style: str, new_text: Callable[[Column, Column], Column], null_payloads: bool = True) -> DataFrame:
    """``bodies`` with ``new_text`` (old text, edit) in the places that ``edits`` (payload, msg, part, edit) names."""
    if style not in FORMATS:
        raise ValueError(f"unknown style {style!r}")
    place = lambda msg, part: F.concat(msg.cast("string"), F.lit(":"), part.cast("string"))
    listed = edits.groupBy(F.col("payload").alias("_p")).agg(F.collect_list(F.struct(place(F.col("msg"), F.col("part")).alias("at"), "edit")).alias("_edits"))  # of one body
    listed = listed.withColumn("_ats", F.transform("_edits", lambda e: e["at"]))
    known = F.col(payload).eqNullSafe(F.col("_p")) if null_payloads else F.col(payload) == F.col("_p")
    own = bodies.join(listed, known, "left").withColumn("_fields", F.from_json(body, "map<string,variant>"))
    fields = F.col("_fields")
    name = "input" if style == "openai_responses" else "messages"
    every = style == "anthropic_messages"

    def edited(msg: Column, part: Column, old: Column) -> Column:
        edit = F.get("_edits", (F.array_position("_ats", place(msg, part)) - 1).cast("int"))["edit"]
        return once(edit, lambda e: F.when(e.isNotNull(), new_text(old, e)))

    def message(m: Column, k: Column) -> Column:
        content = F.try_element_at(m, F.lit("content"))
        out = F.when(content.isNotNull(), _put(m, "content", _edited(content, k, edited, every))).otherwise(m)
        if style == "openai_responses":
            output = F.when(_said(m, "type") == "function_call_output", edited(k, F.lit(0), _said(m, "output")))
            return once(output, lambda new: F.when(new.isNotNull(), _put(m, "output", new.cast("variant"))).otherwise(out))
        return out

    listed = F.try_variant_get(F.try_element_at(fields, F.lit(name)), "$", _LIST)
    out = F.when(listed.isNotNull(), _put(fields, name, _as_variant(F.transform(listed, message)))).otherwise(fields)
    if every:
        system = F.try_element_at(fields, F.lit("system"))
        out = F.when(system.isNotNull(), _put(out, "system", _edited(system, F.lit(-1), edited, False))).otherwise(out)
    new = F.when(F.col("_edits").isNull() | fields.isNull(), F.col(body)).otherwise(F.to_json(out))
    return own.select(*(new.alias(c) if c == body else F.col(c) for c in bodies.columns))


def written_back(bodies: DataFrame, texts: DataFrame, payload: str, body: str, style: str = "openai_chat", null_payloads: bool = True) -> DataFrame:
    """``bodies`` with the texts (payload, msg, part, text) in the places of their segments; all else stays.

    Objects are equal to what they were, their fields may stand in another order.  Bodies that cannot be read and
    bodies without new texts stay as they are, and so does a tool's result that is a list of several texts.
    ``null_payloads``: a null payload is a payload; without, bodies that lie together by payload stay where they are.
    """
    return _written(bodies, texts.withColumnRenamed("text", "edit"), payload, body, style, lambda _, new: new, null_payloads)


def deduped_bodies(bodies: DataFrame, payload: str, body: str, style: str = "openai_chat", scope: str = "all", min_chars: int = chunking.MIN_CONTENT_CHARS) -> DataFrame:
    """``bodies`` with the repeated blocks of their texts replaced; bodies without payload stay as they are.

    References alone meet the bodies, which are cut into blocks once more where something is replaced.
    """
    own = _looked_at(segments(bodies, payload, body, style, scope).where("payload IS NOT NULL"), min_chars)
    made = _references(own, min_chars).where("blocks_deduped > 0")

    def new_text(old: Column, edit: Column) -> Column:
        whole = F.struct(F.lit(None).cast("string").alias("field"), old.alias("text"))
        u = F.when(edit["kind"] == "tool_result", blockdedup.unwrapped(old, min_chars)).otherwise(whole)
        return once(u, lambda x: rebuilt(old, x["field"], x["text"], blockdedup.with_references(x["text"], edit["refs"])))

    return _written(bodies, made.select("payload", "msg", "part", F.struct("kind", "refs").alias("edit")), payload, body, style, new_text, False)


def occurrences(original: DataFrame, reordered: DataFrame, by: str) -> DataFrame:
    """(by, new_pos, pos): where each reordered document stood; the n-th copy of a text is the n-th of the original.

    Both sides: (by, pos, doc).
    """
    from pyspark.sql.window import Window

    copy = F.row_number().over(Window.partitionBy(by, "doc").orderBy("pos"))
    a = original.select(by, "doc", "pos", copy.alias("copy"))
    b = reordered.select(by, "doc", F.col("pos").alias("new_pos"), copy.alias("copy"))
    return b.join(a, [by, "doc", "copy"], "left").select(by, "new_pos", "pos")
