"""Operator 3: chat formatting with linked tool calls.

An assistant's text may be a JSON object with `tool_calls` (and `content` beside them, which becomes a message of the
assistant before its calls), a tool's text one with `tool_call_id`; other texts are plain messages of their own roles. A
call is {id, name, arguments, after}, or {id, function: {name, arguments}}; arguments are an object or JSON text of one.
Other fields of such objects are not carried.
Calls and results are hash-joined by conversation and identifier: each side is first counted by identifier, so every
message stays one row however often an identifier repeats, and a repeat is marked ambiguous. A result comes after its
call, and a call after the results of the identifiers in `after`, of all calls of its identifier; (depth, level) orders all
of it topologically, depth being the latest turn of a message and of what it waits for, level its steps after that. Calls
that wait for each other, or for such calls, are marked cyclic and stay at their own turn. Arguments are checked row by row
against the schema of the tool that the call names, as variants, and every message becomes canonical JSON: sorted keys, no
white space, minimal escapes. format_conversations() joins the messages of a conversation in order, in parts of PART
messages; calls and results that are marked derived go to a list of their own, `trace`, and not into the chat.

Nulls: a null conversation is one of its own; a null identifier links with nothing; a null turn comes first; null texts
are JSON nulls, and invalid. Results without a call and calls without a result stay, unlinked. Arguments that are no JSON
object, or repeat a key, are invalid; what does not parse is kept as a JSON string. Equal rows are messages of their own,
in any order. An empty table gives no rows. Only the named columns are read, so others cannot clash. Arguments up to a
variant's size limit are checked; longer ones are kept as strings and invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.common import discard, heavy_join, table, written

#: Messages in one part of a formatted conversation; a conversation of any length is never one group.
PART = 1000
#: Tools whose schemas may be broadcast.
MAX_TOOLS = 10_000
#: Variant types that each JSON-schema type allows.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID"}

#: Arguments are read as text, so that JSON text and objects look alike and repeated keys stay.
CALL = "array<struct<id:string,name:string,arguments:string,after:array<string>,function:struct<name:string,arguments:string>>>"
#: Kinds of messages, in their order at one place.
OTHER, CALLS, RESULT = 0, 1, 2


def json_string(c: Column) -> Column:
    """A JSON string of a text, null for null: quotes, backslashes and control characters are escaped."""
    out = c
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\f", "\\f"), ("\r", "\\r")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    # Other control characters are rare: only texts that hold one are cut at them.
    pieces = F.split(out, r"(?<=[\x00-\x1f])|(?=[\x00-\x1f])")
    coded = F.transform(pieces, lambda x: F.when((F.length(x) == 1) & (x < F.lit(" ")), F.concat(F.lit("\\u00"), F.lower(F.hex(x)))).otherwise(x))
    out = F.when(F.regexp_like(out, F.lit(r"[\x00-\x1f]")), F.array_join(coded, "")).otherwise(out)
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def canonical_json(fields: dict[str, Column]) -> Column:
    """An object whose values are JSON already, keys in order."""
    parts = []
    for k in sorted(fields):
        parts += [F.lit(("," if parts else "{") + f'"{k}":'), fields[k]]
    return F.concat(*parts, F.lit("}"))


def number(c: str) -> Column:
    """A JSON number of a whole number, null for null."""
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of messages(conv_id, turn, role, text): calls, results and other messages, as link_messages() takes them."""
    like_json = F.coalesce(F.ltrim(F.col("text")).startswith("{"), F.lit(False))
    made = F.when(like_json & (F.col("role") == "assistant"), F.from_json("text", f"struct<tool_calls:{CALL},content:string>"))
    answer = F.when(like_json & (F.col("role") == "tool"), F.from_json("text", "struct<tool_call_id:string,content:string>"))
    typed = F.when(like_json & (F.col("role") == "tool"), F.from_json("text", "struct<content:variant>")["content"])
    read = messages.select("conv_id", "turn", "role", "text", made.alias("_made"), answer.alias("_answer"), typed.alias("_typed"))
    call = F.coalesce(F.size("_made.tool_calls") > 0, F.lit(False))
    result = F.coalesce(F.col("_answer.tool_call_id").isNotNull(), F.lit(False))
    each = read.where(call).select("conv_id", "turn", F.explode("_made.tool_calls").alias("c"))
    calls = each.select("conv_id", "turn", F.col("c.id").alias("call_id"), *(F.coalesce(f"c.{f}", f"c.function.{f}").alias(f) for f in ("name", "arguments")), F.col("c.after").alias("after"))
    # A result's content that is no string is stored as canonical JSON, or as it stands where it repeats a key.
    content = F.when(F.col("_answer.content").isNotNull(), F.coalesce(F.try_variant_get("_typed", "$", "string"), F.to_json("_typed"), F.col("_answer.content")))
    results = read.where(~call & result).select("conv_id", "turn", F.col("_answer.tool_call_id").alias("call_id"), content.alias("content"))
    others = read.where(~result & (~call | F.col("_made.content").isNotNull()))
    return calls, results, others.select("conv_id", "turn", "role", F.when(call, F.col("_made.content")).otherwise(F.col("text")).alias("content"))


def check_arguments(calls: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """Adds `valid` and canonical `arguments_json` to calls(name, arguments).

    tools maps a name to a JSON schema: properties with type (one or a list), enum, minimum, maximum, minLength; required;
    additionalProperties (true if absent). A call of an unknown tool is invalid.
    """
    if len(tools) > MAX_TOOLS:
        raise ValueError(f"{len(tools)} tools; their schemas are broadcast up to {MAX_TOOLS}")
    rows = []
    for name, schema in tools.items():
        fields = []
        for field, rule in schema.get("properties", {}).items():
            kinds = [rule["type"]] if isinstance(rule.get("type"), str) else rule.get("type") or list(TYPES)
            enum = rule.get("enum")
            fields.append((field, "|".join(TYPES[k] for k in kinds), None if enum is None else [str(x) for x in enum], *(None if rule.get(k) is None else float(rule[k]) for k in ("minimum", "maximum", "minLength"))))
        rows.append((name, fields, list(schema.get("required", [])), bool(schema.get("additionalProperties", True))))
    kind = "name string, fields array<struct<field:string,kinds:string,enum:array<string>,low:double,high:double,least:double>>, required array<string>, open boolean"
    known = calls.sparkSession.createDataFrame(rows, kind).withColumnsRenamed({"name": "_tool", "fields": "_fields", "required": "_required", "open": "_open"})
    parsed = calls.withColumn("_variant", F.try_parse_json("arguments"))
    given = parsed.withColumn("_given", F.try_variant_get("_variant", "$", "map<string,variant>"))
    joined = given.join(F.broadcast(known), F.col("name") == F.col("_tool"), "left")

    def sound(f: Column) -> Column:
        x = F.element_at("_given", f["field"])
        text, value = F.try_variant_get(x, "$", "string"), F.try_variant_get(x, "$", "double")
        return x.isNull() | (
            F.regexp_like(F.schema_of_variant(x), F.concat(F.lit("^("), f["kinds"], F.lit(")$")))
            & (f["enum"].isNull() | F.array_contains(f["enum"], text)) & (f["low"].isNull() | (value >= f["low"]))
            & (f["high"].isNull() | (value <= f["high"])) & (f["least"].isNull() | (F.length(text) >= f["least"]))
        )

    has = F.map_keys("_given")
    names = F.transform("_fields", lambda f: f["field"])
    valid = F.forall("_required", lambda r: F.array_contains(has, r)) & F.forall("_fields", sound) & (F.col("_open") | (F.size(F.array_except(has, names)) == 0))
    out = joined.withColumns({"valid": F.coalesce(valid, F.lit(False)), "arguments_json": F.coalesce(F.to_json("_variant"), json_string(F.col("arguments")))})
    return out.drop("_given", "_variant", "_tool", "_fields", "_required", "_open")


#: What tells an identifier apart: derived calls link with derived results alone.
KEY = ["conv_id", "derived", "call_id"]


def _places(named: DataFrame, ids: DataFrame, waiting: bool) -> DataFrame:
    """(KEY, c_at, cyclic): where each identifier's call stands, c_at being (depth, level).

    Only conversations in which something waits for a later turn are walked in rounds, one for each step of the longest
    chain; in all others every call stands at its own turn. A round writes what it places and what still waits, and
    deletes what waited before it.
    """
    own = F.struct(F.col("c_turn").alias("depth"), F.lit(0).alias("level"))
    ids = ids.where("n_calls > 0")
    plain = ids.select(*KEY, own.alias("c_at"), F.lit(False).alias("cyclic"))
    if not waiting:
        return plain
    spark = ids.sparkSession
    asked = named.where(F.col("kind") == CALLS).select("conv_id", "derived", F.col("call_id").alias("v"), F.explode("after").alias("call_id")).distinct()
    ends = ids.select(*KEY, F.greatest("c_turn", "r_turn").alias("_turn"))
    turns = ids.select("conv_id", "derived", F.col("call_id").alias("v"), F.col("c_turn").alias("v_turn"))
    waits = written(asked.join(ends, KEY).join(turns, ["conv_id", "derived", "v"]), "waits")
    odd = waits.where("_turn >= v_turn").select("conv_id", "derived").distinct()
    edges = written(waits.join(odd, ["conv_id", "derived"], "left_semi").select(*KEY, "v"), "edges")
    need = edges.groupBy("conv_id", "derived", F.col("v").alias("call_id")).agg(F.count("*").alias("need"))
    place = "struct<depth:bigint,level:int>"
    start = ids.join(odd, ["conv_id", "derived"], "left_semi").join(need, KEY, "left")
    rest = written(start.select(*KEY, "c_turn", "r_turn", F.coalesce("need", F.lit(0)).alias("need"), F.lit(None).cast(place).alias("end")), "rest")
    discard(waits)
    steps = []
    while True:
        at = F.when(F.col("end.depth") >= F.col("c_turn"), F.struct(F.col("end.depth").alias("depth"), (F.col("end.level") + 1).alias("level"))).otherwise(own)
        step = written(rest.where("need = 0").select(*KEY, at.cast(place).alias("c_at"), "r_turn"), "placed")
        if step.isEmpty():
            discard(step)
            break
        steps.append(step)
        # A call's result stands at its own turn, or one step after the call where that is later.
        after = F.when(F.col("r_turn") > F.col("c_at.depth"), F.struct(F.col("r_turn").alias("depth"), F.lit(0).alias("level"))).when(F.col("r_turn").isNotNull(), F.struct(F.col("c_at.depth").alias("depth"), (F.col("c_at.level") + 1).alias("level"))).otherwise(F.col("c_at"))
        met = edges.join(step.select(*KEY, after.cast(place).alias("_end")), KEY).groupBy("conv_id", "derived", F.col("v").alias("call_id")).agg(F.count("*").alias("_met"), F.max("_end").alias("_end"))
        left = rest.where("need > 0").join(met, KEY, "left").select(*KEY, "c_turn", "r_turn", (F.col("need") - F.coalesce("_met", F.lit(0))).alias("need"), F.greatest("end", "_end").alias("end"))
        old, rest = rest, written(left, "rest")
        discard(old)
    discard(edges)
    moved = rest.select(*KEY, F.lit(None).cast(place).alias("_at"), F.lit(True).alias("_cyclic"))
    if steps:
        placed = spark.read.schema(steps[0].schema).parquet(*(x._tabloom_path for x in steps))
        moved = moved.unionByName(placed.select(*KEY, F.col("c_at").alias("_at"), F.lit(False).alias("_cyclic")))
    seen = plain.join(moved, KEY, "left")
    return seen.select(*KEY, F.coalesce("_at", F.col("c_at").cast(place)).alias("c_at"), F.coalesce("_cyclic", F.lit(False)).alias("cyclic"))


def link_messages(calls: DataFrame, results: DataFrame, others: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """One row for each message: (conv_id, call_id, derived, depth, level, kind, linked, ambiguous, cyclic, valid, json).

    Takes calls(conv_id, call_id, turn, name, arguments string, after array<string>), results(conv_id, call_id, turn,
    content) and others(conv_id, turn, role, content); calls and results may have a boolean `derived`. Kinds are OTHER,
    CALLS and RESULT.
    """
    none = F.lit(None)
    checked = check_arguments(calls, tools)
    as_call = canonical_json({"arguments": F.col("arguments_json"), "id": json_string(F.col("call_id")), "name": json_string(F.col("name")), "role": F.lit('"assistant"'), "turn": number("turn")})
    as_result = canonical_json({"content": json_string(F.col("content")), "id": json_string(F.col("call_id")), "role": F.lit('"tool"'), "turn": number("turn")})
    as_other = canonical_json({"content": json_string(F.col("content")), "role": json_string(F.col("role")), "turn": number("turn")})

    def shape(df: DataFrame, kind: int, call_id: Column, after: Column, valid: Column, json: Column) -> DataFrame:
        derived = F.coalesce("derived", F.lit(False)) if "derived" in df.columns else F.lit(False)
        return df.select("conv_id", call_id.cast("string").alias("call_id"), derived.alias("derived"), F.col("turn").cast("bigint").alias("turn"), F.lit(kind).alias("kind"), after.cast("array<string>").alias("after"), valid.alias("valid"), json.alias("json"))

    there, name = F.col("content").isNotNull(), F.col("call_id")
    both = shape(checked, CALLS, name, F.col("after"), F.col("valid"), as_call).unionByName(shape(results, RESULT, name, none, there, as_result))
    rest = shape(others, OTHER, none, none, there, as_other)
    named = written(both.where("conv_id is not null and call_id is not null"), "messages")
    is_call = F.col("kind") == CALLS
    counted = named.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.count_if(is_call).alias("n_calls"), F.min(F.when(is_call, F.col("turn"))).alias("c_turn"), F.min(F.when(~is_call, F.col("turn"))).alias("r_turn"), F.count_if(F.size("after") > 0).alias("n_waits")
    )
    ids = written(counted, "identifiers")
    total, waits = ids.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_waits"), F.lit(0))).first()  # one row
    info = ids.join(_places(named, ids, waits > 0), KEY, "left").select(*KEY, "n", "n_calls", "c_at", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    met = heavy_join(named, written(info, "links"), KEY, "n", total)
    other_side = F.when(is_call, F.col("n") - F.col("n_calls")).otherwise(F.col("n_calls"))
    after_call = ~is_call & F.coalesce(F.col("c_at.depth") >= F.col("turn"), F.lit(False))
    # A repeated call stands at its own turn, or where the first of its kind waits if that is later.
    late = is_call & F.coalesce(F.col("c_at.depth") >= F.col("turn"), F.lit(False))
    linked = met.select(
        "conv_id", "call_id", "derived", F.greatest("turn", "c_at.depth").alias("depth"), F.when(after_call, F.col("c_at.level") + 1).when(late, F.col("c_at.level")).otherwise(0).alias("level"),
        "kind", (other_side > 0).alias("linked"), ((F.col("n_calls") > 1) | (F.col("n") - F.col("n_calls") > 1)).alias("ambiguous"), "cyclic", "valid", "json",
    )
    single = both.where("conv_id is null or call_id is null").unionByName(rest)
    false = F.lit(False)
    return linked.unionByName(single.select("conv_id", "call_id", "derived", F.col("turn").alias("depth"), F.lit(0).alias("level"), "kind", false.alias("linked"), false.alias("ambiguous"), false.alias("cyclic"), "valid", "json"))


ORDER = ("conv_id", "depth", "level", "kind", "call_id", "json")


def with_positions(messages: DataFrame) -> DataFrame:
    """Adds the 0-based position in the conversation, by a sort into ranges: no conversation is one task's work."""
    ranged = messages.repartitionByRange(*(F.col(c).asc_nulls_first() for c in ORDER[:-1]), F.xxhash64("json")).sortWithinPartitions(*ORDER)
    sorted_ = written(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "sorted")
    spans = sorted_.groupBy("conv_id", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col("conv_id").alias("_conv"), F.col("_range").alias("_of"), "_first", before.alias("_before"))
    met = sorted_.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_range") == F.col("_of")))
    return met.withColumn("position", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_conv", "_of", "_first", "_before")


def format_conversations(linked: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, n_messages, n_calls, n_linked, n_ambiguous, n_cyclic, n_valid, chat, trace): `part` messages a row, in order.

    `chat` holds messages, and calls and results that texts hold; `trace` the derived ones. Counts but n_messages are of both.
    """
    placed = with_positions(linked).withColumn("part", F.floor(F.col("position") / part))
    flag = lambda c: F.count_if(c).alias(f"n_{c}")
    grouped = placed.groupBy("conv_id", "part").agg(F.count_if(~F.col("derived")).alias("n_messages"), F.count_if(F.col("kind") == CALLS).alias("n_calls"), *map(flag, ("linked", "ambiguous", "cyclic", "valid")), F.sort_array(F.collect_list(F.struct("position", "derived", "json"))).alias("_m"))
    of = lambda side: F.concat(F.lit("["), F.array_join(F.transform(F.filter("_m", lambda m: m["derived"] == side), lambda m: m["json"]), ","), F.lit("]"))
    return grouped.withColumns({"chat": of(False), "trace": of(True)}).drop("_m")


#: The tool that a user's turn calls in the trace.
TOOLS = {"reply": {"properties": {"length": {"type": "integer", "minimum": 1}, "sha256": {"type": "string", "minLength": 64}}, "required": ["length", "sha256"], "additionalProperties": False}}


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `conversations`, formatted, a row for each conversation (for each 1000 of its messages and links).

    Every text stays a message of its own role and turn; texts that hold calls and results are read as such. Beside the
    chat, `trace` links questions and answers: a user's turn is a call of the tool `reply`, the assistant's next turn its
    result, each naming its text by digest. ORACLE_SQL covers tables of plain texts, as the supplied ones.
    """
    calls, results, plain = parse_messages(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    name = lambda n: F.concat(F.col("conv_id").cast("string"), F.lit("-"), n.cast("string"))
    digest = F.sha2("content", 256)
    arguments = canonical_json({"length": F.coalesce(F.length("content").cast("string"), F.lit("null")), "sha256": json_string(digest)})
    derived, none = F.lit(True).alias("derived"), F.lit(None).cast("array<string>")
    asked = plain.where("role = 'user'").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), none.alias("after"), derived)
    told = plain.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), digest.alias("content"), derived)
    real = F.lit(False)
    return format_conversations(link_messages(calls.withColumn("derived", real).unionByName(asked), results.withColumn("derived", real).unionByName(told), plain, TOOLS))


def _sql_json(c: str) -> str:
    out = f"replace(replace({c}, '\\', '\\\\'), '\"', '\\\"')"
    for code in range(32):
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(code, f"\\u{code:04x}")
        out = f"replace({out}, chr({code}), '{short}')"
    return f"coalesce('\"' || {out} || '\"', 'null')"


ORACLE_SQL = f"""
with c as (select conv_id, conv_id || '-' || turn as call_id, turn, text from conversations where role = 'user'),
r as (select conv_id, conv_id || '-' || (turn - 1) as call_id, turn, text from conversations where role = 'assistant'),
g as (select conv_id, call_id, count(*) filter (kind = 1) as nc, count(*) filter (kind = 2) as nr, min(turn) filter (kind = 1) as ct
  from (select conv_id, call_id, turn, 1 as kind from c union all select conv_id, call_id, turn, 2 from r) group by all),
m as (
  select c.conv_id, c.call_id, true as derived, c.turn as depth, 0 as level, 1 as kind, coalesce(nr > 0, false) as linked, coalesce(nc > 1 or nr > 1, false) as ambiguous, coalesce(text <> '', false) as valid,
    '{{"arguments":{{"length":' || coalesce(length(text)::varchar, 'null') || ',"sha256":' || coalesce('"' || sha256(text) || '"', 'null') || '}},"id":' || {_sql_json('c.call_id')}
      || ',"name":"reply","role":"assistant","turn":' || coalesce(c.turn::varchar, 'null') || '}}' as json
  from c left join g on c.conv_id = g.conv_id and c.call_id = g.call_id
  union all
  select r.conv_id, r.call_id, true, greatest(r.turn, ct), case when ct >= r.turn then 1 else 0 end, 2, coalesce(nc > 0, false), coalesce(nc > 1 or nr > 1, false), text is not null,
    '{{"content":' || coalesce('"' || sha256(text) || '"', 'null') || ',"id":' || {_sql_json('r.call_id')} || ',"role":"tool","turn":' || coalesce(r.turn::varchar, 'null') || '}}'
  from r left join g on r.conv_id = g.conv_id and r.call_id = g.call_id
  union all
  select conv_id, null, false, turn, 0, 0, false, false, text is not null,
    '{{"content":' || {_sql_json('text')} || ',"role":' || {_sql_json('role')} || ',"turn":' || coalesce(turn::varchar, 'null') || '}}'
  from conversations),
p as (select *, row_number() over (partition by conv_id order by depth nulls first, level, kind, call_id nulls first, json) - 1 as position from m)
select conv_id, position // {PART} as part, count(*) filter (not derived) as n_messages, count(*) filter (kind = 1) as n_calls, count(*) filter (linked) as n_linked,
  count(*) filter (ambiguous) as n_ambiguous, 0::bigint as n_cyclic, count(*) filter (valid) as n_valid,
  '[' || coalesce(string_agg(json, ',' order by position) filter (not derived), '') || ']' as chat, '[' || coalesce(string_agg(json, ',' order by position) filter (derived), '') || ']' as trace
from p group by conv_id, position // {PART}
"""
