"""Tool-call linking (operator 7, DataFrame functions only).

Calls and results are hash-joined by (conversation, call id); calls are put in
topological order of the calls they wait for; arguments are validated against
the tool's schema; each call becomes one line of canonical JSON (sorted keys,
no blanks).

Every key holds the call id, so a conversation with a third of all turns is
spread over all tasks and never gathered.  Runs of calls that each wait for
one are contracted by pointer doubling; the order of the others comes from
rounds of equi-joins over the calls that are still open.  Each round is written
to the shared folder: as many as the logarithm of the longest run, plus the
most calls with several waits on one path.

Defined cases: of calls (or results) with the same id in a conversation the one
with the least turn, then content, counts, the others are ``duplicates``; a
result without a call is a row without ``name``; a call without a result is not
linked; a wait for an unknown call is ignored and reported; calls in a cycle,
or waiting for one, have a null ``level`` and are reported; arguments that are
no JSON object, and unknown tools, are reported; rows without a call id or
conversation are dropped; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.llm.common import stored

# fixed values: tools, their parameters, JSON types and whether they are required
SCHEMAS = [
    ("search", [("limit", "BIGINT", True), ("query", "STRING", True)]),
    ("translate", [("formal", "BOOLEAN", False), ("target", "STRING", True), ("text", "STRING", True)]),
    ("count", [("text", "STRING", True), ("unit", "STRING", False)]),
]

_CALL = "turn", "name", "arguments", "after"


def extract(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results derived from conversations without tools: a user's
    turn is a call (which tool, its arguments and which earlier call it waits
    for follow from the turn and its words), the assistant's next turn its
    result."""
    t = turns.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    call_id = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    words = F.size(F.split("text", " ")).cast("bigint")
    kind = F.col("turn") % 3
    # a limit written as text breaks the schema
    arguments = F.when(kind == 0, F.when(words % 5 == 0, F.to_json(F.struct(line.alias("query"), words.cast("string").alias("limit"))))
                       .otherwise(F.to_json(F.struct(line.alias("query"), words.alias("limit"))))) \
        .when(kind == 1, F.when(words % 7 == 0, F.to_json(F.struct(line.alias("text"), (words > 9).alias("formal"))))
              .otherwise(F.to_json(F.struct(line.alias("text"), F.lit("en").alias("target"), (words > 9).alias("formal"))))) \
        .otherwise(F.to_json(F.struct(line.alias("text"), F.lit("word").alias("unit"))))
    name = F.when(kind == 0, "search").when(kind == 1, "translate").otherwise("count")
    after = F.when((F.col("turn") >= 2) & (F.col("turn") % 8 > 1), F.array(call_id(F.col("turn") - 2)))
    calls = t.where("role = 'user'").select("conv_id", call_id(F.col("turn")).alias("call_id"), "turn", name.alias("name"),
                                            arguments.alias("arguments"), after.alias("after"))
    results = t.where("role = 'assistant'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), "turn",
                                                   F.col("text").alias("content"))
    return calls, results


def _first(rows: DataFrame, *cols: str) -> DataFrame:
    """One row per (conv_id, call_id), and how many more there were."""
    out = rows.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(
        F.min(F.struct(*cols)).alias("_r"), (F.count("*") - 1).alias("more"))
    return out.select("conv_id", "call_id", *[F.col(f"_r.{c}").alias(c) for c in cols], "more")


def _chains(waits: DataFrame) -> DataFrame:
    """(conv_id, call_id, to, dist): for every call with exactly one wait the
    first call up its chain that has none or several, and the steps to it, by
    pointer doubling: as many rounds as the logarithm of the longest chain.
    ``to`` is null where the chain is a cycle or leads into one."""
    one = waits.groupBy("conv_id", "call_id").agg(F.min("dep").alias("to"), F.count("*").alias("n"))
    one = stored(one.where("n = 1").select("conv_id", "call_id", "to"), "one-wait")
    more = one.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("more"))
    cur = stored(one.join(more, ["conv_id", "to"], "left").select(
        "conv_id", "call_id", "to", F.lit(1).cast("bigint").alias("dist"), F.col("more").isNotNull().alias("more")), "chains")
    # no path without a cycle has more calls than its conversation
    longest = one.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    steps = 1
    while steps < longest and cur.where("more").limit(1).count():
        ahead = cur.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("to2"),
                           F.col("dist").alias("dist2"), F.col("more").alias("more2"))
        moved = cur.where("more").join(ahead, ["conv_id", "to"]).select(
            "conv_id", "call_id", F.col("to2").alias("to"), (F.col("dist") + F.col("dist2")).alias("dist"),
            F.col("more2").alias("more"))
        cur = stored(cur.where("NOT more").unionByName(moved), "chains")
        steps *= 2
    return cur.select("conv_id", "call_id", F.when(~F.col("more"), F.col("to")).alias("to"), "dist")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that wait for none, else one more
    than the greatest level waited for.  Calls in cycles have no row."""
    waits = calls.select("conv_id", "call_id", F.explode("after").alias("dep")).distinct()
    known = calls.select("conv_id", F.col("call_id").alias("dep"))
    waits = stored(waits.join(known, ["conv_id", "dep"]), "waits")
    waiting = waits.select("conv_id", "call_id").distinct()
    fresh = calls.select("conv_id", "call_id").join(waiting, ["conv_id", "call_id"], "left_anti")
    done = fresh = stored(fresh.withColumn("level", F.lit(0).cast("bigint")), "level")
    chains = stored(_chains(waits), "chain-ends")
    # waits of calls with several: the end of the chain waited for, and the steps to it
    end = chains.select("conv_id", F.col("call_id").alias("dep"), "to", "dist", F.lit(True).alias("chained"))
    open_ = waits.join(chains.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    open_ = stored(open_.join(end, ["conv_id", "dep"], "left").select(
        "conv_id", "call_id", F.when(F.col("chained"), F.col("to")).otherwise(F.col("dep")).alias("to"),
        F.coalesce("dist", F.lit(0)).alias("dist"), F.lit(None).cast("bigint").alias("met")), "waits-open")
    while open_.limit(1).count() and fresh.limit(1).count():
        hit = fresh.select("conv_id", F.col("call_id").alias("to"), "level")
        marked = stored(open_.join(hit, ["conv_id", "to"], "left").select(
            "conv_id", "call_id", "to", "dist", F.coalesce("met", F.col("level") + F.col("dist")).alias("met")), "waits-open")
        per = marked.groupBy("conv_id", "call_id").agg(F.max("met").alias("met"), F.count(F.when(F.col("met").isNull(), 1)).alias("left"))
        fresh = stored(per.where("left = 0").select("conv_id", "call_id", (F.col("met") + 1).alias("level")), "level")
        done = done.unionByName(fresh)
        open_ = marked.join(fresh.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    of_end = done.select("conv_id", F.col("call_id").alias("to"), "level")
    return done.unionByName(chains.join(of_end, ["conv_id", "to"]).select(
        "conv_id", "call_id", (F.col("level") + F.col("dist")).alias("level")))


def _problems(params):
    """Names of the violations of a schema, in the order of its parameters."""
    m, types = F.col("_args"), F.col("_types")
    return F.concat(
        F.filter(F.transform(params, lambda p: F.when(
            ~F.array_contains(F.map_keys(m), p["param"]), F.when(p["required"], F.concat(F.lit("missing "), p["param"])))
            .when(F.element_at(types, p["param"]) != p["type"], F.concat(F.lit("type of "), p["param"]))), lambda x: x.isNotNull()),
        F.transform(F.filter(F.array_sort(F.map_keys(m)), lambda k: ~F.exists(params, lambda p: p["param"] == k)),
                    lambda k: F.concat(F.lit("unknown "), k)))


def schema_table(spark, schemas=None) -> DataFrame:
    tools = [F.struct(F.lit(n).alias("tool"), F.array(*[
        F.struct(F.lit(p).alias("param"), F.lit(t).alias("type"), F.lit(r).alias("required")) for p, t, r in ps]).alias("params"))
        for n, ps in (schemas or SCHEMAS)]
    return spark.range(1).select(F.inline(F.array(*tools)))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call id: conv_id, call_id, name, level, linked, duplicates,
    problems (joined by '; '), json."""
    calls = stored(_first(calls.select("conv_id", "call_id", *_CALL), *_CALL), "calls")
    results = _first(results.select("conv_id", "call_id", "turn", "content"), "turn", "content").select(
        "conv_id", "call_id", F.col("turn").alias("r_turn"), "content", F.col("more").alias("r_more"))
    both = calls.join(results, ["conv_id", "call_id"], "full")
    both = both.join(levels(calls), ["conv_id", "call_id"], "left")
    unknown = (calls.select("conv_id", "call_id", F.explode("after").alias("dep")).distinct()
               .join(calls.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_anti")
               .groupBy("conv_id", "call_id").agg(F.count("*").alias("n_unknown")))
    both = both.join(unknown, ["conv_id", "call_id"], "left")
    both = both.join(F.broadcast(schemas), F.col("name") == F.col("tool"), "left")  # the schema table is given
    is_call = F.col("turn").isNotNull() | F.col("name").isNotNull() | F.col("arguments").isNotNull()
    parsed = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    both = both.withColumn("_object", is_object).withColumn(
        "_raw", F.when(F.col("_object"), F.from_json("arguments", "map<string,variant>")))
    both = both.withColumn("_args", F.map_from_entries(F.transform(
        F.array_sort(F.map_keys("_raw")), lambda k: F.struct(k, F.element_at("_raw", k)))))
    both = both.withColumn("_types", F.transform_values("_args", lambda k, v: F.schema_of_variant(v)))
    list_of = lambda c, text: F.when(c, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    problems = F.when(~is_call, F.array(F.lit("result without call"))).otherwise(F.concat(
        list_of(F.col("tool").isNull(), "unknown tool"), list_of(~F.col("_object"), "arguments are no object"),
        F.coalesce(_problems(F.col("params")), F.array().cast("array<string>")),
        list_of(F.col("n_unknown").isNotNull(), "waits for unknown call"), list_of(F.col("level").isNull(), "cycle")))
    # keys in alphabetical order
    json = F.to_json(F.struct(F.col("_args").alias("arguments"), "call_id", "conv_id", "level", "name",
                              F.col("content").alias("result")))
    return both.select(
        "conv_id", "call_id", "name", F.col("level").cast("bigint").alias("level"),
        (is_call & F.col("r_turn").isNotNull()).alias("linked"),
        (F.coalesce("more", F.lit(0)) + F.coalesce("r_more", F.lit(0))).alias("duplicates"),
        F.array_join(problems, "; ").alias("problems"), json.alias("json"))


SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS text FROM conversations
                     WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
w AS (SELECT *, string_split(text, chr(10))[1] AS line, len(string_split(text, ' ')) AS n FROM t),
calls AS (
  SELECT conv_id, 'c' || conv_id || '-' || turn AS call_id, turn, n,
         CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'translate' ELSE 'count' END AS name,
         CASE turn % 3
           WHEN 0 THEN '{"limit":' || CASE WHEN n % 5 = 0 THEN '"' || n || '"' ELSE n::VARCHAR END
                       || ',"query":' || to_json(line)::VARCHAR || '}'
           WHEN 1 THEN '{"formal":' || CASE WHEN n > 9 THEN 'true' ELSE 'false' END
                       || CASE WHEN n % 7 = 0 THEN '' ELSE ',"target":"en"' END || ',"text":' || to_json(line)::VARCHAR || '}'
           ELSE '{"text":' || to_json(line)::VARCHAR || ',"unit":"word"}' END AS args,
         CASE WHEN turn >= 2 AND turn % 8 > 1 THEN 'c' || conv_id || '-' || (turn - 2) END AS dep
  FROM w WHERE role = 'user'),
res AS (SELECT conv_id, 'c' || conv_id || '-' || (turn - 1) AS call_id, text FROM t WHERE role = 'assistant'),
lv(conv_id, call_id, level) AS (
  SELECT c.conv_id, c.call_id, 0 FROM calls c LEFT JOIN calls d ON d.conv_id = c.conv_id AND d.call_id = c.dep
  WHERE d.call_id IS NULL
  UNION ALL
  SELECT c.conv_id, c.call_id, level + 1 FROM lv JOIN calls c ON c.conv_id = lv.conv_id AND c.dep = lv.call_id)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, name, level::BIGINT AS level,
       c.call_id IS NOT NULL AND r.call_id IS NOT NULL AS linked, 0::BIGINT AS duplicates,
       CASE WHEN c.call_id IS NULL THEN 'result without call' ELSE concat_ws('; ',
         CASE WHEN name = 'search' AND n % 5 = 0 THEN 'type of limit' WHEN name = 'translate' AND n % 7 = 0 THEN 'missing target' END,
         CASE WHEN dep IS NOT NULL AND NOT EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = c.conv_id AND d.call_id = c.dep)
              THEN 'waits for unknown call' END) END AS problems,
       '{' || CASE WHEN args IS NULL THEN '' ELSE '"arguments":' || args || ',' END
         || '"call_id":"' || coalesce(c.call_id, r.call_id) || '","conv_id":' || coalesce(c.conv_id, r.conv_id)
         || CASE WHEN c.call_id IS NULL THEN '' ELSE ',"level":' || level || ',"name":"' || name || '"' END
         || CASE WHEN r.call_id IS NULL THEN '' ELSE ',"result":' || to_json(r.text)::VARCHAR END || '}' AS json
FROM calls c FULL JOIN res r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
LEFT JOIN lv ON lv.conv_id = c.conv_id AND lv.call_id = c.call_id
"""
