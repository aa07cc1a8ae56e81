"""Parameter proposals: parsing replies, clamping, merging, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys with (low, high, is whole); bounds are an input, these are the defaults.
BOUNDS = {"strength": (0.1, 0.9, False), "guidance_scale": (1.0, 15.0, False), "overlap_ratio": (0.0, 0.9, False), "gabor_alpha": (0.0, 1.0, False), "num_steps": (15.0, 60.0, True), "vl_max_side": (256.0, 1536.0, True), "k": (5.0, 90.0, False)}
VISUAL = ("overlap_ratio", "gabor_alpha", "sharpen_strength", "blend_sigma_divisor")


def json_blocks(text: Column, values: str = "string") -> Column:
    """Maps of the JSON objects fenced in a text, in order; without one, of the object that ends it."""
    fenced = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)```(?:json)?\s*([\s\S]*?)```"), 1), lambda x: F.trim(x)), lambda x: x.startswith("{"))
    parsed = lambda a: F.filter(F.transform(a, lambda x: F.from_json(x, f"map<string,{values}>")), lambda m: m.isNotNull())
    tail = F.regexp_extract(F.trim(text), r"(\{[\s\S]*\})\s*$", 1)
    blocks = parsed(fenced)
    return F.when(F.size(blocks) > 0, blocks).otherwise(parsed(F.array(tail)))


def parsed_reply(text: Column, values: str = "string") -> Column:
    """One map of a reply's parameters; later blocks win; null if there are none."""
    empty = F.from_json(F.lit("{}"), f"map<string,{values}>")
    merged = F.aggregate(json_blocks(text, values), empty, lambda a, m: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(m, k)), m))
    return F.when(F.size(merged) > 0, merged)


def typed_reply(text: Column) -> Column:
    """`parsed_reply` as map<string,variant>: numbers, truth values, lists and groups keep their types. A null text gives
    null; a key whose value is null stays, as a null variant."""
    return parsed_reply(text, "variant")


def clamped(rows: DataFrame, key: str = "key", value: str = "value", bounds: dict = BOUNDS) -> DataFrame:
    """Numbers inside their bounds: whole ones rounded, others to four places; keys that are unknown and
    values that are no numbers go. The bounds are a literal, so no join is needed."""
    x = F.col(value).try_cast("double")
    known = F.create_map(*[v for k, (lo, hi, whole) in bounds.items() for v in (F.lit(k), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(whole).alias("whole")))])
    rows = rows.withColumns({"__x": x, "__b": F.try_element_at(known, F.col(key))}).filter("__x is not null and __b is not null")
    held = F.greatest(F.col("__b.lo"), F.least(F.col("__b.hi"), F.when(F.col("__b.whole"), F.rint("__x")).otherwise(F.col("__x"))))
    return rows.withColumn(value, F.when(F.col("__b.whole"), held).otherwise(F.round(held, 4))).drop("__x", "__b")


# Keys whose values are text, with the most characters that are kept (None: all, trimmed).
TEXTS = {"notes_zh": 2000, "lora_path": None}


def texts(rows: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """The text parameters, cut or trimmed; other keys and nulls go."""
    x = F.col(value).cast("string")
    held = F.coalesce(*[F.when(F.col(key) == k, F.trim(x) if most is None else F.left(x, F.lit(most))) for k, most in TEXTS.items()])
    return rows.filter(F.col(key).isin(*TEXTS) & x.isNotNull()).withColumn(value, held)


def top_rates(rates: Column, k: int) -> Column:
    """The k largest entries of a map of rates as (tag, rate), ties by tag."""
    ordered = F.array_sort(F.transform(F.map_entries(rates), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("tag"))))
    return F.transform(F.slice(ordered, 1, k), lambda x: F.struct(x["tag"].alias("tag"), (-x["less"]).alias("rate")))


def merged(text: DataFrame, visual: DataFrame, on: list, weight: float = 0.6, bounds: dict = BOUNDS) -> DataFrame:
    """Two proposals by key: one side only is taken as it is, visual keys lean to the second, others are
    averaged. on ends with key; values are in `value`."""
    both = text.withColumnRenamed("value", "t").join(visual.withColumnRenamed("value", "v"), on, "full_outer")
    known = F.create_map(*[x for k, (lo, hi, _) in bounds.items() for x in (F.lit(k), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))])
    b = F.try_element_at(known, F.col("key"))
    lean = F.col("v") * weight + F.col("t") * (1 - weight)
    lean = F.when(b.isNull(), lean).otherwise(F.round(F.greatest(b["lo"], F.least(b["hi"], lean)), 4))
    mixed = F.when(F.col("key").isin(*VISUAL), lean).otherwise(F.round((F.col("t") + F.col("v")) / 2, 4))
    return both.select(*on, F.when(F.col("t").isNull(), F.col("v")).when(F.col("v").isNull(), F.col("t")).otherwise(mixed).alias("value"))


def latest(rows: DataFrame, by: list, time: str, tie: str, n: int) -> DataFrame:
    """The latest n of each line, numbered from the oldest of them."""
    newest = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(time), F.desc(tie)))).filter(F.col("__r") <= n)
    return newest.withColumn("index", F.row_number().over(Window.partitionBy(*by).orderBy(F.asc(time), F.asc(tie))).cast("int")).drop("__r")


def tuning_note(calibrated: Column, strict: Column, technical: Column, passed: Column) -> Column:
    """Which advice a run's rates call for, by the first rule that holds."""
    return (
        F.when(calibrated & strict.isNotNull() & (strict != F.coalesce(passed, F.lit(-1.0))), "check_strict_rate")
        .when(strict == 0, "fix_strict_defects")
        .when(technical.isNotNull() & (technical != F.coalesce(passed, F.lit(-1.0))), "use_technical_rate")
        .otherwise("synced")
    )


def typed(reply: Column, key: str, path: str, kind: str) -> Column:
    """The value at a path below a key, null where there is none or it cannot be of that kind."""
    return F.try_variant_get(F.try_element_at(reply, F.lit(key)), path, kind)


def kind_of(value: Column) -> Column:
    """object, array, text, truth, number or null."""
    name = F.schema_of_variant(value)
    named = F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "text").when(name == "BOOLEAN", "truth").when(name == "VOID", "null")
    return F.when(value.isNotNull(), named.otherwise("number"))


def reply_fields(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """(key, kind, n): what the replies' keys hold, one partial count a task before the shuffle."""
    return replies.select(F.explode(reply).alias("key", "value")).groupBy("key", kind_of(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))
