"""Auditing of conversation logs: invented prices, missing sources, answers rebuilt from tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a tool says without a price, how prices look, and the texts put in.
NO_PRICE = "narx mavjud emas"
CURRENCY = "(?iu)[0-9][0-9\\s.,]{1,12}\\s?(so'?m|so‘m|uzs|usd|eur|try|aed|gbp|rub|\\$|€)"
PRICE_WARNING = (
    "⚠️ Ushbu yo'nalish uchun narx ma'lumoti mavjud emas — aktiv provayder narx "
    "taqdim etmaydi. Quyida haqiqiy API natijasi:\n\n"
)
WEB_TOOLS = ("web_search", "recommend_destination_guide")
LOOKUP_TOOLS = ("search_products_tool", "filter_products_tool", "compare_products_tool", "find_cheapest_tool", "product_details_tool")
_URL = "https?://\\S+"

PRODUCT = "name string, brand string, price double, currency string, store string, in_stock boolean, url string"


def with_turns(log: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """`log` with `round`: how many human messages came up to here."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("round", F.sum(F.col("role").isin("user", "human").cast("int")).over(w))


def _last_tool(test: Column, key: str, order: str) -> Column:
    w = Window.partitionBy(key, "round").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when((F.col("role") == "tool") & test, F.col("text")), ignorenulls=True).over(w)


def _final(key: str, order: str) -> Column:
    """Answers without pending tool calls."""
    return F.col("role").isin("assistant", "ai") & (F.coalesce(F.size("tool_calls"), F.lit(0)) <= 0)


def guard_prices(log: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """`log` with `audited` and `overridden`: prices given though the round's tool had none give way to the tool's text.

    Needs columns role, text, tool_calls (array, null or empty: none pending).
    """
    tool = _last_tool(F.contains(F.lower("text"), F.lit(NO_PRICE)), key, order)
    rows = with_turns(log, key, order).withColumn("__tool", tool)
    bad = _final(key, order) & F.col("__tool").isNotNull() & F.col("text").rlike(CURRENCY)
    return rows.withColumn("overridden", F.coalesce(bad, F.lit(False))).withColumn("audited", F.when(F.col("overridden"), F.concat(F.lit(PRICE_WARNING), "__tool")).otherwise(F.col("text"))).drop("__tool", "round")


def append_sources(log: DataFrame, key: str = "conv_id", order: str = "turn", most: int = 5) -> DataFrame:
    """`log` with `audited`: answers of web rounds that carry no link get the tool's links."""
    tool = _last_tool(F.col("tool_name").isin(*WEB_TOOLS), key, order)
    rows = with_turns(log, key, order).withColumn("__tool", tool)
    found = F.transform(F.regexp_extract_all("__tool", F.lit(_URL), F.lit(0)), lambda u: F.regexp_replace(u, "[).,;]+$", ""))
    links = F.slice(F.array_distinct(found), 1, most)
    lines = F.array_join(F.transform(links, lambda u: F.concat(F.lit("- "), u)), "\n")
    wanted = _final(key, order) & (F.size(links) > 0) & ~F.col("text").rlike(_URL)
    return rows.withColumn("audited", F.when(F.coalesce(wanted, F.lit(False)), F.concat("text", F.lit("\n\n**Manbalar:**\n"), lines)).otherwise(F.col("text"))).drop("__tool", "round")


def tool_products(result: Column) -> Column:
    """Products in a tool's JSON: a list, the `comparison_table` of an object, or an object with a name."""
    text = F.trim(result)
    listed = F.from_json(text, f"array<struct<{_fields()}>>")
    table = F.from_json(F.get_json_object(text, "$.comparison_table"), f"array<struct<{_fields()}>>")
    single = F.from_json(text, PRODUCT)
    keys = F.json_object_keys(text)
    found = F.when(text.startswith("["), listed).when(F.array_contains(keys, "comparison_table"), table).when(F.array_contains(keys, "name"), F.array(single))
    return F.filter(F.coalesce(found, F.array().cast(f"array<struct<{_fields()}>>")), lambda p: p.isNotNull() & p["name"].isNotNull())


def _fields() -> str:
    return ",".join(f.strip().replace(" ", ":", 1) for f in PRODUCT.split(","))


def product_rows(results: DataFrame, column: str = "result") -> DataFrame:
    """One row per product in the tools' results; malformed results give none."""
    return results.select(*[c for c in results.columns if c != column], F.inline(tool_products(F.col(column))))


def product_line(p: Column) -> Column:
    price = F.when(p["price"].isNull(), "narxi noma'lum").otherwise(F.replace(F.format_number(p["price"], 0), F.lit(","), F.lit(" ")))
    brand = F.when(F.coalesce(p["brand"], F.lit("")) != "", F.concat(F.lit(" ["), p["brand"], F.lit("]"))).otherwise("")
    stock = F.when(F.coalesce(p["in_stock"], F.lit(True)), "").otherwise(" (sotuvda yo'q)")
    return F.concat(p["name"], brand, F.lit(" — "), price, F.lit(" "), F.coalesce(p["currency"], F.lit("UZS")), F.lit(", "), F.coalesce(p["store"], F.lit("None")), stock)


def grounded_answers(results: DataFrame, answers: DataFrame, nothing: str, key: str = "round_id", most: int = 10) -> DataFrame:
    """`answers` (key, answer) rebuilt from the lookup tools' results (key, seq, tool, result) of their round.

    Equal (tool, result) count once. Where all are empty the answer is `nothing`; rounds
    without a lookup keep theirs.
    """
    lookups = results.where(F.col("tool").isin(*LOOKUP_TOOLS))
    w = Window.partitionBy(key, "tool", F.sha2("result", 256)).orderBy("seq")
    once = lookups.withColumn("nth", F.row_number().over(w)).where("nth = 1").withColumn("products", tool_products(F.col("result")))
    shown = F.slice("products", 1, most)
    numbered = F.array_join(F.transform(shown, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), product_line(p))), "\n")
    first = product_line(F.get("products", F.lit(0)))
    cheapest = F.from_json(F.get_json_object("result", "$.cheapest"), PRODUCT)
    section = (
        F.when(F.size("products") == 0, F.lit(None).cast("string"))
        .when(F.col("tool").isin("search_products_tool", "filter_products_tool"), F.concat(F.lit("Topilgan mahsulotlar:\n"), numbered))
        .when(F.col("tool") == "compare_products_tool", F.concat(F.lit("Narxlar taqqoslash jadvali:\n"), numbered, F.when(cheapest["name"].isNotNull(), F.concat(F.lit("\n\nEng arzoni: "), product_line(cheapest))).otherwise("")))
        .when(F.col("tool") == "find_cheapest_tool", F.concat(F.lit("Eng arzon variant: "), first))
        .otherwise(F.concat(F.lit("**"), F.get("products", F.lit(0))["name"], F.lit("**")))
    )
    rebuilt = once.withColumn("section", section).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section").isNotNull(), F.struct("seq", "section")))), lambda x: x["section"]), "\n\n").alias("rebuilt"))
    out = answers.join(rebuilt, key, "left")
    return out.withColumn("answer", F.when(F.col("rebuilt").isNull(), F.col("answer")).when(F.col("rebuilt") == "", nothing).otherwise(F.col("rebuilt"))).drop("rebuilt")


def last_answers(log: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last assistant text of each thread that is not blank."""
    said = F.col("role").isin("assistant", "ai") & (F.trim("text") != "")
    return log.groupBy(key).agg(F.max_by(F.when(said, F.col("text")), F.when(said, F.col(order))).alias("answer"), F.count_if(said).alias("answers"))


def call_log(log: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row per tool call, in order."""
    return log.select(key, order, F.posexplode("tool_calls").alias("nth", "call"))
