"""Registered queries of sources and streams: tables written in a source's form and read back from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.bindings import FILES, OFFERS, SEARCHES, bound, duck
from siltstone.plans.queries import SP, query, s_clean
from siltstone.session import read_table, scratch
from siltstone.sources import files, payloads
from siltstone.streaming import jobs

# ---- payloads: a service's nested answer for each order, as JSON text


def _orders(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format(F.to_date("o_orderdate"), "yyyy-MM-dd")
    return read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.floor("o_totalprice").cast("string").alias("price"), day.alias("day"))


def _text(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _point(code: str, hour: str) -> Column:
    return _text(iataCode=F.lit(code), at=F.concat("day", F.lit(f"T{hour}:00:00")))


@query(
    "s_flight_offers",
    """SELECT 'XQ' || (o_orderkey % 1000) AS flight_number, CASE WHEN o_custkey % 2 = 0 THEN 'Air' ELSE 'XQ' END AS airline, 'TAS' AS origin, 'IST' AS destination, (60 * (o_orderkey % 9) + 5)::INT AS duration_minutes, 1 AS stops,
    floor(o_totalprice)::DOUBLE AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'BUSINESS' ELSE 'ECONOMY' END AS cabin_class, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || ' 08:00' AS leaves FROM orders""",
)
def _(spark, d):
    number = (F.col("o_orderkey") % 1000).cast("string")
    there = _text(departure=_point("TAS", "08"), arrival=_point("DXB", "10"), carrierCode=F.lit("XQ"), number=number)
    beyond = _text(departure=_point("DXB", "11"), arrival=_point("IST", "12"), carrierCode=F.lit("ZZ"), number=F.lit("1"))
    trip = _text(duration=F.concat(F.lit("PT"), (F.col("o_orderkey") % 9).cast("string"), F.lit("H5M")), segments=F.array(there, beyond))
    cabins = F.when(F.col("o_orderkey") % 3 == 0, F.array(_text(fareDetailsBySegment=F.array(_text(cabin=F.lit("BUSINESS"))))))
    offer = _text(itineraries=F.array(trip), price=_text(total=F.col("price"), currency=F.lit("USD")), travelerPricings=cabins)
    names = F.when(F.col("o_custkey") % 2 == 0, F.create_map(F.lit("XQ"), F.lit("Air"))).otherwise(F.create_map(F.lit("YY"), F.lit("Other")))
    rows = _orders(spark, d).select(F.to_json(_text(data=F.array(offer), dictionaries=_text(carriers=names))).alias("payload"))
    f = payloads.flight_offers(rows)
    return f.select("flight_number", "airline", "origin", "destination", "duration_minutes", "stops", "price", "cabin_class", F.date_format("departure_time", "yyyy-MM-dd HH:mm").alias("leaves"))


@query(
    "s_schedule_legs",
    "SELECT 'XQ' || (o_orderkey % 1000) AS flight_number, 'Air' AS airline, greatest(0, (o_orderkey % 5) * 60 - 60)::INT AS duration_minutes, o_orderstatus AS status FROM orders WHERE o_custkey % 4 <> 0",
)
def _(spark, d):
    lands = F.concat("day", F.format_string("T%02d:00:00+00:00", (7 + F.col("o_orderkey") % 5).cast("int")))
    leaves = F.concat("day", F.lit("T08:00:00+00:00"))
    leg = _text(
        flight_status=F.col("o_orderstatus"),
        departure=_text(iata=F.lit("TAS"), scheduled=leaves),
        arrival=_text(iata=F.lit("IST"), scheduled=F.when(F.col("o_custkey") % 4 != 0, lands)),
        airline=_text(name=F.lit("Air"), iata=F.lit("XQ")),
        flight=_text(iata=F.concat(F.lit("XQ"), (F.col("o_orderkey") % 1000).cast("string"))),
    )
    rows = _orders(spark, d).select(F.to_json(_text(data=F.array(leg))).alias("payload"))
    return payloads.schedule_legs(rows).select("flight_number", "airline", "duration_minutes", "status")


@query(
    "s_places",
    "SELECT upper('x' || c_custkey) AS iata, CASE WHEN c_custkey % 3 = 0 THEN upper('x' || c_custkey) ELSE c_name END AS name, c_mktsegment AS city, (c_nationkey * 3)::DOUBLE AS lat, (c_nationkey * 5)::DOUBLE AS lon FROM customer",
)
def _(spark, d):
    c = read_table(spark, d, "customer")
    props = _text(
        name=F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")),
        city=F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(""),
        county=F.col("c_mktsegment"),
        datasource=_text(raw=_text(iata=F.concat(F.lit("x"), F.col("c_custkey").cast("string")))),
    )
    place = _text(properties=props, geometry=_text(coordinates=F.array((F.col("c_nationkey") * 5).cast("double"), (F.col("c_nationkey") * 3).cast("double"))))
    return payloads.places(c.select(F.to_json(_text(features=F.array(place))).alias("payload"))).select("iata", "name", "city", "lat", "lon")


@query("s_search_results", "SELECT 't' || page_id || '-' || i AS title, url AS link, '' AS snippet FROM pages, range(0, 3) r(i) WHERE i < 1 + page_id % 4")
def _(spark, d):
    p = read_table(spark, d, "pages")
    found = F.transform(F.sequence(F.lit(0), (F.col("page_id") % 4).cast("int")), lambda i: F.struct(F.concat(F.lit("t"), F.col("page_id").cast("string"), F.lit("-"), i.cast("string")).alias("title"), F.col("url").alias("link")))
    return payloads.search_results(p.select(F.to_json(_text(organic=found)).alias("payload")), n=3)


@query(
    "s_listing_offers",
    """SELECT 'europharm' AS store, p_name AS name, p_brand AS brand, p_size::VARCHAR AS package_size, (p_size * 100)::DOUBLE AS price, 'https://e.example/p/' || p_partkey AS url, p_partkey % 2 = 0 AS in_stock
    FROM (SELECT p_partkey, p_size, p_brand, p_name || ' ' || p_size || ' tab' AS p_name FROM part)""",
)
def _(spark, d):
    p = read_table(spark, d, "part")
    html = F.concat(
        F.lit('<div class="product-item"><a href="/p/'), F.col("p_partkey").cast("string"), F.lit('"><p>'), "p_brand", F.lit('</p></a><h3 itemprop="name">'), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(' tab</h3><meta itemprop="price" content="'),
        (F.col("p_size") * 100).cast("string"), F.lit('"><meta itemprop="availability" content="'), F.when(F.col("p_partkey") % 2 == 0, "InStock").otherwise("OutOfStock"), F.lit('"></div>'),
    )
    pages = p.select(F.lit("europharm").alias("store"), F.lit("https://e.example/").alias("url"), html.alias("html"))
    return payloads.listing_offers(pages).select("store", "name", "brand", "package_size", "price", "url", "in_stock")


# ---- files: tables written as files and read back


@query("s_json_lines", "SELECT conv_id || '-' || turn AS instruction, role AS output, false AS broken FROM conversations UNION ALL SELECT NULL, NULL, true FROM conversations WHERE turn = 0")
def _(spark, d):
    path = scratch(spark, "lines")
    c = read_table(spark, d, "conversations")
    files.write_jsonl(c.select(F.concat_ws("-", "conv_id", "turn").alias("instruction"), F.lit("").alias("input"), F.col("role").alias("output")), path)
    c.where("turn = 0").select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    return files.read_jsonl(spark, path).select("instruction", "output", F.col("_corrupt").isNotNull().alias("broken"))


@query("s_csv", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, d):
    path = scratch(spark, "csv")
    files.write_csv(read_table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return files.read_csv(spark, path, "c_custkey long, c_name string, c_mktsegment string")


@query("s_upload", "SELECT count(*) AS total, count(*) FILTER (turn % 3 <> 0) AS valid, count(*) FILTER (turn % 3 = 0) AS invalid FROM conversations")
def _(spark, d):
    path = scratch(spark, "upload")
    c = read_table(spark, d, "conversations")
    output = F.when(F.col("turn") % 3 != 0, F.col("role"))
    c.select(F.to_json(F.struct(F.col("text").alias("instruction"), output.alias("output")), {"ignoreNullFields": "true"}).alias("value")).write.text(path)
    return files.upload_report(files.validate_upload(spark, path))


@query("s_upload_array", "SELECT conv_id, turn, md5(text) AS instruction, turn % 3 <> 0 AS valid FROM conversations UNION ALL SELECT NULL, NULL, NULL, false")
def _(spark, d):
    """All turns as the elements of one array in one file, read back by byte ranges."""
    path = scratch(spark, "array")
    c = read_table(spark, d, "conversations")
    output = F.when(F.col("turn") % 3 != 0, F.concat_ws("-", "conv_id", "turn"))
    rows = c.select(F.to_json(F.struct("text", F.struct(F.col("text").alias("instruction"), F.concat_ws("-", "conv_id", "turn").alias("input"), output.alias("output"), F.array("role", F.lit('], "{ \\')).alias("more")).alias("x"))).alias("value"))
    element = F.regexp_extract("value", "(?s)\"x\":(.*)\\}$", 1)
    # one file, as an upload is: brackets around a null and all turns
    edge = lambda x: spark.createDataFrame([(x,)], "value string")
    files.write_file(edge("[null").unionByName(rows.select(F.concat(F.lit(", "), element).alias("value"))).unionByName(edge("]")), f"{path}/upload.json")
    back = files.validate_upload(spark, f"{path}/upload.json", size=1 << 16)
    id_and_turn = F.split(F.nullif("input", F.lit("")), "-")
    return back.select(id_and_turn[0].cast("long").alias("conv_id"), id_and_turn[1].cast("long").alias("turn"), F.md5("instruction").alias("instruction"), "valid")


@query(
    "s_load_files",
    f"""SELECT doc_id, CASE WHEN regexp_matches(text, '[^{SP}]') THEN 'loaded' ELSE 'failed' END AS status, nullif(md5({s_clean('text', False)}), md5('')) AS text, encode AS encoding
    FROM (SELECT *, 'utf-8' AS encode FROM documents)""",
)
def _(spark, d):
    """The loader over files as a scan gives them: one file for each document, in bytes."""
    rows = read_table(spark, d, "documents")
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("﻿"), "text")).otherwise(F.col("text")).cast("binary")
    scanned = rows.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit(".txt").alias("suffix"), content.alias("content"), F.octet_length("text").cast("long").alias("n_bytes"))
    loaded = files.load_files(scanned)
    return loaded.select(F.regexp_replace("path", "\\.txt$", "").cast("long").alias("doc_id"), "status", F.nullif(F.md5("text"), F.md5(F.lit(""))).alias("text"), "encoding")


@query("s_scan", "SELECT '.txt' AS suffix, sum(octet_length(encode(text)) + 1)::BIGINT AS n_bytes FROM documents")
def _(spark, d):
    """Files of kinds that are not known, and of none, lie between those that count."""
    path = scratch(spark, "corpus")
    text = read_table(spark, d, "documents").select("text")
    text.write.text(f"{path}/some/folder")
    text.write.json(f"{path}/some/lines")
    text.write.orc(f"{path}/orc")
    return files.scan_corpus(spark, path).groupBy("suffix").agg(F.sum("n_bytes").alias("n_bytes"))


#: The upper half of windows-1251, for 0xA0 to 0xFF, from its two rules and the rest by hand; fixed values.
_CP1251 = bytes(range(0xA0, 0x100)).decode("windows-1251")
_LATIN1 = bytes(range(0xA0, 0x100)).decode("latin-1")


@query(
    "s_decoded",
    f"""WITH r AS (SELECT *, doc_id % 3 = 0 AND regexp_matches(text, '[\\x{{A0}}-\\x{{FF}}][\\x00-\\x7F]') AND NOT regexp_matches(text, '[^\\x00-\\x7F\\x{{A0}}-\\x{{FF}}]') AS single FROM documents)
    SELECT doc_id, md5(CASE WHEN single THEN translate(text, '{_LATIN1}', '{_CP1251}') ELSE text END) AS body, CASE WHEN single THEN 'windows-1251' ELSE 'utf-8' END AS encoding FROM r""",
)
def _(spark, d):
    """One in three texts that fit one byte a character comes as such bytes: no valid UTF-8, so it is read by the fallback."""
    single = (F.col("doc_id") % 3 == 0) & F.col("text").rlike("[\\x{A0}-\\x{FF}][\\x00-\\x7F]") & ~F.col("text").rlike("[^\\x00-\\x7F\\x{A0}-\\x{FF}]")
    content = F.when(single, F.encode(F.when(single, F.col("text")), "ISO-8859-1")).otherwise(F.col("text").cast("binary"))
    rows = read_table(spark, d, "documents").select("doc_id", files.decoded(content).alias("d"))
    return rows.select("doc_id", F.md5("d.text").alias("body"), F.col("d.encoding").alias("encoding"))


# ---- streams: tables read as streams to their end


def _stream(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """The rows, and what is in the folder already, as a stream of files, two at a time."""
    df.repartition(4).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("w_sync", f"SELECT path AS file_path, file_hash FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY path) AS nth FROM ({duck(FILES)})) WHERE nth = 1")
def _(spark, d):
    rows = bound(spark, d, FILES).select("path", "file_hash")
    # of equal contents the first path comes first, whatever batch it is in
    first = rows.groupBy("file_hash").agg(F.min("path").alias("path")).select("path", "file_hash")
    table, marks, arrivals = scratch(spark, "sync"), scratch(spark, "marks"), scratch(spark, "arrivals")
    jobs.sync_stream(_stream(spark, first, arrivals), table, marks).awaitTermination()
    # then all files arrive, those again: nothing is new
    jobs.sync_stream(_stream(spark, rows, arrivals), table, marks).awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(table).select("file_path", "file_hash").distinct()


@query("w_trending", f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, searched_at), '%Y-%m-%d %H:%M:%S') AS start, query, count(*) AS searches FROM ({duck(SEARCHES)}) WHERE result_count > 0 GROUP BY ALL")
def _(spark, d):
    rows = bound(spark, d, SEARCHES)
    # files come in any order of times, so nothing counts as late within the table's span
    span = rows.agg(F.unix_timestamp(F.max("searched_at")) - F.unix_timestamp(F.min("searched_at"))).first()[0] or 0
    table = scratch(spark, "trending")
    jobs.trending_table(_stream(spark, rows, scratch(spark, "searches")), table, scratch(spark, "marks"), "1 hour", f"{span + 1} seconds").awaitTermination()
    return jobs.read_trending(spark, table).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "query", "searches")


@query(
    "w_offers",
    f"""WITH o AS (SELECT store, product, TIMESTAMP '2026-01-01 00:00:00' + to_seconds((offer_id % 1800)::INT) AS fetched FROM ({duck(OFFERS)})),
    l AS (SELECT store, product, max(fetched) AS fetched FROM o GROUP BY ALL)
    SELECT store, product::VARCHAR AS url, strftime(fetched, '%H:%M:%S') AS fetched FROM l WHERE fetched >= (SELECT max(fetched) FROM o) - INTERVAL 900 SECOND""",
)
def _(spark, d):
    o = bound(spark, d, OFFERS).select("store", F.col("product").cast("string").alias("url"), "price", F.timestamp_seconds(F.lit(1767225600) + F.col("offer_id") % 1800).alias("fetched_at"))
    table = scratch(spark, "offers")
    jobs.offers_stream(_stream(spark, o, scratch(spark, "fetched")), table, scratch(spark, "marks")).awaitTermination()
    return jobs.read_offers(spark, table).select("store", "url", F.date_format("fetched_at", "HH:mm:ss").alias("fetched"))
