"""Offers of products and flights: filters, comparisons, freshness, rates, places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.values import duration_label, price_label


def union_stores(stores: list[DataFrame], order: str, per_store: int = 10) -> DataFrame:
    """All stores' offers, the first `per_store` of each query and store by `order`."""
    every = stores[0]
    for s in stores[1:]:
        every = every.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy("query", "store").orderBy(order)
    return every.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= per_store).drop("__nth")


def first_of_url(rows: DataFrame, order: str, url: str = "url") -> DataFrame:
    w = Window.partitionBy(url).orderBy(order)
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def priced(price: Column) -> Column:
    """A price that is there and not zero."""
    return price.isNotNull() & (price != 0)


def filter_offers(offers: DataFrame, max_price: float | None = None, min_price: float | None = None, brand: str | None = None, package_size: str | None = None, in_stock: bool = False) -> DataFrame:
    """Offers that pass all given limits, cheapest first, without price last."""
    tests = []
    if max_price is not None:
        tests.append(priced(F.col("price")) & (F.col("price") <= max_price))
    if min_price is not None:
        tests.append(priced(F.col("price")) & (F.col("price") >= min_price))
    if brand is not None:
        tests.append(F.lower("brand") == brand.lower())
    if package_size is not None:
        tests.append(F.col("package_size") == package_size)
    if in_stock:
        tests.append(F.col("in_stock"))
    for t in tests:
        offers = offers.where(t)
    return offers.orderBy(F.col("price").asc_nulls_last())


def compare_offers(offers: DataFrame, by: str, brands: list[str] | None = None, tie: str = "offer_id") -> DataFrame:
    """Of each `by`: how many priced offers, and the cheapest and dearest one."""
    rows = offers.where(priced(F.col("price")))
    if brands:
        rows = rows.where(F.lower("brand").isin([b.lower() for b in brands]))
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("offers"),
        F.min_by(tie, F.struct("price", tie)).alias("cheapest_id"),
        F.min("price").alias("cheapest"),
        F.min_by(tie, F.struct(-F.col("price"), F.col(tie))).alias("dearest_id"),
        F.max("price").alias("dearest"),
    )


def cheapest_in_stock(offers: DataFrame, by: str, tie: str = "offer_id") -> DataFrame:
    """The cheapest priced offer in stock of each `by`, null where there is none."""
    usable = priced(F.col("price")) & F.col("in_stock")
    return offers.groupBy(by).agg(F.min_by(F.when(usable, F.col(tie)), F.when(usable, F.struct("price", tie))).alias("cheapest_id"), F.min(F.when(usable, F.col("price"))).alias("cheapest"))


def unit_price(price: Column, package_size: Column) -> Column:
    """Price per piece; null where the pack size is no number over 0."""
    n = F.replace(package_size, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(n > 0, price / n)


def badges(offers: DataFrame, by: str, tie: str = "offer_id") -> DataFrame:
    """Of each `by`: the cheapest offer in stock and the one of least unit price; unknown stock counts as in stock."""
    stocked = F.coalesce("in_stock", F.lit(True)) & priced(F.col("price"))
    per = unit_price(F.col("price"), F.col("package_size"))
    return offers.groupBy(by).agg(
        F.min_by(F.when(stocked, F.col(tie)), F.when(stocked, F.struct("price", tie))).alias("cheapest_id"),
        F.min_by(F.when(stocked & per.isNotNull(), F.col(tie)), F.when(stocked & per.isNotNull(), F.struct(per.alias("per"), tie))).alias("best_value_id"),
    )


def market_summary(offers: DataFrame, by: str) -> DataFrame:
    """Offers with a price, cheapest, mean, and savings in percent where over 1."""
    out = offers.where(F.col("price").isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("offers"), F.min("price").alias("cheapest"), F.avg("price").alias("average"))
    savings = F.when(F.col("average") > 0, (F.col("average") - F.col("cheapest")) / F.col("average") * 100)
    return out.withColumn("savings", F.when(savings > 1, savings))


def facets(offers: DataFrame) -> DataFrame:
    """One row: sorted distinct brands and stores."""
    return offers.agg(F.array_sort(F.collect_set("brand")).alias("brands"), F.array_sort(F.collect_set("store")).alias("stores"))


def facet_filter(offers: DataFrame, brands: list[str], stores: list[str]) -> DataFrame:
    """Rows of the chosen brands and stores; rows without one pass."""
    for column, chosen in (("brand", brands), ("store", stores)):
        if chosen:
            offers = offers.where(F.col(column).isNull() | (F.col(column) == "") | F.col(column).isin(chosen))
    return offers


def sort_keys(by: str = "price", tie: str = "offer_id") -> list[Column]:
    """The order of offers by `price` (without one last), `name` or `store`, whatever the case; ties by id."""
    keys = {"price": [F.col("price").asc_nulls_last()], "name": [F.lower(F.coalesce("name", F.lit("")))], "store": [F.lower(F.coalesce("store", F.lit("")))]}
    return [*keys[by], F.col(tie)]


def sort_offers(offers: DataFrame, by: str = "price", tie: str = "offer_id") -> DataFrame:
    return offers.orderBy(*sort_keys(by, tie))


def replace_cached(cache: DataFrame, rows: DataFrame, key: str = "query") -> DataFrame:
    """The cache with the rows of each query in `rows` replaced."""
    return cache.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def fresh(cache: DataFrame, now: Column, ttl_seconds: int = 900) -> DataFrame:
    """Rows fetched at most `ttl_seconds` ago."""
    # to the microsecond: whole seconds would let rows pass that are a part of one too old
    return cache.where(F.unix_micros(F.col("fetched_at").cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - 1_000_000 * ttl_seconds)


def recent_searches(history: DataFrame, n: int, tie: str = "id") -> DataFrame:
    return history.orderBy(F.col("searched_at").desc(), F.col(tie).desc()).limit(n)


def trending(history: DataFrame, n: int = 6) -> DataFrame:
    """The queries with results that were searched most, then last."""
    counts = history.where(F.col("result_count") > 0).groupBy("query").agg(F.count(F.lit(1)).alias("searches"), F.max("searched_at").alias("last_searched"))
    return counts.orderBy(F.col("searches").desc(), F.col("last_searched").desc(), "query").limit(n)


def append_row(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def delete_ids(table: DataFrame, ids: list[int]) -> DataFrame:
    return table.where(~F.col("id").isin(ids))


def newest_first(table: DataFrame, at: str = "created_at") -> DataFrame:
    return table.orderBy(F.col(at).desc(), F.col("id").desc())


def due_alerts(alerts: DataFrame, offers: DataFrame, key: str) -> DataFrame:
    """Alerts (id, key, target) with the best priced offer and whether it reaches the target."""
    best = offers.where(priced(F.col("price"))).groupBy(key).agg(F.min("price").alias("best"))
    return alerts.join(best, key, "left").withColumn("triggered", F.coalesce(F.col("best") <= F.col("target"), F.lit(False)))


# ---- flights

# Words for an order, the first that the criteria hold counts; hours of the day from which to which a window lasts; the night wraps.
CRITERIA = {"cheapest": "price", "arzon": "price", "fastest": "duration", "tez": "duration", "direct": "stops", "togridan": "stops"}
WINDOWS = {"morning": (5, 12), "afternoon": (12, 17), "evening": (17, 21), "night": (21, 5)}


def filter_flights(flights: DataFrame, max_stops: int | None = None, airline: str | None = None, window: str | None = None) -> DataFrame:
    """Flights within all given limits; an unknown window is no limit."""
    if max_stops is not None:
        flights = flights.where(F.col("stops") <= max_stops)
    if airline:
        flights = flights.where(F.contains(F.lower("airline"), F.lit(airline.lower())) | F.contains(F.lower("airline_code"), F.lit(airline.lower())))
    if window in WINDOWS:
        start, end = WINDOWS[window]
        hour = F.hour("departure_time")
        flights = flights.where((hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end))
    return flights


def sort_flights(flights: DataFrame, by: str = "departure_time", tie: str = "flight_number") -> DataFrame:
    column = {"price": F.col("price").asc_nulls_last(), "duration": F.col("duration_minutes")}.get(by, F.col("departure_time"))
    return flights.orderBy(column, tie)


def recommend(flights: DataFrame, by: str, criteria: str, tie: str = "flight_number") -> DataFrame:
    """One flight of each `by`: cheapest unless the criteria ask for fastest or direct ones."""
    last = F.coalesce("price", F.lit(math.inf))
    orders = {"price": (last,), "duration": (F.col("duration_minutes"),), "stops": (F.col("stops"), last)}
    asked = next((order for word, order in CRITERIA.items() if word in criteria.lower()), "price")
    keys = (*orders[asked], F.col(tie))
    return flights.groupBy(by).agg(F.min_by(tie, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])).alias("recommended"))


def compare_flights(flights: DataFrame, by: str, numbers: list[str] | None = None, airlines: list[str] | None = None, tie: str = "flight_number") -> DataFrame:
    """Cheapest priced and fastest flight of each `by` with two chosen flights or more."""
    if numbers:
        flights = flights.where(F.upper(tie).isin([n.upper() for n in numbers]))
    if airlines:
        wanted = F.array(*[F.lit(a.lower()) for a in airlines])
        flights = flights.where(F.exists(wanted, lambda a: F.contains(F.lower("airline"), a)))
    has = F.col("price").isNotNull()
    out = flights.groupBy(by).agg(
        F.count(F.lit(1)).alias("flights"),
        F.min_by(F.when(has, F.col(tie)), F.when(has, F.struct("price", tie))).alias("cheapest"),
        F.min_by(tie, F.struct("duration_minutes", tie)).alias("fastest"),
    )
    return out.where(F.col("flights") >= 2)


def display_flights(flights: DataFrame) -> DataFrame:
    """Ten columns of labels for people, with placeholders."""
    clock = lambda place, time: F.concat(F.col(place), F.lit(" "), F.date_format(time, "HH:mm"))
    return flights.select(
        "airline", "flight_number", clock("origin", "departure_time").alias("leaves"), clock("destination", "arrival_time").alias("arrives"),
        F.date_format("departure_time", "yyyy-MM-dd").alias("date"), duration_label(F.col("duration_minutes")).alias("duration"),
        F.when(F.col("stops") == 0, "direct").otherwise(F.concat(F.col("stops").cast("string"), F.lit(" stops"))).alias("stops"),
        F.coalesce(F.nullif("cabin_class", F.lit("")), F.lit("-")).alias("cabin"), price_label(F.col("price"), F.col("currency")).alias("price"),
        F.coalesce(F.nullif("status", F.lit("")), F.lit("-")).alias("status"),
    )


def convert(rows: DataFrame, rates: DataFrame, target: str, strict: bool = True) -> DataFrame:
    """Priced rows in `target` through `rates` (currency, rate to target).

    A priced row whose currency has no rate fails the batch; if not `strict`, it is null.
    missing_rates() lists what lacks.
    """
    joined = rows.join(rates, "currency", "left")
    rate = F.when(F.col("currency") == target, 1.0).otherwise(F.col("rate"))
    if strict:
        lacks = F.col("price").isNotNull() & rate.isNull()
        rate = F.when(lacks, F.raise_error(F.concat(F.lit("no rate from "), F.coalesce("currency", F.lit("null")), F.lit(f" to {target}"))).cast("double")).otherwise(rate)
    return joined.withColumn("converted", F.round(F.col("price") * rate, 2)).drop("rate")


def missing_rates(rows: DataFrame, rates: DataFrame, target: str) -> DataFrame:
    needed = rows.where(F.col("price").isNotNull() & (F.col("currency") != target)).select("currency").distinct()
    return needed.join(rates, "currency", "left_anti")


def flight_status(legs: DataFrame, number: str) -> DataFrame:
    """The first leg of a flight that has both scheduled times."""
    usable = legs.where((F.upper("flight_number") == number.upper()) & F.col("departure_time").isNotNull() & F.col("arrival_time").isNotNull())
    return usable.orderBy("seq").limit(1)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


#: Kilometres of a degree of latitude on the sphere of haversine_km().
DEGREE_KM = 6371.0088 * math.pi / 180


def airports_near(points: DataFrame, airports: DataFrame, radius_km: float = 60.0, n: int = 20) -> DataFrame:
    """The `n` nearest airports within the radius of each point (point_id, lat, lon).

    Places meet, not rows: points of one place have the same answer, and of airports of one place
    only the first `n` by code can be in it. Point ids should be unique.

    Both sides meet by cells: bands of latitude as high as the radius, each cut along longitude
    into as many cells as are at least as wide, so that there are fewer towards the poles. A
    place looks into the cells of three bands that its circle of longitudes touches, across 180
    degrees too, and into whole bands where the circle holds a pole. Longitudes may be given in any turn;
    points and airports without a place, or beyond a pole, take no part.
    """
    height = radius_km / DEGREE_KM * 1.000001
    top = math.ceil(180 / height) - 1

    def band(lat: Column) -> Column:
        return F.least(F.floor((lat + 90) / height).cast("int"), F.lit(top))

    def cells_of(b: Column) -> Column:
        """How many cells a band has: by its border nearer to a pole."""
        far = F.greatest(F.abs(b * height - 90), F.abs((b + 1) * height - 90))
        return F.greatest(F.floor(360 * F.cos(F.radians(F.least(far, F.lit(90.0)))) / height), F.lit(1)).cast("int")

    def at(lon: Column, count: Column) -> Column:
        return F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * count).cast("int")

    placed = lambda df: df.where(F.abs("lat") <= 90).where(F.col("lon").isNotNull() & ~F.isnan("lon"))
    # how far a circle around the point reaches in longitude
    sine = F.sin(F.radians(F.lit(height))) / F.cos(F.radians("lat"))
    reach = F.when((F.abs("lat") + height >= 90) | (sine >= 1), 180.0).otherwise(F.degrees(F.asin(sine)) * 1.000001)
    bands = F.filter(F.array(*[band(F.col("lat")) + i for i in (-1, 0, 1)]), lambda b: (b >= 0) & (b <= top))
    asked = placed(points)
    left = asked.select("lat", "lon").distinct().withColumns({"reach": reach, "band": F.explode(bands)}).withColumn("count", cells_of(F.col("band")))
    span = F.floor((F.col("lon") + 180 + F.col("reach")) / 360 * F.col("count")) - F.floor((F.col("lon") + 180 - F.col("reach")) / 360 * F.col("count"))
    first = F.floor((F.col("lon") + 180 - F.col("reach")) / 360 * F.col("count"))
    steps = F.sequence(F.lit(0).cast("long"), F.least(span, F.col("count").cast("long") - 1))
    left = left.withColumn("cell", F.explode(F.transform(steps, lambda i: F.pmod(first + i, F.col("count").cast("long")).cast("int"))))
    first_here = F.row_number().over(Window.partitionBy("alat", "alon").orderBy("iata"))
    right = placed(airports.select("iata", "lat", "lon")).select("iata", F.col("lat").alias("alat"), F.col("lon").alias("alon")).withColumn("nth", first_here).where(F.col("nth") <= n).drop("nth")
    right = right.withColumn("band", band(F.col("alat"))).withColumn("cell", at(F.col("alon"), cells_of(F.col("band"))))
    # neither side is sent whole: planned sizes are those of packed files
    near = left.join(right.hint("merge"), ["band", "cell"]).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("alat"), F.col("alon"))).where(F.col("km") <= radius_km)
    w = Window.partitionBy("lat", "lon").orderBy("km", "iata")
    best = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).groupBy("lat", "lon").agg(F.collect_list(F.struct("rank", "iata", "km")).alias("best"))
    return asked.join(best.hint("merge"), ["lat", "lon"]).select("point_id", F.inline("best"))
