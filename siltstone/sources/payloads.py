"""Nested payloads of flight, place and search services as flat rows; stored shop pages as offers."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.values import dosage, iso_minutes, pack_size, parse_price
from siltstone.sources.files import map_batches, plain_ampersands

_POINT = "struct<iataCode:string,at:string>"
OFFERS = (
    "struct<data:array<struct<itineraries:array<struct<duration:string,segments:array<struct<departure:" + _POINT + ",arrival:" + _POINT + ",carrierCode:string,number:string>>>>,"
    "price:struct<total:string,currency:string>,travelerPricings:array<struct<fareDetailsBySegment:array<struct<cabin:string>>>>>>,dictionaries:struct<carriers:map<string,string>>>"
)
_SIDE = "struct<iata:string,scheduled:string>"
LEGS = "struct<data:array<struct<flight_status:string,departure:" + _SIDE + ",arrival:" + _SIDE + ",airline:struct<name:string,iata:string>,flight:struct<iata:string>>>>"
PLACES = "struct<features:array<struct<properties:struct<name:string,city:string,county:string,country:string,datasource:struct<raw:struct<iata:string>>>,geometry:struct<coordinates:array<double>>>>>"
SEARCH = "struct<organic:array<struct<title:string,link:string,snippet:string>>>"


def flight_offers(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row per offer: its first itinerary from first to last segment."""
    p = payloads.select(F.from_json(column, OFFERS).alias("p")).select("p.dictionaries.carriers", F.posexplode("p.data").alias("seq", "o"))
    trip = p.withColumn("trip", F.get("o.itineraries", F.lit(0))).withColumns({"first": F.get("trip.segments", F.lit(0)), "last": F.element_at("trip.segments", -1)})
    code = F.col("first.carrierCode")
    cabin = F.get(F.get("o.travelerPricings", F.lit(0))["fareDetailsBySegment"], F.lit(0))["cabin"]
    return trip.select(
        "seq", F.coalesce(F.try_element_at("carriers", code), code).alias("airline"), code.alias("airline_code"), F.concat(code, "first.number").alias("flight_number"),
        F.col("first.departure.iataCode").alias("origin"), F.col("last.arrival.iataCode").alias("destination"),
        F.to_timestamp("first.departure.at").alias("departure_time"), F.to_timestamp("last.arrival.at").alias("arrival_time"),
        iso_minutes(F.col("trip.duration")).alias("duration_minutes"), (F.size("trip.segments") - 1).alias("stops"),
        F.coalesce(cabin, F.lit("ECONOMY")).alias("cabin_class"), F.col("o.price.total").try_cast("double").alias("price"), F.col("o.price.currency").alias("currency"),
    )


def schedule_legs(payloads: DataFrame, column: str = "payload", date: str | None = None) -> DataFrame:
    """One row per leg with both scheduled times; without price. `date` keeps departures of one day."""
    p = payloads.select(F.posexplode(F.from_json(column, LEGS)["data"]).alias("seq", "l"))
    if date:
        p = p.where(F.col("l.departure.scheduled").startswith(date))
    times = p.withColumns({"departure_time": F.to_timestamp("l.departure.scheduled"), "arrival_time": F.to_timestamp("l.arrival.scheduled")})
    times = times.where(F.col("departure_time").isNotNull() & F.col("arrival_time").isNotNull())
    seconds = F.unix_timestamp("arrival_time") - F.unix_timestamp("departure_time")
    return times.select(
        "seq", F.col("l.airline.name").alias("airline"), F.col("l.airline.iata").alias("airline_code"), F.col("l.flight.iata").alias("flight_number"),
        F.col("l.departure.iata").alias("origin"), F.col("l.arrival.iata").alias("destination"), "departure_time", "arrival_time",
        F.greatest(F.lit(0), F.floor(seconds / 60)).cast("int").alias("duration_minutes"), F.lit(None).cast("double").alias("price"), F.col("l.flight_status").alias("status"),
    )


def places(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row per place: code, name, city or county, coordinates (longitude comes first)."""
    f = payloads.select(F.explode(F.from_json(column, PLACES)["features"]).alias("f"))
    props = F.col("f.properties")
    code = F.upper(F.coalesce(props["datasource"]["raw"]["iata"], F.lit("")))
    city = F.coalesce(F.nullif(props["city"], F.lit("")), F.nullif(props["county"], F.lit("")), F.lit(""))
    return f.select(code.alias("iata"), F.coalesce(F.nullif(props["name"], F.lit("")), F.nullif(code, F.lit("")), F.lit("")).alias("name"), city.alias("city"), props["country"].alias("country"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"), F.get("f.geometry.coordinates", F.lit(0)).alias("lon"))


def search_results(payloads: DataFrame, column: str = "payload", n: int = 5) -> DataFrame:
    """The first `n` results of each payload."""
    return payloads.select(F.inline(F.slice(F.from_json(column, SEARCH)["organic"], 1, n))).select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "link", "snippet")])


class _Tree(HTMLParser):
    """A light tree of elements, enough to look fields up by tag, class and attribute."""

    void = {"meta", "img", "br", "link", "input", "hr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: dict = {"tag": "", "attrs": {}, "kids": [], "up": None}
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "kids": [], "up": self.at}
        self.at["kids"].append(node)
        if tag not in self.void:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node["up"] is not None and node["tag"] != tag:
            node = node["up"]
        if node["up"] is not None:
            self.at = node["up"]

    def handle_data(self, data: str) -> None:
        self.at["kids"].append(data)


def _parse(html: str | None) -> dict:
    tree = _Tree()
    tree.feed(plain_ampersands(html or ""))
    tree.close()
    return tree.root


def _all(node: dict, tag: str = "", classes: str = "", **attrs: str):
    for kid in node["kids"]:
        if isinstance(kid, dict):
            own = kid["attrs"].get("class", "").split()
            if (not tag or kid["tag"] == tag) and all(c in own for c in classes.split()) and all(kid["attrs"].get(k) == v for k, v in attrs.items()):
                yield kid
            yield from _all(kid, tag, classes, **attrs)


def _first(node: dict | None, *path: tuple) -> dict | None:
    for tag, classes, attrs in path:
        node = next(_all(node, tag, classes, **attrs), None) if node else None
    return node


def _text(node: dict | None) -> str:
    if node is None:
        return ""
    return "".join(k.strip() if isinstance(k, str) else _text(k) for k in node["kids"])


def _in_stock(text: str) -> bool:
    return "наличии" in text.lower() or "mavjud" in text.lower()


def _oxymed(root: dict, base: str):
    links = list(_all(root, "a", "product-item__link"))
    for box, link in zip(_all(root, "div", "product-item"), links, strict=False):
        name = _first(box, ("", "product-item__name", {}))
        price = _first(box, ("", "product-item__price", {}))
        if name:
            own = "".join(k for k in price["kids"] if isinstance(k, str)) if price else ""
            yield _text(name), None, own, link["attrs"].get("href", ""), _in_stock(_text(_first(box, ("", "product-item__avail", {}))))


def _pharmaclick(root: dict, base: str):
    for box in _all(root, "div", "catalog_item_wrapp item"):
        link = _first(box, ("", "item-title", {}), ("a", "", {}))
        name = _first(link, ("span", "", {}))
        if name:
            brand, price = _first(box, ("", "cml_man", {})), _first(box, ("", "js_price_wrapper", {}), ("", "values_wrapper", {}))
            yield _text(name), _text(brand) or None, _text(price), urljoin(base, link["attrs"].get("href", "")), _in_stock(_text(_first(box, ("", "item-stock", {}), ("", "value", {}))))


def _europharm(root: dict, base: str):
    for box in _all(root, "div", "product-item"):
        name, link = _first(box, ("h3", "", {"itemprop": "name"})), _first(box, ("a", "", {}))
        if name and link and "href" in link["attrs"]:
            price, available = _first(box, ("", "", {"itemprop": "price"})), _first(box, ("", "", {"itemprop": "availability"}))
            said = available["attrs"].get("content", "") if available else ""
            yield _text(name), _text(_first(link, ("p", "", {}))) or None, price["attrs"].get("content", "") if price else "", urljoin(base, link["attrs"]["href"]), "instock" in said.lower() if said else True


_LAYOUTS = {"oxymed": _oxymed, "pharmaclick": _pharmaclick, "europharm": _europharm}


def listing_offers(pages: DataFrame) -> DataFrame:
    """Offers on stored listing pages (store, url, html); stores are told by the layouts above."""

    def offers(row: dict):
        layout = _LAYOUTS.get(row["store"])
        for i, (name, brand, price, url, stock) in enumerate(layout(_parse(row["html"]), row["url"]) if layout else ()):
            yield {"store": row["store"], "seq": i, "name": name, "brand": brand, "price_text": price, "url": url, "in_stock": stock}

    rows = map_batches(pages.select("store", "url", "html"), offers, "store string, seq int, name string, brand string, price_text string, url string, in_stock boolean")
    return rows.select("store", "seq", "name", "brand", dosage(F.col("name")).alias("dosage"), pack_size(F.col("name")).alias("package_size"), parse_price(F.col("price_text")).alias("price"), F.lit("UZS").alias("currency"), "url", "in_stock")


def product_details(pages: DataFrame) -> DataFrame:
    """Nine fields of stored product pages (url, html): by property tables, or heading and description."""

    def details(row: dict):
        root = _parse(row["html"])
        meta = _first(root, ("meta", "", {"name": "description"}))
        props, notes = {}, {}
        if "oxymed.uz" in row["url"]:
            for box in _all(root, "", "product-prop__item"):
                props[_text(_first(box, ("", "product-prop__name", {})))] = _text(_first(box, ("", "product-prop__value", {})))
            for box in _all(root, "", "product-instruct__item"):
                notes[_text(_first(box, ("", "product-instruct__name", {})))] = _text(_first(box, ("", "product-instruct__desc", {})))
        yield {"url": row["url"], "heading": _text(_first(root, ("h1", "", {}))) or None, "meta": meta["attrs"].get("content") if meta else None, "props": props, "notes": notes}

    rows = map_batches(pages.select("url", "html"), details, "url string, heading string, meta string, props map<string,string>, notes map<string,string>")
    prop, note = (lambda k: F.try_element_at("props", F.lit(k))), (lambda k: F.try_element_at("notes", F.lit(k)))
    shop = F.contains("url", F.lit("oxymed.uz"))
    return rows.select(
        "url", F.col("heading").alias("name"), F.coalesce(prop("Производитель"), prop("Бренд")).alias("brand"), prop("Производитель").alias("manufacturer"),
        prop("Дозировка").alias("dosage"), prop("Кол-во в упаковке").alias("package_size"), prop("Форма выпуска").alias("form"),
        F.when(shop, note("Описание")).otherwise(F.col("meta")).alias("description"), note("Способ применения").alias("usage_instructions"),
        F.coalesce(note("Особые указания"), note("Условия хранения")).alias("storage_conditions"),
    )
