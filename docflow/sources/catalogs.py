"""Product catalogs: JSON-lines dumps of six shapes, normalised to one schema.

Each line is one reply of a source, with the code asked for in ``asked``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FACTS = "asked string, status string, product struct<product_name:string, brands:string, image_front_url:string, image_url:string, nutriscore_grade:string, nova_group:int, ingredients_text:string, categories:string, allergens_tags:array<string>, labels_tags:array<string>, categories_tags:array<string>, nutriments:struct<`energy-kcal_100g`:double, `fat_100g`:double, `carbohydrates_100g`:double, `proteins_100g`:double, `sugars_100g`:double, `salt_100g`:double, `fiber_100g`:double>>"
_BOOKS = "asked string, totalItems int, items array<struct<volumeInfo:struct<title:string, authors:array<string>, publisher:string, publishedDate:string, description:string, pageCount:int, categories:array<string>, imageLinks:struct<thumbnail:string>, language:string, previewLink:string, infoLink:string, industryIdentifiers:array<struct<type:string, identifier:string>>>>>"
_LIBRARY = "asked string, book struct<title:string, publishers:array<struct<name:string>>, authors:array<struct<name:string>>, cover:struct<medium:string>, publish_date:string, number_of_pages:int, url:string>"
_LABELS = "asked string, field string, results array<struct<spl_product_data_elements:array<string>, description:array<string>, active_ingredient:array<string>, warnings:array<string>, contraindications:array<string>, indications_and_usage:array<string>, openfda:struct<brand_name:array<string>, generic_name:array<string>, manufacturer_name:array<string>, dosage_form:array<string>, route:array<string>>>>"
# The schema of each source's dump.
SCHEMAS = {"off": _FACTS, "gbooks": _BOOKS, "openlib": _LIBRARY, "fda": _LABELS, "beauty": _FACTS, "pet": _FACTS}


def grams(x: Column, places: int = 1) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{places}fg", x))


def _text(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)


def _first(x: Column) -> Column:
    return F.try_element_at(x, F.lit(1))


def _named(d: DataFrame, source: str, priority: int, category: str, **cols: Column) -> DataFrame:
    return d.select(F.lit(source).alias("source"), F.lit(priority).alias("priority"), F.col("asked").alias("code"), F.lit(category).alias("category"), *(c.alias(n) for n, c in cols.items()))


def normalize(source: str, d: DataFrame) -> DataFrame:
    """Found records of one source's dump as ``(source, priority, code, category, name, brand, description, image_url, food, book, medicine, cosmetics)``."""
    if source in ("off", "beauty", "pet"):
        p = F.col("product")
        n = p["nutriments"]
        d = d.where((F.col("status") == "success") & p.isNotNull())
        energy = F.when(n["energy-kcal_100g"].isNotNull(), F.concat(n["energy-kcal_100g"].cast("int").cast("string"), F.lit(" kcal")))
        macros = [energy.alias("calories"), grams(n["fat_100g"]).alias("fat"), grams(n["carbohydrates_100g"]).alias("carbs"), grams(n["proteins_100g"]).alias("protein")]
        if source == "off":
            food = F.struct(F.upper(p["nutriscore_grade"]).alias("nutri_score"), p["nova_group"].alias("nova_group"), _text(p["ingredients_text"]).alias("ingredients"), *macros, grams(n["sugars_100g"]).alias("sugar"), grams(n["salt_100g"], 2).alias("salt"), F.trim(F.substring_index(p["categories"], ",", 1)).alias("category"))
            return _named(d.where(F.trim(p["product_name"]) != ""), source, 0, "food", name=p["product_name"], brand=_text(p["brands"]), image_url=F.coalesce(p["image_front_url"], p["image_url"]), food=food)
        if source == "beauty":
            none = F.expr("cast(array() as array<string>)")
            cosmetics = F.struct(p["ingredients_text"].alias("ingredients"), *(F.coalesce(p[f"{k}_tags"], none).alias(k) for k in ("allergens", "labels", "categories")))
            return _named(d, source, 5, "cosmetics", name=p["product_name"], brand=p["brands"], image_url=p["image_front_url"], cosmetics=cosmetics)
        food = F.struct(F.lit(None).cast("string").alias("nutri_score"), F.lit(None).cast("int").alias("nova_group"), p["ingredients_text"].alias("ingredients"), *macros, F.lit(None).cast("string").alias("sugar"), F.lit(None).cast("string").alias("salt"), F.lit(None).cast("string").alias("category"))
        return _named(d, source, 6, "pet_food", name=p["product_name"], brand=p["brands"], image_url=p["image_front_url"], food=food)
    if source == "gbooks":
        v = _first(F.col("items"))["volumeInfo"]
        isbn = lambda t: _first(F.filter(v["industryIdentifiers"], lambda i: i["type"] == t))["identifier"]
        book = F.struct(v["title"].alias("title"), F.coalesce(v["authors"], F.expr("cast(array() as array<string>)")).alias("authors"), v["publisher"].alias("publisher"), v["publishedDate"].alias("published"), v["pageCount"].alias("pages"), isbn("ISBN_10").alias("isbn10"), isbn("ISBN_13").alias("isbn13"), v["infoLink"].alias("link"), v["language"].alias("language"))
        return _named(d.where("totalItems > 0 and size(items) > 0"), source, 1, "book", name=v["title"], brand=v["publisher"], description=v["description"], image_url=F.replace(v["imageLinks"]["thumbnail"], F.lit("http:"), F.lit("https:")), book=book)
    if source == "openlib":
        b = F.col("book")
        names = lambda c: F.coalesce(F.filter(F.transform(c, lambda x: x["name"]), lambda x: x.isNotNull()), F.expr("cast(array() as array<string>)"))
        publisher = _first(names(b["publishers"]))
        book = F.struct(b["title"].alias("title"), names(b["authors"]).alias("authors"), publisher.alias("publisher"), b["publish_date"].alias("published"), b["number_of_pages"].alias("pages"), F.when(F.length("asked") == 10, F.col("asked")).alias("isbn10"), F.when(F.length("asked") == 13, F.col("asked")).alias("isbn13"), b["url"].alias("link"), F.lit(None).cast("string").alias("language"))
        return _named(d.where(b.isNotNull()), source, 2, "book", name=b["title"], brand=publisher, image_url=F.replace(b["cover"]["medium"], F.lit("http:"), F.lit("https:")), book=book)
    r = _first(F.col("results"))
    o = r["openfda"]
    # found by UPC first, then by package code
    order = F.when(F.col("field") == "upc", 0).otherwise(1)
    d = d.where("size(results) > 0").groupBy("asked").agg(F.min_by("results", order).alias("results"))
    none = F.expr("cast(array() as array<string>)")
    medicine = F.struct(_first(o["generic_name"]).alias("generic_name"), F.coalesce(r["active_ingredient"], none).alias("active_ingredients"), _first(o["dosage_form"]).alias("dosage_form"), _first(o["route"]).alias("route"), F.coalesce(r["warnings"], none).alias("warnings"), F.coalesce(r["contraindications"], none).alias("contraindications"), _first(r["indications_and_usage"]).alias("indications"))
    return _named(d, "fda", 3, "medicine", name=F.coalesce(_first(o["brand_name"]), _first(r["spl_product_data_elements"])), brand=_first(o["manufacturer_name"]), description=F.substring(_first(r["description"]), 1, 500), medicine=medicine)


def from_json_lines(replies: DataFrame) -> DataFrame:
    """``replies (source, line)`` → one product table of all sources."""
    out = None
    for source, schema in SCHEMAS.items():
        d = replies.where(F.col("source") == source).select(F.from_json("line", schema).alias("j")).select("j.*")
        part = normalize(source, d)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_catalogs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Read the dumps ``{source: path}`` (JSON lines) with explicit schemas, and normalise them."""
    out = None
    for source, path in paths.items():
        part = normalize(source, spark.read.schema(SCHEMAS[source]).json(path))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
