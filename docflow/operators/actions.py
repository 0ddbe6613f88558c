"""Typed actions out of text and barcode payloads: ``(scan_id, pos, kind, key, value, attrs)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import run_sql

# The patterns of actions in text.
URL = r"(?i)\b(?:https?://[^\s<>\"{}|\\^`\[\]]+|www\.[^\s<>\"{}|\\^`\[\]]+\.[a-z]{2,})"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+|00)?[1-9][0-9]{0,2}[-.\s]?\(?[0-9]{1,4}\)?[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,9}"
WIFI = r"(?i)WIFI:(?:T:([^;]*);)?S:([^;]+);(?:P:([^;]*);)?(?:H:([^;]*);)?;?"
ACTION = "array<struct<kind:string,key:string,value:string,attrs:map<string,string>>>"


def _action(kind: str, key: Column, value: Column | None = None, **attrs: Column) -> Column:
    pairs = [x for k, v in attrs.items() for x in (F.lit(k), v)]
    held = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.expr("cast(map() as map<string,string>)")
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), (key if value is None else value).alias("value"), held.alias("attrs"))


def _many(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: _action(kind, v))


def extract_actions(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text)`` → one row an action, ``(doc_id, pos, kind, key, value, attrs)``, distinct by kind and key.

    A Wi-Fi string is exclusive.  Else the first five URL, three e-mail and two phone matches are taken, and only then checked:
    limits come before validation.
    """
    t = F.col("text")
    urls = F.filter(F.transform(F.slice(F.regexp_extract_all(t, F.lit(URL), 0), 1, 5), lambda u: F.when(u.rlike("(?i)^www[.]"), F.concat(F.lit("https://"), u)).otherwise(u)), _valid_url)
    emails = F.slice(F.regexp_extract_all(t, F.lit(EMAIL), 0), 1, 3)
    phones = F.filter(F.transform(F.slice(F.regexp_extract_all(t, F.lit(PHONE), 0), 1, 2), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), _valid_phone)
    copy = F.when(t.rlike(r"\S"), F.array(_action("copy", F.substring(t, 1, 50), t))).otherwise(F.expr(f"cast(array() as {ACTION})"))
    plain = F.concat(_many("url", urls), _many("email", emails), _many("phone", phones), copy)
    part = lambda i: F.regexp_extract(t, WIFI, i)
    security = F.when(F.upper(part(1)).isin("WPA", "WPA2", "WPA3"), "WPA").when(F.upper(part(1)) == "WEP", "WEP").otherwise("OPEN")
    wifi = F.array(_action("wifi", part(2), password=F.when(part(3) != "", part(3)), security=security), _action("copy", F.substring(part(2), 1, 50), part(2)))
    d = docs.where(t.isNotNull()).select("doc_id", F.posexplode(F.when(t.rlike(WIFI), wifi).otherwise(plain)).alias("pos", "a")).select("doc_id", F.col("pos").cast("long").alias("pos"), "a.*")
    return _distinct(d, "doc_id")


def _valid_url(url: Column) -> Column:
    """An http address whose host has two labels or more, the last of two characters or more."""
    host = F.regexp_extract(url, r"^[^:]*://([^/?]*)", 1)
    return url.rlike("(?i)^https?://") & (F.size(F.split(host, r"\.", -1)) >= 2) & (F.length(F.substring_index(host, ".", -1)) >= 2)


def _valid_phone(p: Column) -> Column:
    digits = F.length(F.regexp_replace(p, "[^0-9]", ""))
    return p.rlike(r"^(?:\+|00)") & digits.between(10, 15) & (p.rlike(r"[ (-]") | p.startswith("+"))


def _distinct(actions: DataFrame, owner: str) -> DataFrame:
    """The first action of each kind and key; maps cannot be keys, so a window picks it."""
    return run_sql(f"SELECT * EXCEPT (nth) FROM (SELECT *, row_number() OVER (PARTITION BY {owner}, kind, key ORDER BY pos) AS nth FROM {{actions}}) WHERE nth = 1", actions=actions)


def action_summary(actions: DataFrame, docs: DataFrame) -> DataFrame:
    """``(source, lang, links, emails, phone_numbers, items)``, with totals where source or lang is null by rollup."""
    kind = F.when(F.col("kind") == "url", "links").when(F.col("kind") == "email", "emails").when(F.col("kind") == "phone", "phone_numbers").otherwise("items")
    per = actions.join(docs.select("doc_id", "source", "lang"), "doc_id").withColumn("group", kind)
    counts = [F.count_if(F.col("group") == k).alias(k) for k in ("links", "emails", "phone_numbers", "items")]
    return per.rollup("source", "lang").agg(*counts)


def normalize_links(links: DataFrame) -> DataFrame:
    """``links (doc_id, url)`` → ``(link, n, n_docs)``: https where no scheme stands, schemes in lower case, the rest as it is."""
    t = F.regexp_replace("url", r"^\s+|\s+$", "")
    scheme = F.regexp_extract(t, r"^([a-zA-Z][a-zA-Z0-9+-]*:)", 1)
    link = F.when(scheme == "", F.concat(F.lit("https://"), t)).otherwise(F.concat(F.lower(scheme), F.substring(t, F.length(scheme) + 1, F.length(t))))
    return links.where(F.col("url").isNotNull()).groupBy(link.alias("link")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def _fields(body: Column) -> Column:
    """``K:V;K:V;`` with backslash escapes as a map, the first of equal keys: escapes are set aside, so that a split can cut."""
    marked = F.regexp_replace(body, r"(?s)\\(.)", "\u0001$1\u0002")  # an escaped character between marks
    # a split at ; that is not between marks
    parts = F.split(marked, "(?<!\u0001);", -1)
    plain = F.transform(parts, lambda p: F.regexp_replace(p, "[\u0001\u0002]", ""))
    keyed = F.filter(plain, lambda p: F.instr(p, ":") > 1)
    pairs = F.transform(keyed, lambda p: F.struct(F.upper(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.substring(p, F.instr(p, ":") + 1, F.length(p)).alias("v")))
    firsts = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(firsts)


def _properties(text: Column) -> Column:
    """``KEY;...:value`` lines in order, as (k, v) structs, empty values left out."""
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.upper(F.substring_index(F.substring_index(x, ":", 1), ";", 1))).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    return F.filter(pairs, lambda p: p["v"] != "")


def _decoded(x: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def payload_actions(payloads: DataFrame) -> DataFrame:
    """``payloads (scan_id, ord, format, raw)`` → ``(scan_id, ord, pos, kind, key, value, attrs)``.

    Blank and repeated payloads of a scan are dropped.  The prefix decides the kind; a payload without its required field
    is raw; a copy action is added unless one is there.
    """
    p = payloads.where("trim(raw) <> ''").groupBy("scan_id", "raw").agg(F.min_by("format", "ord").alias("format"), F.min("ord").alias("ord"))
    t, low = F.col("raw"), F.lower("raw")
    raw = F.array(_action("raw", F.substring(t, 1, 50), t))
    f = F.col("f")
    get = lambda k: F.try_element_at(f, F.lit(k))
    full = lambda c: F.when(c != "", c)
    first = lambda k: F.try_element_at(F.filter("props", lambda x: x["k"] == k), F.lit(1))["v"]
    last = lambda k: F.try_element_at(F.filter("props", lambda x: x["k"] == k), F.lit(-1))["v"]
    body = F.when(low.startswith("wifi:"), F.substring(t, 6, F.length(t))).when(low.startswith("matmsg:") | low.startswith("mecard:"), F.substring(t, 8, F.length(t)))
    p = p.withColumn("f", F.when(body.isNotNull(), _fields(body))).withColumn("props", F.when(low.startswith("begin:vcard") | low.contains("begin:vevent"), _properties(t)))

    kind = F.upper(get("T"))
    security = F.when(kind.isin("WPA", "WPA2", "WPA3", "SAE"), "WPA").when(kind == "WEP", "WEP").otherwise("OPEN")
    wifi = F.when(F.coalesce(get("S"), F.lit("")) == "", raw).otherwise(F.array(_action("wifi", get("S"), password=full(get("P")), security=security), _action("copy", F.substring(get("S"), 1, 50), get("S"))))
    address = _decoded(F.substring_index(F.substring(t, 8, F.length(t)), "?", 1))
    query = F.when(F.instr(t, "?") > 0, F.substring(t, F.instr(t, "?") + 1, F.length(t))).otherwise("")
    param = lambda k: F.try_element_at(F.transform(F.filter(F.split(query, "&"), lambda x: F.lower(F.substring_index(x, "=", 1)) == k), lambda x: _decoded(F.when(F.instr(x, "=") > 0, F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise(""))), F.lit(-1))
    mailto = F.when(F.trim(address) == "", raw).otherwise(F.array(_action("email", address, subject=param("subject"), body=param("body"))))
    matmsg = F.when(F.trim(F.coalesce(get("TO"), F.lit(""))) == "", raw).otherwise(F.array(_action("email", get("TO"), subject=get("SUB"), body=get("BODY"))))
    rest = F.substring(t, F.instr(t, ":") + 1, F.length(t))
    to_number = F.trim(F.substring_index(rest, ":", 1))
    to_text = F.when(F.instr(rest, ":") > 0, full(F.substring(rest, F.instr(rest, ":") + 1, F.length(rest))))
    number = F.trim(F.substring_index(rest, "?", 1))
    text = F.when(F.instr(t, "body=") > 0, _decoded(full(F.substring_index(F.substring(t, F.instr(t, "body=") + 5, F.length(t)), "&", 1))))
    smsto = F.when(to_number == "", raw).otherwise(F.array(_action("sms", to_number, message=to_text)))
    sms = F.when(number == "", raw).otherwise(F.array(_action("sms", number, message=text)))
    turned = F.array_join(F.reverse(F.filter(F.split(first("N"), ";"), lambda x: F.trim(x) != "")), " ")
    name, tel, mail = F.coalesce(last("FN"), turned), first("TEL"), first("EMAIL")
    who = lambda n, p_, e: F.concat(F.coalesce(n, F.lit("null")), F.coalesce(p_, F.lit("null")), F.coalesce(e, F.lit("null")))
    vcard = F.when(name.isNull() & tel.isNull() & mail.isNull(), raw).otherwise(F.array(_action("contact", who(name, tel, mail), name, phone=tel, email=mail, organization=F.substring_index(last("ORG"), ";", 1))))
    parts = F.filter(F.split(get("N"), ","), lambda x: F.trim(x) != "")
    me = F.when(F.size(parts) >= 2, F.concat_ws(" ", F.trim(F.try_element_at(parts, F.lit(2))), F.trim(F.try_element_at(parts, F.lit(1))))).otherwise(F.array_join(parts, " "))
    mecard = F.when(get("N").isNull() & get("TEL").isNull() & get("EMAIL").isNull(), raw).otherwise(F.array(_action("contact", who(me, get("TEL"), get("EMAIL")), me, phone=get("TEL"), email=get("EMAIL"), organization=get("ORG"))))
    event = F.array(_action("event", F.concat(F.coalesce(last("SUMMARY"), F.lit("null")), F.coalesce(last("DTSTART"), F.lit("null"))), last("SUMMARY"), location=last("LOCATION"), description=last("DESCRIPTION"), start=last("DTSTART"), end=last("DTEND")))
    product = F.col("format").isin("EAN_13", "EAN_8", "UPC_A", "UPC_E") | t.rlike("^[0-9]{9}[0-9Xx]$")
    found = (
        F.when(low.startswith("wifi:"), wifi)
        .when(low.startswith("http://") | low.startswith("https://"), F.array(_action("url", t)))
        .when(low.startswith("www."), F.array(_action("url", F.concat(F.lit("https://"), t))))
        .when(low.startswith("mailto:"), mailto)
        .when(low.startswith("matmsg:"), matmsg)
        .when(low.startswith("tel:"), F.array(_action("phone", F.trim(F.substring(t, 5, F.length(t))))))
        .when(low.startswith("smsto:"), smsto)
        .when(low.startswith("sms:"), sms)
        .when(low.startswith("begin:vcard"), vcard)
        .when(low.startswith("mecard:"), mecard)
        .when(low.startswith("geo:"), F.array(_action("url", t)))
        .when(low.contains("begin:vevent"), event)
        .when(product, F.concat(F.array(_action("product", t)), raw))
        .otherwise(raw)
    )
    p = p.select("scan_id", "ord", "raw", found.alias("found"))
    whole = F.when(F.exists("found", lambda a: a["kind"] == "copy"), F.col("found")).otherwise(F.concat("found", F.array(_action("copy", F.substring("raw", 1, 50), F.col("raw")))))
    return p.select("scan_id", F.col("ord").cast("long").alias("ord"), F.posexplode(whole).alias("pos", "a")).select("scan_id", "ord", F.col("pos").cast("long").alias("pos"), "a.*")


def barcode_first(payloads: DataFrame, text_actions: DataFrame) -> DataFrame:
    """Text actions of the scans that have no barcode."""
    return text_actions.join(payloads.where("trim(raw) <> ''").select("scan_id").distinct(), "scan_id", "left_anti")


def quick_actions(barcode_actions: DataFrame, text_actions: DataFrame, most: int = 6) -> DataFrame:
    """``(scan_id, nth, kind, key, value)``: barcode actions, then text actions that are neither copy nor raw; the first six distinct."""
    cols = ["scan_id", "kind", "key", "value"]
    b = barcode_actions.select(*cols, F.lit(0).alias("origin"), (F.col("ord") * 1000 + F.col("pos")).alias("pos"))
    t = text_actions.where("kind not in ('copy', 'raw')").select(*cols, F.lit(1).alias("origin"), "pos")
    label = F.when(F.col("kind").isin("url", "phone", "email", "sms", "wifi"), F.concat_ws(":", "kind", "key")).when(F.col("kind") == "contact", F.concat(F.lit("contact:"), F.coalesce("value", F.lit("null")))).otherwise(F.col("kind"))
    both = b.unionByName(t).withColumn("label", label)
    return run_sql(
        f"""
        WITH d AS (SELECT *, row_number() OVER (PARTITION BY scan_id, label ORDER BY origin, pos) AS again FROM {{both}}),
        n AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY origin, pos) AS nth FROM d WHERE again = 1)
        SELECT scan_id, CAST(nth AS BIGINT) AS nth, kind, key, value FROM n WHERE nth <= {most}
        """,
        both=both,
    )
