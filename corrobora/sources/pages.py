"""Archived HTML pages as tables, with regular expressions that run inside Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.text import decode_obfuscated, nonempty, strip_tags, title_case, unescape_html
from corrobora.session import first_by


def _all(c, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def _first(c, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group)


def parse_catalog_html(pages: DataFrame, key: str = "page_id", min_cells: int = 17) -> DataFrame:
    """Rows of the catalogue table of each page: header skipped, short rows dropped, ``//`` lists split."""
    rows = pages.select(key, F.posexplode(_all("html", "(?s)<tr>(.*?)</tr>")).alias("row", "_r")).filter("row > 0")
    cells = rows.select(key, "row", F.transform(_all("_r", "(?s)<td[^>]*>(.*?)</td>"), strip_tags).alias("c")).filter(F.size("c") >= min_cells)
    listed = lambda i: F.filter(F.transform(F.split(F.col("c")[i], "//"), lambda x: F.trim(x)), lambda x: x != "")
    text = {"annotation_url": 5, "gard_id": 6, "omim": 7, "orphanet": 8, "umls": 9, "mesh": 10, "icd10cm": 11, "gene_description": 12}
    return cells.select(
        key, "row", F.col("c")[1].alias("name"), listed(2).alias("aliases"), listed(3).alias("genes"),
        *[F.trim(F.col("c")[i]).alias(n) for n, i in text.items()],
        F.when(F.col("c")[16].rlike(r"^\d+$"), F.col("c")[16].try_cast("int")).otherwise(0).alias("pmid_count"))


def _mail(block: Column, label: str = "") -> Column:
    """A protected address is decoded; plain text counts only when it is an address and no placeholder."""
    hidden = _first(block, 'data-cfemail="([0-9a-fA-F]*)"')
    plain = F.trim(F.replace(strip_tags(block), F.lit(label), F.lit("")) if label else strip_tags(block))
    return F.when(hidden != "", decode_obfuscated(hidden)).when(F.contains(plain, F.lit("@")) & ~plain.startswith("[email"), plain).otherwise("")


def extract_org_cards(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Organisation cards of report pages: name, link, phone, e-mail, fax and the related diseases."""
    section = _first("html", '(?s)<section[^>]*data-id="orgs"[^>]*>(.*?)</section>')
    cards = pages.select(key, section.alias("_s")).select(key, F.posexplode(F.split("_s", '<div[^>]*class="single-rd-resource"[^>]*>')).alias("card", "_c")).filter("card > 0")
    head = _first("_c", "(?s)<h5[^>]*>(.*?)</h5>")
    spanned = lambda cls: _first("_c", rf'(?s)<span[^>]*class="{cls}"[^>]*>(.*?)</span>(?!\s*</span>)')
    phone, related = spanned("phone"), _first("_c", '(?s)<div[^>]*class="rd-details"[^>]*>(.*?)</div>')
    linked = strip_tags(_first(phone, "(?s)<a[^>]*>(.*?)</a>"))
    return cards.filter(head != "").select(
        key, "card", strip_tags(head).alias("name"), F.trim(_first(head, 'href="([^"]*)"')).alias("nord_url"),
        F.coalesce(nonempty(linked), F.trim(F.replace(strip_tags(phone), F.lit("Phone:"), F.lit("")))).alias("phone"),
        _mail(spanned("email"), "Email:").alias("email"), F.trim(F.replace(strip_tags(spanned("fax")), F.lit("Fax:"), F.lit(""))).alias("fax"),
        F.transform(_all(related, "(?s)<a[^>]*>(.*?)</a>"), strip_tags).alias("related_diseases"))


def extract_org_profile(pages: DataFrame, key: str = "url") -> DataFrame:
    """Profile pages: address, phone, e-mail, website, and the paragraphs from the About heading to the next one."""
    contact = _first("html", '(?s)<div[^>]*class="contact-info"[^>]*>(.*?)</div>')
    after = lambda icon: _first(F.col("_k"), rf'(?s)<i[^>]*class="[^"]*{icon}[^"]*"[^>]*>.*?</i>\s*<p[^>]*>(.*?)</p>')
    about = _first("html", "(?is)<h2[^>]*>[^<]*about[^<]*</h2>(.*?)(?:<h2|$)")
    paragraphs = F.filter(F.transform(_all(F.col("_about"), "(?s)<p[^>]*>(.*?)</p>"), strip_tags), lambda p: p != "")
    rows = pages.select(key, contact.alias("_k"), about.alias("_about"))
    site = after("bi-link")
    return rows.select(
        key, F.regexp_replace(strip_tags(F.regexp_replace(after("bi-pin-map"), "<br */?>", " ")), r"\s+", " ").alias("address"),
        strip_tags(after("bi-telephone")).alias("phone"), _mail(after("bi-envelope")).alias("email"),
        F.coalesce(nonempty(F.trim(_first(site, 'href="([^"]*)"'))), strip_tags(site)).alias("website"), F.array_join(paragraphs, " ").alias("description"))


def enrich_orgs(cards: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profile data on the cards: address, website and description come from the profile, phone and e-mail only fill gaps."""
    p = profiles.select(F.col("url").alias("nord_url"), *[F.col(c).alias(f"_{c}") for c in ("address", "phone", "email", "website", "description")])
    get = lambda c: F.coalesce(nonempty(f"_{c}"), F.lit(""))
    return cards.join(p, "nord_url", "left").select(
        *cards.columns[:0], *[c for c in cards.columns if c not in ("phone", "email")],
        F.coalesce(nonempty("phone"), get("phone")).alias("phone"), F.coalesce(nonempty("email"), get("email")).alias("email"),
        get("address").alias("address"), get("website").alias("website"), get("description").alias("description"))


def sitemap_to_slug_map(pages: DataFrame, base: str, key: str = "page_id") -> DataFrame:
    """(seq, key, url): each report link under its slug and under the slug with spaces."""
    pattern = "<loc>(" + base.replace(".", r"\.").rstrip("/") + "/[^/<]+/?)</loc>"
    urls = pages.select(key, F.posexplode(_all("html", pattern)).alias("pos", "u"))
    slug = F.lower(F.trim(F.substring_index(F.rtrim("u", F.lit("/")), "/", -1)))
    both = urls.select(F.struct(key, "pos").alias("seq"), F.concat(F.rtrim("u", F.lit("/")), F.lit("/")).alias("url"),
                       F.explode(F.array(F.replace(slug, F.lit("-"), F.lit(" ")), slug)).alias("key"))
    # a later page overwrites the link of a key but the key keeps its first place in the map
    return both.groupBy("key").agg(F.min("seq").alias("seq"), F.max_by("url", "seq").alias("url"))


def extract_directory_orgs(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Result cards of a directory: id, name, country and city; the first card of an id counts."""
    pattern = r'(?s)(<div class="fw-bold">[^<]+</div>.*?href="/en/patient-organisations/patient/\d+[^"]*">\s*[^<]+?\s*</a>)'
    cards = pages.select(key, F.posexplode(_all("html", pattern)).alias("pos", "_c"))
    places = F.transform(_all("_c", "<div>([^<]+)</div>"), lambda p: F.trim(unescape_html(p)))
    rows = cards.select(
        key, "pos", _first("_c", r"/en/patient-organisations/patient/(\d+)").alias("id"),
        F.trim(unescape_html(_first("_c", r'(?s)patient/\d+[^"]*">\s*([^<]+?)\s*</a>'))).alias("name"),
        title_case(F.trim(_first("_c", '<div class="fw-bold">([^<]+)</div>'))).alias("country"),
        F.coalesce(title_case(F.element_at(F.when(F.size(places) > 0, places), -1)), F.lit("")).alias("city"))
    return first_by(rows, [key, "id"], [F.asc("pos")])
