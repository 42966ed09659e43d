"""Scalar functions over text, numbers and dates, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript has it; Java's \s is ASCII only.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: A word's begin or end as JavaScript has it; Java's \b before version 19 counts all letters.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
MONTH_MS = 30 * 24 * 3600 * 1000


def ascii_edges(pattern: str) -> str:
    """A pattern whose \\b are those of ASCII words, in any Java."""
    return pattern.replace(r"\b", EDGE)


def half_up(x: Column) -> Column:
    """Rounds halves towards positive infinity, unlike round()."""
    return F.floor(x + 0.5)


def clamp_score(x: Column) -> Column:
    """0..100, halves up; null, NaN and infinities are 0."""
    x = x.cast("double")
    real = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(real, F.greatest(F.lit(0), F.least(F.lit(100), half_up(x)))).otherwise(0).cast("int")


def normalize_text(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), SPACE + "+", " "), "^ | $", "")


def normalize_entity_name(s: Column) -> Column:
    s = F.regexp_replace(F.lower(normalize_text(s)), "[\"'`]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9\s]", " "), r"\b(llc|inc|corp|co|ltd|agency|company)\b", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def count_words(s: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(s, F.lit("")), SPACE + "+"), lambda w: w != ""))


# What counts as an e-mail address, and as a phone number.
def emails(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"), F.lit(0))


def phones(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"\+?\d[\d\s().-]{7,}\d"), F.lit(0))


def proper_noun_density(s: Column) -> Column:
    words = F.filter(F.split(F.coalesce(s, F.lit("")), SPACE + "+"), lambda w: w != "")
    proper = F.filter(words, lambda w: w.rlike("^[A-Z][a-zA-Z0-9]+$"))
    return F.when(F.size(words) > 0, F.size(proper) / F.size(words)).otherwise(0.0)


def occurrences(s: Column, name: Column) -> Column:
    """Non-overlapping occurrences of a literal, letters in either case."""
    return F.regexp_count(s, F.concat(F.lit(r"(?iu)\Q"), F.replace(name, F.lit(r"\E"), F.lit("")), F.lit(r"\E")))


def parse_date(s: Column) -> Column:
    """ISO dates and date-times, RFC 1123 dates, and years or months alone; null if none of them."""
    formats = ["yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd'T'HH:mm[XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM", "yyyy", "yyyy/MM/dd", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy", "d MMM yyyy HH:mm:ss z"]
    plain = F.regexp_replace(F.trim(s), r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+0?", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in formats])


def months_ago(date: Column, now: Column) -> Column:
    """Months of 30 days since date; 0 for a date to come."""
    return F.greatest(F.lit(0.0), (F.unix_millis(now) - F.unix_millis(date)) / F.lit(float(MONTH_MS)))


def sitemap_lastmod(xml: Column, url: Column) -> Column:
    """The lastmod that follows the exact <loc> of url, if there is one."""
    quoted = F.concat(F.lit(r"\Q"), F.regexp_replace(url, "#.*$", ""), F.lit(r"\E"))
    pattern = F.concat(F.lit(r"(?is)<url>.*?<loc>"), quoted, F.lit(r"</loc>.*?<lastmod>([^\n\r]*?)</lastmod>.*?</url>"))
    found = F.regexp_extract_all(xml, pattern, F.lit(1))
    return F.nullif(F.get(found, F.lit(0)), F.lit(""))


def copyright_year(s: Column) -> Column:
    """The latest year next to a copyright mark; the end of a range counts."""
    # Marks and years after and before them.
    after = r"(?i)(?:©|copyright(?!ed)|\(c\)(?=\s*\d))\D{0,60}?((?:19|20)\d{2})(?!\d)(?:\s*[-–—]\s*((?:19|20)\d{2})(?!\d))?"
    before = r"(?i)(?<!\d)((?:19|20)\d{2})\s*(?:©|\(c\))"
    found = F.concat(*[F.regexp_extract_all(s, F.lit(p), F.lit(g)) for p, g in ((after, 1), (after, 2), (before, 1))])
    return F.array_max(F.transform(F.filter(found, lambda y: y != ""), lambda y: y.cast("int")))


def content_signal(value: Column) -> Column:
    """A Content-Signal value as a map of the known signals; the last of a name counts."""
    pairs = F.transform(F.split(F.lower(value), ","), lambda t: F.struct(F.trim(F.substring_index(t, "=", 1)).alias("k"), F.trim(F.regexp_extract(t, r"=(.*)$", 1)).alias("v")))
    known = F.filter(pairs, lambda p: p["k"].isin("search", "ai-input", "ai-train") & p["v"].isin("yes", "no"))
    last = F.filter(known, lambda p, i: ~F.exists(F.slice(known, i + 2, F.size(known)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


# Phrases by site category, and what a phrase counts.
CATEGORIES = {
    "saas-devtools": (1.0, ["api", "sdk", "documentation", "docs", "github", "npm install", "pip install", "yarn add", "pnpm add", "cli", "developers", "integration", "webhook", "open source", "opensource", "authentication", "oauth", "api key", "pricing", "enterprise", "self-host", "self host", "getting started"]),
    "ecommerce": (1.5, ["add to cart", "add to bag", "shopping cart", "checkout", "shop now", "buy now", "in stock", "out of stock", "free shipping", "returns", "product details", "sku", "add to wishlist", "view product"]),
    "local-business": (1.5, ["opening hours", "business hours", "directions", "visit us", "our location", "find us", "reservations", "book a table", "menu", "walk-ins welcome", "serving the", "in the heart of", "get directions", "our locations", "schedule a tour", "book a tour", "visit our", "nearest location", "parking", "neighborhood"]),
    "service-business": (1.0, ["book a call", "book a consultation", "get a quote", "request a quote", "free consultation", "our services", "case studies", "client", "testimonials", "schedule a meeting", "hire us"]),
    "blog-or-content": (0.75, ["recent posts", "latest articles", "read more", "by author", "published on", "subscribe to newsletter", "archives", "categories", "tags", "comments"]),
    "real-estate": (1.5, ["floor plan", "floorplan", "square feet", "sq ft", "bedroom", "bathroom", "apartments", "for rent", "for lease", "lease now", "available units", "amenities", "residents", "resident portal", "schedule a tour", "pet policy", "move-in", "per month", "studio", "listing", "property", "realtor", "mls"]),
}
# Schema types that speak for a category, and what they count.
CATEGORY_TYPES = {
    "saas-devtools": (4.0, ["SoftwareApplication", "WebApplication", "MobileApplication"]),
    "ecommerce": (4.0, ["Product", "Offer", "AggregateOffer"]),
    "local-business": (4.0, ["LocalBusiness", "Restaurant", "Store"]),
    "service-business": (2.0, ["Service", "ProfessionalService"]),
    "blog-or-content": (4.0, ["Article", "BlogPosting", "NewsArticle"]),
    "real-estate": (4.0, ["ApartmentComplex", "Apartment", "Residence", "SingleFamilyResidence", "RealEstateListing", "Accommodation"]),
}


def site_category(s: Column, types: Column | None = None, repo_link: Column | None = None) -> Column:
    """struct<category, confidence, specific>: the category with the most points, 2 at least and 1 ahead of the next, else unknown. A category's phrases count three times at most."""
    low = F.lower(s)
    scores = []
    for i, (name, (worth, phrases)) in enumerate(CATEGORIES.items()):
        hits = F.least(F.lit(3), sum((F.when(F.contains(low, F.lit(p)), 1).otherwise(0) for p in phrases), F.lit(0)))
        score = hits * worth
        if types is not None:
            points, known = CATEGORY_TYPES[name]
            score = score + F.when(F.arrays_overlap(types, F.array(*[F.lit(k) for k in known])), points).otherwise(0.0)
        if repo_link is not None and name == "saas-devtools":
            score = score + F.when((hits > 0) & repo_link, 1.0).otherwise(0.0)
        scores.append(F.struct(score.alias("score"), F.lit(-i).alias("ord"), F.lit(name).alias("name")))
    ranked = F.sort_array(F.array(*scores), asc=False)
    top, second = ranked[0], ranked[1]
    known = (top["score"] >= 2) & (top["score"] - second["score"] >= 1)
    total = F.aggregate(ranked, F.lit(0.0), lambda acc, x: acc + x["score"])
    return F.struct(
        F.when(known, top["name"]).otherwise("unknown").alias("category"),
        F.when(known, F.least(F.lit(1.0), top["score"] / F.greatest(total, F.lit(1.0)))).otherwise(0.0).alias("confidence"),
        (known & (top["score"] - second["score"] >= 2)).alias("specific"),
    )


def neutralised(s: Column) -> Column:
    """Control and format characters as spaces, spaces collapsed: for text that others wrote."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[\p{Cc}\p{Cf}]", " "), r"\s+", " "))


def xml_unescaped(s: Column) -> Column:
    """The named and numeric entities of XML; &amp; last, so nothing is decoded twice. A number that is no code point stays."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    for pattern, base in ((r"&#([0-9]+);", 10), (r"&#x([0-9a-fA-F]+);", 16)):
        s = F.when(s.rlike(pattern), _references(s, pattern, base)).otherwise(s)
    return F.replace(s, F.lit("&amp;"), F.lit("&"))


def _references(s: Column, pattern: str, base: int) -> Column:
    """s with each numeric reference replaced by its character: what lies between them and the characters, in turn."""
    between = F.split(s, pattern, -1)
    found = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    digits = F.regexp_extract_all(s, F.lit(pattern), F.lit(1))
    code = lambda d: F.conv(F.ltrim(d, F.lit("0")), base, 10).cast("decimal(20)")
    known = lambda d: F.length(F.ltrim(d, F.lit("0"))).between(1, 7) & (code(d) <= 0x10FFFF) & ~code(d).between(0xD800, 0xDFFF)
    char = lambda d: F.decode(F.unhex(F.lpad(F.conv(F.ltrim(d, F.lit("0")), base, 16), 8, "0")), "UTF-32")
    chars = F.zip_with(found, digits, lambda whole, d: F.when(known(d), char(d)).otherwise(whole))
    return F.array_join(F.zip_with(between, chars, lambda text, c: F.concat(text, F.coalesce(c, F.lit("")))), "")
