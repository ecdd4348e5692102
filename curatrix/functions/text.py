"""Column functions over URLs, names, times and lists. All are built from Spark's own, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.schemas import FILTER_MODES, LABELS, MANUAL, MODEL

STRINGS = "array<string>"
#: The size suffixes of profile images, before the extension.
SIZE_SUFFIX = r"(?i)_(?:normal|bigger|mini|reasonably_small|\d+x\d+|x\d+)(?=\.[A-Za-z0-9]+$)"
TARGET_SUFFIX = "_400x400"
#: Gateways for content-addressed URLs, in the order they are tried.
GATEWAYS = ("https://ipfs.io/ipfs/", "https://cloudflare-ipfs.com/ipfs/", "https://dweb.link/ipfs/", "https://nftstorage.link/ipfs/")
#: Extensions by content type.
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif", "image/avif": ".avif", "image/svg+xml": ".svg"}
EPOCH = "1970-01-01T00:00:00.000Z"


def no_strings() -> Column:
    return F.array().cast(STRINGS)


def normalize_image_url(url: Column) -> Column:
    """Without its query, and in the target size (the collector's form)."""
    return F.regexp_replace(F.regexp_replace(url, r"\?[^#]*", ""), SIZE_SUFFIX, TARGET_SUFFIX)


def normalize_image_url_keeping_query(url: Column) -> Column:
    """In the target size; a suffix before a query is left alone (the command line's form)."""
    return F.regexp_replace(url, SIZE_SUFFIX, TARGET_SUFFIX)


def normalize_handle(handle: Column) -> Column:
    """Trimmed of all white space, without leading slashes and then at signs, in lower case; null gives an empty string."""
    trimmed = F.regexp_replace(F.coalesce(handle, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(trimmed, "^/+", ""), "^@+", ""))


def merge_lists(*lists: Column) -> Column:
    """Sorted distinct union without empty strings; null lists are empty."""
    joined = F.concat(*[F.coalesce(x, no_strings()) for x in lists])
    return F.array_sort(F.array_distinct(F.filter(joined, lambda x: x.isNotNull() & (x != ""))))


def unique_strings(values: Column, mapper=None) -> Column:
    mapped = F.transform(F.coalesce(values, no_strings()), mapper) if mapper else F.coalesce(values, no_strings())
    return merge_lists(mapped)


def whitelist_handles(values: Column) -> Column:
    return unique_strings(values, normalize_handle)


def encode_list(values: Column) -> Column:
    return F.to_json(F.coalesce(values, no_strings()))


def decode_list(text: Column) -> Column:
    return F.coalesce(F.from_json(F.nullif(text, F.lit("")), STRINGS), no_strings())


def latest(new: Column, old: Column) -> Column:
    """The new value if it is neither null nor empty, else the old one."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def parse_time(text: Column) -> Column:
    """ISO text in any of its forms; text without a zone is UTC; empty or broken text is null."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def earliest_time(a: Column, b: Column, now: Column) -> Column:
    return F.coalesce(F.least(a, b), now)


def latest_time(a: Column, b: Column, now: Column) -> Column:
    return F.coalesce(F.greatest(a, b), now)


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def file_stamp(iso: Column) -> Column:
    return F.translate(iso, ":.", "--")


def known_label(label: Column) -> Column:
    return F.when(label.isin(*LABELS), label)


def label_tier(label_source: Column) -> Column:
    """gold for labels by hand, trusted for the model's; anything else is an error."""
    return F.when(label_source == MANUAL, F.lit("gold")).when(label_source == MODEL, F.lit("trusted")).otherwise(F.raise_error(F.concat(F.lit("unsupported label source: "), F.coalesce(label_source, F.lit("null")))).cast("string"))


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def guess_extension(content_type: Column, url: Column) -> Column:
    mime = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    by_type = None
    for kind, extension in EXTENSIONS.items():
        by_type = F.when(mime == kind, extension) if by_type is None else by_type.when(mime == kind, extension)
    suffix = F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), r"(\.[A-Za-z0-9]+)$", 1)
    return F.coalesce(by_type, F.nullif(suffix, F.lit("")), F.lit(".img"))


def gateway_urls(url: Column) -> Column:
    """The URLs to try: one for each gateway if the URL is content-addressed, else itself."""
    cid = F.regexp_replace(url, r"^ipfs://(?:ipfs/)?", "")
    return F.when(url.startswith("ipfs://"), F.array(*[F.concat(F.lit(g), cid) for g in GATEWAYS])).otherwise(F.array(url))


def metadata_image(metadata: Column) -> Column:
    """The image of a JSON document; without one, null."""
    return F.nullif(F.get_json_object(metadata, "$.image"), F.lit(""))


def unescape_entities(text: Column) -> Column:
    out = text
    for entity, char in (("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


#: Fixed value: where a page's images by contract are.
IMAGE_HOST = r"https://i2c\.seadn\.io/ethereum/"


def html_image_url(html: Column, contract: str) -> Column:
    """The first image URL in a page that names the contract in lower case, unescaped and without backslashes."""
    safe = "".join(c if c.isalnum() else "\\" + c for c in contract.lower())
    found = F.regexp_extract(html, IMAGE_HOST + safe + """/[^"' ]+""", 0)
    return F.nullif(F.replace(unescape_entities(found), F.lit("\\"), F.lit("")), F.lit(""))


def fill_template(template: Column, token_id: Column) -> Column:
    return F.replace(template, F.lit("{token_id}"), token_id.cast("string"))


def resolve_urls(templates: Column, metadata: Column, html: Column, token_id: Column, contract: str) -> Column:
    """The URLs to try for a token: its templates, else its metadata's image, else its page's; null if there is none."""
    from_templates = F.flatten(F.transform(templates, lambda t: gateway_urls(fill_template(t, token_id))))
    image, page = metadata_image(metadata), html_image_url(html, contract)
    return F.when(F.size(templates) > 0, from_templates).when(image.isNotNull(), gateway_urls(image)).when(page.isNotNull(), gateway_urls(page))


def half_up(x: Column) -> Column:
    """Rounds like JavaScript: halves go up, also below zero."""
    return F.floor(x + 0.5)


#: Units of relative time and their seconds, and what one unit before and after is called.
UNITS = (("year", 31_536_000), ("month", 2_592_000), ("week", 604_800), ("day", 86_400), ("hour", 3600), ("minute", 60), ("second", 1))
CALLED = {"year": ("last year", "next year"), "month": ("last month", "next month"), "week": ("last week", "next week"), "day": ("yesterday", "tomorrow")}


def relative_time(then: Column, now: Column) -> Column:
    """"5 minutes ago", "in 2 hours", "yesterday", in the largest fitting unit; a year has 365 days and a month 30."""
    delta = (F.unix_micros(then) - F.unix_micros(now)) / 1e6
    out = F.when(F.lit(False), F.lit(""))
    for unit, size in UNITS:
        n = half_up(delta / size)
        many = F.concat(F.abs(n).cast("string"), F.lit(f" {unit}"), F.when(F.abs(n) == 1, "").otherwise("s"))
        said = F.when(delta < 0, F.concat(many, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), many))
        if unit in CALLED:
            said = F.when(n == -1, CALLED[unit][0]).when(n == 1, CALLED[unit][1]).otherwise(said)
        elif unit == "second":
            said = F.when(n == 0, "now").otherwise(said)
        out = out.when((F.abs(delta) >= size) | F.lit(unit == "second"), said)
    return out


def format_duration(seconds: Column) -> Column:
    """1h02m03s, 2m03s or 3s; halves go to the even second."""
    total = F.bround(seconds).cast("long")
    h, m, s = F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, s)).when(m > 0, F.format_string("%dm%02ds", m, s)).otherwise(F.format_string("%ds", s))


def score_label(score: Column, digits: int = 3) -> Column:
    return F.when(score.isNull(), F.lit("n/a")).otherwise(F.format_string(f"%.{digits}f", score))


def score_percent(score: Column) -> Column:
    """The width of a score's bar, 0 to 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(score, F.lit(0.0)) * 100))


def absolute_url(url: Column, base: str) -> Column:
    host = "/".join(base.split("/")[:3])
    scheme = base.split(":")[0]
    return F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/\s]+"), url).when(url.startswith("//"), F.concat(F.lit(scheme + ":"), url)).when(url.startswith("/"), F.concat(F.lit(host), url)).when(url.rlike(r"^[^:\s]+$"), F.concat(F.lit(host + "/"), url))


def display_name(spans: Column) -> Column:
    """The first span with text that is neither a handle nor a separator."""
    trimmed = F.transform(spans, lambda x: F.trim(x))
    return F.try_element_at(F.filter(trimmed, lambda x: (x != "") & ~x.startswith("@") & (x != "·")), F.lit(1))


def read_number(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def filter_mode(mode: Column) -> Column:
    return F.when(mode.isin(*FILTER_MODES), mode).otherwise(F.lit("hide"))


def resolve_path(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def cache_shard(sha: Column) -> Column:
    return F.substring(sha, 1, 2)


def error_file_name(index: Column, probability: Column, sample_id: Column, path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.concat(F.format_string("%03d__p%.3f__", index.cast("int"), probability), F.replace(sample_id, F.lit(":"), F.lit("__")), suffix)
