"""What a page's source text and headers say about a site, as columns: format, system, scripts, media, headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveworks.functions.scores import any_of

# Marks of content systems (any case), then of frameworks (as written); the first that fits holds.
SYSTEMS = {
    "WordPress": ("wp-content", "wp-includes", "wp-json", "/wp/"), "Ghost": ("ghost.io", "content/ghost", "/assets/built/"),
    "Drupal": ("drupal.js", "drupal.min.js", "sites/default/"), "Joomla": ("/templates/", "joomla", "com_content"),
    "Wix": ("wixstatic.com", "wix.com", "x-wix-"), "Squarespace": ("squarespace.com", "squarespace-cdn.com"),
    "Shopify": ("shopify.com", "cdn.shopify.com", "shopify.theme"), "Strapi": ("/api/", "strapi", "_strapi"),
    "Contentful": ("contentful.com", "ctfassets.net"), "Webflow": ("webflow.com", "webflow.io"), "Magento": ("mage", "magento"),
    "PrestaShop": ("prestashop", "prestashop.com"),
}
FRAMEWORKS = (
    ("Next.js", ("__NEXT_DATA__", "/_next/")), ("Nuxt.js", ("__NUXT__", "_nuxt/")), ("React SPA", ("data-reactroot", "_ReactDOM")),
    ("Angular", ("ng-version", "ng-app")), ("SvelteKit", ("sveltekit", "__sveltekit")), ("Astro", ("astro-island",)), ("SolidJS", ("window.SolidJS", "solid-js")),
)
SCRIPT_MARKS = (
    "ng-app", "ng-version", "[_nghost", "[_ngcontent", "__NEXT_DATA__", "/_next/static", "data-reactroot", "__react", "__NUXT__", "/_nuxt/",
    "data-v-", "__vue_", "__sveltekit", "sveltekit", "svelte-", "astro-island", "astro:load", "/@astro/", "__remixContext", "/__remix-",
    "solid-js", "window._solid", "___gatsby", "gatsby-runtime", "qwik-", "q:base", "window.__INITIAL_STATE__", "window.__PRELOADED_STATE__",
    "window.__APP_STATE__", "window.__SERVER_DATA__", 'application/json">{', "cf-chl-bypass", "__cf_chl_",
)
FORMATS = (
    ("NEXTJS", r"__NEXT_DATA__|_next/static|/_next/"), ("NUXTJS", r"__NUXT__|_nuxt/"), ("SPA_REACT", r"data-reactroot|__REACT_DEVTOOLS|reactProps"),
    ("SPA_VUE", r"data-v-|__VUE__|v-app"), ("SPA_ANGULAR", r"ng-app|ng-controller|\[ng-"),
)
BAD_RESPONSES = ("not found", "404", "login", "sign in", "captcha", "just a moment", "enable javascript")
#: Headers and their points; 20 more for https.
HEADER_POINTS = {"content-security-policy": 20, "x-frame-options": 15, "strict-transport-security": 20, "x-content-type-options": 10, "x-xss-protection": 10, "referrer-policy": 5}
CDN_MARKS = (("cloudflare", "Cloudflare"), ("cf-ray", "Cloudflare"), ("akamai", "Akamai"), ("fastly", "Fastly"), ("cloudfront", "Amazon CloudFront"), ("x-amz-cf", "Amazon CloudFront"), ("bunny", "BunnyCDN"), ("cdn", "Generic CDN"))
SHIELD_MARKS = (
    ("cf-ray", "Cloudflare"), ("cloudflare", "Cloudflare"), ("akamai", "Akamai"), ("_abck", "Akamai"), ("imperva", "Imperva/Incapsula"), ("incapsula", "Imperva/Incapsula"),
    ("sucuri", "Sucuri"), ("datadome", "DataDome"), ("perimeterx", "PerimeterX"), ("_px", "PerimeterX"),
)
RELAY_HEADERS = ("via", "x-forwarded-for", "x-real-ip", "x-cache")
LD_JSON = r"(?i)<script[^>]+type\s*=\s*[\"']application/ld\+json[\"']"


def data_format(html: Column, url: Column) -> Column:
    out = (
        F.when(html.rlike(LD_JSON), "JSON_LD").when(html.contains("application/json"), "JSON_EMBEDDED")
        .when(F.ltrim(html).startswith("{") | F.ltrim(html).startswith("["), "JSON_API").otherwise("HTML_STANDARD")
    )
    for name, pattern in reversed(FORMATS):
        out = F.when(html.rlike(pattern), name).otherwise(out)
    out = F.when(url.endswith(".xml") | url.contains("/feed"), "XML").otherwise(out)
    return F.when(html.rlike(r"(?i)<(rss|feed|channel)[\s>]"), "RSS").otherwise(out)


def content_system(html: Column, headers: Column) -> Column:
    """headers: a text of all header values."""
    low = F.lower(F.concat(html, headers))
    out = F.when(html.contains("_app.js") & html.contains("gatsby"), "Gatsby").otherwise("Unknown")
    for name, marks in reversed(FRAMEWORKS):
        out = F.when(any_of(html, marks), name).otherwise(out)
        if name == "SvelteKit":
            out = F.when(html.contains("data-v-") & html.contains("__vue_"), "Vue.js").otherwise(out)
    for name, marks in reversed(list(SYSTEMS.items())):
        out = F.when(any_of(low, marks), name).otherwise(out)
    return out


def needs_script(html: Column, body_text: Column, n_scripts: Column) -> Column:
    """By marks of frameworks, or a short text with scripts, or a note for browsers without them."""
    note = F.lower(F.regexp_extract(html, r"(?is)<noscript[^>]*>(.*?)</noscript>", 1)).contains("javascript")
    return any_of(html, SCRIPT_MARKS) | ((F.length(body_text) < 200) & (n_scripts >= 3)) | (note & (F.length(body_text) < 500))


def needs_login(html: Column) -> Column:
    return html.rlike(r"(?i)<form[^>]+action\s*=\s*[\"'][^\"']*login|<form[^>]+id\s*=\s*[\"']login[\"']|class\s*=\s*[\"'][^\"']*\b(?:login-form|auth-required)\b|<input[^>]+(?:name|type)\s*=\s*[\"']password[\"']|id\s*=\s*[\"']login-required[\"']")


def bundle_counts(html: Column) -> Column:
    """struct(chunks, maps, endpoints) of scripts' marks."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?i)<script[^>]+src\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    chunks = F.size(F.filter(scripts, lambda s: F.lower(s).rlike("chunk|webpack|_next/"))) + F.regexp_count(html, F.lit("webpackJsonp|__webpack_require__|webpackChunk"))
    maps = F.regexp_count(html, F.lit(r"sourceMappingURL=[^*\s]+")) + F.size(F.filter(scripts, lambda s: F.lower(s).endswith(".map")))
    ends = F.regexp_count(html, F.lit(r"(?i)['\"`][^'\"`]*(?:api|ajax|graphql|search|endpoint)[^'\"`]*['\"`]"))
    return F.struct(chunks.cast("long").alias("chunks"), maps.cast("long").alias("maps"), ends.cast("long").alias("endpoints"))


def media_in_source(html: Column, most: int = 20) -> Column:
    """Quoted media URLs of a page's source, each once."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)['\"`]([^'\"`]+(?:\.m3u8|\.mpd|\.mp4|\.webm)[^'\"`]*)['\"`]"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(found, lambda u: F.replace(u, F.lit("\\/"), F.lit("/")))), 1, most)


def meta_tags(html: Column) -> Column:
    """Map of og:, twitter: and plain descriptions; the last of a name holds, empty ones do not count."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    attribute = lambda t, names: F.regexp_extract(t, rf"(?is)\s(?:{names})\s*=\s*[\"']([^\"']*)[\"']", 1)
    pairs = F.transform(tags, lambda t: F.struct(attribute(t, "property|name").alias("k"), attribute(t, "content").alias("v")))
    pairs = F.filter(pairs, lambda p: (p["v"] != "") & p["k"].rlike(r"^(og:|twitter:)|^(description|keywords|author)$"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def header_profile(url: Column, headers: Column) -> Column:
    """struct(points, cookie, cdn, relays) of response headers (a map with names in any case)."""
    named = F.transform_keys(headers, lambda k, _: F.lower(k))
    points = F.when(url.startswith("https"), 20).otherwise(0)
    for name, n in HEADER_POINTS.items():
        points = points + F.when(F.map_contains_key(named, name), n).otherwise(0)
    cookie = named["set-cookie"]
    flags = F.concat_ws(", ", *[F.when(F.lower(cookie).contains(f.lower()), f) for f in ("Secure", "HttpOnly", "SameSite")])
    text = F.lower(F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat_ws(":", e["key"], e["value"])), " "))
    cdn = F.lit("Unknown")
    for mark, label in reversed(CDN_MARKS):
        cdn = F.when(text.contains(mark), label).otherwise(cdn)
    relays = F.array_join(F.array_sort(F.filter(F.map_keys(named), lambda k: k.isin(*RELAY_HEADERS))), ",")
    label = F.when(cookie.isNull(), "No cookies").when(flags == "", "No security flags").otherwise(flags)
    return F.struct(points.alias("points"), label.alias("cookie"), cdn.alias("cdn"), relays.alias("relays"))


def shield_label(headers: Column, html: Column) -> Column:
    """The name of the protection that headers or the head of a page show; a label for statistics only."""
    text = F.lower(F.concat_ws(" ", F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat_ws(":", e["key"], e["value"])), " "), F.substring(html, 1, 5000)))
    out = F.lit("None detected")
    for mark, label in reversed(SHIELD_MARKS):
        out = F.when(text.contains(mark), label).otherwise(out)
    return out


def response_quality(text: Column) -> Column:
    """The rule's answer where no model judges: 0.25 for texts with a bad mark, else 0.82."""
    return F.when(any_of(F.lower(text), BAD_RESPONSES), 0.25).otherwise(0.82)


def json_part(raw: Column) -> Column:
    """From the first brace to the last."""
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


def freshness_verdict(answer: Column) -> Column:
    """is_fresh of an answer, else its score from 0.8 on, else true."""
    return F.coalesce(F.get_json_object(answer, "$.is_fresh").try_cast("boolean"), F.get_json_object(answer, "$.freshness_score").try_cast("double") >= 0.8, F.lit(True))


def fixed_category(own: Column, answer: Column) -> Column:
    """A correction that is sure enough and differs, else the category as it is."""
    to, sure = F.get_json_object(answer, "$.corrected_category"), F.coalesce(F.get_json_object(answer, "$.confidence").try_cast("double"), F.lit(0.0))
    return F.when((F.trim(to) != "") & (sure >= 0.8) & ~to.eqNullSafe(own), to).otherwise(own)


def schema_kind(name: Column) -> Column:
    return F.when(name == "Movie", "MOVIE").when(name == "TVSeries", "SERIES").when(name == "TVEpisode", "EPISODE").otherwise("VIDEO")
