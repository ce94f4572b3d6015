"""Similarity of words, titles and queries, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveworks.functions.scores import most_edits

# Fixed values.
STOP_WORDS = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "or", "but", "is", "are", "was", "were", "be", "been", "has",
    "have", "had", "do", "does", "did", "with", "this", "that", "it", "its", "by", "from", "up", "out", "as", "into", "than",
)
PUNCTUATION = ",.!?\"'()"
CATEGORY_WORDS = {
    "STREAMING": ("watch", "stream", "movie", "movies", "series", "tv", "episode", "episodes", "film", "cinema", "show", "shows", "anime", "documentary", "season", "netflix", "online", "hulu", "play"),
    "TORRENT": ("download", "torrent", "magnet", "seed", "seeder", "leecher", "peers", "tracker", "dht", "pirate", "bit"),
    "NEWS": ("news", "article", "latest", "breaking", "report", "journalist", "headline", "story", "blog", "post", "update"),
    "MEDIA": ("video", "music", "audio", "photo", "image", "gallery", "mp3", "mp4", "flac", "wav", "jpeg", "png"),
}


def _stripped(query: Column) -> Column:
    """Words by white space, without the punctuation at their ends."""
    marks = "[" + "".join(f"\\{c}" for c in PUNCTUATION) + "]+"
    return F.transform(F.split(F.lower(query), r"\s+"), lambda w: F.regexp_replace(w, f"^{marks}|{marks}$", ""))


def query_words(query: Column) -> Column:
    """Words of two characters at least before their punctuation goes, no stop words."""
    marks = "[" + "".join(f"\\{c}" for c in PUNCTUATION) + "]+"
    long = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) > 1)
    return F.filter(F.transform(long, lambda w: F.regexp_replace(w, f"^{marks}|{marks}$", "")), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def query_terms(query: Column) -> Column:
    """Words without stop words, then the pairs of neighbours of which neither is one."""
    words = F.filter(_stripped(query), lambda w: F.length(w) > 1)
    single = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b")))
    pairs = F.filter(F.when(F.size(words) > 1, pairs).otherwise(F.slice(pairs, 1, 0)), lambda p: ~p["a"].isin(*STOP_WORDS) & ~p["b"].isin(*STOP_WORDS))
    return F.concat(single, F.when(F.size(words) > 1, F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"]))).otherwise(F.array().cast("array<string>")))


def keywords(query: Column, stop_words: tuple[str, ...]) -> Column:
    """Distinct words of two characters at least that are no stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*stop_words)))


def fuzzy_match(text: Column, term: Column) -> Column:
    """The word of a text nearest to a term within its edits, the first among equals; null for terms under three characters."""
    words = F.filter(F.split(text, r"\W+"), lambda w: (F.length(w) > 1) & (F.abs(F.length(w) - F.length(term)) <= most_edits(term) + 1))
    near = F.filter(F.transform(words, lambda w, i: F.struct(F.levenshtein(w, term).alias("d"), i.alias("i"), w.alias("w"))), lambda x: x["d"] <= most_edits(term))
    return F.when(F.length(term) >= 3, F.array_min(near)["w"])


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0.9 and 0.85 where one begins, ends or holds the other, else by edits over the longer length."""
    longer = F.when(F.length(a) > F.length(b), a).otherwise(b)
    shorter = F.when(F.length(a) > F.length(b), b).otherwise(a)
    return (
        F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).when(longer.startswith(shorter) | longer.endswith(shorter), 0.9)
        .when(longer.contains(shorter), 0.85).otherwise(1.0 - F.levenshtein(a, b) / F.length(longer))
    )


def alike(a: Column, b: Column) -> Column:
    """Equal, one within the other, or the same first four characters."""
    head = (F.length(a) >= 4) & (F.length(b) >= 4) & (F.substring(a, 1, 4) == F.substring(b, 1, 4))
    return a.contains(b) | b.contains(a) | head


def tab_relevance(text: Column, url: Column, words: Column) -> Column:
    """Points of a link for the words of a query."""
    t, u = F.lower(text), F.lower(url)
    points = lambda w: F.when(t == w, 1.0).when(t.contains(w), 0.7).when(u.contains(w), 0.5).when(alike(t, w), 0.3).otherwise(0.0)
    return F.aggregate(F.transform(words, points), F.lit(0.0), lambda a, x: a + x)


def concept_similarity(title: Column, description: Column, terms: Column) -> Column:
    """6 for each distinct term over two characters that title or description holds."""
    combined = F.lower(F.concat_ws(" ", title, F.coalesce(description, F.lit(""))))
    return (F.size(F.filter(F.array_distinct(F.filter(terms, lambda t: F.length(t) > 2)), lambda t: combined.contains(F.lower(t)))) * 6).cast("double")


def fits_category(kind: Column, query: Column) -> Column:
    """Whether a query has a word of the provider's kind."""
    low, out = F.lower(query), F.lit(False)
    for name, words in CATEGORY_WORDS.items():
        found = F.lit(False)
        for w in words:
            found = found | low.contains(w)
        out = F.when(kind == name, found).otherwise(out)
    return out


def thumbnail_score(keywords_of_image: Column, query: Column) -> Column:
    """100 times the share of a query's words among an image's keywords."""
    words = F.filter(F.split(F.lower(query), r"\W+"), lambda w: w != "")
    return 100.0 * F.size(F.filter(words, lambda w: F.array_contains(keywords_of_image, w))) / F.greatest(F.size(words), F.lit(1))
