"""Text relevance of results to a query: evidence for each row and query term, summed by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.scores import ngrams

# Words of a query that are passed over.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "it", "this", "that",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "can", "shall", "not", "no", "so", "if", "then",
)
# Query words and related terms.
SYNONYMS = {
    "movie": ("film", "cinema", "feature", "flick", "motion picture"), "film": ("movie", "cinema", "feature", "flick", "motion picture"),
    "video": ("clip", "footage", "recording", "stream", "content"), "watch": ("view", "stream", "play", "see", "look"),
    "download": ("get", "save", "grab", "fetch", "dl"), "hd": ("high definition", "720p", "1080p", "high quality", "hq"),
    "full": ("complete", "entire", "whole", "uncut"), "episode": ("ep", "part", "chapter", "installment"),
    "season": ("series", "s0", "complete season"), "free": ("gratis", "no cost", "freeware"),
    "online": ("streaming", "web", "internet", "digital"), "latest": ("new", "recent", "newest", "fresh", "updated"),
    "best": ("top", "greatest", "finest", "premium", "ultimate"), "trailer": ("preview", "teaser", "promo"),
    "subtitle": ("sub", "subs", "subtitles", "cc", "captions"), "dubbed": ("dub", "english dub", "dual audio"),
    "anime": ("animation", "cartoon", "animated"), "series": ("show", "tv show", "tv series", "television"),
    "song": ("music", "track", "audio", "mp3"), "game": ("gaming", "gameplay", "playthrough", "walkthrough"),
    "tutorial": ("guide", "how to", "howto", "lesson"), "review": ("opinion", "critique", "analysis"),
    "live": ("livestream", "live stream", "broadcast"), "old": ("classic", "vintage", "retro", "throwback"),
    "funny": ("comedy", "humor", "hilarious", "lol"), "scary": ("horror", "terrifying", "creepy", "spooky"),
    "torrent": ("magnet", "download", "p2p", "seedbox"), "stream": ("streaming", "watch online", "live stream", "play"),
    "4k": ("uhd", "ultra hd", "2160p", "ultra-hd"), "bluray": ("blu-ray", "blu ray", "bd", "bdrip"), "remux": ("bdremux", "bdmv", "full bluray"),
    "new": ("latest", "recent", "fresh", "updated", "newest"), "popular": ("trending", "viral", "top", "best", "hot"),
    "clip": ("short", "snippet", "cut", "highlight"), "show": ("tv show", "television", "programme", "program"),
    "documentary": ("doc", "docuseries", "documentary film"), "cartoon": ("animated", "animation", "anime"),
    "indian": ("bollywood", "hindi", "desi", "tollywood"), "kids": ("children", "family", "cartoon", "toddler"),
    "sport": ("sports", "match", "game", "league", "cup"), "music": ("song", "audio", "album", "track", "mp3"),
}
# Points.
EXACT, EXACT_DESCRIPTION, START, FUZZY, GRAM, SYNONYM, STEM, ALL_TERMS, ORDER = 40.0, 25.0, 30.0, 8.0, 5.0, 7.0, 7.2, 25.0, 18.0


def terms_of(query: str) -> list[str]:
    return [t for t in query.lower().split() if len(t) > 1 and t not in STOP_WORDS]


def edits_of(term: str) -> int:
    return 0 if len(term) <= 3 else 1 if len(term) <= 5 else 2


def _term_table(query: str) -> Column:
    """The query's terms as an array of structs; the table is as long as the query."""
    rows = []
    for t in terms_of(query):
        grams = list(dict.fromkeys(t[i : i + 3] for i in range(len(t) - 2))) or [t]
        rows.append(F.struct(
            F.lit(t).alias("term"), F.lit(edits_of(t)).alias("edits"), F.array(*map(F.lit, grams)).alias("grams"),
            F.array(*map(F.lit, SYNONYMS.get(t, ()))).cast("array<string>").alias("near"), F.lit(t[:-1] if len(t) >= 3 else None).cast("string").alias("stem")))
    return F.array(*rows)


def _count(text: Column, term: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)


def _first_edit(words: Column, term: Column, most: Column) -> Column:
    """Distance of the first word that is near but not equal; null without one."""
    return F.get(F.filter(F.transform(words, lambda w: F.levenshtein(w, term)), lambda d: (d >= 1) & (d <= most)), F.lit(0))


def _in_order(text: Column, terms: list[str]) -> Column:
    """Whether each term begins after the begin of the one before."""
    last, found = F.lit(0), F.lit(True)
    for t in terms:
        last = F.call_function("locate", F.lit(t), text, last + 1)
        found = found & (last > 0)
    return found


def _marked(q: Column, t: Column, d: Column) -> Column:
    """A term with its occurrences in title and description, and the distance of the first word near to it in each."""
    return F.struct(q.alias("q"), _count(t, q["term"]).alias("n_t"), _count(d, q["term"]).alias("n_d"), _first_edit(F.col("__tw"), q["term"], q["edits"]).alias("t_edit"), _first_edit(F.col("__dw"), q["term"], q["edits"]).alias("d_edit"))


def _valued(m: Column, t: Column, d: Column) -> Column:
    """What one marked term gives: points, and its kind of hit."""
    q, here, there = m["q"], m["n_t"] > 0, m["n_d"] > 0
    fuzzy = ~here & m["t_edit"].isNotNull()
    share = F.size(F.array_intersect(q["grams"], "__tg")) / F.size(q["grams"])
    gram = ~here & ~fuzzy & (F.length(q["term"]) >= 4) & (share >= 0.5)
    synonym = ~here & F.exists(q["near"], lambda s: t.contains(s))
    points = (
        F.when(here, (1 + F.log(m["n_t"])) * 7 + F.greatest(F.lit(0.0), 8 - (F.instr(t, q["term"]) - 1) / 12)).otherwise(0.0)
        + F.when(fuzzy, FUZZY * (1 - m["t_edit"] / (q["edits"] + 1))).otherwise(0.0)
        + F.when(gram, GRAM * share).otherwise(0.0) + F.when(synonym, SYNONYM).otherwise(0.0)
        + F.when(~here & F.coalesce(t.contains(q["stem"]), F.lit(False)), STEM).otherwise(0.0)
        + F.when(there, (1 + F.log(m["n_d"])) * 5).otherwise(F.when(m["d_edit"].isNotNull(), FUZZY * 0.6).otherwise(0.0) + F.when(F.exists(q["near"], lambda s: d.contains(s)), SYNONYM * 0.5).otherwise(0.0))
    )
    flags = {"hits": here, "d_hits": there, "fuzzies": fuzzy, "synonyms": synonym, "grams": gram}
    return F.struct(points.cast("double").alias("points"), *[v.cast("int").alias(k) for k, v in flags.items()])


def with_relevance(rows: DataFrame, query: str) -> DataFrame:
    """rows (title, description, and more) with relevance (0 to 1). The query's few terms are an array beside each row, marked,
    valued and summed there, so rows are neither multiplied nor shuffled. A query without terms gives 0.1 for all."""
    terms = terms_of(query)
    if not terms:
        return rows.withColumn("relevance", F.lit(0.1))
    n, whole = len(terms), query.lower()
    words = lambda c: F.filter(F.split(c, r"\W+"), lambda w: F.length(w) > 1)
    own = rows.withColumns({"__t": F.lower("title"), "__d": F.lower(F.coalesce("description", F.lit("")))})
    t, d, c = F.col("__t"), F.col("__d"), F.col
    own = own.withColumns({"__tw": words(t), "__dw": words(d), "__tg": ngrams(t, 3)})
    own = own.withColumn("__marks", F.transform(_term_table(query), lambda q: _marked(q, t, d)))
    own = own.withColumn("__values", F.transform("__marks", lambda m: _valued(m, t, d)))
    names = ("hits", "d_hits", "fuzzies", "synonyms", "grams")
    start = F.struct(F.lit(0.0).alias("points"), *[F.lit(0).alias(k) for k in names])
    own = own.withColumn("__sum", F.aggregate("__values", start, lambda a, v: F.struct(*[(a[k] + v[k]).alias(k) for k in ("points", *names)])))
    whole_points = F.when(t.contains(whole), EXACT).otherwise(0.0) + F.when(d.contains(whole), EXACT_DESCRIPTION).otherwise(0.0) + F.when(t.startswith(whole), START).otherwise(0.0)
    if n > 1:
        whole_points = whole_points + F.when(_in_order(t, terms), ORDER).otherwise(0.0)
    hits, d_hits, fuzzies, synonyms, grams = (c("__sum")[k] for k in names)
    matched = hits + fuzzies * 0.6 + synonyms * 0.4 + grams * 0.3
    every = F.when(hits == n, 1.0).when(matched >= n * 0.6, 0.6).when(hits + d_hits >= n, 0.5).when(matched >= n * 0.3, 0.25).otherwise(0.0)
    coverage = (hits + d_hits * 0.6 + fuzzies * 0.5 + synonyms * 0.4 + grams * 0.3) / n
    score = (c("__sum")["points"] + whole_points + every * ALL_TERMS) * (0.3 + coverage * 0.7)
    score = F.when(hits + d_hits > 0, F.greatest(score, F.lit(2.0))).otherwise(score) * F.when(F.length("title") > 150, 0.85).otherwise(1.0)
    scored = own.withColumn("relevance", F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)) / 100.0)
    return scored.drop("__t", "__d", "__tw", "__dw", "__tg", "__marks", "__values", "__sum")


def text_relevance(rows: DataFrame, query: str) -> DataFrame:
    """pos and relevance (0 to 1) of rows (pos, title, description)."""
    return with_relevance(rows, query).select("pos", "relevance")
