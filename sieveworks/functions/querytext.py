"""Query understanding as column functions: normalising, tokens, intent, natural language, expansion, fallbacks, variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveworks.functions.similarity import STOP_WORDS as FALLBACK_STOP_WORDS

# Replaced anywhere, in this order.
CONTRACTIONS = {
    "i'm": "i am", "i've": "i have", "i'll": "i will", "i'd": "i would", "you're": "you are", "you've": "you have",
    "you'll": "you will", "you'd": "you would", "he's": "he is", "she's": "she is", "it's": "it is", "we're": "we are",
    "we've": "we have", "we'll": "we will", "they're": "they are", "they've": "they have", "they'll": "they will",
    "they'd": "they would", "that's": "that is", "who's": "who is", "what's": "what is", "where's": "where is",
    "how's": "how is", "there's": "there is", "here's": "here is", "let's": "let us", "can't": "cannot", "won't": "will not",
    "don't": "do not", "doesn't": "does not", "didn't": "did not", "isn't": "is not", "aren't": "are not", "wasn't": "was not",
    "weren't": "were not", "hasn't": "has not", "haven't": "have not", "hadn't": "had not", "wouldn't": "would not",
    "couldn't": "could not", "shouldn't": "should not", "mustn't": "must not", "needn't": "need not", "ain't": "is not",
    "gonna": "going to", "wanna": "want to", "gotta": "got to", "kinda": "kind of", "sorta": "sort of",
    "coulda": "could have", "woulda": "would have", "shoulda": "should have",
}
# Whole words, in this order.
SLANG = {
    "lol": "funny", "lmao": "very funny", "rofl": "hilarious", "omg": "amazing", "af": "extremely", "ngl": "", "tbh": "", "imo": "",
    "imho": "", "fyi": "", "btw": "", "smh": "disappointed", "fr": "for real", "lowkey": "", "highkey": "very", "deadass": "seriously",
    "sus": "suspicious", "cap": "lie", "nocap": "truth", "no cap": "truth", "bruh": "", "fam": "", "yeet": "throw", "vibe": "feeling",
    "vibes": "feeling", "slay": "amazing", "fire": "great", "lit": "exciting", "goat": "greatest", "bussin": "great", "bet": "agree",
    "noob": "beginner", "rekt": "destroyed", "pwned": "owned", "gg": "good game",
}
# Words by kind.
STOP_WORDS = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "or", "but", "is", "are", "was", "were", "be", "been", "has", "have",
    "had", "do", "does", "did", "with", "this", "that", "it", "its", "by", "from", "up", "out", "as", "into", "than", "so", "too", "very",
    "just", "really", "about", "over", "then", "there", "here", "when", "where", "what", "which", "who", "how", "all", "each", "every",
    "both", "few", "more", "most", "some", "any", "no", "not", "only", "own", "same", "such", "can", "will", "would", "could", "should",
    "may", "might", "must", "shall", "need", "dare", "am", "like", "also", "even", "still", "already", "yet", "ever", "never", "always",
    "often", "sometimes", "my", "your", "his", "her", "our", "their",
)
PRONOUNS = (
    "i", "me", "my", "mine", "myself", "you", "your", "yours", "yourself", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "we", "us", "our", "ours", "ourselves", "they", "them", "their", "theirs", "themselves", "who", "whom", "whose",
    "which", "that", "someone", "something", "everyone", "everything", "anyone", "anything", "nobody", "nothing",
)
VERB_ENDS = ("ing", "ed", "es", "ize", "ise", "ate", "ify")
VERB_STARTS = (
    "jump", "scar", "freak", "run", "mov", "play", "watch", "search", "fight", "catch", "throw", "break", "crash", "laugh", "scream",
    "react", "attack", "chas", "escap", "climb", "flip", "spin", "bounc", "launch", "explod", "hack", "crack", "scan", "exploit", "bypass",
    "inject", "intercept", "decrypt", "encrypt", "spoof", "phish", "infiltrat", "penetrat", "enumerat", "brut",
)
ADJECTIVE_ENDS = ("ful", "less", "ous", "ive", "able", "ible", "al", "ish", "ical")
INTENTS = {
    "VIDEO": ("video", "watch", "clip", "footage", "stream", "movie", "film", "show", "episode", "series", "season", "youtube", "compilation",
              "montage", "reaction", "vlog", "podcast", "tutorial", "walkthrough", "review", "trailer", "teaser"),
    "DOWNLOAD": ("download", "torrent", "magnet", "file", "iso", "zip", "rar", "software", "app", "program", "install", "crack", "keygen",
                 "patch", "tool", "exploit"),
    "ARTICLE": ("article", "blog", "post", "news", "report", "guide", "tutorial", "how to", "explain", "review", "analysis", "writeup",
                "write-up", "advisory", "disclosure", "cve"),
    "IMAGE": ("image", "picture", "photo", "screenshot", "wallpaper", "meme", "gif", "infographic", "diagram", "chart"),
}
EXPANSIONS = {
    "movie": ("film", "cinema", "flick", "feature"), "film": ("movie", "cinema"), "series": ("show", "tv show", "season", "episodes"),
    "show": ("series", "tv series", "season"), "episode": ("ep", "episodes", "part"), "download": ("torrent", "magnet", "direct"),
    "watch": ("stream", "view", "play"), "stream": ("watch", "online", "live"), "music": ("song", "audio", "track", "album"),
    "song": ("music", "track", "audio"), "video": ("clip", "footage", "recording"), "anime": ("animation", "cartoon", "manga"),
    "documentary": ("doc", "documentary film"), "hd": ("720p", "1080p", "high definition"), "4k": ("2160p", "uhd", "ultra hd"),
    "new": ("latest", "recent", "2024", "2025"), "latest": ("new", "recent", "newest"), "free": ("gratis", "no cost"),
    "game": ("gaming", "gameplay"), "live": ("stream", "online", "broadcast"), "full": ("complete", "entire"),
    "english": ("eng", "en"), "subtitle": ("sub", "subtitled", "subs"), "dubbed": ("dub", "audio track"),
}


def normal_query(raw: Column) -> Column:
    """Trimmed and lower-cased, contractions and slang written out in order, runs of ! ? . shortened."""
    s = F.lower(F.trim(raw))
    for short, full in CONTRACTIONS.items():
        s = F.replace(s, F.lit(short), F.lit(full))
    for slang, plain in SLANG.items():
        s = F.regexp_replace(s, f"(?<![A-Za-z0-9_]){slang}(?![A-Za-z0-9_])", plain)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "!{2,}", "!"), r"\?{2,}", "?"), r"\.{3,}", "...")


def query_tokens(text: Column) -> Column:
    stripped = F.transform(F.split(text, r"[\s,;:!?]+"), lambda w: F.regexp_replace(w, r"""^[."'()\[\]]+|[."'()\[\]]+$""", ""))
    return F.filter(stripped, lambda w: w != "")


def intent(tokens: Column) -> Column:
    """The intent most of whose words stand in the joined tokens; the earlier one on ties; GENERAL without any."""
    text = F.array_join(tokens, " ")
    scored = [F.struct(sum((text.contains(w).cast("int") for w in ws[1:]), text.contains(ws[0]).cast("int")).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, ws) in enumerate(INTENTS.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["name"]).otherwise("GENERAL")


def is_verb_form(word: Column) -> Column:
    return word.rlike(f"({'|'.join(VERB_ENDS)})$|^({'|'.join(VERB_STARTS)})")


def is_adjective_form(word: Column) -> Column:
    return word.rlike(f"({'|'.join(ADJECTIVE_ENDS)})$")


def is_natural(tokens: Column, verbs: tuple[str, ...] = ()) -> Column:
    """Three tokens at least, and over a quarter stop words, or a pronoun and a verb, or six tokens. verbs: known besides the forms."""
    count = lambda test: F.size(F.filter(tokens, test))
    stops, pronouns = count(lambda w: w.isin(*STOP_WORDS)), count(lambda w: w.isin(*PRONOUNS))
    verb_count = count(lambda w: is_verb_form(w) | (w.isin(*verbs) if verbs else F.lit(False)))
    n = F.size(tokens)
    return (n > 2) & ((stops / F.greatest(n, F.lit(1)) > 0.25) | ((pronouns > 0) & (verb_count > 0)) | (n >= 6))


def expand_query(query: Column, most: int = 5) -> Column:
    """The query and, in the order of its words, itself with a word's related terms in its place."""
    low = F.lower(F.trim(query))
    table = F.create_map(*[x for w, ts in EXPANSIONS.items() for x in (F.lit(w), F.array(*map(F.lit, ts)))])
    words = F.filter(F.split(low, r"\s+"), lambda w: F.coalesce(table[w].isNotNull(), F.lit(False)))
    variants = F.flatten(F.transform(words, lambda w: F.transform(table[w], lambda t: F.replace(low, w, t))))
    return F.slice(F.array_distinct(F.concat(F.array(low), variants)), 1, most)


def fallback_queries(query: Column, most: int = 8) -> Column:
    """The query's words over 2 letters, no stop words: ever shorter beginnings, then single words, longest first."""
    stripped = F.transform(F.split(F.lower(query), r"\s+"), lambda w: F.regexp_replace(w, r"""^[,.!?"']+|[,.!?"']+$""", ""))
    words = F.array_distinct(F.filter(stripped, lambda w: (F.length(w) > 2) & ~w.isin(*FALLBACK_STOP_WORDS)))
    begins = F.filter(F.transform(F.reverse(F.sequence(F.lit(1), F.size(words))), lambda i: F.array_join(F.slice(words, 1, i), " ")), lambda s: s != F.lower(query))
    placed = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    singles = F.transform(F.sort_array(placed), lambda s: s["w"])
    return F.when(F.size(words) == 0, F.array(query)).otherwise(F.slice(F.array_distinct(F.concat(begins, singles)), 1, most))


def query_variants(query: Column, year: int, most: int = 6) -> Column:
    """Other separators; the year and the one before where no year is named; sNNeNN written out."""
    base = F.lower(F.trim(query))
    years = F.when(base.rlike(r"(?<![a-z0-9_])(19|20)\d{2}(?![a-z0-9_])"), F.array().cast("array<string>")).otherwise(F.array(F.concat(base, F.lit(f" {year}")), F.concat(base, F.lit(f" {year - 1}"))))
    season, part = (F.regexp_extract(base, r"s(\d{1,2})e(\d{1,2})", i) for i in (1, 2))
    long = F.replace(base, F.regexp_extract(base, r"s(\d{1,2})e(\d{1,2})", 0), F.concat(F.lit("season "), season.try_cast("int").cast("string"), F.lit(" episode "), part.try_cast("int").cast("string")))
    extra = F.when(season != "", F.array(long)).otherwise(F.array().cast("array<string>"))
    same = [F.replace(base, F.lit(" "), F.lit(s)) for s in (".", "-", "+")]
    return F.slice(F.array_distinct(F.concat(F.array(base, *same), years, extra)), 1, most)
