"""Query understanding: word classes, base forms, concepts, generated queries, as columns.

Word lists of up to some hundred entries stand here; the long ones (verbs, nouns, thesaurus and the like) are a Lexicon that
the caller gives, as they belong to an application."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveworks.functions.querytext import PRONOUNS, STOP_WORDS, is_adjective_form, is_verb_form
from sieveworks.functions.scores import any_of

# Fixed values.
DETERMINERS = (
    "the", "a", "an", "this", "that", "these", "those", "my", "your", "his", "her", "its", "our", "their", "some", "any", "no", "every",
    "each", "all", "both", "few", "several", "many", "much", "more", "most",
)
PREPOSITIONS = (
    "in", "on", "at", "to", "for", "with", "from", "by", "about", "into", "through", "during", "before", "after", "above", "below", "between",
    "under", "over", "up", "down", "out", "off", "away", "around", "along", "across", "behind", "beyond", "near", "toward", "upon",
)
CONJUNCTIONS = ("and", "but", "or", "nor", "for", "yet", "so", "because", "although", "while", "if", "when", "then", "than", "whether", "unless", "until", "since", "though")
INTERJECTIONS = ("oh", "wow", "ooh", "ahh", "oops", "yikes", "omg", "whoa", "damn", "dang", "geez", "haha", "lol", "lmao", "bruh", "bro", "yo", "hey", "ugh", "meh", "hmm")
ADVERBS = (
    "very", "really", "extremely", "incredibly", "absolutely", "totally", "completely", "quite", "rather", "somewhat", "barely", "hardly",
    "nearly", "almost", "just", "already", "still", "always", "never", "often", "sometimes", "usually", "quickly", "slowly", "fast", "hard",
    "well", "badly", "easily", "seriously", "literally", "basically", "actually", "probably", "definitely", "certainly", "suddenly", "finally",
    "immediately", "especially", "particularly", "exactly", "simply", "merely", "enough", "too", "so", "super", "insanely", "ridiculously",
    "hilariously", "freaking",
)
ADJECTIVES = (
    "big", "small", "little", "large", "huge", "tiny", "massive", "great", "good", "bad", "best", "worst", "better", "worse", "new", "old",
    "young", "ancient", "modern", "recent", "fast", "slow", "quick", "rapid", "instant", "sudden", "high", "low", "tall", "short", "long",
    "deep", "wide", "hot", "cold", "warm", "cool", "frozen", "burning", "hard", "soft", "rough", "smooth", "sharp", "flat", "dark", "light",
    "bright", "dim", "clear", "shiny", "loud", "quiet", "silent", "noisy", "calm", "peaceful", "happy", "sad", "angry", "scared", "afraid",
    "nervous", "brave", "strong", "weak", "powerful", "gentle", "tough", "funny", "hilarious", "silly", "crazy", "insane", "wild", "cute",
    "beautiful", "ugly", "pretty", "handsome", "smart", "dumb", "stupid", "clever", "wise", "brilliant", "strange", "weird", "odd", "normal",
    "typical", "unusual", "amazing", "awesome", "incredible", "unbelievable", "epic", "terrible", "horrible", "awful", "fantastic",
    "wonderful", "dangerous", "safe", "risky", "secure", "vulnerable", "hidden", "secret", "visible", "invisible", "exposed", "real", "fake",
    "genuine", "false", "true", "authentic",
)
IRREGULAR_NOUNS = {
    "mice": "mouse", "men": "man", "women": "woman", "children": "child", "teeth": "tooth", "feet": "foot", "geese": "goose", "oxen": "ox",
    "people": "person", "wolves": "wolf", "knives": "knife", "lives": "life", "leaves": "leaf", "halves": "half", "selves": "self",
    "calves": "calf", "loaves": "loaf", "thieves": "thief",
}
IRREGULAR_VERBS = {
    "went": "go", "gone": "go", "came": "come", "saw": "see", "seen": "see", "got": "get", "gotten": "get", "made": "make", "took": "take",
    "taken": "take", "gave": "give", "given": "give", "found": "find", "knew": "know", "known": "know", "thought": "think", "said": "say",
    "told": "tell", "showed": "show", "shown": "show", "tried": "try", "left": "leave", "kept": "keep", "ran": "run", "fell": "fall",
    "fallen": "fall", "flew": "fly", "swam": "swim", "fought": "fight", "threw": "throw", "thrown": "throw", "caught": "catch",
    "broke": "break", "broken": "break", "bit": "bite", "bitten": "bite", "held": "hold", "hung": "hang", "slid": "slide", "slept": "sleep",
    "woke": "wake", "ate": "eat", "drank": "drink", "drove": "drive", "rode": "ride", "wrote": "write", "sang": "sing", "spoke": "speak",
    "chose": "choose", "wore": "wear", "drew": "draw", "grew": "grow", "blew": "blow", "hid": "hide", "crept": "creep", "leapt": "leap",
    "dove": "dive", "swung": "swing", "spun": "spin", "flung": "fling", "clung": "cling", "crouched": "crouch",
}
# Fixed values. Endings in order: ending, least length, letters that go, letters that come.
NOUN_ENDINGS = (("ies", 5, 3, "y"), ("ves", 5, 3, "f"), ("ses", 5, 2, ""), ("xes", 5, 2, ""), ("ches", 6, 2, ""), ("shes", 6, 2, ""))
VERB_ENDINGS = (
    ("ying", 0, 4, "y"), ("pping", 0, 4, "p"), ("tting", 0, 4, "t"), ("nning", 0, 4, "n"), ("mming", 0, 4, "m"), ("gging", 0, 4, "g"),
    ("dding", 0, 4, "d"), ("bing", 0, 4, "b"), ("ting", 6, 3, "e"), ("ving", 6, 3, "e"), ("king", 6, 3, "e"), ("cing", 6, 3, "e"),
    ("ging", 6, 3, "e"), ("zing", 6, 3, "e"), ("ing", 5, 3, ""), ("ied", 0, 3, "y"), ("pped", 0, 3, ""), ("tted", 0, 3, ""), ("nned", 0, 3, ""),
    ("mmed", 0, 3, ""), ("gged", 0, 3, ""), ("dded", 0, 3, ""), ("bbed", 0, 3, ""), ("ated", 0, 1, ""), ("ized", 0, 1, ""), ("ised", 0, 1, ""),
    ("ted", 5, 2, "e"), ("ked", 5, 2, "e"), ("ced", 5, 2, "e"), ("ved", 5, 2, "e"), ("zed", 5, 2, "e"), ("ed", 4, 2, ""), ("es", 4, 2, ""),
)
# Fixed values.
INTENT_FORMS = {
    "VIDEO": ("{} compilation", "{} funny", "best {}", "{} moments", "{} reaction", "{} video"), "DOWNLOAD": ("{} download", "{} torrent", "{} free"),
    "ARTICLE": ("{} explained", "{} guide", "how to {}"), "IMAGE": ("{} pictures", "{} photos", "{} images"),
}
MOST_QUERIES = 20


@dataclass(frozen=True)
class Lexicon:
    """An application's word lists; thesaurus and the others map a word to related ones."""

    verbs: tuple[str, ...] = ()
    nouns: tuple[str, ...] = ()
    thesaurus: dict[str, tuple[str, ...]] = field(default_factory=dict)
    compounds: dict[str, tuple[str, ...]] = field(default_factory=dict)
    phrases: tuple[str, ...] = ()
    emotions: dict[str, tuple[str, ...]] = field(default_factory=dict)
    emotion_terms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    contexts: dict[str, tuple[str, ...]] = field(default_factory=dict)


NOTHING = Lexicon()


def _ending(word: Column, rules: tuple, irregular: dict[str, str]) -> Column:
    plain_s = word.endswith("s") & ~word.endswith("ss") & (F.length(word) > 3)
    out = F.when(plain_s, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    for end, least, gone, comes in reversed(rules):
        test = word.endswith(end) & (F.length(word) >= least) if least else word.endswith(end)
        out = F.when(test, F.concat(F.substring(word, F.lit(1), F.length(word) - gone), F.lit(comes))).otherwise(out)
    table = F.create_map(*[F.lit(x) for pair in irregular.items() for x in pair])
    return F.coalesce(table[word], out)


def noun_base(word: Column) -> Column:
    return _ending(word, NOUN_ENDINGS, IRREGULAR_NOUNS)


def verb_base(word: Column) -> Column:
    return _ending(word, VERB_ENDINGS, IRREGULAR_VERBS)


def is_noun_likely(word: Column) -> Column:
    return (F.length(word) >= 3) & ~word.isin(*STOP_WORDS)


def word_class(word: Column, lexicon: Lexicon = NOTHING) -> Column:
    """The first class that fits."""
    listed = lambda words: word.isin(*words) if words else F.lit(False)
    return (
        F.when(listed(PRONOUNS), "PRONOUN").when(listed(DETERMINERS), "DETERMINER").when(listed(PREPOSITIONS), "PREPOSITION").when(listed(CONJUNCTIONS), "CONJUNCTION")
        .when(listed(INTERJECTIONS), "INTERJECTION").when(listed(ADVERBS) | word.endswith("ly"), "ADVERB").when(listed(lexicon.verbs) | is_verb_form(word), "VERB")
        .when(listed(ADJECTIVES) | is_adjective_form(word), "ADJECTIVE").when(listed(lexicon.nouns) | is_noun_likely(word), "NOUN").otherwise("UNKNOWN")
    )


def tagged(tokens: Column, lexicon: Lexicon = NOTHING) -> Column:
    """struct(word, class) of each token."""
    return F.transform(tokens, lambda w: F.struct(w.alias("word"), word_class(w, lexicon).alias("class")))


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _texts(values=()) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _named(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The names of a table any of whose words stand in the text."""
    found = [F.when(any_of(text, words), name) for name, words in table.items()]
    return F.array_compact(F.array(*found)) if found else _texts()


def cause_effects(words: Column, text: Column) -> Column:
    """struct(cause, effect) of two verbs joined by and, then of what stands before and after so, then, and it."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0)))
    word = lambda i, k: F.get(words, i + k)
    both = F.filter(at, lambda i: (F.size(words) >= 3) & (word(i, 1)["word"] == "and") & (word(i, 0)["class"] == "VERB") & (word(i, 2)["class"] == "VERB"))
    pairs = F.transform(both, lambda i: F.struct(verb_base(word(i, 0)["word"]).alias("cause"), verb_base(word(i, 2)["word"]).alias("effect")))
    pattern = r"(\w+)\s+(?:so|then|and it)\s+(\w+)"
    told = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("cause"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("effect"))
    return F.concat(pairs, F.transform(told, lambda p: F.struct(p["cause"].alias("cause"), p["effect"].alias("effect"))))


def concepts(tokens: Column, text: Column, lexicon: Lexicon = NOTHING) -> Column:
    """struct(subjects, actions, descriptors, emotions, contexts, compounds, causes) of a query's tokens and normalised text."""
    return _let(tagged(tokens, lexicon), lambda words: _concepts(words, text, lexicon))


def _concepts(words: Column, text: Column, lexicon: Lexicon) -> Column:
    thing = lambda w: w["class"].isin("NOUN", "UNKNOWN")
    nouns = F.filter(words, lambda w: thing(w) & ~w["word"].isin(*STOP_WORDS) & (F.length(w["word"]) > 2))
    subjects = F.array_distinct(F.transform(nouns, lambda w: noun_base(w["word"])))
    verbs = F.filter(words, lambda w: w["class"] == "VERB")
    actions = F.array_distinct(F.flatten(F.transform(verbs, lambda w: F.array(verb_base(w["word"]), w["word"]))))
    descriptors = F.array_distinct(F.transform(F.filter(words, lambda w: w["class"].isin("ADJECTIVE", "ADVERB") & ~w["word"].isin(*STOP_WORDS)), lambda w: w["word"]))
    joint = F.create_map(*[x for k, v in lexicon.compounds.items() for x in (F.lit(k), _texts(v))]) if lexicon.compounds else None
    known = F.flatten(F.transform(nouns, lambda w: F.coalesce(joint[noun_base(w["word"])], joint[w["word"]], _texts()))) if joint is not None else _texts()
    phrases = F.array_compact(F.array(*[F.when(text.contains(p), p) for p in lexicon.phrases])) if lexicon.phrases else _texts()
    places = F.slice(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), 1, F.greatest(F.size(words) - 1, F.lit(0)))
    pair = lambda i: (F.get(words, i), F.get(words, i + 1))
    near = F.filter(places, lambda i: pair(i)[0]["class"].isin("VERB", "ADJECTIVE") & thing(pair(i)[1]))
    made = F.transform(near, lambda i: F.concat_ws(" ", F.when(pair(i)[0]["class"] == "VERB", verb_base(pair(i)[0]["word"])).otherwise(pair(i)[0]["word"]), noun_base(pair(i)[1]["word"])))
    return F.struct(
        subjects.alias("subjects"), actions.alias("actions"), descriptors.alias("descriptors"), _named(text, lexicon.emotions).alias("emotions"),
        _named(text, lexicon.contexts).alias("contexts"), F.array_distinct(F.concat(known, phrases, made)).alias("compounds"), cause_effects(words, text).alias("causes"),
    )


def related(word: Column, lexicon: Lexicon) -> Column:
    """Words of the thesaurus for a word and its base forms, by entry and by being named in one, less itself."""
    if not lexicon.thesaurus:
        return _texts()
    table = F.create_map(*[x for k, v in lexicon.thesaurus.items() for x in (F.lit(k), _texts(v))])
    back: dict[str, list[str]] = {}
    for key, values in lexicon.thesaurus.items():
        for v in values:
            back.setdefault(v, []).extend(x for x in (key, *values) if x not in back.get(v, []))
    reverse = F.create_map(*[x for k, v in back.items() for x in (F.lit(k), _texts(v))])
    look = lambda forms: F.flatten(F.concat(F.transform(forms, lambda f: F.coalesce(table[f], _texts())), F.transform(forms, lambda f: F.coalesce(reverse[f], _texts()))))
    return _let(F.array(word, noun_base(word), verb_base(word)), lambda forms: F.array_distinct(F.filter(look(forms), lambda t: (t != forms[0]) & (t != forms[1]))))


def _crossed(left: Column, right: Column, form) -> Column:
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: form(a, b))))


def _spaced(*parts) -> Column:
    return F.concat_ws(" ", *parts)


def generated_queries(c: Column, intent: Column, lexicon: Lexicon = NOTHING) -> Column:
    """Up to MOST_QUERIES search queries of concepts: core pairs, related words, compounds, emotions, causes, intent, broad ones."""
    return _let(c, lambda known: _generated(known, intent, lexicon))


def _generated(c: Column, intent: Column, lexicon: Lexicon) -> Column:
    subjects, actions, some = F.slice(c["subjects"], 1, 3), F.slice(c["actions"], 1, 3), F.slice(c["descriptors"], 1, 2)
    first, two, act2 = F.get(c["subjects"], F.lit(0)), F.slice(c["subjects"], 1, 2), F.slice(c["actions"], 1, 2)
    core = F.flatten(_crossed(subjects, actions, lambda s, a: F.concat(F.array(_spaced(s, a)), F.transform(some, lambda d: _spaced(s, a, d)))))
    turned = _crossed(actions, subjects, lambda a, s: _spaced(a, s))
    whole = F.when((F.size(subjects) > 1) & (F.size(actions) > 0), F.array(_spaced(F.array_join(subjects, " "), F.get(actions, F.lit(0))))).otherwise(_texts())
    near = lambda w: F.slice(related(w, lexicon), 1, 3)
    grown = lambda ws: F.transform(ws, lambda w: F.struct(w.alias("w"), near(w).alias("near")))
    synonyms = F.flatten(_let(grown(act2), lambda acts: _let(grown(two), lambda subs: _crossed(subs, acts, _near_pairs))))
    compounds = F.concat(c["compounds"], F.flatten(F.transform(two, lambda s: F.transform(F.filter(c["compounds"], lambda x: ~x.contains(s)), lambda x: _spaced(s, x)))))
    terms = F.create_map(*[x for k, v in lexicon.emotion_terms.items() for x in (F.lit(k), _texts(v[:3]))]) if lexicon.emotion_terms else None
    felt = lambda e: F.coalesce(terms[e], F.array(e)) if terms is not None else F.array(e)
    emotions = F.flatten(F.flatten(F.transform(c["emotions"], lambda e: F.transform(two, lambda s: F.flatten(F.transform(felt(e), lambda t: F.array(_spaced(s, t), _spaced(t, s))))))))
    causes = F.flatten(_crossed(c["causes"], two, lambda x, s: F.array(_spaced(s, x["cause"], x["effect"]), _spaced(s, F.lit("gets"), x["cause"], F.lit("and"), x["effect"]), _spaced(x["cause"], s, x["effect"]))))
    base = F.when(F.size(c["actions"]) > 0, _spaced(first, F.get(c["actions"], F.lit(0)))).otherwise(first)
    forms = _texts()
    for name, texts in INTENT_FORMS.items():
        forms = F.when(intent == name, F.array(*[F.replace(F.lit(t), F.lit("{}"), base) for t in texts])).otherwise(forms)
    asked = F.when(first.isNotNull(), forms).otherwise(_texts())
    broad = F.concat(c["subjects"], F.when(F.size(c["subjects"]) >= 2, F.array(F.array_join(two, " "))).otherwise(_texts()), F.when(first.isNotNull(), F.transform(act2, lambda a: _spaced(first, a))).otherwise(_texts()))
    every = F.transform(F.concat(core, turned, whole, synonyms, compounds, emotions, causes, asked, broad), lambda q: F.lower(F.trim(q)))
    return F.slice(F.array_distinct(F.filter(every, lambda q: F.length(q) >= 3)), 1, MOST_QUERIES)


def _near_pairs(s: Column, a: Column) -> Column:
    both = F.when((F.size(s["near"]) > 0) & (F.size(a["near"]) > 0), F.array(_spaced(F.get(s["near"], F.lit(0)), F.get(a["near"], F.lit(0))))).otherwise(_texts())
    return F.concat(F.transform(a["near"], lambda x: _spaced(s["w"], x)), F.transform(s["near"], lambda x: _spaced(x, a["w"])), both)


def concept_terms(c: Column, lexicon: Lexicon = NOTHING) -> Column:
    """All terms a result may match: words of the concepts with related ones, emotions with their terms, compounds."""
    words = F.concat(c["subjects"], c["actions"], c["descriptors"])
    grown = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), related(w, lexicon))))
    terms = F.create_map(*[x for k, v in lexicon.emotion_terms.items() for x in (F.lit(k), _texts(v))]) if lexicon.emotion_terms else None
    felt = F.flatten(F.transform(c["emotions"], lambda e: F.concat(F.array(e), F.coalesce(terms[e], _texts()) if terms is not None else _texts())))
    return F.array_distinct(F.concat(grown, felt, c["compounds"]))


def fingerprint(intent: Column, c: Column) -> Column:
    """Intent, three subjects and two actions in order."""
    return F.concat_ws("|", intent, F.array_join(F.slice(F.sort_array(c["subjects"]), 1, 3), ","), F.array_join(F.slice(F.sort_array(c["actions"]), 1, 2), ","))


# Words of queries made for an intent.
INTENT_WORDS = ("compilation", "moments", "reaction", "download", "torrent", "guide")


def query_strategy(query: Column, c: Column, lexicon: Lexicon = NOTHING) -> Column:
    """Which strategy likely made a query of these concepts, by what it holds: the first that fits."""
    return _let(F.struct(F.lower(query).alias("q"), c.alias("c")), lambda x: _strategy(x["q"], x["c"], lexicon))


def _strategy(q: Column, c: Column, lexicon: Lexicon) -> Column:
    held = lambda words: F.exists(words, lambda w: q.contains(w))
    terms = F.create_map(*[x for k, v in lexicon.emotion_terms.items() for x in (F.lit(k), _texts(v))]) if lexicon.emotion_terms else None
    felt = F.exists(c["emotions"], lambda e: held(F.coalesce(terms[e], _texts()))) if terms is not None else F.lit(False)
    caused = F.exists(c["causes"], lambda x: q.contains(x["cause"]) & q.contains(x["effect"]))
    return (
        F.when(held(c["compounds"]), "compound").when(felt, "emotion").when(caused, "cause_effect").when(held(c["subjects"]) & held(c["actions"]), "core_concept")
        .when(F.exists(c["subjects"], lambda s: held(related(s, lexicon))), "synonym").when(any_of(q, INTENT_WORDS), "intent").otherwise("broad")
    )
