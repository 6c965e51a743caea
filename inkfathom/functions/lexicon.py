"""Word lists, replacement tables, thresholds and messages of the style engine, in their order of use."""

from __future__ import annotations

# --- Fixed values: counted terms ---
CONTRACTIONS = [
    "I'm", "I've", "I'd", "I'll", "you're", "you've", "you'd", "you'll", "we're", "we've", "we'd", "we'll", "they're", "they've", "they'd",
    "they'll", "it's", "that's", "there's", "here's", "who's", "what's", "where's", "when's", "why's", "how's", "isn't", "aren't", "wasn't",
    "weren't", "hasn't", "haven't", "hadn't", "doesn't", "don't", "didn't", "won't", "wouldn't", "shouldn't", "couldn't", "can't",
    "mustn't", "needn't", "ain't", "y'all", "gonna", "wanna", "gotta",
]
FIRST_PERSON = [
    "I", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves",
]
BE_FORMS = [
    "am", "is", "are", "was", "were", "be", "been", "being",
]
FORMAL = [
    "therefore", "thus", "hence", "moreover", "furthermore", "consequently", "nevertheless", "wherein", "whereby", "heretofore",
    "aforementioned", "pursuant", "regarding", "with respect to", "in accordance with",
]
INFORMAL = [
    "yeah", "yep", "nope", "kinda", "sorta", "gonna", "wanna", "gotta", "lol", "haha", "btw", "tbh", "imo", "like,", "you know", "honestly",
    "basically", "literally", "super", "pretty much", "a bunch", "stuff", "things",
]
TRANSITIONS = [
    "however", "therefore", "meanwhile", "in contrast", "for example", "in other words", "as a result", "on the other hand", "that said",
    "in fact", "of course", "at the same time", "for instance", "in addition", "beyond that", "still", "even so", "after all",
]

# --- Fixed values: replacements (first, by second), applied in this order; case does not matter unless a term starts with the pronoun I ---
FORMAL_TO_CASUAL = [
    ("utilize", "use"),
    ("approximately", "about"),
    ("subsequently", "then"),
    ("therefore", "so"),
    ("however", "but"),
    ("in order to", "to"),
    ("due to the fact that", "because"),
    ("at this point in time", "now"),
    ("prior to", "before"),
    ("commence", "start"),
    ("terminate", "end"),
    ("assist", "help"),
    ("obtain", "get"),
    ("demonstrate", "show"),
    ("individuals", "people"),
    ("additional", "more"),
    ("sufficient", "enough"),
    ("numerous", "many"),
    ("facilitate", "help"),
    ("regarding", "about"),
    ("in the event that", "if"),
    ("it is important to note that", ""),
    ("it should be noted that", ""),
    ("in conclusion", "overall"),
    ("leverage", "use"),
    ("synergy", "teamwork"),
    ("paradigm", "model"),
    ("robust", "strong"),
    ("seamless", "smooth"),
    ("cutting-edge", "modern"),
    ("state-of-the-art", "advanced"),
]
GENERAL_RULES = 12  # how many of FORMAL_TO_CASUAL apply without a profile
CASUAL_TO_FORMAL = [
    ("a lot of", "many"),
    ("kinda", "somewhat"),
    ("sorta", "somewhat"),
    ("gonna", "going to"),
    ("wanna", "want to"),
    ("gotta", "need to"),
    ("yeah", "yes"),
    ("nope", "no"),
    ("stuff", "material"),
    ("things", "items"),
    ("pretty much", "largely"),
    ("basically", "essentially"),
    ("literally", ""),
    ("super", "very"),
    ("get", "obtain"),
    ("help", "assist"),
    ("show", "demonstrate"),
    ("start", "begin"),
    ("end", "conclude"),
    ("but", "however"),
    ("so", "therefore"),
    ("because", "since"),
    ("about", "regarding"),
]
EXPANSIONS = [
    ("I'm", "I am"),
    ("I've", "I have"),
    ("I'd", "I would"),
    ("I'll", "I will"),
    ("you're", "you are"),
    ("you've", "you have"),
    ("you'd", "you would"),
    ("you'll", "you will"),
    ("we're", "we are"),
    ("we've", "we have"),
    ("we'd", "we would"),
    ("we'll", "we will"),
    ("they're", "they are"),
    ("they've", "they have"),
    ("they'd", "they would"),
    ("they'll", "they will"),
    ("it's", "it is"),
    ("that's", "that is"),
    ("there's", "there is"),
    ("isn't", "is not"),
    ("aren't", "are not"),
    ("wasn't", "was not"),
    ("weren't", "were not"),
    ("hasn't", "has not"),
    ("haven't", "have not"),
    ("hadn't", "had not"),
    ("doesn't", "does not"),
    ("don't", "do not"),
    ("didn't", "did not"),
    ("won't", "will not"),
    ("wouldn't", "would not"),
    ("shouldn't", "should not"),
    ("couldn't", "could not"),
    ("can't", "cannot"),
]
CONTRACTED = [
    ("I am", "I'm"),
    ("I have", "I've"),
    ("I would", "I'd"),
    ("I will", "I'll"),
    ("you are", "you're"),
    ("you have", "you've"),
    ("you will", "you'll"),
    ("we are", "we're"),
    ("we have", "we've"),
    ("we will", "we'll"),
    ("they are", "they're"),
    ("they have", "they've"),
    ("they will", "they'll"),
    ("it is", "it's"),
    ("that is", "that's"),
    ("there is", "there's"),
    ("is not", "isn't"),
    ("are not", "aren't"),
    ("was not", "wasn't"),
    ("were not", "weren't"),
    ("has not", "hasn't"),
    ("have not", "haven't"),
    ("had not", "hadn't"),
    ("does not", "doesn't"),
    ("do not", "don't"),
    ("did not", "didn't"),
    ("will not", "won't"),
    ("would not", "wouldn't"),
    ("should not", "shouldn't"),
    ("could not", "couldn't"),
    ("cannot", "can't"),
]
#: Patterns that may end anywhere, with the white space after them.
FILLER_PREFIXES = ["In today's (?:fast-paced|digital) world,?", "It is worth noting that", "In summary,?", "Overall, it can be said that"]
FILLER = [
    ("delve into", "look at"),
    ("navigate the (?:complex )?landscape", "handle"),
    ("play a crucial role", "matter"),
    ("a testament to", "proof of"),
    ("underscores the importance", "shows the value"),
    ("in the realm of", "in"),
    ("when it comes to", "for"),
]

# --- Fixed values: thresholds ---
FREQUENT, RARE = 0.015, 0.008
REWRITE_CASUAL, REWRITE_FORMAL = 0.45, 0.62
TONE_FORMAL, TONE_CASUAL = 0.65, 0.35
SCREEN_FORMAL, SCREEN_CASUAL = 0.6, 0.4
VARIED, REPEATED = 0.55, 0.35
MIN_CHARS, MAX_CHARS, MAX_BYTES, MAX_SAMPLES, MAX_TITLE = 40, 50_000, 100_000, 40, 200

# --- Fixed values: messages ---
TONE = {
    "short": "prefers short, punchy sentences",
    "long": "comfortable with longer, flowing sentences",
    "moderate": "uses moderate sentence length",
    "frequent": "natural use of contractions",
    "rare": "often writes without contractions",
    "some": "uses contractions selectively",
    "formal": "leans formal and precise",
    "casual": "leans casual and conversational",
    "balanced": "balanced tone between casual and formal",
    "first": "frequently writes in first person",
    "question": "asks rhetorical or direct questions",
    "dash": "uses em dashes for asides",
    "semicolon": "occasionally joins related clauses with semicolons",
    "varied": "varied vocabulary",
    "repeated": "repeats familiar wording for clarity",
}
NOTE = {
    "empty": "Add some text to rewrite.",
    "filler": "Removed common AI filler phrasing",
    "general": "No writing samples yet — used general naturalization. Upload samples for a closer match to your voice.",
    "casual": "Shifted wording toward your more casual register",
    "formal": "Shifted wording toward your more formal register",
    "balanced": "Kept a balanced register matching your samples",
    "contract": "Applied contractions the way your samples do",
    "expand": "Expanded contractions to match your samples",
}
EMPTY_SUMMARY = "No samples uploaded yet."
EMPTY_TONE = "Upload writing samples so the engine can learn your voice"
