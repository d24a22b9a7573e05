"""Constants of the rules as the SQL counterparts hold them, apart from those of the operators, so that a
wrong constant on either side shows."""

# Fixed values.
STRENGTHEN = [
    "absolutely", "amazingly", "completely", "considerably", "decidedly", "deeply", "enormously",
    "entirely", "especially", "exceptionally", "extremely", "fully", "greatly", "highly", "hugely",
    "incredibly", "intensely", "more", "most", "particularly", "purely", "quite", "really",
    "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously", "unusually",
    "utterly", "very",
]
WEAKEN = [
    "almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly",
    "scarcely", "slightly", "somewhat", "sorta",
]
NEGATE = [
    "ain't", "aint", "cannot", "can't", "cant", "couldn't", "didn't", "didnt", "doesn't", "doesnt",
    "don't", "dont", "hadn't", "hasn't", "haven't", "isn't", "isnt", "mustn't", "neither", "never",
    "none", "nope", "nor", "not", "nothing", "nowhere", "rarely", "seldom", "shouldn't", "wasn't",
    "wasnt", "weren't", "without", "won't", "wont", "wouldn't", "wouldnt",
]
WEAKEN_PAIRS = [
    "just enough", "kind of", "sort of",
]
IDIOMS = {
    "bad ass": 1.5, "cut the mustard": 2.0, "hand to mouth": -2.0, "kiss of death": -1.5,
    "the bomb": 3.0, "the shit": 3.0, "yeah right": -2.0,
}
LEXICON = {
    "amazing": 2.8, "awesome": 3.1, "beautiful": 2.9, "best": 3.2, "better": 1.9,
    "comfortable": 1.5, "delighted": 2.3, "easy": 1.9, "enjoy": 2.2, "enjoyed": 2.3,
    "excellent": 2.7, "fantastic": 2.6, "fine": 0.8, "free": 2.3, "friendly": 2.2, "glad": 2.0,
    "good": 1.9, "great": 3.1, "happy": 2.7, "helpful": 1.8, "impressed": 2.1, "improved": 2.1,
    "love": 3.2, "loved": 2.9, "lovely": 2.8, "nice": 1.8, "okay": 0.9, "perfect": 2.7,
    "perfectly": 3.2, "pleasant": 2.3, "pleased": 1.9, "recommend": 1.5, "recommended": 0.8,
    "reliable": 1.6, "safe": 1.9, "satisfied": 1.8, "special": 1.7, "superb": 3.1, "support": 1.7,
    "sweet": 2.0, "thank": 1.5, "thanks": 1.9, "truly": 1.3, "useful": 1.9, "value": 1.4,
    "welcome": 2.0, "well": 1.1, "win": 2.8, "wonderful": 2.7, "worth": 0.9, "angry": -2.3,
    "annoying": -1.7, "awful": -2.0, "bad": -2.5, "broken": -1.8, "cheap": -0.6, "cheated": -2.3,
    "complaint": -1.2, "confusing": -0.9, "damaged": -1.9, "defective": -1.9, "delayed": -0.9,
    "difficult": -1.5, "dirty": -1.9, "disappointed": -2.1, "disappointing": -2.2, "dull": -1.7,
    "error": -1.7, "fail": -2.5, "failed": -2.3, "fake": -2.1, "fault": -1.7, "faulty": -1.3,
    "fraud": -2.8, "frustrating": -1.9, "hate": -2.7, "horrible": -2.5, "late": -0.5, "lost": -1.3,
    "mess": -1.5, "missing": -1.2, "no": -1.2, "pain": -2.3, "poor": -2.1, "problem": -1.7,
    "refused": -1.2, "regret": -1.8, "rude": -2.0, "sad": -2.1, "scam": -2.7, "slow": -0.8,
    "sorry": -0.3, "stolen": -2.2, "terrible": -2.1, ":)": 2.0, ":-)": 1.3, ":d": 2.3, ";)": 0.9,
    "<3": 1.9, ":(": -1.9, ":-(": -1.5, ":/": -1.4, ":'(": -2.2, "ugly": -2.3, "unhappy": -1.8,
    "unhelpful": -1.5, "upset": -1.6, "useless": -1.8, "waste": -1.8, "weak": -1.9, "worse": -2.1,
    "worst": -3.1, "wrong": -2.1,
}
TOPICS = {
    "Delivery": ["delivery", "delivered", "shipping", "arrived", "late"],
    "Product Quality": ["quality", "damaged", "defective", "broken", "works"],
    "Pricing": ["price", "expensive", "value", "money"],
    "Customer Service": ["service", "support", "helpful", "unhelpful", "response"],
    "Payment": ["payment", "refund", "charged", "billing"],
}
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
