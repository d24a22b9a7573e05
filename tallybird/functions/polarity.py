"""Rule-based polarity of a text (Hutto & Gilbert 2014) as one column expression.

A lexicon in the plan suits some thousands of tokens; ``polarity_by_table`` takes one of any size.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybird.functions.text import fresh_name

# The published constants of the rules.
BOOST, CAPITALS, NEGATION = 0.293, 0.733, -0.74
DAMPING = [1.0, 0.95, 0.9]  # by distance 1, 2, 3
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS = 0.18, 0.96
NORMALISER = 15
NEVER_SO = {2: 1.5, 3: 1.25}  # "never so", "never this", by distance of "never"

# The ASCII punctuation removed around words.
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""

# Words that strengthen, weaken or negate what follows.
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

WEAKEN_PAIRS = ["just enough", "kind of", "sort of"]
SO, AT_LEAST = ["so", "this"], ["at", "very"]

# Phrases whose value replaces that of a word in or next to them.
IDIOMS = {
    "bad ass": 1.5, "cut the mustard": 2.0, "hand to mouth": -2.0, "kiss of death": -1.5, "the bomb": 3.0,
    "the shit": 3.0, "yeah right": -2.0,
}

# A small lexicon, valence -4 to 4, as far as remembered the published one's. Pass another
# for real use. Signs are looked up as they stand in the text, words without the punctuation around them.
LEXICON = {
    "amazing": 2.8, "awesome": 3.1, "beautiful": 2.9, "best": 3.2, "better": 1.9, "comfortable": 1.5,
    "delighted": 2.3, "easy": 1.9, "enjoy": 2.2, "enjoyed": 2.3, "excellent": 2.7, "fantastic": 2.6,
    "fine": 0.8, "free": 2.3, "friendly": 2.2, "glad": 2.0, "good": 1.9, "great": 3.1, "happy": 2.7,
    "helpful": 1.8, "impressed": 2.1, "improved": 2.1, "love": 3.2, "loved": 2.9, "lovely": 2.8,
    "nice": 1.8, "okay": 0.9, "perfect": 2.7, "perfectly": 3.2, "pleasant": 2.3, "pleased": 1.9,
    "recommend": 1.5, "recommended": 0.8, "reliable": 1.6, "safe": 1.9, "satisfied": 1.8,
    "special": 1.7, "superb": 3.1, "support": 1.7, "sweet": 2.0, "thank": 1.5, "thanks": 1.9,
    "truly": 1.3, "useful": 1.9, "value": 1.4, "welcome": 2.0, "well": 1.1, "win": 2.8,
    "wonderful": 2.7, "worth": 0.9,
    "angry": -2.3, "annoying": -1.7, "awful": -2.0, "bad": -2.5, "broken": -1.8, "cheap": -0.6,
    "cheated": -2.3, "complaint": -1.2, "confusing": -0.9, "damaged": -1.9, "defective": -1.9,
    "delayed": -0.9, "difficult": -1.5, "dirty": -1.9, "disappointed": -2.1,
    "disappointing": -2.2, "dull": -1.7, "error": -1.7, "fail": -2.5, "failed": -2.3, "fake": -2.1,
    "fault": -1.7, "faulty": -1.3, "fraud": -2.8, "frustrating": -1.9, "hate": -2.7,
    "horrible": -2.5, "late": -0.5, "lost": -1.3, "mess": -1.5, "missing": -1.2, "no": -1.2,
    "pain": -2.3, "poor": -2.1, "problem": -1.7, "refused": -1.2, "regret": -1.8, "rude": -2.0,
    "sad": -2.1, "scam": -2.7, "slow": -0.8, "sorry": -0.3, "stolen": -2.2, "terrible": -2.1,
    ":)": 2.0, ":-)": 1.3, ":d": 2.3, ";)": 0.9, "<3": 1.9, ":(": -1.9, ":-(": -1.5, ":/": -1.4, ":'(": -2.2,
    "ugly": -2.3, "unhappy": -1.8, "unhelpful": -1.5, "upset": -1.6, "useless": -1.8,
    "waste": -1.8, "weak": -1.9, "worse": -2.1, "worst": -3.1, "wrong": -2.1,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _among(word: str, tokens: Iterable[str]) -> str:
    """A constant IN list, which Spark tests by hash."""
    listed = ", ".join(_quoted(t) for t in tokens)
    return f"{word} IN ({listed})" if listed else "false"


class _Constants:
    """Lookups in a lexicon that is part of the plan: one hashed set test per distinct valence."""

    def __init__(self, lexicon: Mapping[str, float]):
        self.lexicon = lexicon

    def known(self, word: str) -> str:
        return _among(word, self.lexicon)

    def valence(self, word: str) -> str:
        words: dict[float, list[str]] = {}
        for token, value in self.lexicon.items():
            words.setdefault(value, []).append(token)
        cases = " ".join(f"WHEN {_among(word, tokens)} THEN {v}D" for v, tokens in words.items())
        return f"CASE {cases} ELSE 0D END" if cases else "0D"


class _Column:
    """Lookups in a map column with the text's own part of a lexicon."""

    def __init__(self, column: str):
        self.column = f"`{column}`"

    def known(self, word: str) -> str:
        return f"coalesce(map_contains_key({self.column}, {word}), false)"

    def valence(self, word: str) -> str:
        return f"coalesce(element_at({self.column}, {word}), 0D)"


def _is_capital(word: str) -> str:
    return f"({word} = upper({word}) AND {word} <> lower({word}))"


def _let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once per row under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _count(text: str, mark: str) -> str:
    return f"(length({text}) - length(replace({text}, '{mark}', '')))"


def _emphasis(text: str) -> str:
    questions = _count(text, "?")
    return (
        f"(least({_count(text, '!')}, {MOST_EXCLAMATIONS}) * {EXCLAMATION}D"
        f" + CASE WHEN {questions} > 3 THEN {MANY_QUESTIONS}D"
        f" WHEN {questions} > 1 THEN {questions} * {QUESTION}D ELSE 0D END)"
    )


def _phrase(*places: int) -> str:
    """The words at these places from the hit as a phrase; NULL past either end."""
    return "concat(" + ", ' ', ".join(f"get(low, h.at + ({p}))" for p in places) + ")"


def _moved_by_neighbour(lexicon: _Constants | _Column) -> str:
    """A word's value after a look at the word ``d`` places before it: boosted, then negated; at the
    third place phrases around the word come in. A place before the text has no word."""
    before, shown = "get(low, h.at - d)", "get(words, h.at - d)"
    sign = "CASE WHEN v < 0 THEN -1D ELSE 1D END"
    loud = f"CASE WHEN c.mixed AND {_is_capital(shown)} THEN {CAPITALS}D ELSE 0D END"
    loud = f"{loud} * CASE WHEN v > 0 THEN 1D ELSE -1D END"
    damping = f"element_at(array({', '.join(f'{d}D' for d in DAMPING)}), d)"
    boosted = (
        f"CASE WHEN {_among(before, STRENGTHEN)} THEN v + ({BOOST}D * {sign} + {loud}) * {damping}"
        f" WHEN {_among(before, WEAKEN)} THEN v + (-{BOOST}D * {sign} + {loud}) * {damping}"
        " ELSE v END"
    )
    negated = f"({_among(before, NEGATE)} OR endswith({before}, 'n\\'t'))"
    second, next_to = _among("get(low, h.at - 2)", SO), _among("get(low, h.at - 1)", SO)
    turned = (
        f"CASE WHEN d = 2 AND {before} = 'never' AND {next_to} THEN {NEVER_SO[2]}D"
        f" WHEN d = 3 AND (({before} = 'never' AND {second}) OR {next_to}) THEN {NEVER_SO[3]}D"
        f" WHEN {negated} THEN {NEGATION}D ELSE 1D END"
    )
    idioms = "map(" + ", ".join(f"{_quoted(k)}, {v}D" for k, v in IDIOMS.items()) + ")"
    # three words first; what begins with the word counts before what ends with it
    around = [(0, 1, 2), (0, 1), (-1, 0), (-2, -1, 0), (-2, -1), (-3, -2, -1), (-3, -2)]
    found = ", ".join(f"element_at({idioms}, coalesce({_phrase(*places)}, ''))" for places in around)
    weakened = " OR ".join(_among(_phrase(*places), WEAKEN_PAIRS) for places in ((-3, -2), (-2, -1)))
    phrased = f"coalesce({found}, m) - CASE WHEN {weakened} THEN {BOOST}D ELSE 0D END"
    moved = _let("m", f"({boosted}) * ({turned})", f"CASE WHEN d = 3 THEN {phrased} ELSE m END")
    return f"CASE WHEN h.at < d OR {lexicon.known(before)} THEN v ELSE {moved} END"


def _tokens(text: str, lexicon: _Constants | _Column) -> str:
    """Words without punctuation around them, signs of the lexicon as they stand; single characters go."""
    bare = f"btrim(w, {_quoted(PUNCTUATION)})"
    shown = f"CASE WHEN {lexicon.known('lower(w)')} THEN w ELSE {bare} END"
    return f"filter(transform(split({text}, '\\\\s+'), w -> {shown}), w -> length(w) > 1)"


def _score(text: str, lexicon: _Constants | _Column) -> Column:
    column = f"`{text}`"
    skipped = [*STRENGTHEN, *WEAKEN]
    hits = (
        "filter(transform(low, (w, i) -> named_struct('at', i, 'word', w)),"
        f" h -> {lexicon.known('h.word')} AND NOT {_among('h.word', skipped)}"
        " AND NOT (h.word = 'kind' AND coalesce(get(low, h.at + 1), '') = 'of'))"
    )
    context = (
        f"named_struct('mixed', exists(words, w -> NOT {_is_capital('w')})"
        f" AND exists(words, w -> {_is_capital('w')}), 'but', array_position(low, 'but'))"
    )
    base = (
        f"{lexicon.valence('h.word')} + CASE WHEN c.mixed AND {_is_capital('get(words, h.at)')}"
        f" THEN {CAPITALS}D * sign({lexicon.valence('h.word')}) ELSE 0D END"
    )
    side = (
        f"CASE WHEN c.but > 0 AND h.at + 1 < c.but THEN {BEFORE_BUT}D"
        f" WHEN c.but > 0 AND h.at + 1 > c.but THEN {AFTER_BUT}D ELSE 1D END"
    )
    earlier = "coalesce(get(low, h.at - 2), '')"
    least = (
        f"CASE WHEN get(low, h.at - 1) = 'least' AND NOT {lexicon.known(_quoted('least'))}"
        f" AND NOT {_among(earlier, AT_LEAST)} THEN {NEGATION}D ELSE 1D END"
    )
    value = f"aggregate(array(1, 2, 3), {base}, (v, d) -> {_moved_by_neighbour(lexicon)})"
    total = f"aggregate({hits}, 0D, (total, h) -> total + {value} * {least} * {side})"
    total = _let(
        "words", _tokens(column, lexicon), _let("low", "transform(words, w -> lower(w))", _let("c", context, total))
    )
    # the column is named once more here, inside a lambda: its variable must not hide it
    inner = f"{text}_sum"
    pushed = f"`{inner}` + sign(`{inner}`) * {_emphasis(column)}"
    compound = _let("s", pushed, f"round(s / sqrt(s * s + {NORMALISER}), 4)")
    scored_text = _let(f"`{inner}`", total, compound)
    return F.expr(f"CASE WHEN {column} IS NOT NULL THEN {scored_text} END")


def polarity(text: str, lexicon: Mapping[str, float] = LEXICON) -> Column:
    """Compound polarity in [-1, 1] of the column named ``text``, four digits.

    Linear in the length of the text: words are told from the rest by a hashed test, and only
    lexicon words are weighed, each looking at the three words before it and phrases around it.
    """
    return _score(text, _Constants(lexicon))


SALTS = 16


def polarity_by_table(
    docs: DataFrame, lexicon: DataFrame, name: str = "sentiment_score", text: str = "text"
) -> DataFrame:
    """``docs`` with the polarity of ``text`` in column ``name``, by a (token, valence) table of any size.

    The distinct tokens of each row meet the lexicon in a join; a frequent word's rows are dealt to ``SALTS``
    places, and equal texts come together only after it, as one set of what the lexicon has of them. That comes
    back as a map no larger than the text. A null token or valence is no entry; of
    repeated tokens the least valence counts; tokens are compared in lower case.
    """
    key, found = (fresh_name(docs, k) for k in ("text_digest", "text_lexicon"))
    keyed = docs.withColumn(key, F.unhex(F.sha2(F.col(text), 256)))
    pieces = f"split(`{text}`, '\\\\s+')"
    bare = f"transform({pieces}, w -> btrim(w, {_quoted(PUNCTUATION)}))"
    tokens = (
        keyed.where(F.col(text).isNotNull())
        .select(key, F.expr(f"explode(array_distinct(transform(concat({pieces}, {bare}, array('least')), w -> lower(w)))) AS token"))
        .where("length(token) > 1")
        # copies of a text lie in many partitions, and so do their salts
        .withColumn("salt", F.pmod(F.xxhash64(F.col(key), F.spark_partition_id()), F.lit(SALTS)))
    )
    entries = (
        lexicon.where("token IS NOT NULL AND valence IS NOT NULL")
        .groupBy(F.lower("token").alias("token"))
        .agg(F.min(F.col("valence").cast("double")).alias("valence"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    )
    per_text = (
        tokens.join(entries, ["token", "salt"])
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_set(F.struct("token", "valence"))).alias(found))
    )
    scored = keyed.join(per_text, key, "left").withColumn(name, _score(text, _Column(found)))
    return scored.select(*[c for c in docs.columns if c != name], name)
