"""Text expressions: columns in, columns out, all of them inside the JVM.

Patterns use ``(?U)`` where letters and white space of all scripts count.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What negates a word, what ends its reach, and what cancels it.
NEGATORS = ("not", "no", "never", "without", "zero", "hardly", "barely", "nothing", "neither", "nor", "cannot", "less", "lack", "lacks", "lacking", "fewer")
REACH_ENDS = ("and", "but", "because", "while", "although", "though", "however", "yet", "or")
CANCELS = ("doubt", "only")
REACH = 3
PUNCTUATION = (",", ";", ".", ":", "!", "?", "(", ")")
SUFFIXES = ("ity", "ness", "ly")
HEDGES = ("bit", "slightly", "little", "somewhat", "tad")
SHORTFALLS = ("too", "enough", "less", "more", "not", "but", "although", "though", "than", "expected", "hard", "difficult", "poor")
DEGREE_WORDS = (
    "too", "very", "so", "really", "quite", "bit", "slightly", "rather", "extremely", "overly", "pretty", "little", "not",
    "is", "was", "are", "were", "be", "feels", "feel", "felt", "seems", "looks", "looked", "smells", "tastes", "tasted",
)
# Contractions typed without their apostrophe.
CONTRACTIONS = {
    "dont": "don't", "doesnt": "doesn't", "didnt": "didn't", "isnt": "isn't", "wasnt": "wasn't", "arent": "aren't", "werent": "weren't", "havent": "haven't",
    "hasnt": "hasn't", "hadnt": "hadn't", "wouldnt": "wouldn't", "couldnt": "couldn't", "shouldnt": "shouldn't", "cant": "can't", "thats": "that's", "whats": "what's",
}

TOKEN = r"[a-z']+|[,;.:!?()]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row; without it a lambda computes it for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def lower(c: Column | str) -> Column:
    """Letter by letter, as in SQL; by itself Spark makes two letters of "İ" and looks at the neighbours of "Σ"."""
    return F.lower(F.replace(F.replace(col(c), F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def short_sha(c: Column | str, length: int = 16) -> Column:
    """The first hex digits of SHA-1."""
    return F.substring(F.sha1(col(c).cast("binary")), 1, length)


def clean(c: Column | str) -> Column:
    """Null becomes empty, a lost apostrophe returns, white space collapses, ends are trimmed."""
    t = F.replace(F.coalesce(col(c), F.lit("")), F.lit("�"), F.lit("'"))
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), "^ | $", "")


def is_answer(cleaned: Column | str, min_chars: int = 2, non_answer: str | None = None) -> Column:
    """Long enough and not, as a whole, one of the non-answers."""
    ok = F.length(col(cleaned)) >= min_chars
    return ok & ~F.rlike(F.lower(col(cleaned)), F.lit(rf"^(?:{non_answer})\z")) if non_answer else ok


def text_key(cleaned: Column | str, valid: Column | str) -> Column:
    """What equal answers share; empty for a non-answer."""
    return F.when(col(valid), short_sha(F.lower(col(cleaned)))).otherwise(F.lit(""))


def word_count(c: Column | str) -> Column:
    """Runs of what is no white space."""
    return F.regexp_count(col(c), F.lit(r"(?U)\S+"))


def tokens(c: Column | str, pattern: str = TOKEN) -> Column:
    t = F.replace(F.replace(lower(c), F.lit("’"), F.lit("'")), F.lit("�"), F.lit("'"))
    return F.regexp_extract_all(t, F.lit(pattern), 0)


def interleaved(texts: Column) -> Column:
    """One text of the first tokens of all texts, then their second ones, and so on; a single text stays as it is."""

    def merged(toks: Column) -> Column:
        longest = F.array_max(F.transform(toks, lambda t: F.size(t)))
        turns = F.transform(F.sequence(F.lit(0), longest), lambda i: F.filter(F.transform(toks, lambda t: F.get(t, i)), lambda w: w.isNotNull()))
        return F.array_join(F.flatten(turns), " ")

    return F.when(F.size(texts) > 1, let(F.transform(texts, lambda t: tokens(t)), merged)).otherwise(F.get(texts, 0))


# -- patterns -------------------------------------------------------------


def keyword_pattern(keywords: Iterable[str], plural: bool = False) -> str:
    """Whole words, any case; ``re:`` marks a pattern to be used as it is."""
    parts = [k[3:] if k.startswith("re:") else rf"\b{re.escape(k)}{'(?:e?s)?' if plural else ''}\b" for k in keywords]
    return "(?i)" + "|".join(parts)


def stem_pattern(term: str) -> str:
    """A word with up to three more letters; the plural mark of longer words does not count."""
    stem = term[:-1] if len(term) > 4 and term.endswith("s") else term
    return rf"(?i)(?<!\w){re.escape(stem)}\w{{0,3}}(?!\w)"


def beside_pattern(keyword: str, others: Sequence[str]) -> str:
    """The keyword as a part of a compound with another theme's word."""
    any_of = "|".join(map(re.escape, sorted(others, key=lambda w: (-len(w), w))))
    k = re.escape(keyword)
    return rf"(?i)\b(?:{any_of})[ -]{k}\b|\b{k}[ -](?:{any_of})\b"


def any_pattern(patterns: Iterable[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


# -- clauses --------------------------------------------------------------


def contrast_pattern(words: Sequence[str]) -> str:
    return rf"(?i)[,;]?\s*\b(?:{'|'.join(map(re.escape, words))})\b\s*"


def sentences(c: Column | str) -> Column:
    """Pieces that end with a full stop, an exclamation mark or a question mark before white space."""
    return F.split(F.regexp_replace(col(c), r"([.!?]+)\s+", "$1\u0001"), "\u0001")


def trim_clause(c: Column) -> Column:
    return F.btrim(c, F.lit(" ,;.!?-"))


def cut_at_and(c: Column, least: int) -> Column:
    """The two or more parts around "and" where all of them have so many words, else the piece itself."""

    def chosen(parts: Column) -> Column:
        return F.when((F.size(parts) > 1) & F.forall(parts, lambda p: word_count(p) >= least), parts).otherwise(F.array(c))

    return let(F.split(c, r"(?i)\s+and\s+"), chosen)


def clauses(c: Column | str, contrast: Sequence[str], min_words: int = 2, keep_short: bool = False, not_opinion: Sequence[str] = (), and_words: int = 0) -> Column:
    """The clauses of an answer in their order; an answer without one is its own clause."""
    pattern = contrast_pattern(contrast)

    def of_parts(parts: Column) -> Column:
        several = F.size(parts) > 1
        pieces = F.flatten(F.transform(parts, lambda p: cut_at_and(p, and_words))) if and_words else parts

        def keep(p: Column) -> Column:
            ok = word_count(p) >= min_words
            if keep_short:
                ok |= several & F.rlike(p, F.lit(r"^(?U)\p{Alpha}{3,}$")) & ~F.lower(p).isin([w.lower() for w in not_opinion])
            return ok

        return let(F.transform(pieces, trim_clause), lambda trimmed: F.filter(trimmed, keep))

    of_sentences = F.flatten(F.transform(sentences(c), lambda s: let(F.split(s, pattern), of_parts)))
    return let(of_sentences, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(col(c))))


# -- negation and valence -------------------------------------------------


def scan(c: Column | str) -> Column:
    """array<struct(word, negated)>: a word is negated by a negator up to three tokens before it.

    Punctuation and conjunctions in between end the reach; a negator right before
    "doubt" or "only" does not negate.
    """

    def negates(t: Column, i: Column) -> Column:
        stops = [*PUNCTUATION, *REACH_ENDS]
        blocked = F.lit(False)
        hit = F.lit(False)
        for back in range(1, REACH + 1):
            before = F.when(i >= back, F.get(t, i - back))
            ends = F.coalesce(before.isin(stops), F.lit(True))
            negator = F.coalesce(before.isin(list(NEGATORS)) | before.endswith("n't"), F.lit(False))
            here = ~blocked & ~ends & negator & ~F.get(t, i - back + 1).isin(list(CANCELS))
            blocked = blocked | ends | here
            hit = hit | here
        return hit

    def words(t: Column) -> Column:
        both = F.transform(t, lambda w, i: F.struct(w.alias("word"), negates(t, i).alias("negated")))
        return F.filter(both, lambda s: ~s["word"].isin(list(PUNCTUATION)))

    return let(tokens(c), words)


def valence_map(words: dict[str, int]) -> Column:
    """Literal map of words to +1 or -1, a table of theme-independent opinion words (bounded by the caller)."""
    pairs = [F.lit(x) for w, v in sorted(words.items()) for x in (w, v)]
    return F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))


def word_valence(word: Column, known: Column) -> Column:
    """A word's sign, else that of the word it is formed from."""
    out = known[word]
    for suffix in SUFFIXES:
        out = F.coalesce(out, F.when(word.endswith(suffix), known[F.substring(word, F.lit(1), F.length(word) - len(suffix))]))
    return F.coalesce(out, F.lit(0))


def lexical_flags(c: Column | str, known: Column) -> Column:
    """struct(plain_pos, plain_neg, flip_pos, flip_neg); flip_pos is a negated negative word."""
    signed = F.transform(scan(c), lambda s: F.struct(s["negated"].alias("negated"), word_valence(s["word"], known).alias("sign")))

    def flags(v: Column) -> Column:
        def has(negated: bool, sign: int) -> Column:
            return F.exists(v, lambda s: (s["negated"] == negated) & (s["sign"] == sign))

        return F.struct(has(False, 1).alias("plain_pos"), has(False, -1).alias("plain_neg"), has(True, -1).alias("flip_pos"), has(True, 1).alias("flip_neg"))

    return let(signed, flags)


def evaluative(flags: Column) -> tuple[Column, Column]:
    return flags["plain_pos"] | flags["flip_pos"], flags["plain_neg"] | flags["flip_neg"]


def says_any(c: Column | str, patterns: Sequence[str]) -> Column:
    """Whether a text matches one of the patterns; curly apostrophes count as straight ones."""
    if not patterns:
        return F.lit(False)
    return F.rlike(F.replace(F.coalesce(col(c), F.lit("")), F.lit("’"), F.lit("'")), F.lit(any_pattern(patterns)))


def lukewarm(c: Column | str, phrases: Sequence[str], known: Column | None = None, blockers: Sequence[str] = ()) -> Column:
    """Only lukewarm: a neutral phrase, and without it nothing evaluative and no blocker."""
    if not phrases:
        return F.lit(False)
    t = F.coalesce(col(c), F.lit(""))
    rest = F.regexp_replace(t, any_pattern(phrases), " ")
    out = F.rlike(t, F.lit(any_pattern(phrases)))
    if known is not None:
        pos, neg = evaluative(lexical_flags(rest, known))
        out &= ~(pos | neg)
    return out & ~F.rlike(rest, F.lit(any_pattern(blockers))) if blockers else out


def is_firm(c: Column | str, min_words: int = 4) -> Column:
    """Long enough to be an opinion of its own, and with a shortfall in it or without a hedge."""

    def firm(words: Column) -> Column:
        shortfall = F.exists(words, lambda w: w.isin(list(SHORTFALLS)) | w.endswith("n't"))
        hedge = F.exists(words, lambda w: w.isin(list(HEDGES)))
        return (F.size(words) >= min_words) & (shortfall | ~hedge)

    return let(F.filter(tokens(c), lambda w: ~w.isin(list(PUNCTUATION))), firm)


# -- spelling -------------------------------------------------------------


def like_case(source: Column, new: Column) -> Column:
    """The new word in the old one's case: upper, capitalised or as it is."""
    upper = (F.upper(source) == source) & (F.lower(source) != source) & (F.length(source) > 1)
    first = F.substring(source, 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    titled = F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))
    return F.when(upper, F.upper(new)).when(capital, titled).otherwise(new)


def spelling_twins(word: Column) -> Column:
    """The same word as it is spelt across the Atlantic."""
    return F.array(
        F.replace(word, F.lit("our"), F.lit("or")),
        F.regexp_replace(word, "is(?=e|ed|es|ing|ation)", "iz"),
        F.regexp_replace(word, "(?<=[aeiou])ll(?=ing|ed)", "l"),
        F.replace(word, F.lit("tre"), F.lit("ter")),
    )


def fold_plural(word: Column, longer_than: int = 3) -> Column:
    return F.when((F.length(word) > longer_than) & word.endswith("s") & ~word.endswith("ss"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
