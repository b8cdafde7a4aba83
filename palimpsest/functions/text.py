"""Text functions: tokens, sentences, byte slices, signatures, locations, part-of-speech weights."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
PIECE = rf"{TOKEN}|[^\p{{L}}\p{{N}}_]+"
#: A sentence may start after these, never after a comma.
STOP = r"[.!?…;:\n]+"

# Weights of Penn tags, at strength 1.
TAG_WEIGHTS = {
    "CC": 0.7, "CD": 0.8, "DT": 0.7, "EX": 0.7, "FW": 0.7, "IN": 0.7, "JJ": 0.7, "JJR": 0.7, "JJS": 0.8,
    "LS": 0.7, "MD": 1.2, "NN": 0.8, "NNS": 1.0, "NNP": 0.8, "NNPS": 0.8, "PDT": 0.7, "POS": 0.7, "PRP": 0.7,
    "PRP$": 0.7, "RB": 1.3, "RBR": 1.2, "RBS": 1.0, "RP": 1.2, "SYM": 0.7, "TO": 0.8, "UH": 0.7, "VB": 1.2,
    "VBD": 1.2, "VBG": 1.1, "VBN": 0.8, "VBP": 1.2, "VBZ": 1.2, "WDT": 0.7, "WP": 0.7, "WP$": 0.7, "WRB": 1.3,
}
DETERMINERS = ("the", "a", "an", "this", "that", "der", "die", "das", "le", "la", "les", "un", "une", "el", "los", "las")
# Words that an acronym leaves out.
IGNORED_IN_TITLES = ("THE", "A", "OF", ",", "&", "AND", "OR")


def sentence_array(text: Column) -> Column:
    """The sentences that hold a token."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), STOP), lambda s: s.rlike(TOKEN))


def token_array(sentence: Column) -> Column:
    return F.regexp_extract_all(F.lower(sentence), F.lit(TOKEN), F.lit(0))


#: Characters that Java and Python lower and tell apart alike; what a text of these has for tokens is found in Python.
PLAIN = "\x00-\x7f\xa0-\u012f\u0131-\u017f\u2010-\u2027"
STOPS = re.compile(STOP)
BETWEEN = re.compile(STOP.replace("[", "[^"))
TOKENS = re.compile("[0-9A-Z_a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\u017f]+")


def plain_words(text: str | None) -> list[list[str]]:
    """The tokens of each sentence."""
    found = [TOKENS.findall(s) for s in STOPS.split((text or "").lower())]
    return [x for x in found if x]


def is_plain(text: Column) -> Column:
    return text.rlike(rf"\A[{PLAIN}]*+\z")  # possessive: no class is tried twice at a place


def plain_sentence_texts(text: str) -> list[str]:
    """From the first token of each sentence to the first one of the next, the last to the end."""
    firsts = (TOKENS.search(text, s.start(), s.end()) for s in BETWEEN.finditer(text))
    starts = [m.start() for m in firsts if m]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=bool(starts))]


def byte_slice(text: Column, idx: Column, length: Column) -> Column:
    """Text from a UTF-8 byte offset on."""
    return F.substring(F.encode(text, "utf-8"), idx + 1, length).cast("string")


def universal_pos(token: Column) -> Column:
    """The default tagger: determiners and numbers are told apart, all else is a noun."""
    return F.when(token.isin(*DETERMINERS), "DET").when(token.rlike(r"^\p{N}+$"), "NUM").otherwise("NOUN")


def penn_tag(token: Column) -> Column:
    return F.when(token.isin(*DETERMINERS), "DT").when(token.rlike(r"^\p{N}+$"), "CD").otherwise("NN")


def pos_weight(tag: Column, strength: float) -> Column:
    table = F.create_map(*[F.lit(x) for k, w in TAG_WEIGHTS.items() for x in (k, 1 - strength + strength * w)])
    return F.coalesce(F.try_element_at(table, tag), F.lit(1.0))


def normalised(text: Column) -> Column:
    """Lower case, all that is no letter, digit or underscore as one blank."""
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " ")))


def every_fourth_hex(text: Column, n: int) -> Column:
    """n upper-case hex digits of the sha1, every fourth from the first on."""
    digest = F.sha1(text)
    return F.upper(F.concat(*[F.substring(digest, 4 * k + 1, 1) for k in range(n)]))


def acronym(title: Column, length: int = 4, ignored: tuple[str, ...] = IGNORED_IN_TITLES) -> Column:
    """The first letter of each part, then second letters from the left, third ones, until the length is reached; X pads."""
    parts = F.filter(
        F.split(F.upper(title), " "),
        lambda p: (p != "") & ~p.isin(*ignored) & F.substring(p, 1, 1).rlike(r"^\p{L}$"),
    )
    parts = F.slice(parts, 1, length)  # later ones have no letter in it
    sizes = F.transform(parts, lambda p: F.length(p))

    def taken(p: Column, i: Column) -> Column:
        """The letters of part i: its k-th is taken if fewer than ``length`` letters come before it."""

        def wanted(k: Column) -> Column:
            earlier = F.aggregate(sizes, F.lit(0), lambda a, x: a + F.least(x, k - 1))
            same = F.size(F.filter(sizes, lambda x, j: (j < i) & (x >= k)))
            return (k <= F.length(p)) & ((k == 1) | (earlier + same < length))

        return F.substr(p, F.lit(1), F.size(F.filter(F.sequence(F.lit(1), F.lit(length)), wanted)))

    return F.rpad(F.array_join(F.transform(parts, taken), ""), length, "X")


def document_signature(author: Column, title: Column, text: Column) -> Column:
    last = F.element_at(F.split(F.upper(author), " "), -1)
    key = F.concat_ws(":", author, title, text)
    return F.concat_ws("-", F.substring(last, 1, 4), acronym(title), every_fourth_hex(key, 10))


def sentence_signature(sentence: Column, number: Column) -> Column:
    """number is 0-based."""
    return F.concat_ws("-", acronym(sentence, 6, ()), F.format_string("%06d", number + 1), every_fourth_hex(sentence, 6))


# Act numerals.
NUMERALS = ("I", "II", "III", "IV", "V", "VI", "VII")


def location(book: Column, chapter: Column, speaker: Column, paragraph: Column, compat: bool = True) -> Column:
    """Where a sentence stands. With compat, acts are numbered as the original does: act 1 reads II."""
    at = book + (1 if compat else 0)
    act = F.coalesce(F.get(F.array(*[F.lit(x) for x in NUMERALS]), at - 1), at.cast("string"))
    play = F.when(book < 0, F.format_string("line %d", paragraph)).otherwise(
        F.concat(act, F.lit("."), chapter.cast("string"), F.format_string(", line %d", paragraph))
    )
    par = F.format_string("par. %d", paragraph)
    novel = F.when(book < 0, F.format_string("Chapter %d, par. %d", chapter, paragraph)).otherwise(
        F.format_string("Book %d, Chapter %d, par. %d", book, chapter, paragraph)
    )
    return F.when(speaker > 0, play).when(chapter > 0, novel).otherwise(par)


def gap_penalty(n: Column, cutoff: int, longest: Column) -> Column:
    """What skipping n tokens costs; as many as the document's longest sentence cannot be skipped."""
    if cutoff < 0:
        cost = F.lit(0.0)
    elif cutoff == 0:
        cost = F.lit(1.0)
    else:
        cost = F.least(F.lit(1.0), 1 - F.pow(F.lit(2.0), -n / cutoff))
    return F.when(n >= longest, 1e10).otherwise(cost)


def penalised(score: Column, n: Column, cutoff: int, longest: Column) -> Column:
    """A score less the share that n skipped tokens cost, 0 at least."""
    return score * F.greatest(F.lit(0.0), 1 - gap_penalty(n, cutoff, longest))
