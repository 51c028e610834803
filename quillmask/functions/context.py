"""Context words: lift the score of a match that follows a telling word."""

from __future__ import annotations

from quillmask.catalogue import CONTEXT_WORDS_BEFORE, WORD
from quillmask.functions.spans import NEAR
from quillmask.functions.sql import let, regex, text as text_literal

_FAR = 4000


def telling_words(text: str, stopwords) -> str:
    """Lower-case word tokens that are no stopwords."""
    whole, quick = (f"regexp_extract_all(lw, {regex(w)}, 0)" for w in (WORD, "[a-z0-9_]+"))
    words = let("lw", f"lower({text})", f"if(octet_length(lw) = length(lw), {quick}, {whole})")
    if not stopwords:
        return words
    return f"filter({words}, v -> v not in ({', '.join(map(text_literal, stopwords))}))"


def lemmas_of(word: str, lemmas) -> str:
    """The lemmas of a word: one hashed test of its forms for each lemma that can lift."""
    cases = [f"if({word} in ({', '.join(map(text_literal, forms))}), {text_literal(lemma)}, null)" for lemma, forms in lemmas]
    return f"filter(array({', '.join(cases)}), l -> l is not null)"


def context_of(text: str, match: str, stopwords, lemmas=()) -> str:
    """The words that can lift a match, joined by blanks.

    These are the last five words before the match that are no stopwords, plus
    the match's own first run of non-blanks, punctuation included. Nearly always the ``lead`` characters hold
    enough words; if not, a longer and finally the whole prefix is read. A
    window cut inside a word is only trusted when it holds one word more than
    needed. ``lemmas`` (lemma, forms) add the lemmas of the words before the match.
    """
    enough = CONTEXT_WORDS_BEFORE + 1
    window = f"substring({text}, greatest({match}.start - {_FAR}, 0) + 1, least({match}.start, {_FAR}))"
    whole = telling_words(f"substring({text}, 1, {match}.start)", stopwords)
    far = let(
        "w2",
        telling_words(window, stopwords),
        f"if(size(w2) >= {enough} or {match}.start <= {_FAR}, w2, {whole})",
    )
    before = let(
        "w1",
        telling_words(f"{match}.lead", stopwords),
        f"if(size(w1) >= {enough} or {match}.start <= {NEAR}, w1, {far})",
    )
    last = let("w0", before, f"slice(reverse(w0), 1, {CONTEXT_WORDS_BEFORE})")
    if lemmas:
        last = f"flatten(transform({last}, v -> concat(array(v), {lemmas_of('v', lemmas)})))"
    return f"concat_ws(' ', {last}, regexp_extract(lower({match}.text), {regex(chr(92) + "S+")}, 0))"


def has_context(context: str, context_words: str) -> str:
    """True when any context word lies inside any of the joined words."""
    return let("around", context, f"exists({context_words}, w -> contains(around, w))")
