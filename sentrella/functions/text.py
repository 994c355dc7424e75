"""Text normalisers. Every function maps columns to columns.

The replacement chains test one combined pattern first: where no wrong form occurs, none of
the hundred replacements can apply, and the chain isn't entered.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sentrella.functions import fixed
from sentrella.functions.dialect import any_of, any_whole, java, literal, needed_all, whole



def _unchanged() -> str:
    """A pattern of texts that Unicode composition leaves alone: ASCII, and characters of common
    scripts that stay as they are and take no mark from a neighbour."""
    spans: list[list[int]] = []
    for first, last in ((0xA0, 0x24F), (0x370, 0x52F), (0x620, 0x6D3), (0x2010, 0x20BF), (0x3001, 0x30FF), (0x4E00, 0x9FFF)):
        for n in range(first, last + 1):
            c = chr(n)
            if unicodedata.category(c)[0] in "LNPS" and unicodedata.normalize("NFKC", c) == c:
                if spans and spans[-1][1] == n - 1:
                    spans[-1][1] = n
                else:
                    spans.append([n, n])
    return "\\A(?:[\\x00-\\x7F]++|[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]++)*+\\z"


UNCHANGED = _unchanged()
SPACES = java(r"\s+")


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition. Texts that it leaves alone stay in the JVM, and Python
    gets a null in their place."""
    return F.coalesce(_nfkc(F.when(~text.rlike(UNCHANGED), text)), text)


def seen(asked: list[tuple[Column, list[list[str]]]]) -> Column:
    """Bits of a long, in the order of the lists: whether any word of a list occurs in its text.

    Arrow searches a text for hundreds of words in one pass (its patterns are automata), where the JVM
    tries them one by one; for long texts that is worth the way to Python and back."""
    plain = lambda w: "".join(literal(c) if c.isascii() else c for c in w)
    lists = [(i, "|".join(map(plain, words))) for i, (_, of) in enumerate(asked) for words in of]
    assert len(lists) < 63

    @F.arrow_udf("long")
    def bits(texts: pa.Array) -> pa.Array:
        each = texts.flatten()
        found = np.zeros(len(texts), dtype=np.int64)
        for k, (i, words) in enumerate(lists):
            found |= pc.match_substring_regex(each[i], words).fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64) << k
        return pa.array(found)

    return bits(F.struct(*[text.alias(f"t{i}") for i, (text, _) in enumerate(asked)]))


def bit(bits: Column, k: int) -> Column:
    return bits.bitwiseAND(F.lit(1 << k).cast("long")) != 0


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def leet(text: Column) -> Column:
    return F.translate(F.lower(text), fixed.LEET_FROM, fixed.LEET_TO)


def basic(composed: Column) -> Column:
    """The prompt normaliser's first step, over NFKC text."""
    t = leet(composed)
    t = F.translate(t, "“”‘’‐‑‒–—―", "\"\"''------")
    t = F.regexp_replace(t, r"[_/\\]+", " ")
    return squeeze(F.regexp_replace(t, java(r"[^\w\s'\"-]"), " "))


def _chain(text: Column, pairs: list[tuple[str, str]], may: Column | None = None) -> Column:
    """``may`` tells whether a wrong form may occur, where that is known."""
    changed = reduce(lambda t, p: F.regexp_replace(t, whole(p[0]), p[1]), pairs, text)
    wrong = [a for a, _ in pairs]
    here = text.rlike(any_of(wrong)) & text.rlike(any_whole(wrong))
    return F.when(here if may is None else may & here, changed).otherwise(text)


def _log(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Which replacements applied, each tested on the text as its predecessors left it."""
    kind = "array<struct<from:string,to:string>>"
    steps = F.array(*[F.struct(F.lit(whole(a)).alias("p"), F.lit(a).alias("from"), F.lit(b).alias("to")) for a, b in pairs])
    none = F.array().cast(kind)

    def step(acc: Column, s: Column) -> Column:
        hit = F.regexp(acc["text"], s["p"])
        more = F.when(hit, F.array(F.struct(s["from"].alias("from"), s["to"].alias("to"))).cast(kind)).otherwise(none)
        return F.struct(F.regexp_replace(acc["text"], s["p"], s["to"]).alias("text"), F.concat(acc["log"], more).alias("log"))

    done = F.aggregate(steps, F.struct(text.alias("text"), none.alias("log")), step, lambda acc: acc["log"])
    return F.when(text.rlike(any_whole([a for a, _ in pairs])), done).otherwise(none)


def typos(text: Column, may: Column | None = None) -> Column:
    return _chain(text, fixed.TYPOS, may)


def phrases(text: Column, may: Column | None = None) -> Column:
    return _chain(text, fixed.PHRASES, may)


def grammar(text: Column, may: Column | None = None) -> Column:
    return _chain(text, list(fixed.GRAMMAR), may)


def typo_log(text: Column) -> Column:
    return _log(text, fixed.TYPOS)


def phrase_log(text: Column) -> Column:
    return _log(text, fixed.PHRASES)


def compact(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, "")


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def where_needed(text: Column, lowered: Column, pattern: str) -> Column:
    """Whether a pattern occurs in a text, tried only where its lower-cased form holds the words
    that every match holds, which a text search settles far sooner."""
    return reduce(lambda a, b: a & b, [*[contains_any(lowered, words) for words in needed_all(pattern)], text.rlike(java(pattern))])


def hits(named: list[tuple[str, Column]]) -> Column:
    """The names whose conditions hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named]), lambda x: x.isNotNull())


def language_hints(raw: Column, corrected: Column) -> Column:
    both = F.concat(F.lower(raw), F.lit(" "), corrected)
    return F.array_sort(hits([(lang, contains_any(both, words)) for lang, words in fixed.LANGUAGE_TERMS.items()]))


def policy_text(composed: Column) -> Column:
    """The policy rules' own normaliser (before its replacements)."""
    t = F.regexp_replace(leet(composed), r"[_\-/\\]+", " ")
    return squeeze(F.regexp_replace(t, java("[^\\w\\s\\x{FFFF}'-]"), " "))


def policy_expanded(text: Column, may: Column | None = None) -> Column:
    """Plain substring replacements, in order, also inside words."""
    pairs = fixed.POLICY_TYPOS
    changed = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)
    return F.when(text.rlike(any_of([a for a, _ in pairs])) if may is None else may, changed).otherwise(text)


def plain(text: Column) -> Column:
    """The normaliser of hashes and of structures."""
    return squeeze(F.lower(F.coalesce(text, F.lit(""))))


def skeleton(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), java(r"\d+"), " # ")
    return squeeze(F.regexp_replace(t, java(r"[^a-z0-9\s]+"), " "))


STRUCTURE = (
    (java(r"https?://\S+|www\.\S+"), "<url>"),
    (java(r"(?i)\b[\w.+-]+@[\w.-]+\.[a-z]{2,}\b"), "<email>"),
    (java(r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"), "<id>"),
    (java(r"(?i)\b[0-9a-f]{16,}\b"), "<hash>"),
    ("(?d)(['\"])(?:(?=(\\\\?))\\2.)*?\\1", "<quote>"),
    (java(r"\b\d+(?:\.\d+)?\b"), "<num>"),
)


def structure(text: Column) -> Column:
    t = reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), STRUCTURE, plain(text))
    tokens = F.regexp_extract_all(t, F.lit(r"[a-z0-9_<>']+"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda x: F.when((F.length(x) >= 24) & x.rlike("[0-9]"), "<id>").otherwise(x)), " ")


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java(r"\d+")), F.lit(0)), lambda x: x.cast("double"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(plain(text), F.lit(r"[a-z0-9_']+"), F.lit(0))


def character_grams(text: Column, size: int = 4) -> Column:
    t = F.replace(plain(text), F.lit(" "), F.lit("_"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (size - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(size)))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(grams)


def title(text: Column) -> Column:
    return F.initcap(F.regexp_replace(text, "[_-]+", " "))


def iso(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")
