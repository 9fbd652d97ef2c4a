"""Text folds, names and labels."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions import numbers
from veritab.functions.spans import let


def _bare(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()


def folded_value(s: str) -> str:
    """:func:`fold` of one value."""
    return " ".join(_bare(s).split())


#: Latin letters whose folded form is one character, by rule; texts of these, ASCII and some signs need no Python.
LATIN = [c for c in map(chr, range(0xC0, 0x250)) if len(_bare(c)) == 1]
UNFOLDED = "".join(map(chr, range(65, 91))) + "".join(LATIN)
FOLDED = "".join(map(_bare, UNFOLDED))
KEPT = "\t\n\x0b\x0c\r" + "".join(map(chr, range(0x20, 0x7F))) + "–—‘’“”•€" + "".join(LATIN)


@F.pandas_udf(T.StringType())
def _fold_any(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else " ".join(_bare(s).split()))


def is_ascii(x: Column) -> Column:
    """Whether all characters have one byte."""
    return F.length(x) == F.octet_length(x)


def fold_ascii(x: Column) -> Column:
    """:func:`fold` of texts of ASCII; Python's white space has four more characters than Java's."""
    return F.trim(F.regexp_replace(F.lower(x), r"[\s\x1c-\x1f]+", " "))


def fold(x: Column) -> Column:
    """NFKD without combining marks, casefolded, blanks collapsed and trimmed; null stays null.

    Texts of ASCII, Latin letters and common signs are folded by built-in functions; only others go through Python.
    """
    plain = lambda v: F.when(is_ascii(v), fold_ascii(v)).when(F.translate(v, KEPT, "") == "", F.trim(F.regexp_replace(F.translate(v, UNFOLDED, FOLDED), r"\s+", " ")))
    odd = lambda v: F.when(~is_ascii(v) & (F.translate(v, KEPT, "") != ""), v)
    return F.coalesce(let(x, plain), _fold_any(let(x, odd)))  # x is worked out once for the fold


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_all(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else [None if s is None else folded_value(s) for s in json.loads(v)])


def fold_each(x: Column) -> Column:
    """:func:`fold` of each text of an array. Arrays go through Python as JSON: nulls among arrays make Arrow's writer slow."""
    plain = F.transform(x, lambda s: F.when(is_ascii(s), fold_ascii(s)).otherwise(F.trim(F.regexp_replace(F.translate(s, UNFOLDED, FOLDED), r"\s+", " "))))
    odd = F.exists(x, lambda s: s.isNotNull() & ~is_ascii(s) & (F.translate(s, KEPT, "") != ""))
    return F.when(~odd, plain).otherwise(_fold_all(F.when(odd, F.to_json(x))))


def folded_text(x: Column) -> Column:
    """:func:`fold` without closing punctuation at either end."""
    return F.regexp_replace(fold(x), r"^[ .,;:\-–—]+|[ .,;:\-–—]+$", "")


def word_text(x: Column) -> Column:
    """:func:`fold` with every run of other characters than a-z and 0-9 as one blank, trimmed."""
    return words_of(fold(x))


def words_of(folded: Column) -> Column:
    """:func:`word_text` of a text that is folded."""
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def slug(x: Column) -> Column:
    got = F.regexp_replace(F.regexp_replace(fold(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(got, F.lit("")), F.lit("sem_titulo"))


#: Names of the supply entry and of the main board.
ENTRY = ("PORT", "PORTINHOLA", "ARM", "ARMARIO", "CP", "CAIXAPORTINHOLA")
MAIN = ("QE", "QEG", "QGBT", "QG")


def unprefixed(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)^\s*quadro\s+", "")


def core(name: Column) -> Column:
    """Upper-case letters and digits of a board's name without accents and prefix; the entry and the main board by one name each."""
    return core_of(fold(unprefixed(name)))


def core_of(folded: Column) -> Column:
    """:func:`core` of a name that is folded, its prefix gone before."""
    named = lambda b: F.when(b.isin(*ENTRY), "PORTINHOLA").when(b.isin(*MAIN), "QEG").otherwise(F.regexp_replace(b, "^QP?(?=[0-9A-Z])", ""))
    return let(F.regexp_replace(F.upper(folded), "[^0-9A-Z]", ""), named)


def same_board(a: Column, b: Column) -> Column:
    return core(a) == core(b)


def match_score(a: Column, b: Column) -> Column:
    """2 for equal cores, 1 if one begins with the other, else 0; empty cores match nothing."""
    blank = (a == "") | (b == "")
    return F.when(blank, 0).when(a == b, 2).when(a.startswith(b) | b.startswith(a), 1).otherwise(0)


def letters(n: Column, most: int = 13) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA: bijective base 26, up to ``most`` letters (13 hold every long)."""
    start = F.struct(F.lit("").alias("out"), (n.cast("long") + 1).alias("rest"))

    def step(acc: Column, _: Column) -> Column:
        k = acc["rest"] - 1
        go = F.struct(F.concat(F.chr(65 + k % 26), acc["out"]).alias("out"), F.floor(k / 26).cast("long").alias("rest"))
        return F.when(acc["rest"] > 0, go).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["out"]


def next_label(label: Column) -> Column:
    """The label after another as revisions are named: the last letter moves on, and Z gets an A behind it.

    ZA is followed by B, so labels may meet again: :func:`letters` is the sound sequence.
    """
    last = F.substring(label, -1, 1)
    return F.when(last < "Z", F.chr(F.ascii(last) + 1)).otherwise(F.concat(label, F.lit("A")))


LINKING = ("de", "da", "do", "das", "dos", "e")


def word_list(words: Column, stop: tuple[str, ...] = LINKING) -> Column:
    """The words of a word text but those of ``stop``, each once."""
    return F.array_except(F.filter(F.split(words, " "), lambda w: w != ""), F.array(*[F.lit(w) for w in stop]))


def same_words(a: Column, b: Column, stop: tuple[str, ...] = LINKING, least: int = 5) -> Column:
    """Equal word texts, or one a shorter form of the other: its words are all in the other, one of them long enough."""
    return (a == b) | shorter_form(word_list(a, stop), word_list(b, stop), least)


def shorter_form(x: Column, y: Column, least: int = 5) -> Column:
    """Whether the words of one list are all in the other, one of them long enough."""
    inside = lambda short, long: F.exists(short, lambda w: F.length(w) >= least) & (F.size(F.array_except(short, long)) == 0)
    return F.when(F.size(x) <= F.size(y), inside(x, y)).otherwise(inside(y, x))


def entity(folded: Column) -> Column:
    """One name for a municipality and its chamber."""
    return F.regexp_replace(folded, r"^(?:a\s+)?camara municipal d[eoa]\s+", "municipio de ")


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


#: Stop words by language, in the order in which ties are decided.
STOP_WORDS = {
    "en": ("the", "and", "of", "to", "in"),
    "de": ("der", "die", "und", "den", "von"),
    "fr": ("les", "des", "et", "la", "un"),
    "es": ("el", "los", "que", "de", "y"),
}


def language(text: Column, least: int = 3) -> Column:
    """Language with the most stop words, at least ``least``; ties go to the first of STOP_WORDS."""
    words = F.split(F.lower(text), "[^a-z]+")
    hits = {k: F.size(F.filter(words, _one_of(v))) for k, v in STOP_WORDS.items()}
    best = F.greatest(*hits.values())
    out = F.when(best < least, None)
    for k, h in hits.items():
        out = out.when(h == best, k)
    return out


def _one_of(v: tuple[str, ...]):
    return lambda w: w.isin(*v)


@F.pandas_udf(T.StringType())
def fold_in_place(x: pd.Series) -> pd.Series:
    """Lower case without accents, one character for each of the text, so that places stay valid."""

    def one(s: str | None) -> str | None:
        return None if s is None else "".join(unicodedata.normalize("NFKD", c)[0].lower() for c in s)

    return x.map(one)


def comparable(kind: Column, value: Column) -> Column:
    """The form in which two sources are compared: numbers as numbers, boards by their cores, public bodies by one name, supplies as three-phase or single-phase, other texts folded."""
    folded = fold(value)
    number = numbers.ingest_number(value)
    phase = F.when(folded.startswith("tri"), "trif").when(folded.startswith("mon"), "mono").otherwise(folded)
    return F.when((kind == "number") & number.isNotNull(), number.cast("string")).when(kind == "board", core(value)).when(kind == "entity", entity(folded)).when(kind == "phase", phase).otherwise(folded)


#: Steps of screens, and the steps that become corrections after a first review.
STEPS = {"ficheiros": "dados", "ficha": "ficha", "documentos": "mdj", "validacao": "verificacao", "equipamentos": "verificacao", "revisao": "conjunto"}
EDITING = ("ficha", "mdj", "cte", "formularios")


def work_step(screen: Column, hint: Column, reviewed: Column) -> Column:
    """The step of a screen; null for screens outside a project. The hint only tells which part of the editor is used."""
    known = F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv])
    step = F.when((screen == "documentos") & hint.isin("mdj", "cte", "formularios"), hint).otherwise(F.try_element_at(known, screen))
    return F.when(reviewed & step.isin(*EDITING), "correcoes").otherwise(step)


def luminaire_codes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(?:L\d+(?:\.\d+)?|SNC)"), F.lit(0)), F.upper)


def luminaire_type(code: Column) -> Column:
    """The type that a code is a variant of."""
    return F.regexp_replace(F.upper(code), r"\.\d+$", "")


def first_keyword(key: Column, table: list[tuple[str, str]]) -> Column:
    """The category of the first keyword that the last part of a dotted key holds; null if none."""
    tail = F.element_at(F.split(key, r"\."), -1)
    return F.coalesce(*[F.when(tail.contains(k), F.lit(c)) for k, c in table])
