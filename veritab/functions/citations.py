"""Citations of laws and standards in texts, incomplete references, and numbers without a source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions.privacy import masked
from veritab.functions.spans import blanked, found, in_turn, let

#: How laws, standards and the technical rules are cited, in the order in which they win.
CITED = (
    r"(?iu)\b(?:Decreto(?:\s+de)?[\s\-\u2010-\u2014]*Lei|DL|Portaria|Despacho(?:\s+Normativo)?|Lei|Decreto Regulamentar)\s*(?:n\.?\s*[º°o]?\s*)?\d+(?:-[A-Z])?/\d{2,4}",
    r"\b(?:NP\s+)?(?:EN|IEC|CEI|HD|ISO)\s?\d{2,3}(?:\s?\d{3})?(?:-\d+)*\b",
    r"(?i)\bRTIEBT\b",
)
#: A section or article of the technical rules without its number.
INCOMPLETE = r"(?iu)\b(?:sec[çc](?:[ãa]o|[õo]es)|artigos?)\s+d[aeo]s?\s+(?:RTIEBT|Regras\s+T[ée]cnicas)"
PLACEHOLDER = r"\{\{v:[a-z0-9_.]+\}\}"
#: Numbers that a text may hold, in the order in which they are taken out.
ALLOWED = (
    r"(?iu)\b(?:decreto-lei|portaria|despacho|lei|dl)\s*(?:n\.?º\s*)?\d+(?:-[A-Z])?/\d{4}",
    r"(?i)\b\d+(?:-[A-Z])?/\d{4}\b",
    r"(?i)\b(?:NP\s+)?(?:EN|IEC|HD|ISO|NP)\s*\d[\d ]*(?:[-.:]\d+)*",
    r"(?iu)\b(?:sec[çc](?:ão|ões|ao|oes)|art(?:igo|igos|\.º|\.)?|quadro|tabela|anexo|ponto|cap[íi]tulo|n\.º)\s*\d+(?:[.\-]\d+)*(?:\.?º)?(?:\s*(?:,|e|a)\s*\d+(?:[.\-]\d+)*(?:\.?º)?)*",
    r"\b[A-Za-z]+\d+[A-Za-z0-9.,()\-]*",
    r"(?i)\b\d+\s*A\s*(?:-|a)\s*\d+\s*V\b",
    r"(?i)\b230\s*/\s*400\s*V\b",
    r"(?i)\b(?:230|400)\s*V\b",
)


def citations(text: Column) -> Column:
    """(start, stop, text) of all citations; a pattern does not take what an earlier one has taken."""
    return in_turn(*[found(text, p) for p in CITED])


def incomplete(text: Column) -> Column:
    return found(text, INCOMPLETE)


def stray_numbers(text: Column, around: int = 30) -> Column:
    """What stands around each number that begins outside placeholders and allowed forms, personal data masked."""

    def outside(bare: Column) -> Column:
        allowed = F.concat(*[found(bare, p) for p in ALLOWED])
        both = F.struct(allowed.alias("a"), found(bare, r"\d+(?:[.,]\d+)*").alias("n"))
        return let(both, lambda x: F.filter(x["n"], lambda n: ~F.exists(x["a"], lambda s: (s["start"] <= n["start"]) & (n["start"] < s["stop"]))))

    def shown(s: Column) -> Column:
        left, right = F.greatest(F.lit(0), s["start"] - around), F.least(F.length(text), s["stop"] + around)
        return F.trim(text.substr(left + 1, right - left))

    return F.transform(F.transform(let(blanked(text, PLACEHOLDER), outside), shown), lambda t: masked(t))


def first_code(citation: Column, corpus: list[tuple[str, str]]) -> Column:
    """The code of the first pattern of ``corpus`` (code, pattern) that a folded citation fits; null if none."""
    return F.coalesce(*[F.when(citation.rlike(p), F.lit(c)) for c, p in corpus])
